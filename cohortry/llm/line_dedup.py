"""Line dedup: drop lines whose normalised form many documents hold. DataFrame functions only.

Plan: explode the hash and position of every line, count rows a hash (with partial counts, so that a line found
everywhere costs one row a task), and keep the hits: rows whose hash passes that first, looser count. Of the hits alone distinct
documents are counted, dealt by hash and document together. The positions to drop are gathered for each row of the
input, which its id and text name, and the text meets them once. Nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Written, ascii_lower, packed, with_outputs


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(lines: Column, min_chars: int) -> Column:
    """A 64-bit hash per line; null for lines whose key is too short."""
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(ASCII_SPACE))))
    return F.transform(keys, lambda k: F.when(F.length(k) >= max(1, min_chars), F.xxhash64(k)))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` without those at the sorted positions ``drop`` (from 0): the slices between them, put together."""
    after = F.concat(F.array(F.lit(-1)), drop)
    until = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(after, until, lambda a, z: F.slice(lines, a + 2, z - a - 1)))


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All columns of ``docs``, and ``kept_text``, ``n_lines``, ``n_dropped`` (replacing columns of these names).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points (1 or more) held by at least ``min_docs`` documents lose all their lines in every row. Rows of one id are one
    document, however often they repeat and whatever their texts. Rows with a null id count as no document, but
    lose the lines of others as any row does. A null text is one empty line, and its ``kept_text`` is empty; so is that of a text
    all of whose lines go. Lines that tie at the threshold all go. Very long texts are read whole, in time that grows with their
    length; input columns may have any names. An empty table gives an empty one. Keys are told apart by 64-bit
    hashes: a rare line is lost in error with probability (frequent keys)/2^64.
    """
    text, key = F.col("row").getField(text_col), F.col("row").getField(id_col)
    rows = docs.select(packed(docs).alias("row")).withColumns({"k1": F.xxhash64(key, text), "k2": F.hash(text, key)})
    lines = _lines(text)
    held = rows.select("k1", "k2", key.alias("id"), F.posexplode(_hashes(lines, min_chars)).alias("at", "h")).where("h is not null")
    held = Written(held, "lines")
    # each table below is written, so that a join is of two plain exchanges, which can be split at a line that is everywhere
    many = Written(held.df.groupBy("h").count().where(F.col("count") >= min_docs).select("h"), "many")
    hits = Written(held.df.join(many.df, "h"), "hits")
    owners = hits.df.where("id is not null").select("h", "id").distinct()
    common = Written(owners.groupBy("h").count().where(F.col("count") >= min_docs).select("h"), "common")
    drops = Written(hits.df.join(common.df, "h").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("drop")), "drops")
    # one array of positions a row, in all at most a number a line: a part of the text that it is joined to
    joined = rows.join(drops.df.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "drop", F.when(F.col("drop").isNotNull(), lines).alias("lines"))
    for old in (held, many, hits, common):
        old.drop()
    # only texts that lose a line are taken apart
    whole = F.coalesce(text, F.lit(""))
    kept = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join(_without(F.col("lines"), F.col("drop")), "\n"))
    dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    n = F.when(F.col("drop").isNull(), F.octet_length(whole) - F.octet_length(F.translate(whole, "\n", "")) + 1).otherwise(F.size("lines"))
    outputs = {"kept_text": kept, "n_lines": n.cast("long"), "n_dropped": dropped.cast("long")}
    return joined.select(*with_outputs(docs, "row", outputs))
