"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import table

from .alignment import ByteSide, PieceSide, align
from .bytelevel import ByteLevel, vocabulary
from .collocations import collocations
from .cover_tree import embedding_links
from .licenses import license_scan
from .line_dedup import drop_common_lines
from .mixing import mix
from .ngram_join import ngram_classes
from .packing import pack
from .pieces import PieceTable, encode
from .pii import KINDS as PII_KINDS
from .pii import pii_scan
from .quality import UNSPACED, quality_cascade
from .secrets import secret_scan
from .sharding import kd_shards


#: The piece table of the tokenizing queries; another model may be named in the environment.
PIECE_MODEL = os.environ.get("COHORTRY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def piece_table(path: str | None = None) -> PieceTable:
    return PieceTable.load(path or PIECE_MODEL)


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    docs, pieces = table(spark, sf_dir, "documents"), piece_table()
    return encode(docs, pieces, check=True)


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan(table(spark, sf_dir, "documents"))
    start = F.transform("base", lambda x: x["start"])
    base = F.transform("base", lambda x: x["label"])
    labels = F.transform("found", lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, labels)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_common_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii_scan(table(spark, sf_dir, "documents"))
    both = F.concat("base", "added")
    rank = F.array(*[F.lit(k) for k in PII_KINDS])
    keyed = F.array_sort(F.transform(both, lambda x: F.struct(F.array_position(rank, x["kind"]).alias("r"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return got.select("doc_id", *[_of_kind("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(keyed).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan(table(spark, sf_dir, "documents"))
    rank = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")])
    keyed = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("r"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return got.select("doc_id", *[_of_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(keyed).alias("spans"))


def op11_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"), ByteLevel.load(vocabulary("byte_bpe_50k.json")), capacity=2048, end_id=1)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ByteSide(ByteLevel.load(vocabulary("byte_bpe_50k.json"))), PieceSide.load(PIECE_MODEL)
    return align(table(spark, sf_dir, "documents"), a, b)


QUERIES = {f.__name__: f for f in (op1_kd_shards, op2_quality_rules, op3_sentencepiece, op4_cover_tree, op5_license_scan, op6_mixing, op7_ngram_jaccard, op8_line_dedup, op9_pii, op10_secrets, op11_bin_slack_packing, op12_collocations, op13_token_alignment)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOWER.format(r"trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

_SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_WORDS = _SPLIT.format("text")
_CLASSES = """reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
first AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)"""


def _raking(rounds: int = 30, power: float = 0.7) -> str:
    """Cells, goals, and one common table for each step of the fitting; the last is named ``raked``."""
    dims = ("source", "lang", "topic")
    out = ["cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass, sum(tokens)::DOUBLE AS raked FROM d GROUP BY 1, 2, 3)"]
    out += [f"goal_{k} AS (SELECT {k}, pow(sum(mass), {power}) / sum(pow(sum(mass), {power})) OVER () AS share FROM cells GROUP BY 1)" for k in dims]
    last = "cells"
    for i in range(rounds * 3):
        k = dims[i % 3]
        out.append(f"r{i} AS MATERIALIZED (SELECT source, lang, topic, mass, CASE WHEN sum(raked) OVER (PARTITION BY {k}) > 0 THEN raked * (share * (SELECT sum(mass) FROM cells) / sum(raked) OVER (PARTITION BY {k})) ELSE 0 END AS raked FROM {last} JOIN goal_{k} USING ({k}))")
        last = f"r{i}"
    return ",\n".join(out) + f",\nraked AS (SELECT *, CASE WHEN mass > 0 THEN raked / mass ELSE 1.0 END AS rate FROM {last})"


ORACLES = {
    "op2_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS} AS ws FROM t),
ls AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS dots, count(*) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) AS bullets FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
g AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM g WHERE z IS NOT NULL) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) s(k) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(ls.n, 0) AS n_lines, coalesce(dots, 0) AS dots, coalesce(bullets, 0) AS bullets,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
  2 * len(list_filter(regexp_extract_all(text, '{UNSPACED}'), lambda x: regexp_matches(x, '\p{{L}}'))) <= len(regexp_extract_all(text, '\p{{L}}')) AS spaced, length(text) - length(replace(text, '!', '')) AS exclaims,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper
  FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR letters >= 50 AND 10 * upper > 6 * letters OR 10 * exclaims > 4 * n_words
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words AND spaced OR 10 * n_dup_lines > 5 * n_lines
    OR 10 * dots > 5 * n_lines OR 10 * bullets > 9 * n_lines AND n_lines >= 5 OR 10 * lettered < 6 * n_words) AS kept
FROM m""",
    "op4_cover_tree": f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{_CLASSES}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept FROM e LEFT JOIN first ON x = vec_id""",
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, lang, len({_SPLIT.format("coalesce(text, '')")})::BIGINT AS tokens,
  CASE WHEN 20 * (length(text) - length(replace(text, '|', ''))) > length(text) THEN 'table' WHEN 40 * (length(text) - length(replace(text, chr(10), ''))) > length(text) THEN 'list'
    WHEN length(text) < 600 THEN 'brief' WHEN length(text) > 6000 THEN 'essay' ELSE 'prose' END AS topic FROM documents),
{_raking()},
o AS (SELECT *, row_number() OVER w AS k, coalesce(sum(mass) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(rate * mass) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM raked WINDOW w AS (ORDER BY rate DESC, source, lang, topic)),
s AS (SELECT *, (0.8::DOUBLE * (SELECT sum(mass) FROM cells) - capped) / open AS s FROM o WHERE open > 0),
best AS (SELECT s FROM s WHERE s * rate <= 1 + 1e-12 ORDER BY k LIMIT 1),
c AS (SELECT source, lang, topic, CASE WHEN mass > 0 THEN least(1.0, rate * (SELECT s FROM best)) ELSE 1.0 END AS p FROM raked)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, ('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS sampled FROM d JOIN c USING (source, lang, topic)""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_CLASSES}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN first ON x = doc_id""",
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) s(m)) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 100),
cut AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM c, range(1, 5) s(k) WHERE k < m),
scored AS (SELECT cut.lang, cut.phrase, a, k, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT c.*, k, unnest(range(1, m - k + 2)) AS i FROM c, range(2, 5) s(k) WHERE k < m) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, pos, l, {_KEY} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id""",
}
