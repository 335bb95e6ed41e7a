"""Phrase collocations: counts of all phrases by marginalising counts of the longest windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, bounded_batches
from .hashing import ROOT, mixed

#: What parts pieces, and what parts words inside them, as single bytes.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_TO = bytes.maketrans(BREAKS + SPACES, b"\n" * len(BREAKS) + b" " * len(SPACES))
#: Bytes of text taken at a time, and distinct words that a task remembers.
_SECTION, _WORDS = 1 << 19, 1 << 16


def words_of(data: bytes) -> list[bytes]:
    """Lower-case words (A-Z alone) of a text in UTF-8; ``\\n`` stands between pieces."""
    return [w for w in data.lower().translate(_TO).replace(b"\n", b" \n ").split(b" ") if w]


def _sections(texts: list[bytes]):
    """Texts joined by a break, in parts of some ``_SECTION`` bytes that end at a break; a longer piece stays whole."""
    data = b"\n".join(texts).translate(_TO)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= _SECTION else data.rfind(b"\n", at, at + _SECTION)
        if end < at:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
        if end > at:
            yield data[at:end]
        at = end + 1


class _Codes(dict):
    """Codes of words from 1 on, given as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Coder:
    """Codes of words, 0 for a break, and a hash of each; forgotten between sections once there are many."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.code, self.hashes = _Codes({b"\n": 0}), np.zeros(1, np.uint64)

    @property
    def words(self) -> list[bytes]:
        return list(self.code)

    def codes(self, data: bytes) -> np.ndarray:
        import xxhash

        if len(self.code) > _WORDS:
            self.clear()
        words = words_of(data)
        out = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        new = self.words[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return out


def _seed(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang))


def _pairs(codes: np.ndarray, coder: _Coder, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word but the last is followed by one of its piece, hashes of these pairs)."""
    h = coder.hashes[codes]
    on = (codes[:-1] > 0) & (codes[1:] > 0)
    return on, mixed((h[:-1] * np.uint64(ROOT) + h[1:]) ^ _seed(lang))


def _by_lang(batches):
    """(language, section): texts of a language are gathered over batches, of all languages some two sections at most."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for whole in batches:
        step = max(1, whole.num_rows * _SECTION // max(1, whole.nbytes))
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                held.setdefault(lang, []).extend(b.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist())
            size += b.nbytes
            if size > 2 * _SECTION:
                yield from ((lang, s) for lang, own in held.items() for s in _sections(own))
                held, size = {}, 0
    yield from ((lang, s) for lang, own in held.items() for s in _sections(own))


def _pair_counts(batches):
    coder = _Coder()
    for lang, section in _by_lang(batches):
        codes = coder.codes(section)
        on, pairs = _pairs(codes, coder, lang)
        h, n = np.unique(pairs[on], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def _windows(bitmap, bits: int, longest: int):
    """Windows of ``longest`` words from each word on, padded with "" behind the piece's end and behind a pair that cannot be frequent."""

    def run(batches):
        mask = np.frombuffer(bitmap.value, np.uint8)
        coder = _Coder()

        for lang, section in _by_lang(batches):
            codes = coder.codes(section)
            if not len(codes):
                continue
            on, pairs = _pairs(codes, coder, lang)
            slot = (pairs & np.uint64(bits - 1)).view(np.int64)
            on &= (mask[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            going = np.append(on, False)
            alone = np.bincount(codes[~going])
            alone[0] = 0
            first = np.flatnonzero(going)
            lead = [codes[first]]
            for k in range(1, longest):
                # the word k places on, as long as all pairs up to it hold
                open_ = going[first] if k == 1 else open_ & going[np.minimum(first + k - 1, len(codes) - 1)]
                lead.append(np.where(open_, codes[np.minimum(first + k, len(codes) - 1)], 0))
            order = np.lexsort(lead[::-1])
            rows = [c[order] for c in lead]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in rows], axis=0)]) if len(order) else np.zeros(0, np.int64)
            n = np.diff(np.r_[new, len(order)])
            single = np.flatnonzero(alone)
            words = pa.array([b"", *coder.words[1:]], pa.binary()).cast(pa.string())
            zeros = np.zeros(len(single), np.int64)
            heads = np.r_[rows[0][new], single]
            cols = [heads, *[np.r_[c[new], zeros] for c in rows[1:]]]
            cols = [words.take(pa.array(c)) for c in cols]
            n = np.r_[n, alone[single]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *cols, pa.array(n)], names=["lang", *[f"w{i + 1}" for i in range(longest)], "n"])

    return run


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits, a power of two, with the bit of each key's last digits set: its size does not depend on the keys."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1  # bitmap functions count from 1
    rows = keys.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m")).collect()
    out = bytearray(max(bits // 8, 4096))
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["m"]
    return bytes(out)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, bits: int = 1 << 26) -> Written:
    """(lang, m, phrase, f): all phrases of 1 to ``longest`` words with at least ``least`` occurrences in their language, and for m = 0 the number
    of all words of a language.

    Windows of the longest size are counted alone; a roll-up over their words sums up the counts of all prefixes. A phrase is as frequent as its
    rarest pair of neighbours at most: a first pass counts pairs by 64-bit hashes, and windows end before a pair whose bit is not set. Pairs that
    share a bit or a hash with a frequent one only make a window longer than it need be, so counts are exact.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("t"))
    pairs = source.mapInArrow(_pair_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bitmap = spark.sparkContext.broadcast(_bitmap(pairs.where(F.col("n") >= least), bits))
    ws = [f"w{i + 1}" for i in range(longest)]
    windows = source.mapInArrow(_windows(bitmap, bits, longest), f"lang string, {', '.join(f'{w} string' for w in ws)}, n long")
    counted = windows.groupBy("lang", *ws).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *ws).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # the columns that are summed over are the last ones: g has a bit for each
    m = longest - F.length(F.regexp_replace(F.bin("g"), "0", ""))
    last = F.get(F.array(F.lit("all"), *ws), F.col("m"))
    phrases = rolled.where(F.col("g") < (1 << longest)).withColumn("m", m).where((F.col("m") == 0) & (F.col("f") > 0) | ((F.col("f") >= least) & (last != "")))
    held = Written(phrases.select("lang", "m", F.concat_ws(" ", *ws).alias("phrase"), "f"), "phrases")
    bitmap.destroy()
    return held


def _floor_ratio(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits."""
    d = lambda c: c.cast("decimal(19,0)")
    work = F.struct((F.lit(1000).cast("decimal(4,0)") * d(a) * d(n)).alias("x"), (d(l) * d(r)).alias("y"))
    return F.transform(F.array(work), lambda s: F.call_function("div", s["x"], s["y"]))[0]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, top: int = 2000, bits: int = 1 << 26) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    Candidates have ``a`` >= ``least`` occurrences; of all cuts into a first part (``l`` occurrences) and the rest (``r``) the one with the lowest
    floor(1000 a n / (l r)) counts, n being the language's words; ties go to the shortest first part. A candidate inside a longer one that is as
    frequent is dropped. Order: score and ``a`` from the highest, then the phrase by bytes.

    Nulls: a null text is an empty one, a null language ``und``; ids are not read. Very long texts are taken in sections that end at breaks, whole;
    repeated rows count each. Empty tables give empty ones; other columns, and their names, do not matter. No phrase is left out: no step samples or caps but
    ``top`` itself.
    """
    held = phrase_counts(docs, lang_col, text_col, longest, least, bits).df
    key = ["lang", "phrase"]
    own = held.where("m >= 2").withColumnRenamed("f", "a")
    words = held.where("m = 0").select("lang", F.col("f").alias("n"))
    cuts = own.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - m)")})
    counts = held.where("m >= 1")
    heads, tails = (counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(words, "lang")
    score = _floor_ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    best = scored.groupBy(*key).agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("s")).select(*key, "s.*")
    parts = own.where("m >= 3").select("lang", F.split("phrase", " ").alias("w"), "m", "a")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    inside = parts.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy(*key).agg(F.max("a").alias("longer"))
    open_ = best.join(inside, key, "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of 64 parts of a language each, so that the last sort of a language has a bounded number of rows
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = open_.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
