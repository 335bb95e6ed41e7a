"""SentencePiece encoding and decoding over a relational lattice.

A text becomes atoms: it is cut between any two characters that stand side by side in no piece. Distinct atoms are counted
over the corpus, and only they are segmented: their bounded-length substrings are exploded and equi-joined to the
piece table (of fixed size, broadcast), edges are gathered by atom, and a higher-order aggregate folds them into the best path. For
unigram tables that fold is Viterbi's. The scores of BPE tables are merge ranks, whose best sum is not what the
format's encoder gives; there the same lattice is folded in rank order, merging where an edge spans two neighbours. Atoms of over 60
characters go through the lattice in windows, and the fold runs over their edges in Arrow batches.

Known atoms go to all tasks as arrays, up to a fixed number of them, the most frequent ones (4 million take some 80 MB).
Where there are more, texts become codes of atoms, and the rare ones are joined to blocks of documents by a shuffle,
however many they are.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, bounded_batches
from .hashing import mixed, powers

SPACE = "▁"
#: Atoms of up to so many characters have their boundaries in one long.
_SHORT = 60


@dataclass
class PieceTable:
    """Pieces with scores; ``bytes_at`` is the id of the byte piece for 0, or -1; ``kind`` is "bpe" or "unigram"."""

    pieces: list[str]
    scores: list[float]
    kind: str
    normal: list[bool]
    bytes_at: int = -1
    unk: int = 0
    prefix: bool = True
    width: int = field(init=False)

    def __post_init__(self):
        self.width = max([1, *(len(p) for p, n in zip(self.pieces, self.normal) if n)])

    @classmethod
    def load(cls, path: str) -> "PieceTable":
        """From a model file on the driver. Models must leave texts as they are but for spaces."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalization are supported")
        names = [p.piece for p in m.pieces]
        return cls(
            names, [p.score for p in m.pieces], {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type], [p.type == 1 for p in m.pieces],
            names.index("<0x00>") if m.trainer_spec.byte_fallback else -1, next((i for i, p in enumerate(m.pieces) if p.type == 2), 0), n.add_dummy_prefix,
        )

    def cuts(self) -> "Cuts":
        """Where texts may be cut: between two characters that stand side by side in no piece, which none can reach across."""
        return Cuts({(x, y) for p, n in zip(self.pieces, self.normal) if n for x, y in zip(p, p[1:])})

    def decode(self, ids) -> str:
        """The text of ``ids``: bytes joined and read as UTF-8, control and unknown ids left out."""
        lo = self.bytes_at
        out, run = [], bytearray()
        for i in ids:
            if lo >= 0 and lo <= i < lo + 256:
                run.append(i - lo)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if self.normal[i]:
                out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Cuts:
    """The pairs of characters that pieces hold, over the small alphabet of such characters."""

    #: Up to so many characters the pairs are a table of bits; beyond, a sorted list of codes.
    _DENSE = 4096

    def __init__(self, pairs: set[tuple[str, str]]):
        letters = sorted({c for p in pairs for c in p})
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.n = len(letters) + 1
        self.number = np.zeros(0x110000, np.uint16 if self.n < 65536 else np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, self.n)
        codes = np.array(sorted(number[x] * self.n + number[y] for x, y in pairs), np.int64)
        self.codes, self.dense = codes, None
        if self.n <= self._DENSE:
            self.dense = np.zeros(self.n * self.n, bool)
            self.dense[codes] = True

    def between(self, points: np.ndarray) -> np.ndarray:
        """For each place between two code points whether it may be cut."""
        k = self.number[points].astype(np.int64)
        code = k[:-1] * self.n + k[1:]
        if self.dense is not None:
            return ~self.dense[code]
        if not len(self.codes):
            return np.ones(len(code), bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] != code


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def ranked(table: PieceTable) -> list[tuple[str, int, int, float]]:
    """(piece, id, rank, score) of the normal pieces; ``rank`` numbers distinct scores, the highest first."""
    ranks = {s: i for i, s in enumerate(sorted({s for s, n in zip(table.scores, table.normal) if n}, reverse=True))}
    return [(p, i, ranks[s], float(s)) for i, (p, s, n) in enumerate(zip(table.pieces, table.scores, table.normal)) if n]


def _pieces(spark: SparkSession, table: PieceTable) -> DataFrame:
    """The piece table and an empty piece of id -1. It has a fixed size, that of the vocabulary, and is broadcast."""
    rows = pd.DataFrame([*ranked(table), ("", -1, 0, 0.0)], columns=["piece", "id", "rank", "score"])
    return F.broadcast(spark.createDataFrame(rows, "piece string, id int, rank int, score double"))


def edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """The columns of ``words`` and (start, end, rank, score, id): each piece at each place of a distinct short word, and one row with id -1 for each word."""
    n = F.length("word")
    own = words.columns
    at = words.select(*own, n.alias("__n"), F.explode(F.sequence(F.lit(1), n)).alias("s"))
    at = at.select(*own, "s", F.explode(F.sequence(F.when(F.col("s") == 1, 0).otherwise(1), F.least(F.lit(table.width), F.col("__n") - F.col("s") + 1))).alias("k"))
    at = at.withColumn("piece", F.col("word").substr(F.col("s"), F.col("k")))
    return at.join(_pieces(words.sparkSession, table), "piece").select(*own, (F.col("s") - 1).alias("start"), (F.col("s") + F.col("k") - 1).alias("end"), "rank", "score", "id")


def long_edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """(wid, edges) of words of any length: each edge as start << 8 | length, and rank << 32 | id.

    A word is cut into windows that reach a piece's length into the next one. The rows of the lattice carry a window and
    the word's hash, not the word, so that their bytes grow with its length.
    """
    step, over = max(_SHORT, table.width), table.width - 1
    chunks = words.select("wid", F.regexp_extract_all("word", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("c"))
    windows = F.transform("c", lambda x, i: F.struct((i * step).alias("from"), F.length(x).alias("n"), F.concat(x, F.coalesce(F.left(F.get("c", i + 1), F.lit(over)), F.lit(""))).alias("part")))
    rows = chunks.select("wid", F.inline(windows))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("s"))
    rows = rows.select("wid", "from", "part", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.width), F.length("part") - F.col("s") + 1))).alias("k"))
    rows = rows.select("wid", (F.col("from") + F.col("s") - 1).alias("start"), "k", F.col("part").substr(F.col("s"), F.col("k")).alias("piece"))
    place = F.shiftleft(F.col("start").cast("long"), 8).bitwiseOR(F.col("k").cast("long"))
    what = F.shiftleft(F.col("rank").cast("long"), 32).bitwiseOR(F.col("id").cast("long"))
    return rows.join(_pieces(words.sparkSession, table), "piece").groupBy("wid").agg(F.collect_list(F.struct(place.alias("place"), what.alias("what"))).alias("edges"))


def _single(i: Column, table: PieceTable) -> Column:
    """Ids of the character at ``i`` (from 0) of ``word`` that is no piece: its bytes, or the unknown id."""
    if table.bytes_at < 0:
        return F.array(F.lit(table.unk))
    hexes = F.hex(F.encode(F.col("word").substr(i + 1, F.lit(1)), "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2 - 1).cast("int")), lambda j: F.conv(F.substr(hexes, (j * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + table.bytes_at)


def _filled(found: Column, table: PieceTable) -> Column:
    """Ids of a path given as sorted longs (start << 34 | length << 28 | id); characters that it leaves out are filled in.

    Pieces have up to ``_SHORT`` characters, so that a length has room in 6 bits, and a start in 29.
    """
    start = lambda e: F.shiftright(e, 34).cast("int")
    end = lambda e: start(e) + F.shiftright(e, 28).bitwiseAND(F.lit(63)).cast("int")
    plain = F.transform(found, lambda e: e.bitwiseAND(F.lit((1 << 28) - 1)).cast("int"))
    n = F.length("word")
    covered = F.aggregate(found, F.lit(0), lambda s, e: s + end(e) - start(e))
    at = lambda i: F.get(F.filter(found, lambda e: (start(e) <= i) & (i < end(e))), F.lit(0))
    whole = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when(at(i).isNull(), _single(i, table)).when(start(at(i)) == i, F.array(at(i).bitwiseAND(F.lit((1 << 28) - 1)).cast("int"))).otherwise(F.array().cast("array<int>")),
        )
    )
    return F.when(covered == n, plain).otherwise(whole)


def _merge_short(grouped: DataFrame, table: PieceTable) -> DataFrame:
    """Fold edges (rank << 36 | start << 30 | end << 24 | id) in rank order over a mask of the boundaries left."""
    one = F.lit(1).cast("long")
    st = lambda e: F.shiftright(e, 30).bitwiseAND(F.lit(63)).cast("int")
    en = lambda e: F.shiftright(e, 24).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda i: F.call_function("shiftleft", one, i)
    ends = lambda e: bit(st(e)).bitwiseOR(bit(en(e)))
    inner = lambda e: (bit(en(e)) - 1).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(2).cast("long"), st(e)) - 1))
    full = F.call_function("shiftleft", F.lit(2).cast("long"), F.length("word")) - 1
    joins = lambda m, e: (m.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(m.bitwiseAND(inner(e))) == 1)
    mask = F.aggregate("edges", full, lambda m, e: F.when(joins(m, e), m.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(m))
    done = grouped.withColumn("mask", mask)
    m = F.col("mask")
    path = F.filter("edges", lambda e: (m.bitwiseAND(ends(e)) == ends(e)) & (m.bitwiseAND(inner(e)) == 0))
    packed = F.sort_array(F.transform(path, lambda e: F.shiftleft(st(e).cast("long"), 34).bitwiseOR(F.shiftleft((en(e) - st(e)).cast("long"), 28)).bitwiseOR(e.bitwiseAND(F.lit((1 << 24) - 1)))))
    # a column of its own, as it is read more than once
    own = [c for c in grouped.columns if c != "edges"]
    return done.select(*own, packed.alias("path")).select(*own, _filled(F.col("path"), table).alias("ids"))


def _own(rows: DataFrame) -> list[str]:
    """The columns of the words that edges were made of."""
    return [c for c in rows.columns if c not in ("start", "end", "rank", "score", "id")]


def merged_path(n: int, start: np.ndarray, size: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts that are left when edges are applied in rank order over an array of boundaries."""
    bound = bytearray([1]) * (n + 1)
    order = np.lexsort((start, rank))
    for s, k in zip(start[order].tolist(), size[order].tolist()):
        if bound[s] and bound[s + k] and bound.count(1, s + 1, s + k) == 1:
            bound[s + 1 : s + k] = bytes(k - 1)
    at = [i for i in range(n + 1) if bound[i]]
    return list(zip(at, at[1:]))


def best_path(n: int, start: np.ndarray, size: np.ndarray, score: np.ndarray, low: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of the best sum; a character that no edge takes costs ``low``. Ties go to the edge that starts first."""
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    order = np.lexsort((start, start + size))
    s_, e_, w_ = start[order].tolist(), (start + size)[order].tolist(), score[order].tolist()
    i = 0
    for t in range(1, n + 1):
        one = best[t - 1] + low
        while i < len(e_) and e_[i] == t:
            if best[s_[i]] + w_[i] > best[t]:
                best[t], back[t] = best[s_[i]] + w_[i], s_[i]
            i += 1
        if one > best[t]:
            best[t], back[t] = one, t - 1
    out, t = [], n
    while t:
        out.append((back[t], t))
        t = back[t]
    return out[::-1]


def _fold_long(words: DataFrame, table: PieceTable) -> DataFrame:
    """The same folds for long words, in time that grows with their length. ``words`` has ``word`` and ``wid``."""
    own = [c for c in words.columns if c != "wid"]
    rows = words.join(long_edges(words, table), "wid", "left").select(*own, "edges")
    unigram, fallback, unk = table.kind == "unigram", table.bytes_at, table.unk
    scores = np.array(sorted({s for s, n in zip(table.scores, table.normal) if n}, reverse=True), np.float64)
    low = float(scores.min(initial=0.0)) - 10.0
    at = own.index("word")

    def ids_of(word: str, place: np.ndarray, what: np.ndarray) -> list[int]:
        start, size, rank = place >> 8, place & 255, what >> 32
        named = dict(zip(place.tolist(), (what & 0xFFFFFFFF).tolist()))
        path = best_path(len(word), start, size, scores[rank], low) if unigram else merged_path(len(word), start, size, rank)
        out: list[int] = []
        for a, z in path:
            i = named.get(a << 8 | z - a) if z - a < 256 else None
            out += [i] if i is not None else [fallback + c for c in word[a:z].encode()] if fallback >= 0 else [unk]
        return out

    def fold(batches):
        for b in batches:
            lists = b.column(len(own))
            got = []
            for word, cell in zip(b.column(at).to_pylist(), lists):
                e = cell.values
                place, what = (np.empty(0, np.int64),) * 2 if e is None else (e.field(0).to_numpy(), e.field(1).to_numpy())
                got.append(ids_of(word, place, what))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), pa.array(got, pa.list_(pa.int32()))], names=[*own, "ids"])

    return rows.mapInArrow(fold, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", ids array<int>")


def _viterbi(rows: DataFrame, table: PieceTable) -> DataFrame:
    """The best path by summed scores: a fold over edges by end, then a walk back. Unknown characters cost more than any piece.

    Ties go to the edge that starts first.
    """
    low = min([s for s, n in zip(table.scores, table.normal) if n], default=0.0) - 10.0
    n = F.length("word")
    own = _own(rows)
    grouped = rows.groupBy(*own).agg(F.collect_list(F.struct("end", "start", "id", "score")).alias("edges"))
    step = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("end"), (i - 1).alias("start"), F.lit(-2).alias("id"), F.lit(low).alias("score")))
    every = F.sort_array(F.concat(F.filter("edges", lambda e: e["id"] >= 0), step))
    none = F.lit(float("-inf"))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(none).alias("best"), F.lit(-1).alias("from"), F.lit(-2).alias("id")))

    def relax(state: Column, e: Column) -> Column:
        total = F.element_at(state, e["start"] + 1)["best"] + e["score"]
        better = total > F.element_at(state, e["end"] + 1)["best"]
        return F.when(better, F.transform(state, lambda x, i: F.when(i == e["end"], F.struct(total.alias("best"), e["start"].alias("from"), e["id"].alias("id"))).otherwise(x))).otherwise(state)

    state = F.aggregate(every, start, relax)
    done = grouped.withColumn("state", state)
    walk0 = F.struct(F.length("word").alias("at"), F.array().cast("array<long>").alias("path"))

    def back(acc: Column, _: Column) -> Column:
        here = F.element_at(F.col("state"), acc["at"] + 1)
        packed = F.shiftleft(here["from"].cast("long"), 34).bitwiseOR(F.shiftleft((acc["at"] - here["from"]).cast("long"), 28)).bitwiseOR(here["id"].cast("long"))
        path = F.when(here["id"] >= 0, F.concat(F.array(packed), acc["path"])).otherwise(acc["path"])
        return F.when(acc["at"] > 0, F.struct(here["from"].alias("at"), path.alias("path"))).otherwise(acc)

    path = F.aggregate(F.sequence(F.lit(1), n), walk0, back)["path"]
    return done.withColumn("path", path).select(*own, _filled(F.col("path"), table).alias("ids"))


def segment(words: DataFrame, table: PieceTable) -> DataFrame:
    """The columns of ``words`` and ``ids``, for distinct non-empty words in escaped form in column ``word``."""
    if table.width > _SHORT:
        raise ValueError("pieces are too long")
    short = words.where(F.length("word") <= _SHORT)
    long = words.where(F.length("word") > _SHORT).withColumn("wid", F.xxhash64("word"))
    if table.kind == "unigram":
        done = _viterbi(edges(short, table), table)
    else:
        packed = edges(short, table).select(*words.columns, F.when(F.col("id") >= 0, F.shiftleft(F.col("rank").cast("long"), 36).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 30)).bitwiseOR(F.shiftleft(F.col("end").cast("long"), 24)).bitwiseOR(F.col("id").cast("long"))).alias("e"))
        done = _merge_short(packed.groupBy(*words.columns).agg(F.sort_array(F.collect_list("e")).alias("edges")), table)
    return done.unionByName(_fold_long(long, table))


@dataclass
class Atoms:
    """The atoms of a batch of texts: code points, where atoms start and end, their hashes, and the atoms before each text."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    before: np.ndarray

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def atoms_of(texts: list[str], cuts: Cuts, prefix: bool) -> Atoms:
    """All texts are cut and hashed together: the hash of an atom is the difference of two prefix sums of values of code
    points times powers, taken back to the same power."""
    own = [SPACE + t if prefix and t else t for t in texts]
    points = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").copy()
    points[points == 32] = ord(SPACE)
    n = len(points)
    bounds = np.cumsum([0, *map(len, own)])
    first = np.empty(n + 1, bool)
    first[1:n] = cuts.between(points)
    first[bounds] = True
    first[n] = True
    cut = np.flatnonzero(first)
    start, end = cut[:-1], cut[1:]
    up, down = powers(n + 1)
    value = points.astype(np.uint64) + np.uint64(1)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value *= np.uint64(0x94D049BB133111EB)
    value *= up[:n]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    return Atoms(points, start, end, hashes, np.searchsorted(start, bounds))


class AtomIndex:
    """Ids of known atoms by hash: sorted keys behind a table of their leading bits."""

    _BITS = 20

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, flat: np.ndarray):
        self.keys, self.offsets, self.flat = keys, offsets, flat
        self.first = np.searchsorted(keys, np.arange((1 << self._BITS) + 1, dtype=np.uint64) << np.uint64(64 - self._BITS)).astype(np.int32)
        self.first[-1] = len(keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        at = self.first[(hashes >> np.uint64(64 - self._BITS)).astype(np.int64)]
        top = np.int32(len(self.keys) - 1)
        at = np.minimum(at, top)
        key = self.keys[at]
        open_ = np.flatnonzero(key < hashes)
        while len(open_):
            more = np.minimum(at[open_] + 1, top)
            stuck = more == at[open_]
            at[open_] = more
            open_ = open_[(self.keys[more] < hashes[open_]) & ~stuck]
        return np.where(self.keys[at] == hashes, at, np.int32(-1))


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _pack(codes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def encode(
    docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 22, block_atoms: int = 100_000, check: bool = False
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (array of int) and, if asked for, ``round_trip``: whether the decoded ids are as many
    bytes, with the CRC-32, of the text (with its space signs as spaces).

    Null and empty texts have no tokens and decode to the empty text. Null ids stay; repeated rows are encoded each; an
    empty table gives an empty one. Very long texts, and texts without a place to cut, are encoded whole, in time that grows with
    their length. Paths of equal scores are told apart as the format's library does: the earlier place first. Other columns are not
    read and may have any names. A text with the space sign of the format decodes to one
    with a space there, as in the format's own library. ``frequent`` bounds what all tasks are sent; the ids do not depend on it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cuts, prefix = table.cuts(), table.prefix
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    id_type = source.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # repartitioned by word, so that edges need no further exchange to be gathered
    counted = source.mapInArrow(_counter(cuts, prefix), "word string, n long").repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"))
    words = Written(counted, "words")
    total = words.df.count()
    whole = total <= frequent
    asked = words.df.repartition(parts, "word")
    with _setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "200000"):
        pieced = segment(asked, table)
        pieced = Written(pieced.drop("n") if whole else pieced, "pieced")
    words.drop()
    if whole:
        known = pieced.df
    else:
        least = held = 0
        for r in pieced.df.groupBy("n").count().orderBy(F.desc("n")).limit(frequent).toLocalIterator():
            held += r["count"]
            if held > frequent:
                least = r["n"] + 1
                break
        known = pieced.df.where(F.col("n") >= least)
    index = spark.sparkContext.broadcast(_index(known.select("word", "ids").mapInArrow(_hasher(cuts), "h long, ids array<int>").toArrow()))
    read = _reader(table)
    columns = f"id {id_type}, n_tokens long, ids array<int>" + ", round_trip boolean" * check
    if whole:
        pieced.drop()
        out = source.mapInArrow(_encoder(cuts, prefix, index, read if check else None, id_type), columns)
        return out.withColumnRenamed("id", id_col)
    kind = f"block long, ids array<{id_type}>, ends array<int>, blob binary, rare array<string>, sums array<long>"
    coded = Written(source.mapInArrow(_coder(cuts, prefix, index, block_atoms, id_type), kind), "coded")
    rare = coded.df.select("block", F.posexplode("rare").alias("k", "word")).join(pieced.df.select("word", "ids"), "word")
    rare = rare.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", F.col("ids").alias("own")))).alias("r"))
    rare = rare.select("block", F.transform("r", lambda x: x["own"]).alias("rare_ids"))
    joined = coded.df.select("block", "ids", "ends", "blob", "sums").join(rare, "block", "left").select("ids", "ends", "blob", "rare_ids", "sums")
    return joined.mapInArrow(_builder(index, read if check else None, id_type), columns).withColumnRenamed("id", id_col)


def _slices(b: pa.RecordBatch):
    """(ids, texts) of some 1 MB."""
    step = max(1, b.num_rows * (1 << 20) // max(1, b.nbytes))
    for at in range(0, b.num_rows, step):
        s = b.slice(at, step)
        yield s.column(0).to_pylist(), s.column(1).to_pylist()


def _counter(cuts: Cuts, prefix: bool):
    """Distinct atoms of a task with their counts, sent on whenever there are very many."""

    def run(batches):
        known, counts, words = np.empty(0, np.uint64), np.empty(0, np.int64), []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], names=["word", "n"])

        for b in batches:
            for _, texts in _slices(b):
                a = atoms_of(texts, cuts, prefix)
                h, at, n = np.unique(a.hashes, return_index=True, return_counts=True)
                place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                old = known[place] == h if len(known) else np.zeros(len(h), bool)
                counts[place[old]] += n[old]
                new = ~old
                fresh = [a.word(i) for i in at[new].tolist()]
                both = np.concatenate([known, h[new]])
                order = np.argsort(both, kind="stable")
                known, counts = both[order], np.concatenate([counts, n[new]])[order]
                every = np.empty(len(order), object)
                every[: len(words)] = words
                every[len(words) :] = fresh
                words = every[order]
                if len(known) > 600_000:
                    yield out()
                    known, counts, words = np.empty(0, np.uint64), np.empty(0, np.int64), []
        if len(known):
            yield out()

    return run


def _hasher(cuts: Cuts):
    """Atoms as their hashes."""

    def run(batches):
        for b in batches:
            a = atoms_of(b.column(0).to_pylist(), cuts, False)
            yield pa.RecordBatch.from_arrays([pa.array(a.hashes.view(np.int64)), b.column(1)], names=["h", "ids"])

    return run


def _index(rows: pa.Table) -> AtomIndex:
    """Built chunk by chunk: the driver never holds the lists twice."""
    keys = np.concatenate([np.empty(0, np.int64), *(c.to_numpy() for c in rows.column("h").chunks)]).view(np.uint64)
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    keys = keys[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two atoms have one hash")
    chunks = rows.column("ids").chunks
    sizes = np.concatenate([np.empty(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in chunks)])
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[order])])
    top = max([0, *(c.values.to_numpy().max() for c in chunks if len(c.values))])
    flat = np.empty(offsets[-1], np.uint16 if top < 65536 else np.int32)
    at = 0
    for c in chunks:
        n = len(c)
        size = sizes[at : at + n]
        ids = c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[n].as_py()]
        target = offsets[place[at : at + n]]
        flat[np.repeat(target - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        at += n
    return AtomIndex(keys, offsets.astype(np.int32), flat)


def _sum_of(text: str) -> int:
    raw = text.encode()
    return (zlib.crc32(raw) << 32 | len(raw) & 0xFFFFFFFF) - (1 << 63)


def _type(id_type: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(id_type))


def _batch(ids, cut, tokens, sums, read, to) -> pa.RecordBatch:
    cols = [pa.array(ids, to), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(tokens.astype(np.int32)))]
    if read:
        cols.append(pa.array([_sum_of(read(tokens[a:z].tolist())) == s for a, z, s in zip(cut[:-1], cut[1:], sums)], pa.bool_()))
    return pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids", "round_trip"][: len(cols)])


def _encoder(cuts, prefix, index, read, id_type):
    """Ids where all atoms are known."""
    to = _type(id_type)

    def run(batches):
        known = index.value
        for b in batches:
            for ids, texts in _slices(b):
                a = atoms_of(texts, cuts, prefix)
                code = known.find(a.hashes)
                if (code < 0).any():
                    raise RuntimeError("an atom is unknown that was counted before: the input has changed")
                start = known.offsets[code].astype(np.int64)
                size = known.offsets[code + 1] - start
                cut = np.concatenate([[0], np.cumsum(size)])[a.before]
                yield _batch(ids, cut, gather(known.flat, start, size), [_sum_of(t.replace(SPACE, " ")) for t in texts] if read else None, read, to)

    return run


def _coder(cuts, prefix, index, block_atoms, id_type):
    """Blocks of documents as codes of atoms; atoms not in the index are listed with the block."""
    to = _type(id_type)

    def run(batches):
        from pyspark import TaskContext

        task, blocks, known = TaskContext.get().partitionId(), 0, index.value
        for b in batches:
            for ids, texts in _slices(b):
                a = atoms_of(texts, cuts, prefix)
                lo = 0
                while lo < len(ids):
                    hi = max(lo + 1, int(np.searchsorted(a.before, a.before[lo] + block_atoms, "right")) - 1)
                    x, y = a.before[lo], a.before[min(hi, len(ids))]
                    code = known.find(a.hashes[x:y]).astype(np.int32)
                    cold = np.flatnonzero(code < 0)
                    _, at, which = np.unique(a.hashes[x:y][cold], return_index=True, return_inverse=True)
                    code[cold] = -1 - which
                    rare = [a.word(int(x + cold[i])) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([task << 32 | blocks]), pa.array([ids[lo:hi]], pa.list_(to)), pa.array([(a.before[lo + 1 : hi + 1] - x).tolist()], pa.list_(pa.int32())), pa.array([_pack(code)], pa.binary()),
                            pa.array([rare], pa.list_(pa.string())), pa.array([[_sum_of(t.replace(SPACE, " ")) for t in texts[lo:hi]]], pa.list_(pa.int64())),
                        ],
                        names=["block", "ids", "ends", "blob", "rare", "sums"],
                    )
                    blocks += 1
                    lo = hi

    return run


def _builder(index, read, id_type):
    """Ids of blocks whose rare atoms have been joined."""
    to = _type(id_type)

    def run(batches):
        known = index.value
        for b in batches:
            for k in range(b.num_rows):
                ids, ends = b.column(0)[k].as_py(), np.array(b.column(1)[k].as_py(), np.int64)
                code = _unpack(b.column(2)[k].as_py()).astype(np.int64)
                rare = b.column(3)[k].as_py() or []
                off = np.cumsum([0, *map(len, rare)])
                flat = np.array([i for x in rare for i in x], np.int32)
                hot = code >= 0
                start, size = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
                start[hot] = known.offsets[code[hot]]
                size[hot] = known.offsets[code[hot] + 1] - start[hot]
                cold = -1 - code[~hot]
                start[~hot] = off[cold]
                size[~hot] = off[cold + 1] - off[cold]
                which = np.repeat(hot, size)
                tokens = np.empty(len(which), np.int32)
                tokens[which] = gather(known.flat, start[hot], size[hot])
                tokens[~which] = gather(flat, start[~hot], size[~hot])
                cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
                yield _batch(ids, cut, tokens, b.column(4)[k].as_py() if read else None, read, to)

    return run


def _reader(table: PieceTable):
    """A function from a list of ids to their text."""
    # byte pieces as code points of a private area, put together after all pieces are joined
    lo, prefix = table.bytes_at, table.prefix
    names = [p.replace(SPACE, " ") if n else "" for p, n in zip(table.pieces, table.normal)]
    if any("\U000f0000" <= c <= "\U000f00ff" for p in names for c in p):
        return table.decode
    if lo >= 0:
        names[lo : lo + 256] = [chr(0xF0000 + i) for i in range(256)]
    mark = re.compile("[\U000f0000-\U000f00ff]+")

    def read(ids: list[int]) -> str:
        t = "".join(map(names.__getitem__, ids))
        if not t.isascii():
            t = mark.sub(lambda m: bytes(ord(c) - 0xF0000 for c in m.group()).decode("utf-8", "replace"), t)
        return t[1:] if prefix and t.startswith(" ") else t

    return read


def decode(tokens: DataFrame, table: PieceTable, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``: a null list of ids gives a null text, an empty one the empty text; null ids are left out."""
    source = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    read = _reader(table)

    def run(batches):
        for b in batches:
            out = [read([i for i in ids if i is not None]) if ids is not None else None for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
