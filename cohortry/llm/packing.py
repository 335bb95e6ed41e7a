"""Packing of token sequences into windows by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytelevel import ByteLevel
from .common import Written, bounded_batches

#: A plan's columns: of all pieces of ``whole`` tokens with a rank from ``lo`` to ``hi`` - 1 the ``size`` tokens from ``begin`` on go into windows from
#: ``window`` on, ``each`` to a window from ``at`` on; ``phase`` such parts come before the first.
SEGMENT = ("whole", "begin", "lo", "hi", "size", "window", "each", "phase", "at")


def closest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, ``counts`` of each at most, whose sum comes closest to ``room`` from below.

    Subset sums are bits of an integer. Counts are taken in chunks of powers of two; ``lengths`` is descending, so that long
    ones go first and the search ends once ``room`` itself is reached. The chunks' bitsets give the counts back.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for x in lengths:
        if x > room:
            continue
        left, chunk = min(counts[x], room // x), 1
        while left:
            take = min(chunk, left)
            more = reach | (reach << (take * x)) & mask
            if more != reach:
                layers.append((x, take, reach))
                reach = more
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    top, out = reach.bit_length() - 1, {}
    for x, take, before in reversed(layers):
        if not before >> top & 1:
            out[x] = out.get(x, 0) + take
            top -= take * x
    return out


def pack_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """(segments as ``SEGMENT``, windows) for ``histogram[n]`` pieces of n tokens each, 1 to ``capacity``.

    The longest open length is fixed in a window and the rest is filled by ``closest``; the pattern is repeated as often as counts
    allow. Should the best fill leave slack, it is closed by the head of one more piece of the then longest length, whose tail goes back.
    So only the last window is not full. Each round uses up a length or ends the pool, hence the size depends on ``capacity``, not on the pieces.
    """
    pool = {n: deque([(n, 0, 0, k)]) for n, k in histogram.items() if k > 0}
    counts = {n: k for n, k in histogram.items() if k > 0}
    segments: list[tuple[int, ...]] = []
    window = 0

    def take(n: int, k: int) -> list[tuple[int, int, int, int]]:
        got = []
        counts[n] -= k
        while k:
            whole, begin, lo, hi = pool[n].popleft()
            if hi - lo > k:
                pool[n].appendleft((whole, begin, lo + k, hi))
                hi = lo + k
            got.append((whole, begin, lo, hi))
            k -= hi - lo
        if not counts[n]:
            del counts[n], pool[n]
        return got

    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        rest = {**counts, first: counts[first] - 1}
        need = closest(lengths, rest, capacity - first)
        need[first] = need.get(first, 0) + 1
        slack = capacity - sum(n * k for n, k in need.items())
        cut = next((n for n in lengths if counts[n] > need.get(n, 0)), None) if slack else None
        if cut is not None:
            times = min(counts[n] // (k + (n == cut)) for n, k in {cut: 0, **need}.items())
        else:
            times = 1 if slack else min(counts[n] // k for n, k in need.items())
        at = 0
        for n, k in sorted(need.items(), reverse=True):
            phase = 0
            for whole, begin, lo, hi in take(n, k * times):
                segments.append((whole, begin, lo, hi, n, window, k, phase, at))
                phase += hi - lo
            at += n * k
        if cut is not None:
            phase = 0
            for whole, begin, lo, hi in take(cut, times):
                segments.append((whole, begin, lo, hi, slack, window, 1, phase, at))
                phase += hi - lo
                pool.setdefault(cut - slack, deque()).append((whole, begin + slack, lo, hi))
            counts[cut - slack] = counts.get(cut - slack, 0) + times
        window += times
    return segments, window


class Placer:
    """Where the parts of a piece go, for many pieces at once."""

    def __init__(self, segments: list[tuple[int, ...]]):
        table = np.array(segments, np.int64).reshape(-1, len(SEGMENT))
        table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
        self.col = dict(zip(SEGMENT, table.T))
        starts = np.flatnonzero(np.r_[True, (table[1:, :2] != table[:-1, :2]).any(axis=1)]) if len(table) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(table)]
        self.block = {(int(table[s, 0]), int(table[s, 1])): (int(s), int(e)) for s, e in zip(starts, ends)}

    def parts(self, whole: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(begin, size, window, offset) of each part of the piece of ``whole`` tokens with this rank."""
        out, begin, c = [], 0, self.col
        while begin < whole:
            s, e = self.block[whole, begin]
            i = s + int(np.searchsorted(c["lo"][s:e], rank, "right")) - 1
            nth = int(c["phase"][i]) + rank - int(c["lo"][i])
            size, each = int(c["size"][i]), int(c["each"][i])
            out.append((begin, size, int(c["window"][i]) + nth // each, int(c["at"][i]) + nth % each * size))
            begin += size
        return out


def _pieces(tokens: ByteLevel, end_id: int, capacity: int, width: str):
    """Arrow batches (id, text) to pieces of at most ``capacity`` ids: (id, start, total, size, ids)."""

    def run(batches):
        for whole in batches:
            step = max(1, whole.num_rows * (2 << 20) // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                owner, start, total, size, blobs = [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    ids = np.append(tokens.ids(text, specials=True), end_id).astype(width)
                    for s in range(0, len(ids), capacity):
                        part = ids[s : s + capacity]
                        owner.append(i), start.append(s), total.append(len(ids)), size.append(len(part)), blobs.append(part.tobytes())
                        if len(blobs) >= 2048:
                            yield _piece_batch(b, owner, start, total, size, blobs)
                            owner, start, total, size, blobs = [], [], [], [], []
                if blobs:
                    yield _piece_batch(b, owner, start, total, size, blobs)

    return run


def _piece_batch(b: pa.RecordBatch, owner, start, total, size, blobs) -> pa.RecordBatch:
    cols = [b.column(0).take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(size, pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "start", "total", "size", "ids"])


def _placed(placer, width: str):
    def run(batches):
        for b in batches:
            place, out = placer.value, [[] for _ in range(5)]
            owner, start, total = [], b.column(1).to_pylist(), []
            for i, (size, rank, ids) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist(), b.column(4).to_pylist())):
                own = np.frombuffer(ids, width).astype("<u4")
                for begin, n, window, at in place.parts(size, rank):
                    owner.append(i)
                    for c, v in zip(out, (start[i] + begin, n, own[begin : begin + n].tobytes(), window, at)):
                        c.append(v)
            at = pa.array(owner, pa.int32())
            cols = [b.column(0).take(at), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), b.column(2).take(at), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids", "total", "window", "at"])

    return run


def pack(docs: DataFrame, tokens: ByteLevel, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, group: int = 50_000) -> DataFrame:
    """Pieces of all documents in windows of ``capacity`` tokens: ``id_col``, ``start``, ``length``, ``ids`` (binary, unsigned 32-bit little-endian,
    as token files hold them), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text, special strings as tokens of their own, and ``end_id``. It is cut at multiples of ``capacity``; what remains,
    a piece of 1 to ``capacity`` tokens, is placed by minimum bin slack. The plan is made from the histogram of lengths (``capacity`` rows at
    most) and says for ranges of ranks where pieces go and which are cut once more to close a window. Ranks are counted in groups of a length of at most
    some ``group`` pieces, so that no length, however frequent, meets in one task. All windows but the last are full, and offsets are gapless.

    Nulls: a null text is an empty one, a document of ``end_id`` alone; null ids stay. Repeated rows are documents each; of pieces of equal length
    any order will do, the written table fixes one. Very long texts are encoded whole. An empty table gives an empty one; other columns
    are not read, and those named like an output do not matter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    width = "<u2" if max(len(tokens.tokens) - 1, end_id) < 1 << 16 else "<u4"
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    raw = source.mapInArrow(_pieces(tokens, end_id, capacity, width), f"id {kind}, start long, total long, size int, ids binary")
    # written once: the encoder does not run again, and ``at`` stays what it is
    held = Written(raw.withColumn("at", F.monotonically_increasing_id()), "pieces", compression="zstd")
    histogram = {r["size"]: r["count"] for r in held.df.groupBy("size").count().collect()}
    segments, _ = pack_plan(histogram, capacity)
    n = sum(histogram.values())
    most = max(1, min(group, n // 1024))
    # at most ``capacity`` rows
    groups = spark.createDataFrame([(k, -(-c // most)) for k, c in histogram.items()], "size int, groups long")
    dealt = held.df.join(F.broadcast(groups), "size").withColumn("group", F.pmod(F.xxhash64("at"), F.col("groups")))
    starts = dealt.groupBy("size", "group").count()
    before = Window.partitionBy("size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    starts = starts.select("size", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("size", "group").orderBy("at"))
    ranked = dealt.withColumn("k", inside).join(starts, ["size", "group"]).select("id", "start", "total", "size", "ids", (F.col("first") + F.col("k") - 1).alias("rank"))
    placer = spark.sparkContext.broadcast(Placer(segments))
    placed = ranked.mapInArrow(_placed(placer, width), f"id {kind}, start long, length long, ids binary, total long, window long, at long")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids", F.col("total").alias("doc_tokens"), F.col("window").alias("sequence_id"), F.col("at").alias("offset"))
