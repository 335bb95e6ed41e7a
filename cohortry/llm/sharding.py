"""Sharding by a k-d tree over metadata, cut at distributed weighted medians. DataFrame functions only.

Equal texts are one unit with the bytes of all its copies, so that they share a shard. Only a group of copies that would
tip the balance, of more than ``slack`` of a shard, is dealt out in several units. Each level asks for the extent of every
dimension in every node (one aggregate with a row a node), takes the widest dimension, and finds the byte-weighted cut by
radix histograms over a 52-bit sort code. Executors sum the histograms and pick the digit at which a node's bytes cross
the middle; one row a node comes to the driver, and goes back as a broadcast table with a row a node at most. Units
learn their side by that table, without a shuffle, and a level is written before the next. Rows join their unit at the end.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written

_DIGIT, _PASSES = 13, 4
_TIE_BITS, _DIM_BITS = 32, 20
#: A cut is exact enough when what it misses is below this part of its node.
_MISS = 1e-5
#: Strings are ordered by this many bytes behind the prefix that all values share, and kept for that by so many characters.
_CODE_BYTES, _CODE_CHARS = 6, 64


@dataclass
class _Node:
    """A node that shall hold ``leaves`` shards, the first of them ``first``."""

    leaves: int
    first: int
    weight: int = 0
    dim: int = 0
    cut: int = -1


def _shared_prefix(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def _shared_chars(a: str | None, b: str | None) -> int:
    return next((i for i, (x, y) in enumerate(zip(a or "", b or "")) if x != y), min(len(a or ""), len(b or "")))


def _code(c: str, skip: int) -> Column:
    """Strings as numbers in the order of their bytes."""
    own = F.hex(F.substring(F.col(c).cast("binary"), skip + 1, _CODE_BYTES))
    return F.conv(F.rpad(own, 2 * _CODE_BYTES, "0"), 16, 10).cast("double")


def _small(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a row a node, from one literal: its size is bounded by the number of shards."""
    names = [x.split()[0] for x in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>"))))


def _key() -> Column:
    return F.shiftleft(F.get("d", F.col("dim")), _TIE_BITS).bitwiseOR(F.col("tie"))


def _cuts(units: DataFrame, nodes: list[_Node], dims: int) -> None:
    """Give each of ``nodes`` the dimension and the cut that part its bytes as its leaves are parted.

    ``units`` has the index of its node in ``nodes`` as ``node``, or -1.
    """
    spark = units.sparkSession
    here = units.where("node >= 0")
    widths = [(F.max(F.get("d", F.lit(i))) - F.min(F.get("d", F.lit(i)))).alias(f"w{i}") for i in range(dims)]
    for r in here.groupBy("node").agg(F.sum("size").alias("w"), *widths).collect():
        nodes[r["node"]].weight = r["w"]
        nodes[r["node"]].dim = max(range(dims), key=lambda i: (r[f"w{i}"], -i))
    keyed = here.join(_small(spark, [(i, n.dim) for i, n in enumerate(nodes)], "node int, dim int"), "node").select("node", _key().alias("key"), "size")
    rest = {i: n.weight * (n.leaves // 2) / n.leaves for i, n in enumerate(nodes) if n.weight}
    prefix = dict.fromkeys(rest, 0)
    for p in range(_PASSES):
        if not rest:
            return
        shift = (_PASSES - 1 - p) * _DIGIT
        open_ = _small(spark, [(i, prefix[i], rest[i]) for i in rest], "node int, prefix long, rest double")
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)).alias("digit")
        counts = keyed.join(open_, "node").where(F.shiftright("key", shift + _DIGIT) == F.col("prefix")).groupBy("node", "rest", digit).agg(F.sum("size").alias("w"))
        until = F.sum("w").over(Window.partitionBy("node").orderBy("digit"))
        crossing = counts.withColumn("until", until).where("until > rest and until - w <= rest")
        for r in crossing.collect():
            i, missing, extra = r["node"], r["rest"] - (r["until"] - r["w"]), r["until"] - r["rest"]
            own = (prefix[i] << _DIGIT) + r["digit"]
            if min(missing, extra) <= _MISS * nodes[i].weight or p == _PASSES - 1:
                # up to the last digit that fits, or with this one, whichever is nearer
                nodes[i].cut = ((own + (extra < missing)) << shift) - 1
                del rest[i]
            else:
                prefix[i], rest[i] = own, missing


def _tree(units: DataFrame, leaves: int, dims: int) -> Written:
    """``units`` with their ``shard``, level by level."""
    spark = units.sparkSession
    level = [_Node(leaves, 0)] if leaves > 1 else []
    held = Written(units.withColumns({"shard": F.lit(0), "node": F.lit(0 if level else -1)}), "units")
    while level:
        _cuts(held.df, level, dims)
        below: list[_Node] = []
        sides = []
        for i, x in enumerate(level):
            half = x.leaves // 2
            row: list = [i, x.dim, x.cut]
            for y in (_Node(half, x.first), _Node(x.leaves - half, x.first + half)):
                row += [y.first, len(below) if y.leaves > 1 else -1]
                below += [y] if y.leaves > 1 else []
            sides.append(tuple(row))
        table = _small(spark, sides, "node int, dim int, cut long, s0 int, n0 int, s1 int, n1 int")
        left = _key() <= F.col("cut")
        at = {"shard": F.when(F.col("cut").isNull(), F.col("shard")).when(left, F.col("s0")).otherwise(F.col("s1")), "next": F.when(F.col("cut").isNull(), -1).when(left, F.col("n0")).otherwise(F.col("n1"))}
        moved = held.df.join(table, "node", "left").withColumns(at).drop("node", "dim", "cut", "s0", "n0", "s1", "n1").withColumnRenamed("next", "node")
        after = Written(moved, "units")
        held.drop()
        held, level = after, below
    return held


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    shards: int | None = None,
    target_bytes: int | None = None,
    slack: float = 1 / 32,
) -> DataFrame:
    """``id_col``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Give ``shards``, or ``target_bytes`` for as many leaves as the bytes need. Equal texts share a shard, unless together
    they hold over ``slack`` of an average shard: such a group is dealt out in parts of that size, as sizes could not be near
    equal otherwise. A unit of equal texts lies at the smallest of its rows' values in each dimension. Strings are ordered
    by the first six bytes behind the prefix that all share, however long it is, and by a hash among equal ones; other values are taken as numbers. Dimensions that the table lacks
    are left out; the size is always one. Ties in a dimension are ordered by a hash of the text.

    Nulls: a null text has no bytes (size 1, checksum 0) and equals an empty one; a null dimension counts as its smallest value;
    null ids are sharded like any other. Repeated rows are rows each, with slots of their own. A very long text is a unit of
    its own, whatever the shard's target. An empty table gives an empty one. Other columns are not read and may
    have any names. No row is dropped; each has one shard and one slot.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [c for c in dims if c in docs.columns]
    words = {f"c{i + 1}" for i, c in enumerate(own) if dict(docs.dtypes)[c] in ("string", "binary")}
    # what all values of a string dimension share, however long, is passed over
    ends = docs.agg(F.lit(0), *[f(F.col(f"`{c}`").cast("string")) for i, c in enumerate(own) if f"c{i + 1}" in words for f in (F.min, F.max)]).first()[1:]
    shared = {k: _shared_chars(lo, hi) for k, lo, hi in zip([f"c{i + 1}" for i in range(len(own)) if f"c{i + 1}" in words], ends[::2], ends[1::2])}
    value = lambda i, c: F.substring(F.col(f"`{c}`").cast("string"), shared[f"c{i + 1}"] + 1, _CODE_CHARS) if f"c{i + 1}" in words else F.col(f"`{c}`").cast("double")
    raw = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("g1"),
        F.hash(text).alias("g2"),
        *[value(i, c).alias(f"c{i + 1}") for i, c in enumerate(own)],
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("c0", F.log2("size"))
    names = [f"c{i}" for i in range(len(own) + 1)]
    table = Written(raw, "shard")
    total = table.df.agg(F.count("*").alias("n"), F.sum("size").alias("w"), *[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    leaves = shards or max(1, math.ceil((total["w"] or 0) / (target_bytes or 1 << 30)))
    most = max(1.0, slack * (total["w"] or 0) / leaves)
    # groups of more than ``most`` bytes: fewer than leaves / slack of them, whatever the input
    large = table.df.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.count("*").alias("k")).where((F.col("w") > most) & (F.col("k") > 1))
    parts = F.least(F.ceil(F.col("w") / most), F.col("k")).alias("parts")
    rows = table.df.join(F.broadcast(large.select("g1", "g2", parts)), ["g1", "g2"], "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("at"), F.col("parts")), F.lit(0)))
    code = {c: _code(c, _shared_prefix(total[f"lo{c}"], total[f"hi{c}"])) if c in words and total[f"lo{c}"] is not None else F.col(c).cast("double") for c in names}
    units = rows.groupBy("g1", "g2", "part").agg(F.sum("size").alias("size"), *[F.min(code[c]).alias(c) for c in names])
    units = Written(units.withColumn("tie", F.pmod(F.xxhash64("g1", "g2", "part"), F.lit(1 << _TIE_BITS))), "units")
    extent = units.df.agg(*[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << _DIM_BITS) - 1

    def scaled(c: str) -> Column:
        lo, hi = extent[f"lo{c}"], extent[f"hi{c}"]
        if lo is None or not hi > lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(c) - lo) / (hi - lo) * top), F.lit(0)).cast("long")

    placed = _tree(units.df.select("g1", "g2", "part", "size", "tie", F.array(*[scaled(c) for c in names]).alias("d")), leaves, len(names))
    units.drop()
    dealt = rows.select("id", "size", "crc", "at", "g1", "g2", "part").join(placed.df.select("g1", "g2", "part", "shard"), ["g1", "g2", "part"])
    dealt = Written(dealt.select("id", "size", "crc", "shard", "at", F.spark_partition_id().alias("task")), "shard")
    table.drop(), placed.drop()
    # slots count on from those of the tasks before, so that no task numbers more rows of a shard than it has written
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.df.groupBy("shard", "task").count().select("shard", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "task").orderBy("at"))
    return dealt.df.withColumn("k", inside).join(starts, ["shard", "task"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot")
    )
