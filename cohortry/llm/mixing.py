"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells by source, language and topic. One aggregate with partial sums gives the cells' token masses;
raking scales them, one dimension after the other, to the target marginals. The rates (raked over natural mass) are
scaled by one factor so that the expected sample has the wanted share of all tokens, no rate above 1. A document is sampled
if a uniform number made from its id lies below its cell's probability: a retried task decides alike. Cells are raked on
the driver, or, where they are very many, as a table, by the same steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, packed, with_outputs

DIMS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of ASCII white space's making; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic told from the form of a text: table, list, brief, essay or prose. Another column may replace it."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    pipes, lines = n - F.length(F.replace(t, F.lit("|"), F.lit(""))), n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(20 * pipes > n, "table").when(40 * lines > n, "list").when(n < 600, "brief").when(n > 6000, "essay").otherwise("prose")


def tempered(masses: dict, power: float) -> dict:
    """Shares in proportion to the masses' ``power``: below 1 it lifts what is rare."""
    lifted = {k: v**power for k, v in masses.items()}
    total = sum(lifted.values())
    return {k: v / total for k, v in lifted.items()} if total else lifted


def scale_for(sums, budget: float) -> float:
    """The factor s with the sum of min(1, s * rate) * mass at ``budget``, or infinity where all of it is less.

    ``sums(s)`` gives the mass of the cells that s caps at 1, and the sum of rate * mass of the others. From below, each
    step caps more cells, until none is new: so many steps at most as there are distinct rates, a few as a rule.
    """
    s, capped = 0.0, -1.0
    while True:
        now, open_ = sums(s)
        if now == capped or open_ <= 0:
            return s if open_ > 0 else float("inf")
        s, capped = max(s, (budget - now) / open_), now


def array_sums(rate: np.ndarray, mass: np.ndarray):
    def sums(s: float) -> tuple[float, float]:
        full = s * rate >= 1
        return float(mass[full].sum()), float((rate * mass)[~full].sum())

    return sums


def table_sums(raked: DataFrame):
    def sums(s: float) -> tuple[float, float]:
        full = F.col("rate") * s >= 1
        r = raked.agg(F.sum(F.when(full, F.col("mass"))).alias("a"), F.sum(F.when(~full, F.col("rate") * F.col("mass"))).alias("b")).first()
        return float(r["a"] or 0), float(r["b"] or 0)

    return sums


def rake(cells: list[tuple], masses: np.ndarray, targets: list[dict], rounds: int, close: float = 1e-12) -> np.ndarray:
    """``masses`` scaled in turn to each of ``targets`` (shares by value), which are restricted to values present.

    Ends with a round in which no factor was further than ``close`` from 1, or after ``rounds``.
    """
    total, out = masses.sum(), masses.astype(float)
    if not cells:
        return out
    at = []
    for d, target in enumerate(targets):
        values = sorted({c[d] for c in cells}, key=lambda v: (v is None, str(v)))
        index = {v: i for i, v in enumerate(values)}
        share = np.array([target.get(v, 0.0) for v in values], float)
        at.append((np.array([index[c[d]] for c in cells]), share / share.sum() if share.sum() else share))
    for _ in range(rounds):
        far = 0.0
        for where, share in at:
            now = np.bincount(where, out, len(share))
            factor = np.divide(share * total, now, out=np.ones(len(share)), where=now > 0)
            far = max(far, float(np.abs(factor - 1).max(initial=0.0)))
            out = out * factor[where]
        if far <= close:
            break
    return out


def rake_table(cells: DataFrame, dims: list[str], targets: list[DataFrame], rounds: int, close: float = 1e-12) -> Written:
    """The same over a table of cells too many to collect: ``cells`` has ``dims`` and ``mass``, a target has (value, share)."""
    total = cells.agg(F.sum("mass")).first()[0]
    now = Written(cells.withColumn("raked", F.col("mass").cast("double")), "rake")
    for _ in range(rounds):
        far = 0.0
        for d, target in zip(dims, targets):
            sums = now.df.groupBy(F.col(d).alias("value")).agg(F.sum("raked").alias("s"))
            # a value without mass has nothing to scale, and the division would fail
            scaled = F.when(F.col("s") > 0, F.coalesce(F.col("share"), F.lit(0.0)) * total / F.col("s")).otherwise(1.0)
            factor = Written(sums.join(target, sums["value"].eqNullSafe(target["value"]), "left").select(sums["value"], scaled.alias("f")), "factor")
            far = max(far, factor.df.agg(F.max(F.abs(F.col("f") - 1))).first()[0] or 0.0)
            after = Written(now.df.join(factor.df, F.col(d).eqNullSafe(F.col("value"))).withColumn("raked", F.col("raked") * F.col("f")).drop("value", "f"), "rake")
            now.drop(), factor.drop()
            now = after
        if far <= close:
            break
    return now


def _shares(cells: DataFrame, key: str, power: float, given: dict | None) -> DataFrame:
    """(value, share) of a dimension: what is ``given``, restricted to values present, or tempered natural shares."""
    if given:
        named = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], f"value {cells.schema[key].dataType.simpleString()}, share double")
        have = cells.select(F.col(key).alias("v")).distinct()
        goal = Written(named.join(have, F.col("value").eqNullSafe(F.col("v")), "left_semi"), "goal").df
        total = goal.agg(F.sum("share")).first()[0] or 1.0
        return goal.select("value", (F.col("share") / total).alias("share"))
    natural = cells.groupBy(F.col(key).alias("value")).agg(F.pow(F.sum("mass"), F.lit(power)).alias("x"))
    total = natural.agg(F.sum("x")).first()[0] or 1.0
    return Written(natural.select("value", (F.col("x") / total).alias("share")), "goal").df


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, dict] | None = None, power: float = 0.7, keep_share: float = 0.8, rounds: int = 30, seed: int = 17, max_cells: int = 200_000,
) -> DataFrame:
    """All columns of ``docs``, and ``topic``, ``tokens``, ``probability`` and ``sampled`` (replacing columns of these names).

    ``targets`` has shares by value for "source", "lang" and "topic"; one left out gets the natural shares to ``power``.
    Values that a target leaves out get probability 0, with words or without; values that no document has are left out. Null sources and
    languages are values like others. Documents without words, as null and empty texts, have no mass: they take their cell's probability, or 1
    where the whole cell has none. Repeated rows decide alike; rows with a null id decide by their text. Cells of equal rates are capped
    together. Very long texts are counted whole. Input columns may have any names. An empty table gives an empty one.
    Raking ends when no marginal moves, or after ``rounds``. Up to ``max_cells`` cells are raked on the driver and broadcast;
    more are raked as a table and joined, by the same steps, so that rates differ by rounding alone.
    """
    own = F.col("row")
    text, ident = own.getField(text_col), own.getField(id_col)
    keys = ["k_source", "k_lang", "k_topic"]
    rows = docs.select(packed(docs).alias("row"), (topic if topic is not None else topic_of(F.col(f"`{text_col}`"))).cast("string").alias("k_topic"))
    rows = rows.select("row", own.getField(source_col).alias("k_source"), own.getField(lang_col).alias("k_lang"), "k_topic", token_count(text).alias("n"))
    cells = Written(rows.groupBy(*keys).agg(F.sum("n").alias("mass")), "cells")
    targets = targets or {}
    n = cells.df.count()
    spark = docs.sparkSession
    if n <= max_cells:
        got = [tuple(r) for r in cells.df.orderBy(*keys).collect()]
        names, mass = [r[:3] for r in got], np.array([r[3] for r in got], float)
        goals = []
        for d, name in enumerate(DIMS):
            natural: dict = {}
            for r in got:
                natural[r[d]] = natural.get(r[d], 0) + r[3]
            goals.append(targets.get(name) or tempered(natural, power))
        raked = rake(names, mass, goals, rounds)
        rate = np.divide(raked, mass, out=np.zeros(len(mass)), where=mass > 0)
        s = scale_for(array_sums(rate, mass), keep_share * mass.sum())
        # s is infinite where what the targets leave is less than the budget: then all of that is taken
        p = np.where(mass > 0, np.minimum(1.0, np.multiply(s, rate, out=np.zeros(len(rate)), where=rate > 0)), 1.0)
        p[[any(targets.get(name) and not targets[name].get(c[d]) for d, name in enumerate(DIMS)) for c in names]] = 0.0
        schema = ", ".join(f"`{k}` {cells.df.schema[k].dataType.simpleString()}" for k in keys)
        table = F.broadcast(spark.createDataFrame([(*c, float(x)) for c, x in zip(names, p)], f"{schema}, p double"))
    else:
        goals = [_shares(cells.df, k, power, targets.get(name)) for k, name in zip(keys, DIMS)]
        raked = rake_table(cells.df, keys, goals, rounds).df.withColumn("rate", F.when(F.col("mass") > 0, F.col("raked") / F.col("mass")).otherwise(0.0))
        s = scale_for(table_sums(raked), keep_share * raked.agg(F.sum("mass")).first()[0])
        scaled = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(s))).otherwise(0.0)
        table = raked.select(*keys, F.when(F.col("mass") > 0, scaled).otherwise(1.0).alias("p"))
        for k, name, goal in zip(keys, DIMS, goals):
            if targets.get(name):
                named = table.join(goal, F.col(k).eqNullSafe(F.col("value")), "left")
                table = named.select(*keys, F.when(F.col("share") > 0, F.col("p")).otherwise(0.0).alias("p"))
    table = table.select(*[F.col(k).alias(f"{k}_c") for k in keys], "p")
    on = [F.col(k).eqNullSafe(F.col(f"{k}_c")) for k in keys]
    joined = rows.join(table, on[0] & on[1] & on[2])
    name = F.coalesce(ident.cast("string"), F.xxhash64(text).cast("string"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return joined.select(*with_outputs(docs, "row", {"topic": F.col("k_topic"), "tokens": F.col("n"), "probability": F.col("p"), "sampled": u < F.col("p")}))
