"""Two-stage pseudo-labels: weak scores and a threshold search, then votes of several clusterings."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import argmax, clip, normalized, relative_distance, sigmoid
from .features import standardize
from .quantiles import column_quantiles


def anchors(score: Column, low: float, high: float) -> tuple[Column, Column]:
    """Weak negative and positive labels; both may hold."""
    return (score <= low), (score >= high)


def anchors_with_fallback(df: DataFrame, score: str, positive: Column, negative: Column, least: int = 10, q_low: float = 0.25, q_high: float = 0.75) -> DataFrame:
    """``anchor_pos`` and ``anchor_neg``; a side with fewer than ``least`` rows is taken by a quantile of the score."""
    out = df.withColumn("anchor_pos", positive).withColumn("anchor_neg", negative)
    n = out.agg(F.count_if("anchor_pos").alias("p"), F.count_if("anchor_neg").alias("n")).first()
    if min(n["p"], n["n"]) < least:
        lo, hi = column_quantiles(out, [score], [q_low, q_high])[score]
        if n["p"] < least:
            out = out.withColumn("anchor_pos", F.col(score) >= hi)
        if n["n"] < least:
            out = out.withColumn("anchor_neg", F.col(score) <= lo)
    return out


def stage1_scores(df: DataFrame, heuristic: str, d_pos: str, d_neg: str, density: str) -> DataFrame:
    """``score_raw``: 0.55 z(heuristic) + 0.30 z(relative distance) - 0.15 z(density), and its sigmoid as ``prob``."""
    work = df.withColumn("__h", F.col(heuristic)).withColumn("__r", relative_distance(F.col(d_pos), F.col(d_neg))).withColumn("__k", F.col(density))
    z = standardize(work, ["__h", "__r", "__k"], zero=float("inf"), least=1e-12)
    out = z.withColumn("score_raw", 0.55 * F.col("__h") + 0.30 * F.col("__r") - 0.15 * F.col("__k"))
    return out.withColumn("prob", sigmoid(F.col("score_raw"))).drop("__h", "__r", "__k")


def balanced_cut(df: DataFrame, prob: str, pos: str, neg: str, points: int = 61, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """(np, nq, t, balanced_accuracy) at each point of the grid: one pass counts the anchors by the grid points that they reach,
    and each point adds up these few counts."""
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    p, q = F.col(pos).cast("boolean"), F.col(neg).cast("boolean")
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(prob)))
    counts = df.groupBy(reached.alias("reached")).agg(F.count_if(p).alias("p"), F.count_if(q).alias("q"))
    each = counts.select("*", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "t"))
    hit, total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)), lambda c: F.sum(c)
    sums = each.groupBy("i", "t").agg(total("p").alias("np"), total("q").alias("nq"), hit("p", F.col("reached") > F.col("i")).alias("a"), hit("q", F.col("reached") <= F.col("i")).alias("b"))
    return sums.select("np", "nq", "t", ((F.try_divide(F.col("a"), F.col("np")) + F.try_divide(F.col("b"), F.col("nq"))) / 2).alias("balanced_accuracy"))


def threshold_search(df: DataFrame, prob: str, pos: str, neg: str, least: int = 5, floor: float = 0.3, ceiling: float = 0.75) -> float:
    """The grid's first best point within bounds; 0.5 with fewer than ``least`` anchors on a side."""
    rows = balanced_cut(df, prob, pos, neg).collect()
    if not rows or rows[0]["np"] < least or rows[0]["nq"] < least:
        return 0.5
    best = max(rows, key=lambda r: (r["balanced_accuracy"], -r["t"]))
    return min(max(best["t"], floor), ceiling)


def guarded_threshold(df: DataFrame, prob: str, t: float, least: int = 30, spare: int = 15, q: float = 0.3) -> float:
    """``t``, or a quantile of the probabilities where it would leave too few rows on a side."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.col(prob) >= t).alias("p")).first()
    return column_quantiles(df, [prob], [q])[prob][0] if r["p"] < least or r["p"] > r["n"] - spare else t


def votes(df: DataFrame, models: list[str], k: int) -> DataFrame:
    """Shares of the models that vote for each of ``k`` clusters, the consensus (first of equal ones) and its share."""
    every = F.array(*[F.col(m) for m in models])
    shares = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter(every, lambda v: v == c)) / len(models))
    return df.withColumn("vote_shares", shares).withColumn("cluster_consensus", argmax(F.col("vote_shares"))).withColumn("confidence", F.array_max("vote_shares"))


def size_ranks(df: DataFrame, cluster: str, k: int) -> DataFrame:
    """(cluster, n, drug_index) of all ``k`` clusters, the largest first from 1; of equal ones the smaller number."""
    dims = df.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    sizes = dims.join(df.groupBy(cluster).agg(F.count("*").alias("n")), cluster, "left").select(cluster, F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.withColumn("drug_index", F.row_number().over(Window.orderBy(F.desc("n"), cluster)))


def _tables(df: DataFrame, ref: str, cands: list[str], k: int) -> dict[str, list[list[int]]]:
    """Of each candidate the rows of each label (down) and reference label (across), of the labels 0 to k - 1: one pass, k times k counts to the driver."""
    labels = list(range(k))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("int").alias("b")) for i, c in enumerate(cands)])
    met = df.where(F.col(ref).isin(labels)).select(F.col(ref).cast("int").alias("a"), F.inline(each)).where(F.col("b").isin(labels))
    counts = {(r["i"], r["a"], r["b"]): r["count"] for r in met.groupBy("i", "a", "b").count().collect()}
    return {c: [[counts.get((i, a, b), 0) for a in labels] for b in labels] for i, c in enumerate(cands)}


def align_labels(df: DataFrame, ref: str, cand: str | list[str], k: int) -> DataFrame:
    """(model, ordinal, permutation, matches): rows on which a permuted candidate agrees with the reference, for all k! permutations.

    A report for few labels; ``best_permutations`` finds the best for any number.
    """
    cands = [cand] if isinstance(cand, str) else cand
    rows = [(c, i, list(p), sum(t[b][p[b]] for b in range(k))) for c, t in _tables(df, ref, cands, k).items() for i, p in enumerate(itertools.permutations(range(k)))]
    return df.sparkSession.createDataFrame(rows, "model string, ordinal int, permutation array<int>, matches long")


def best_assignment(gain: list[list[int]]) -> list[int]:
    """The column of each row, all different, of the greatest summed gain; of equal ones the first in the order of the lists.

    Prices are raised along shortest augmenting paths (the Hungarian method). The assignments of greatest gain are those of edges whose price is met exactly,
    so each row in turn takes its first such column that still leaves an assignment for all.
    """
    k = len(gain)
    u, v, row_of = [0] * k, [0] * k, [-1] * k
    for start in range(k):
        least, way, done, at, col = [None] * k, [-1] * k, [False] * k, start, -1
        while True:
            step, nxt = None, -1
            for j in range(k):
                if not done[j]:
                    cost = -gain[at][j] - u[at] - v[j]
                    if least[j] is None or cost < least[j]:
                        least[j], way[j] = cost, col
                    if step is None or least[j] < step:
                        step, nxt = least[j], j
            u[start] += step
            for j in range(k):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            done[nxt], col = True, nxt
            if row_of[nxt] < 0:
                break
            at = row_of[nxt]
        while col >= 0:
            row_of[col] = row_of[way[col]] if way[col] >= 0 else start
            col = way[col]
    tight = [[j for j in range(k) if -gain[i][j] == u[i] + v[j]] for i in range(k)]
    out = [0] * k
    for j, i in enumerate(row_of):
        out[i] = j
    for i in range(k):
        for j in tight[i]:
            if j == out[i]:
                break
            if j not in out[:i] and (moved := _rematched(tight, out, i, j)):
                out = moved
                break
    return out


def _rematched(tight: list[list[int]], out: list[int], row: int, col: int) -> list[int] | None:
    """``out`` with ``col`` for ``row``, earlier rows as they are and later ones moved along an alternating path, if there is one."""
    lost, free = out.index(col), out[row]
    came, todo = {lost: None}, [lost]
    while todo:
        i = todo.pop(0)
        for j in tight[i]:
            if j == col or j in out[:row]:
                continue
            if j == free:
                got = list(out)
                got[row] = col
                while i is not None:
                    j, got[i], i = got[i], j, came[i]
                return got
            other = out.index(j)
            if other not in came:
                came[other] = i
                todo.append(other)
    return None


def best_permutations(df: DataFrame, ref: str, cands: list[str], k: int) -> dict[str, list[int]]:
    """The permutation of each candidate that agrees the most; of equal ones the first in order."""
    return {c: best_assignment(t) for c, t in _tables(df, ref, cands, k).items()}


def best_permutation(df: DataFrame, ref: str, cand: str, k: int) -> list[int]:
    return best_permutations(df, ref, [cand], k)[cand]


def relabel(c: Column, permutation: list[int]) -> Column:
    """Through the permutation; unknown labels become 0."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in permutation]), c), F.lit(0))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2.0


def pairwise_ari(df: DataFrame, models: list[str]) -> DataFrame:
    """(model_a, model_b, ari) for all pairs of models: one pass counts the contingency tables of all, and their margins and totals follow."""
    pairs = list(itertools.combinations(range(len(models)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "model_a string, model_b string, ari double")
    each = F.array(*[F.struct(F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"), F.col(models[i]).alias("a"), F.col(models[j]).alias("b")) for i, j in pairs])
    key = ["model_a", "model_b"]
    cells = df.select(F.inline(each)).groupBy(*key, "a", "b").agg(F.count("*").alias("n"))
    rows = cells.groupBy(*key, "a").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum(_pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(*key, "b").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum(_pairs(F.col("n"))).alias("sb"))
    one = cells.groupBy(*key).agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(rows, key).join(cols, key)
    expected = F.col("sa") * F.col("sb") / F.greatest(_pairs(F.col("n")), F.lit(1e-300))
    top = (F.col("sa") + F.col("sb")) / 2.0
    return one.select(*key, F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` of two labelings."""
    return pairwise_ari(df, [a, b]).select("ari")


def blend(df: DataFrame, prob: str, label: str, shares: str, affinity: str, order: list[int], w: float = 0.7) -> DataFrame:
    """Outputs of both stages: conditional shares blended for labelled rows, in drug order, times the first stage's
    probability. The label comes from the stages, not from the largest probability; confidence is the label's probability.
    """
    mixed = F.zip_with(shares, affinity, lambda a, b: w * a + (1 - w) * b)
    cond = normalized(F.when(F.col(label) == 1, mixed).otherwise(F.col(affinity)))
    ordered = F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(cond, i))
    p_no = clip(1.0 - F.col(prob), 1e-9, 1.0)
    drugs = F.transform(ordered, lambda c: clip(F.col(prob) * c, 1e-9, 1.0))
    every = normalized(F.concat(F.array(p_no), drugs))
    index = F.array_position(F.array(*[F.lit(i) for i in order]), F.col("cluster_consensus")).cast("int")
    out = df.withColumn("p", every).withColumn("drug_index", F.when(F.col(label) == 1, index).otherwise(0))
    return out.withColumn("label_name", F.when(F.col("drug_index") == 0, "No_Festival").otherwise(F.concat(F.lit("Drug_"), F.col("drug_index").cast("string")))).withColumn("label_confidence", F.get("p", F.col("drug_index")))


def shift_metrics(df: DataFrame, label_a: str, label_b: str, prob_a: str, prob_b: str) -> DataFrame:
    """How often labels differ, and by how much probabilities do on average."""
    return df.agg(F.avg((F.col(label_a) != F.col(label_b)).cast("double")).alias("flip_rate"), F.avg(F.abs(F.col(prob_a) - F.col(prob_b))).alias("mean_abs_shift"))


def anchor_balanced_accuracy(df: DataFrame, label: str, pos: str, neg: str, least: int = 5) -> DataFrame:
    """(TPR + TNR) / 2 over the anchors; null unless either side has ``least``."""
    p, q = F.col(pos).cast("boolean"), F.col(neg).cast("boolean")
    r = df.agg(F.count_if(p).alias("np"), F.count_if(q).alias("nq"), F.count_if(p & (F.col(label) == 1)).alias("tp"), F.count_if(q & (F.col(label) == 0)).alias("tn"))
    return r.select(F.when((F.col("np") >= least) & (F.col("nq") >= least), (F.col("tp") / F.col("np") + F.col("tn") / F.col("nq")) / 2).alias("balanced_accuracy"))
