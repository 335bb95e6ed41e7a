"""Folds, class weights and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import argmax, normalized
from .metric import scratch
from .quantiles import running_sums


def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """(label, n, weight): n / (classes present * count); 1.0 for a class that no row has."""
    dims = df.sparkSession.createDataFrame([(c,) for c in classes], f"`{label}` {df.schema[label].dataType.simpleString()}")
    counts = dims.join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count_if(F.col("n") > 0).alias("present"))
    return counts.join(total, how="cross").select(label, "n", F.when(F.col("n") > 0, F.col("all") / (F.col("present") * F.col("n"))).otherwise(1.0).alias("weight"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42, block: int = 20_000) -> DataFrame:
    """``fold``: in each label, the row's place in the order of md5(key|seed), modulo ``k``.

    Places come from counts of ranges of the hash and the place inside a range, so that a frequent label is not sorted in one task.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    n = df.count()
    digits = 0
    while n / 16**digits > block:
        digits += 1
    part = hashed.withColumn("__p", F.substring("__h", 1, digits))
    starts = part.groupBy(label, "__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(label).alias("__l"), F.col("__p").alias("__q"), before.alias("__start"))
    placed = part.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__p").orderBy("__h", key)) - 1)
    joined = placed.join(starts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn("fold", ((F.col("__start") + F.col("__r")) % k).cast("int")).drop("__h", "__p", "__r", "__l", "__q", "__start")


def usable_folds(df: DataFrame, label: str, k: int) -> int:
    """At least 2, at most ``k`` and the rarest class's rows."""
    rarest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 2
    return min(max(2, k), max(2, rarest))


def greedy_turns(loads: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """(start, length, folds): how ``count`` groups of one size go to the folds with the fewest rows (the first of equal ones); changes ``loads``.

    Groups go round among the folds that are within one group of the lowest, in the order of their rows, until the next fold is reached, which then
    joins in. So there are at most as many turns as folds, whatever the count.
    """
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    active, waiting, start, out = order[:1], order[1:], 0, []
    while start < count:
        active.sort(key=lambda i: (loads[i], i))
        if waiting:
            m = waiting[0]
            gaps = [loads[m] - loads[i] for i in active]
            # groups that a fold takes before the waiting one has fewer rows, or as few and comes first
            many = sum(0 if g < 0 else -(-g // size) + (g % size == 0 and i < m) for g, i in zip(gaps, active))
        else:
            many = count - start
        many = min(many, count - start)
        if many:
            out.append((start, many, list(active)))
            for place, i in enumerate(active):
                loads[i] += size * ((many - place + len(active) - 1) // len(active))
        start += many
        if waiting:
            active.append(waiting.pop(0))
    return out


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): whole groups, the largest first, each to the fold with the fewest rows so far. Null is a group.

    Groups of equal size differ only by their place among them, in the order of names, and where a run of them goes has a closed form. So the
    driver sees the number of groups of each size and no group; groups are ranked by ranges, so that no task sorts all of those of a size.
    """
    spark = df.sparkSession
    sizes = scratch(df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("__NA__")).alias("g")).agg(F.count("*").alias("n")), "sizes")
    counts = sorted(((r["n"], r["count"]) for r in sizes.groupBy("n").count().collect()), reverse=True)
    total = sum(c for _, c in counts)
    k = max(1, min(k, total))
    loads, turns, before = [0] * k, [], 0
    for n, c in counts:
        turns += [(n, before + start, before + start + length, folds) for start, length, folds in greedy_turns(loads, n, c)]
        before += c
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch(sizes.repartitionByRange(parts, F.desc("n"), F.asc("g")).select("g", "n", F.spark_partition_id().alias("p")), "ranged")
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = ranged.groupBy("p").count().select("p", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    placed = ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "g")) - 1).join(F.broadcast(starts), "p").withColumn("r", F.col("r") + F.col("ahead"))
    table = spark.createDataFrame(turns, "n long, lo long, hi long, folds array<int>")
    table = F.broadcast(table) if len(turns) <= 100_000 else table
    found = placed.join(table, "n").where("r >= lo and r < hi")
    return found.select(F.col("g").alias(group), "n", F.get("folds", ((F.col("r") - F.col("lo")) % F.size("folds")).cast("int")).alias("fold"))


def fold_class_counts(df: DataFrame, fold: str, label: str, classes: list) -> DataFrame:
    return df.groupBy(fold).agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])


def renormalized(p: Column) -> Column:
    """Probabilities clipped to [1e-9, 1], summing to 1."""
    return normalized(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1.0))))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Support, precision, recall and F1 of each class in the truth or the predictions; 0 where undefined. From one confusion table."""
    c = confusion(df, truth, pred)
    long = c.select(F.inline(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    s = long.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, sup, pre = F.col("tp"), F.col("support"), F.col("predicted")
    return s.select("class", "support", ratio(tp, pre).alias("precision"), ratio(tp, sup).alias("recall"), ratio(2.0 * tp, sup + pre).alias("f1"))


def basic_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, macro and weighted F1, and balanced accuracy (over classes present in the truth)."""
    m = class_metrics(df, truth, pred)
    sup = F.sum("support")
    return m.agg((F.sum(F.col("recall") * F.col("support")) / sup).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / sup).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def log_loss(df: DataFrame, truth_index: str, probs: str) -> DataFrame:
    return df.select(F.get(renormalized(F.col(probs)), F.col(truth_index)).alias("p")).agg((-F.avg(F.ln("p"))).alias("log_loss"))


def _score_counts(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(score.alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))


def _areas(counts: DataFrame, by: str | None = None) -> DataFrame:
    """``auroc`` of counts (s, p, n), for each value of ``by``: a negative below counts 1, one of equal score a half."""
    s = running_sums(counts, "s", {"below": "n"}, inclusive=False, by=by)
    t = s.groupBy(*([by] if by else [])).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(*([by] if by else []), F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def auroc(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Area under the curve by average ranks. Null with one class only."""
    return _areas(_score_counts(df, positive, score))


def macro_auroc(df: DataFrame, truth_index: str, probs: str, classes: int) -> DataFrame:
    """Mean of one-against-rest areas, all classes in one pass; null should one be undefined."""
    each = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("class"), F.get(F.col(probs), c).alias("s"), (F.col(truth_index) == c).alias("hit")))
    counts = df.select(F.inline(each)).groupBy("class", "s").agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n"))
    return _areas(counts, "class").agg(F.when(F.count("auroc") == classes, F.avg("auroc")).alias("macro_auroc"))


def average_precision(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Sum over distinct scores, from the highest, of the gain in recall times the precision there."""
    s = _score_counts(df, positive, score).withColumn("both", F.col("p") + F.col("n"))
    r = running_sums(s, "s", {"tp": "p", "k": "both"}, descending=True)
    return r.agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.sum("p")).otherwise(0.0).alias("average_precision"))


def aggregate_folds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, min) over folds, without NaN, with the population's deviation."""
    clean = [(m, F.nanvl(F.col(m), F.lit(None).cast("double"))) for m in metrics]
    row = df.agg(*[f(c).alias(f"{k}_{m}") for m, c in clean for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{k}_{m}").alias(k) for k in ("mean", "std", "min")]) for m in metrics])))


def with_prediction(df: DataFrame, probs: str) -> DataFrame:
    return df.withColumn("prediction", argmax(F.col(probs)))
