"""Encounter-style inputs made from the star-schema tables: notes, scores, event cells and pseudo-models.

Everything here is arithmetic over keys, so that another engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: (divisor of the customer key, phrase) of the notes.
PHRASES = ((2, "severe"), (3, "tachycardia"), (4, "sweating"), (5, "dilated pupils"), (6, "mild"), (7, "agitated"), (9, "acute"), (10, "hypertensive"), (11, "clonus"), (13, "seizure"), (17, "hallucinations"), (19, "chest pain"), (23, "3 days"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, note): phrases whose divisor divides the key."""
    c = table(spark, sf, "customer")
    note = F.concat_ws(" ", *[F.when(F.col("c_custkey") % d == 0, F.lit(p)) for d, p in PHRASES])
    return c.select("c_custkey", note.alias("note"))


def hash_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{salt}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a made score on a grid of 1000 points, and probabilities of three classes."""
    x = table(spark, sf, "labels").withColumn("y", (F.col("quality") + F.col("toxic")).cast("int"))
    x = x.withColumn("score", F.floor((0.7 * hash_unit(F.col("doc_id"), "s") + 0.3 * F.col("toxic")) * 1000) / 1000)
    u = [0.1 + hash_unit(F.col("doc_id"), f"p{i}") + F.when(F.col("y") == i, 0.4).otherwise(0.0) for i in range(3)]
    total = u[0] + u[1] + u[2]
    return x.withColumn("probs", F.array(*[c / total for c in u]))


def voters(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, m0 to m4): five pseudo-clusterings into three, mostly alike up to their names."""
    d = table(spark, sf, "documents").select("doc_id")
    base = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long") % 3).cast("int")
    cols = []
    for m in range(5):
        other = (F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"|m{m}"))), 1, 6), 16, 10).cast("long") % 10).cast("int")
        cols.append(F.when(other < 8, (base + m) % 3).otherwise(other % 3).cast("int").alias(f"m{m}"))
    return d.select("doc_id", base.alias("base"), *cols)


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, cell): each user's events as a list of dicts in Python's notation, in order of time."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", F.concat(F.lit("{'minute': "), (F.hour("ts") * 60 + F.minute("ts")).cast("string"), F.lit(", 'value': "), F.when(F.col("event_id") % 17 == 0, "None").otherwise(F.col("value").cast("decimal(18,4)").cast("string")), F.lit(", 'event_type': '"), F.col("event_type"), F.lit("'}")).alias("item")).alias("s"))
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return g.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ", "), F.lit("]")).alias("cell"))
