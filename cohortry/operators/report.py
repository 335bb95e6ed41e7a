"""Ranked examples of each category, and reports as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded_text
from .contracts import ContractError


def category_order(label: Column) -> list[Column]:
    """Sort keys: ``Drug_n`` by number, then ``No_Festival``, then others by name."""
    number = F.regexp_extract(label, r"^Drug_(\d+)$", 1)
    rank = F.when(number != "", 0).when(label == "No_Festival", 1).otherwise(2)
    return [rank, F.when(number != "", number.try_cast("int")).otherwise(0), label]


def choose_categories(df: DataFrame, label: str, wanted: list[str] | None = None, prefix: str | None = None, limit: int = 10_000) -> list[str]:
    """Categories in order, or ``wanted`` ones, which must exist; fails beyond ``limit``, as each becomes a section."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(*category_order(F.col(label))).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ContractError(f"{label} has more than {limit} categories")
    if wanted is not None:
        if odd := [w for w in wanted if w not in found]:
            raise ContractError(f"no such category: {odd}")
        return wanted
    return [f for f in found if prefix is None or f.startswith(prefix)]


def top_examples(df: DataFrame, category: str, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each category; of equal scores the smaller key. Spark prunes to ``k`` a task before the exchange."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), key))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def sampled_examples(df: DataFrame, category: str, score: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each category by the order of md5(key|seed), ranked by score."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    picked = df.withColumn("__h", h).withColumn("__r", F.row_number().over(Window.partitionBy(category).orderBy("__h", key))).where(F.col("__r") <= k)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), key))).drop("__h", "__r")


def vitals_shorthand(hr: Column, rr: Column, sbp: Column, dbp: Column, spo2: Column, temp: Column, gcs: Column, o2: Column) -> Column:
    n = rounded_text
    return F.concat(F.lit("HR "), n(hr), F.lit(" | RR "), n(rr), F.lit(" | BP "), n(sbp), F.lit("/"), n(dbp), F.lit(" | SpO2 "), n(spo2), F.lit("% | Temp "), n(temp, 1), F.lit("C | GCS "), n(gcs), F.lit(" | SuppO2 "), n(o2))


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown; a last line says how many rows it leaves out, if any."""
    rows = df.limit(limit).collect()
    more = df.count() - limit if len(rows) == limit else 0
    text = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(text, r)) + " |" for r in rows), *([f"\n{more} more rows"] if more > 0 else [])])


def metric_table(df: DataFrame, as_text: bool = False) -> DataFrame:
    """One row of aggregates as (metric, value) rows; as text where kinds are mixed."""
    kind = "string" if as_text else "double"
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast(kind).alias("value")) for c in df.columns])))


def console_summary(metrics: DataFrame, title: str = "", say: Callable[[str], None] = print) -> None:
    """Rows (metric, value) as aligned lines between rules, for a terminal."""
    rows = [(str(r["metric"]), "" if r["value"] is None else f"{r['value']:.6f}" if isinstance(r["value"], float) else str(r["value"])) for r in metrics.select("metric", "value").collect()]
    wide = max([len(m) for m, _ in rows], default=0)
    say("---")
    for line in ([title] if title else []) + [f"{m + ':':<{wide + 1}} {v}" for m, v in rows]:
        say(line)
    say("---")


def examples_report(df: DataFrame, category: str, fields: list[str], title: str, most: int = 10_000) -> str:
    """Markdown with a section for each category in order; ``df`` has the few rows to show, ``most`` at most, with a ``rank``."""
    rows = df.orderBy("rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"more than {most} examples")
    out = [f"# {title}"]
    for c in choose_categories(df, category):
        out += ["", f"## {c}"]
        for r in (x for x in rows if x[category] == c):
            out += ["", f"### {r['rank']}", *[f"- {f}: {r[f]}" for f in fields]]
    return "\n".join(out)
