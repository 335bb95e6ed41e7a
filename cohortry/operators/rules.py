"""Rule-based symptoms in text, and their match with prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import argmax, clip, nonzero
from .model import kmeans
from .vectors import similarities

# Names, patterns and weights of symptoms, severities and onsets, prototypes and scales.
SYMPTOMS = (
    ("tachycardia", (r"tachycard", r"heart rate\s*(?:>|of\s*)?\s*1[01]\d", r"hr\s*(?:>|of\s*)?\s*1[01]\d"), 1.0),
    ("diaphoresis", (r"diaphoret", r"sweat(?:ing)?"), 1.0),
    ("mydriasis", (r"mydriasis", r"dilated pupils?"), 1.2),
    ("agitation", (r"agitat", r"restless", r"combative"), 1.0),
    ("hyperthermia", (r"hypertherm", r"temp(?:erature)?\s*(?:>|of\s*)?\s*(?:10[01]|39)"), 1.4),
    ("clonus", (r"clonus", r"hyperreflex"), 1.5),
    ("hallucination", (r"hallucin", r"psychosis", r"paranoid"), 1.0),
    ("seizure", (r"seizure", r"convuls"), 1.3),
    ("hypertension", (r"hypertens", r"bp\s*(?:>|of\s*)?\s*1[6-9]\d"), 0.9),
    ("chest_pain", (r"chest pain", r"palpitation"), 0.8),
)
PROTOTYPES = {
    "Drug_1": {"tachycardia": 1.0, "diaphoresis": 1.0, "mydriasis": 1.0, "agitation": 0.9, "hypertension": 0.8},
    "Drug_2": {"hyperthermia": 1.0, "clonus": 1.0, "mydriasis": 0.8, "agitation": 0.8, "seizure": 0.6},
    "Drug_3": {"hallucination": 1.0, "agitation": 0.9, "tachycardia": 0.6, "hypertension": 0.5, "mydriasis": 0.5},
}
SEVERITY = (("mild", r"\bmild\b"), ("moderate", r"\bmoderate\b"), ("severe", r"\bsevere\b|\bextreme\b|\bmarked\b"))
ONSET = (("sudden", r"\bsudden\b|\bacute\b"), ("hours", r"\b\d+\s*hours?\b|\bthis evening\b|\btoday\b"), ("days", r"\b\d+\s*days?\b|\bfor days\b"))
SEVERITY_SCALE = {"unknown": 0.8, "mild": 0.8, "moderate": 1.0, "severe": 1.2}
NO_PARTY = "No_Party_Drug"


def first_match(low: Column, rules: tuple[tuple[str, str], ...], otherwise: str = "unknown") -> Column:
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in rules], F.lit(otherwise))


def symptom_triples(text: Column, symptoms=SYMPTOMS) -> Column:
    """Structs of symptom, severity and onset for each symptom that the text names, in the rules' order.

    Severity and onset are the text's first that match. Negations are not looked at.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    severity, onset = first_match(low, SEVERITY), first_match(low, ONSET)
    found = [F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.struct(F.lit(n).alias("symptom"), severity.alias("severity"), onset.alias("onset_timing"))) for n, ps, _ in symptoms]
    return F.array_compact(F.array(*found))


def with_triples(df: DataFrame, text: Column, name: str = "triples", symptoms=SYMPTOMS) -> DataFrame:
    """The same as a column, in steps that a plan keeps apart: each expression runs once a text, not once a symptom or a reader."""
    low = df.withColumn("__low", F.lower(F.coalesce(text, F.lit(""))))
    told = low.withColumns({"__severity": first_match(F.col("__low"), SEVERITY), "__onset": first_match(F.col("__low"), ONSET)})
    found = [F.when(F.col("__low").rlike("|".join(f"(?:{p})" for p in ps)), F.struct(F.lit(n).alias("symptom"), F.col("__severity").alias("severity"), F.col("__onset").alias("onset_timing"))) for n, ps, _ in symptoms]
    return told.withColumn(name, F.array_compact(F.array(*found))).drop("__low", "__severity", "__onset")


def symptom_vector(triples: Column, symptoms=SYMPTOMS) -> Column:
    """For each symptom its weight times the highest scale of its severities, or 0."""
    scale = lambda t: F.coalesce(*[F.when(t["severity"] == s, F.lit(x)) for s, x in SEVERITY_SCALE.items()], F.lit(1.0))
    return F.array(*[F.coalesce(F.array_max(F.transform(F.filter(triples, lambda t: t["symptom"] == n), lambda t: scale(t) * w)), F.lit(0.0)) for n, _, w in symptoms])


def prototype_rows(prototypes=None, symptoms=SYMPTOMS) -> list[list[float]]:
    return [[float(spec.get(n, 0.0)) for n, *_ in symptoms] for spec in (prototypes or PROTOTYPES).values()]


def prototype_match(df: DataFrame, vector: str, prototypes=None, least_similarity: float = 0.35, least_evidence: int = 2, low_confidence: float = 0.55) -> DataFrame:
    """Adds similarities, their maximum, evidence, confidence, label, and whether the row is a low-confidence case."""
    own = prototypes or PROTOTYPES
    v = F.col(vector)
    out = df.withColumn("similarities", similarities(v, prototype_rows(own))).withColumn("evidence", nonzero(v)).withColumn("max_similarity", F.array_max("similarities"))
    out = out.withColumn("confidence", 0.7 * F.col("max_similarity") + 0.3 * clip(F.col("evidence") / 5.0, 0.0, 1.0))
    none = (F.col("max_similarity") < least_similarity) | (F.col("evidence") < least_evidence)
    best = F.get(F.array(*[F.lit(n) for n in own]), argmax(F.col("similarities")))
    return out.withColumn("label", F.when(none, NO_PARTY).otherwise(best)).withColumn("residual", ~none & (F.col("confidence") < low_confidence))


def residual_labels(df: DataFrame, key: str, vector: str, text_vector: str, least: int = 9, k: int = 3, seeds: tuple[int, ...] = (42, 43, 44), prototypes=None) -> DataFrame:
    """``prototype_match`` with low-confidence rows relabelled: clustered, each cluster by its center's nearest prototype.

    Fewer than ``least`` such rows keep their label.
    """
    own = prototypes or PROTOTYPES
    matched = prototype_match(df, vector, own).cache()  # read by each start of the clustering, and by the join
    low = matched.where("residual").select(key, F.concat(F.col(vector), F.col(text_vector).cast("array<double>")).alias("both"))
    if low.limit(least).count() < least:
        return matched
    model, clustered = kmeans(low, "both", k, seeds)
    rows, names, labels = prototype_rows(own), list(own), []
    for c in model.clusterCenters():
        c = [float(x) for x in c[: len(rows[0])]]
        cos = [sum(a * b for a, b in zip(c, p)) / ((sum(a * a for a in c) * sum(b * b for b in p)) ** 0.5 or 1.0) for p in rows]
        labels.append(names[cos.index(max(cos))])
    named = clustered.select(key, F.get(F.array(*[F.lit(x) for x in labels]), F.col("cluster")).alias("relabel"))
    return matched.join(named, key, "left").withColumn("label", F.coalesce("relabel", "label")).drop("relabel")
