"""Structured extraction: schema, coercion, features, and the client that extracts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ws

# The enumerations of the extraction record.
ENUMS = {
    "polarity": ("present", "absent", "uncertain"),
    "severity": ("mild", "moderate", "severe", "unknown"),
    "onset": ("sudden", "gradual", "unknown"),
    "arrival_mode": ("ems", "festival_tent_transfer", "walk_in", "private_vehicle", "police", "other", "unknown"),
    "patient_origin": ("main_stage", "campground", "vip_tent", "beach_shuttle_stop", "medical_tent", "offsite", "unknown"),
    "suspected_substance_exposure": ("yes", "no", "unclear"),
    "mental_status": ("normal", "anxious", "agitated", "confused", "somnolent", "psychotic", "unknown"),
}
DEFAULTS = {"arrival_mode": "unknown", "patient_origin": "unknown", "suspected_substance_exposure": "unclear", "mental_status": "unknown"}
RAW = (
    "struct<symptoms:array<struct<name:string,polarity:string,severity:string,duration_minutes:string,onset:string>>,arrival_mode:string,patient_origin:string,"
    "time_prior_to_arrival_minutes:string,suspected_substance_exposure:string,mental_status:string,confidence:string>"
)


def _minutes(c: Column) -> Column:
    """Rounded half to even; null unless a number of at least 0."""
    n = F.bround(c.try_cast("double"), 0).cast("long")
    return F.when(n >= 0, n)


def coerce(raw: Column) -> Column:
    """A record read leniently (all leaves as strings) with defaults for what is missing and nulls for what is unusable.

    Symptoms without a name go.
    """
    symptoms = F.filter(F.coalesce(raw["symptoms"], F.array().cast("array<struct<name:string,polarity:string,severity:string,duration_minutes:string,onset:string>>")), lambda s: s.isNotNull() & s["name"].isNotNull() & (s["name"] != ""))
    fixed = F.transform(symptoms, lambda s: F.struct(s["name"].alias("name"), s["polarity"].alias("polarity"), s["severity"].alias("severity"), _minutes(s["duration_minutes"]).alias("duration_minutes"), s["onset"].alias("onset")))
    rest = [F.coalesce(raw[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    return F.struct(fixed.alias("symptoms"), *rest, _minutes(raw["time_prior_to_arrival_minutes"]).alias("time_prior_to_arrival_minutes"), F.coalesce(raw["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"))


def unreadable(text: Column) -> Column:
    """True for a response that is null, blank, or no JSON object."""
    return F.coalesce(F.json_object_keys(text).isNull(), F.lit(True))


def read_extraction(text: Column, strict: bool = False) -> Column:
    """JSON text to a coerced record. Unreadable text gives the default one, or fails the query if ``strict``."""
    if strict:
        text = F.when(unreadable(text), F.raise_error(F.concat(F.lit("no JSON object: "), F.coalesce(F.left(text, F.lit(80)), F.lit("null")))).cast("string")).otherwise(text)
    return coerce(F.from_json(F.coalesce(text, F.lit("{}")), RAW))


#: Fields that a record must have, all of them and no others.
FIELDS = ("symptoms", "arrival_mode", "patient_origin", "time_prior_to_arrival_minutes", "suspected_substance_exposure", "mental_status", "confidence")
SYMPTOM_FIELDS = ("name", "polarity", "severity", "duration_minutes", "onset")


def schema_violations(text: Column) -> Column:
    """What the schema finds wrong in a response, in order: ``unreadable``, or fields missing, unknown, or with a value not allowed."""
    array = lambda names: F.array(*[F.lit(n) for n in names])
    label = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(f"{kind}:"), n))
    keys = F.json_object_keys(text)
    items = F.coalesce(F.from_json(F.get_json_object(text, "$.symptoms"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    inner = F.transform(items, lambda m: F.map_keys(m))
    absent = F.array_distinct(F.flatten(F.transform(inner, lambda k: F.array_except(array(SYMPTOM_FIELDS), k))))
    extra = F.array_distinct(F.flatten(F.transform(inner, lambda k: F.array_except(k, array(SYMPTOM_FIELDS)))))
    found = F.concat(
        label("missing", F.array_except(array(FIELDS), keys)), label("unknown", F.array_except(keys, array(FIELDS))), label("missing", F.transform(F.array_sort(absent), lambda n: F.concat(F.lit("symptoms."), n))),
        label("unknown", F.transform(F.array_sort(extra), lambda n: F.concat(F.lit("symptoms."), n))), label("value", violations(F.from_json(text, RAW))),
    )
    return F.when(unreadable(text), F.array(F.lit("unreadable"))).otherwise(found)


def violations(record: Column) -> Column:
    """Names of the fields whose value the schema does not allow."""
    top = [F.when(~record[k].isin(*ENUMS[k]), F.lit(k)) for k in DEFAULTS]
    inside = [F.when(F.exists(record["symptoms"], lambda s: ~F.coalesce(s[k], F.lit("")).isin(*ENUMS[k])), F.lit(f"symptoms.{k}")) for k in ("polarity", "severity", "onset")]
    return F.array_compact(F.array(*top, *inside))


def entity_summary(record: Column) -> Column:
    """Distinct symptom names, lower-cased and in order, as one text with the context."""
    names = F.array_sort(F.array_distinct(F.transform(record["symptoms"], lambda s: F.lower(F.trim(s["name"])))))
    return F.concat_ws(" | ", F.concat(F.lit("symptoms: "), F.array_join(names, ", ")), F.concat(F.lit("origin: "), record["patient_origin"]), F.concat(F.lit("arrival: "), record["arrival_mode"]))


def multi_hot(df: DataFrame, record: str, max_names: int = 10_000) -> list[Column]:
    """``symptom:<name>`` for every name found, in order; polarity is not looked at. Fails beyond ``max_names``, as each becomes a column."""
    names = F.transform(F.col(record)["symptoms"], lambda s: F.lower(F.trim(s["name"])))
    found = sorted(r[0] for r in df.select(F.explode(names)).distinct().limit(max_names + 1).collect())
    if len(found) > max_names:
        raise ValueError(f"more than {max_names} symptom names")
    return [F.array_contains(names, n).cast("double").alias(f"symptom:{n}") for n in found]


def numeric_block(record: Column) -> list[Column]:
    return [F.coalesce(record["time_prior_to_arrival_minutes"].cast("double"), F.lit(-1.0)).alias("time_prior"), record["confidence"].alias("confidence"), F.size(record["symptoms"]).cast("double").alias("n_symptoms")]


def prompt_record(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[normalize_ws(F.col(f"`{c}`")).alias(c) for c in columns]))


def extract_with(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], attempts: int = 4, pause: float = 1.25, fatal: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """Run ``client`` over prompts in Arrow batches: (key, response, error). A failed row has a null response and its error.

    Other errors than ``fatal`` are tried again after a pause that grows with the attempt.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f["prompt"]:
                got, why = None, None
                for n in range(attempts):
                    try:
                        got, why = client(p), None
                        json.loads(got)
                        break
                    except fatal as e:
                        got, why = None, str(e)
                        break
                    except Exception as e:  # noqa: BLE001  a client may fail in any way
                        got, why = None, str(e)
                        if n + 1 < attempts:
                            time.sleep(pause * (n + 1))
                out.append((got, why))
            yield pd.DataFrame({key: f["key"], "response": [a for a, _ in out], "error": [b for _, b in out]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).mapInPandas(run, f"`{key}` {kind}, response string, error string")


def rule_client(prompt: str) -> str:
    """An offline stand-in for a model: the rules of ``rules`` as an extraction record."""
    import re

    from .rules import SEVERITY, SYMPTOMS

    low = prompt.lower()
    severity = next((n for n, p in SEVERITY if re.search(p, low)), "unknown")
    found = [n for n, ps, _ in SYMPTOMS if any(re.search(p, low) for p in ps)]
    return json.dumps({"symptoms": [{"name": n, "polarity": "present", "severity": severity, "duration_minutes": None, "onset": "unknown"} for n in found], "confidence": min(1.0, len(found) / 5)})
