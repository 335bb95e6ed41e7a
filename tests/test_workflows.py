import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators.embed import embed_with, hashing_encoder
from cohortry.plans import workflows as W


@pytest.fixture(scope="module")
def encounters(spark):
    r = random.Random(12)
    rows = []
    for i in range(90):
        group = i % 3
        fest = group != 0
        note = f"patient from {'main stage' if fest else 'home'} with {['palpitation', 'severe agitation and tachycardia, dilated pupils', 'hallucinations, restless'][group]}"
        vitals = "[" + ", ".join(f"{{'minute': {m * 30}, 'hr': {60 + 20 * group + r.random() * 5:.1f}, 'state': '{'calm' if group == 0 else 'agitated'}'}}" for m in range(group + 1)) + "]"
        rows.append((f"E{i:04d}", "Festival Medical Tent Transfer" if fest else "Walk-in", note, vitals, ["Discharge", "Floor", "ICU"][group], float(group) + r.random() / 4))
    df = spark.createDataFrame(rows, "encounter_id string, arrival string, hpi string, `ed_course.vitals` string, disposition string, lactate double")
    return df.withColumnRenamed("ed_course.vitals", "vitals").cache()


def test_profile(encounters):
    got = W.profile_tables({"a": encounters, "b": encounters.select("encounter_id").limit(40)})
    assert got["id_overlap"].first()["intersection"] == 40
    text = W.profile_report({k: v for k, v in got.items() if k != "a__numeric_summary"})
    assert "## a__missingness" in text and "| disposition |" in text


def _joined(encounters):
    scored = W.weak_scores(encounters, F.col("hpi"), F.col("arrival"), F.col("hpi"))
    events = W.nested_features(encounters, "encounter_id", ["vitals"])
    joined = scored.join(events, "encounter_id").withColumn("v", F.array(F.col("heuristic_score"), F.coalesce("vitals__hr_mean", F.lit(0.0)), F.col("vitals__n_events"), F.col("lactate"), encounter_noise()))
    return joined.cache()


def encounter_noise():
    return F.conv(F.substring(F.md5("encounter_id"), 1, 6), 16, 10).cast("double") / (1 << 24)


def test_two_stage(spark, encounters):
    joined = _joined(encounters)
    got = W.two_stage(joined, "encounter_id", "v", "heuristic_score", F.col("heuristic_score") >= 2.5, F.col("heuristic_score") <= 0)
    labels = got.labels.select("encounter_id", "label", "label_name", "label_confidence", "p").collect()
    assert len(labels) == 90 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in labels)
    fest = {r["encounter_id"] for r in encounters.where("disposition != 'Discharge'").collect()}
    assert {r["encounter_id"] for r in labels if r["label"] == 1} == fest
    assert {r["label_name"] for r in labels if r["label"] == 0} == {"No_Festival"}
    assert got.stability.count() == 10
    same = {r["check"]: r["value"] for r in W.leakage_sensitivity(got, joined, "encounter_id", "v", "heuristic_score", F.col("heuristic_score") >= 2.5, F.col("heuristic_score") <= 0).collect()}
    assert same == {"stage1_label_flip_rate": 0.0, "stage1_mean_abs_prob_shift": 0.0, "stage2_flip_rate_on_base_positives": 0.0, "stage2_ari_on_base_positives": 1.0}
    leaky = joined.withColumn("v", F.concat("v", F.array(F.when(F.col("disposition") == "ICU", 40.0).otherwise(0.0))))
    moved = {r["check"]: r["value"] for r in W.leakage_sensitivity(got, leaky, "encounter_id", "v", "heuristic_score", F.col("heuristic_score") >= 2.5, F.col("heuristic_score") <= 0, least=10_000).collect()}
    assert moved["stage1_mean_abs_prob_shift"] > 0 and moved["stage2_ari_on_base_positives"] is None


def test_nested_features_find_keys_and_values(encounters):
    got = W.nested_features(encounters, "encounter_id", ["vitals"], full=False)
    assert {"vitals__hr_delta", "vitals__state_count_agitated", "vitals__minute_span"} <= set(got.columns)
    assert "vitals__hr_std" not in got.columns


def test_symptoms_and_extraction(encounters, tmp_path):
    s = {r["label"] for r in W.symptom_labels(encounters, "encounter_id", F.col("hpi")).collect()}
    assert "Drug_1" in s and "No_Party_Drug" in s
    labels, errors = W.extraction_labels(encounters, "encounter_id", ["hpi"], k=3)
    assert labels.count() == 90 and errors.count() == 0
    rows = labels.collect()
    assert all(0 < r["confidence"] <= 1 for r in rows) and len({r["label"] for r in rows}) == 3
    logged = W.extraction_labels(encounters, "encounter_id", ["hpi"], k=3, log=str(tmp_path / "log"))[0]
    assert sorted(logged.collect()) == sorted(rows)

    def silent(prompt):
        raise AssertionError("asked again")

    again, errors = W.extraction_labels(encounters, "encounter_id", ["hpi"], client=silent, k=3, log=str(tmp_path / "log"))
    assert errors.count() == 0 and sorted(again.collect()) == sorted(rows)


def test_cross_validation(encounters):
    out, scores = W.cross_validated(encounters.drop("hpi", "vitals"), "encounter_id", "disposition", ["Discharge", "Floor", "ICU"], folds=3)
    assert out.count() == 90 and scores.count() == 3
    assert all(r["accuracy"] > 0.9 and r["macro_auroc"] > 0.9 for r in scores.collect())


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "k long, t string")
    rows = {r["k"]: r["embedding"] for r in embed_with(df, "k", "t", hashing_encoder).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-9 and not any(rows[2])


def test_residual_labels(spark):
    """Notes of one weak symptom pair are unsure; with enough of them each gets its cluster's prototype."""
    notes = ["mild hallucinations with seizure", "mild chest pain and clonus", "mild hypertension, hyperthermia and chest pain", "severe tachycardia, sweating, dilated pupils, agitated"]
    df = spark.createDataFrame([(i, notes[i % 4], [float(i % 4), 1.0]) for i in range(60)], "k long, t string, e array<double>")
    plain = {r["k"]: r for r in W.symptom_labels(df, "k", F.col("t")).collect()}
    unsure = {k for k, r in plain.items() if r["residual"]}
    assert len(unsure) >= 9
    again = {r["k"]: r["label"] for r in W.symptom_labels(df, "k", F.col("t"), "e", seeds=(42,)).collect()}
    assert all(again[k] == plain[k]["label"] for k in plain if k not in unsure)
    assert {again[k] for k in unsure} <= {"Drug_1", "Drug_2", "Drug_3"} and all(len({again[k] for k in unsure if k % 4 == g}) <= 1 for g in range(4))
    few = df.where("k < 8")
    assert {r["k"]: r["label"] for r in W.symptom_labels(few, "k", F.col("t"), "e").collect()} == {k: plain[k]["label"] for k in range(8)}


def test_leakage_safe_table(spark):
    whole = spark.createDataFrame([(1, 40, "Floor")], "encounter_id int, age int, final_disposition string")
    course = spark.createDataFrame([(1, 2.5, "x")], "encounter_id int, lactate double, clinical_course string")
    got = W.leakage_safe({"triage": whole, "course": course}, "encounter_id", "triage", {"course": ["lactate"]})
    assert got.columns == ["encounter_id", "age", "lactate"]
    with pytest.raises(Exception, match="leaking"):
        W.leakage_safe({"triage": whole, "course": course}, "encounter_id", "triage", {"course": ["clinical_course"]})


def test_example_report(spark):
    df = spark.createDataFrame([(i, f"Drug_{i % 2 + 1}", i / 10, f"note {i}") for i in range(10)], "k long, label string, conf double, note string")
    top = W.example_report(df, "label", "conf", "k", ["note"], k=2)
    assert "note 9" in top and "note 6" in top and "note 1\n" not in top and "| Drug_2 | 5 |" in top
    one = W.example_report(df, "label", "conf", "k", ["note"], k=3, mode="sample", categories=["Drug_2"])
    assert one.count("### ") == 3 and "## Drug_1" not in one
    for bad in ({"categories": ["Drug_9"]}, {"mode": "best"}, {"k": 0}):
        with pytest.raises(ValueError):
            W.example_report(df, "label", "conf", "k", ["note"], **bad)


def test_cross_validated_network(encounters):
    out, scores = W.cross_validated(encounters.drop("hpi", "vitals"), "encounter_id", "disposition", ["Discharge", "Floor", "ICU"], folds=2, kind="network", hidden=(12,))
    assert out.count() == 90 and all(r["accuracy"] > 0.8 for r in scores.collect())
