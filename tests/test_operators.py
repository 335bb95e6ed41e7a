import ast
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import numeric as N
from cohortry.functions import text as X
from cohortry.operators import cluster, consensus, contracts, evaluate, extract, features, model, nested, profile, quantiles, report, rules, simulate, vectors


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.slugify(F.lit("  Ed_Course.Vitals (4h)! "))) == "ed_course_vitals_4h"
    assert X.slug("A.b C") == "a_b_c"
    assert one(spark, X.normalize_ws(F.lit(" a  \n b "))) == "a b"
    assert one(spark, X.term_hits(F.lit("Festival at the main stage, FESTIVAL"), ["festival", "main stage", "gym"])) == 2.0
    assert one(spark, X.rounded_text(F.lit(2.5))) == "2" and one(spark, X.rounded_text(F.lit(3.5))) == "4"
    assert one(spark, X.rounded_text(F.lit(None).cast("double"))) == "NA"
    assert one(spark, X.rounded_text(F.lit(36.25), 1)) == "36.2"
    assert one(spark, X.priority_class(F.lit("a female"), [("Male", r"\bmale\b"), ("Female", r"\bfemale\b")], "Unknown")) == "Female"
    assert one(spark, X.duration_text(F.lit(5400.0))) == "90.0 min (1.50 hr)"


def test_numeric_functions(spark):
    assert math.isclose(one(spark, N.sigmoid(F.lit(0.0))), 0.5)
    assert one(spark, N.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert one(spark, N.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert math.isclose(sum(one(spark, N.softmax(F.array(F.lit(1000.0), F.lit(1001.0)), 0.5))), 1.0)
    assert math.isclose(one(spark, N.exclusive_quantile(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda x: x.cast("double")), 0.9)), 10.8)
    assert one(spark, N.finite_or_null(F.lit(float("inf")))) is None


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (1, "w")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one_join(a, b, "k")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["nope"])
    with pytest.raises(contracts.ContractError):
        contracts.require_labels(a, "v", ["x"])
    assert contracts.fold_join({"one": a, "No Key": a.drop("k"), "Second Sheet": a}, "k").columns == ["k", "v", "second_sheet__v"]
    leaky = spark.createDataFrame([(1, 1, 1)], ["encounter_id", "final_disposition", "age"])
    assert contracts.without_leakage(leaky).columns == ["encounter_id", "age"]
    assert contracts.id_columns(leaky) == ["encounter_id"]


def test_profile_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (3, None, 3.0)], "id long, c string, x double")
    m = {r["column"]: (r["missing_count"], round(r["missing_pct"], 3)) for r in profile.missingness(df).collect()}
    assert m == {"id": (0, 0.0), "c": (1, 33.333), "x": (1, 33.333)}
    assert [r["column"] for r in profile.missingness(df).collect()] == ["c", "x", "id"]
    c = profile.categorical_summary(df).first()
    assert (c["n_unique"], c["missing_count"], c["top_values"]) == (1, 1, "a: 2")
    s = {r["column"]: r for r in profile.numeric_summary(df).collect()}
    assert s["x"]["count"] == 2 and math.isclose(s["x"]["std"], math.sqrt(2))


CELLS = [
    (None, 0, 0), ("", 0, 0), ("  ", 0, 0), ("[]", 0, 0), ("[{'minute': 0, 'hr': 84.9}]", 1, 1), ("[{'hr': None}]", 1, 1), ("{'minute': 1}", 1, 0),
    ("[{'hr': nan}]", 0, 0), ("""[{'name': "it's"}]""", 1, 1), ("no list", 0, 0),
]


def test_nested_cells(spark):
    df = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(CELLS)], "i int, cell string")
    rows = df.select("i", F.size(nested.parse_nested(F.col("cell"))).alias("a"), F.size(nested.parse_nested(F.col("cell"), strict=True)).alias("b"), F.size(nested.parse_literals(F.col("cell"))).alias("c"), F.size(nested.parse_literals(F.col("cell"), strict=True)).alias("d")).orderBy("i").collect()
    for r, (cell, lenient, strict) in zip(rows, CELLS):
        assert (r["c"], r["d"]) == (lenient, strict), cell
        if cell != "[{'hr': nan}]":
            assert (r["a"], r["b"]) == (lenient, strict), cell
    mixed = spark.createDataFrame([("[1, {'a': 2}]",), ("[{'hr': null}]",)], ["cell"])
    assert [r[0] for r in mixed.select(F.size(nested.parse_literals(F.col("cell")))).collect()] == [1, 1]


def test_quoted_words_stay(spark):
    got = spark.createDataFrame([("[{'a': 'say None, True', 'b': None, 'c': True}]",)], ["cell"]).select(nested.parse_nested(F.col("cell"))[0].alias("d")).first()["d"]
    assert got["a"] == "say None, True" and got["b"] is None and got["c"] == "true"


def test_nested_summary_matches_python(spark):
    cell = "[{'minute': 5, 'hr': 80.0, 'kind': 'a'}, {'minute': 1, 'hr': None, 'kind': 'b'}, {'minute': 9, 'hr': 90.0, 'kind': 'a'}]"
    items = ast.literal_eval(cell)
    df = spark.createDataFrame([(1, cell), (2, None)], "k int, cell string").select("k", nested.parse_nested(F.col("cell")).alias("items"))
    got = {r["k"]: r for r in nested.summarize_nested(df, "k", "items", "v", ["hr"], {"kind": ["a", "b"]}).collect()}
    hr = [x["hr"] for x in items if x["hr"] is not None]
    mean = sum(hr) / 2
    assert got[1]["v__hr_mean"] == mean and got[1]["v__hr_std"] == math.sqrt(sum((x - mean) ** 2 for x in hr) / 2)
    assert got[1]["v__hr_delta"] == 10.0 and got[1]["v__minute_span"] == 8.0 and got[1]["v__kind_count_a"] == 2.0
    assert got[2]["v__n_events"] == 0.0 and got[2]["v__hr_mean"] is None


def test_discovery(spark):
    df = spark.createDataFrame([("[1]", "x"), ("[]", "y")], ["a", "b"])
    assert nested.discover_nested(df, ("b",)) == ["b", "a"]


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, None, None, False), (3, 5.0, "b", None)], "k int, x double, c string, f boolean")
    got = features.feature_frame(df, "k").orderBy("k").collect()
    assert got[0].asDict() == {"k": 1, "c_a": 1.0, "c_b": 0.0, "c_nan": 0.0, "f": 1.0, "x": 1.0}
    assert got[1]["x"] == 3.0 and got[1]["c_nan"] == 1.0


def test_knn_in_blocks_is_the_same(spark, monkeypatch):
    import random

    r = random.Random(3)
    df = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "k long, v array<double>")
    whole = {x[0]: x[1] for x in vectors.knn_mean_distance(df, df, "k", "v", 5).collect()}
    monkeypatch.setattr(vectors, "MAX_SENT", 17)
    parts = {x[0]: x[1] for x in vectors.knn_mean_distance(df, df, "k", "v", 5).collect()}
    assert whole.keys() == parts.keys() and all(math.isclose(whole[k], parts[k]) for k in whole)


def test_rules(spark):
    df = spark.createDataFrame([(1, "Severe TACHYCARDIA, sweating; denies chest pain for 2 days"), (2, None)], "k int, t string")
    rows = {r["k"]: r["x"] for r in df.select("k", rules.symptom_triples(F.col("t")).alias("x")).collect()}
    assert [s["symptom"] for s in rows[1]] == ["tachycardia", "diaphoresis", "chest_pain"] and rows[1][0]["severity"] == "severe" and rows[1][0]["onset_timing"] == "days"
    assert rows[2] == []
    v = df.withColumn("v", rules.symptom_vector(rules.symptom_triples(F.col("t"))))
    m = {r["k"]: r for r in rules.prototype_match(v, "v").collect()}
    assert m[2]["label"] == rules.NO_PARTY and m[1]["evidence"] == 3


def test_extraction(spark):
    texts = ['{"symptoms":[{"name":"A","duration_minutes":2.5},{"name":""}],"time_prior_to_arrival_minutes":-4,"confidence":"x"}', None, "broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract.read_extraction(F.col("t")).alias("r"))
    r = {x["i"]: x["r"] for x in df.collect()}
    assert r[0]["symptoms"][0]["duration_minutes"] == 2 and len(r[0]["symptoms"]) == 1
    assert r[0]["time_prior_to_arrival_minutes"] is None and r[0]["confidence"] == 0.0 and r[1]["mental_status"] == "unknown" and r[2]["symptoms"] == []
    got = extract.extract_with(spark.createDataFrame([(1, "severe seizure")], "k long, p string"), "k", "p", extract.rule_client).first()
    assert "seizure" in got["response"] and got["error"] is None


def test_extraction_errors_are_rows(spark):
    def client(p):
        raise ValueError("bad request") if p == "a" else RuntimeError("busy")

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    rows = {r["k"]: r for r in extract.extract_with(df, "k", "p", client, attempts=2, pause=0.0).collect()}
    assert rows[1]["error"] == "bad request" and rows[2]["error"] == "busy" and rows[1]["response"] is None


def test_golden_scores(spark):
    # hand-checkable: hits, arrival and place to score
    rows = [(0, 1, 0, 0, 1, -1.9), (3, 0, 1, 1, 0, 5.8)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "f double, c double, a double, lf double, lc double, want double")
    got = df.select((1.5 * F.col("a") + 1.1 * F.col("f") + F.col("lf") - 0.9 * F.col("c") - F.col("lc")).alias("s"), "want").collect()
    assert all(math.isclose(r["s"], r["want"]) for r in got)


def test_consensus(spark):
    df = spark.createDataFrame([(i, i % 3, (i + 1) % 3) for i in range(30)], "k int, a int, b int")
    p = consensus.best_permutation(df, "a", "b", 3)
    assert [p[(i + 1) % 3] for i in range(3)] == [0, 1, 2]
    assert consensus.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    v = consensus.votes(df.withColumn("c", F.lit(0)), ["a", "b", "c"], 3).where("k = 1").first()
    assert v["cluster_consensus"] == 0 and math.isclose(v["confidence"], 1 / 3)
    t = spark.createDataFrame([(0.9, True, False)] * 6 + [(0.1, False, True)] * 6, "p double, a boolean, b boolean")
    assert math.isclose(consensus.threshold_search(t, "p", "a", "b"), 0.3)
    assert consensus.threshold_search(t.limit(3), "p", "a", "b") == 0.5


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5)], "y int, s double")
    assert evaluate.auroc(df, F.col("y") == 1, F.col("s")).first()["auroc"] is None
    tie = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert evaluate.auroc(tie, F.col("y") == 1, F.col("s")).first()["auroc"] == 0.5
    w = {r["y"]: r["weight"] for r in evaluate.class_weights(df, "y", [0, 1]).collect()}
    assert w == {0: 1.0, 1: 1.0}


def test_group_folds_balance(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [(None,)], "g string")
    f = {r["g"]: r["fold"] for r in evaluate.group_folds(df, "g", 2).collect()}
    assert f == {"a": 0, "b": 1, "c": 1, "__NA__": 0}


def test_folds_do_not_depend_on_blocks(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("y"))
    a = {r["id"]: r["fold"] for r in evaluate.stratified_folds(df, "id", "y", 5).collect()}
    b = {r["id"]: r["fold"] for r in evaluate.stratified_folds(df, "id", "y", 5, block=20).collect()}
    assert a == b


def test_bisecting(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(30)], "k long, v array<double>")
    assert len({r["cluster"] for r in model.bisecting(df, "k", "v", 3).collect()}) == 3


def test_ward(spark):
    pts = [(i, [float(i // 10) * 10, float(i % 3)]) for i in range(30)]
    got = {r["k"]: r["cluster"] for r in model.ward(spark.createDataFrame(pts, "k long, v array<double>"), "k", "v", 3).collect()}
    assert len({got[i] for i in range(10)}) == 1 and len(set(got.values())) == 3


def test_reports(spark):
    df = spark.createDataFrame([("Drug_10", 1.0, 1), ("Drug_2", 2.0, 2), ("No_Festival", 3.0, 3), ("x", 1.0, 4)], "c string, s double, k int")
    assert report.choose_categories(df, "c") == ["Drug_2", "Drug_10", "No_Festival", "x"]
    assert report.choose_categories(df, "c", prefix="Drug_") == ["Drug_2", "Drug_10"]
    with pytest.raises(contracts.ContractError):
        report.choose_categories(df, "c", ["Drug_3"])
    top = report.top_examples(df, "c", "s", "k", 1)
    assert "## Drug_2" in report.examples_report(top, "c", ["s"], "t")
    assert report.markdown_table(df.limit(1)).count("|") == 12


def test_simulation(spark):
    s = simulate.time_summary(simulate.simulate(spark, 20, 30), "total_seconds").first()
    assert s["mean"] >= 60 and s["p50"] <= s["p99"]
    import statistics

    r = random.Random(1)
    for n in (2, 3, 7, 150):
        values = [r.choice((1.5, r.random() * 9)) for _ in range(n)]
        got = simulate.time_summary(spark.createDataFrame([(v,) for v in values], "s double"), "s").first()
        want = statistics.quantiles(values, n=100)
        assert np.allclose([got[f"p{q}"] for q in (50, 90, 95, 99)], [want[q - 1] for q in (50, 90, 95, 99)])
    one_row = simulate.time_summary(spark.createDataFrame([(4.0,)], "s double"), "s").first()
    assert one_row["mean"] == one_row["p50"] == one_row["p99"] == 4.0


def test_quantiles_against_sorting(spark):
    r = random.Random(3)
    rows = [(r.choice((None, 1.0, 2.5, float("nan"))) if i % 3 == 0 else r.random() * 10, None, float(i % 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = quantiles.column_quantiles(df, ["a", "b", "c"], [0.0, 0.01, 0.5, 0.95, 1.0])
    for k, c in ((0, "a"), (2, "c")):
        values = [x[k] for x in rows if x[k] is not None and not math.isnan(x[k])]
        assert np.allclose(got[c], np.quantile(values, [0.0, 0.01, 0.5, 0.95, 1.0]))
    assert "b" not in got and features.medians(df, ["b"]) == {"b": 0.0}
    counts = spark.createDataFrame([(g, float(i), i + g) for g in range(3) for i in range(50)], "g int, x double, n long")
    run = quantiles.running_sums(counts, "x", {"below": "n"}, inclusive=False, by="g").collect()
    assert all(x["below"] == sum(i + x["g"] for i in range(int(x["x"]))) for x in run) and len(run) == 150


def test_one_pass_for_all_pairs_and_classes(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), r.randrange(3), r.choice((None, 0, 1)), [r.choice((0.1, 0.5, 0.4)) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int, p array<double>")
    pairs = {(x["model_a"], x["model_b"]): x["ari"] for x in consensus.pairwise_ari(df, ["a", "b", "c"]).collect()}
    assert len(pairs) == 3 and all(abs(pairs[q] - consensus.adjusted_rand(df, *q).first()["ari"]) < 1e-12 for q in pairs)

    def area(c):
        pos, neg = ([x[4][c] for x in rows if (x[1] == c) == side] for side in (True, False))
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)

    assert math.isclose(evaluate.macro_auroc(df, "a", "p", 3).first()[0], sum(map(area, range(3))) / 3)
    best = consensus.best_permutations(df, "a", ["a", "b", "c"], 3)
    assert best["a"] == [0, 1, 2] and best["b"] == consensus.best_permutation(df, "a", "b", 3)


def test_nothing_is_cut_in_silence(spark):
    names = [f"n{i:05d}" for i in range(12)]
    record = "struct<symptoms:array<struct<name:string,polarity:string,severity:string,duration_minutes:long,onset:string>>>"
    df = spark.createDataFrame([([(n, None, None, None, None) for n in names],)], "s array<struct<name:string,polarity:string,severity:string,duration_minutes:long,onset:string>>").select(F.struct(F.col("s").alias("symptoms")).alias("r"))
    assert record and len(extract.multi_hot(df, "r", 12)) == 12
    with pytest.raises(ValueError, match="11 symptom names"):
        extract.multi_hot(df, "r", 11)
    many = spark.range(30).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"), F.lit(1).alias("rank"))
    with pytest.raises(contracts.ContractError):
        report.choose_categories(many, "c", limit=29)
    with pytest.raises(contracts.ContractError):
        report.examples_report(many, "c", ["c"], "t", most=29)
    assert report.markdown_table(many, 10).endswith("20 more rows") and "more rows" not in report.markdown_table(many, 30)
    with pytest.raises(ValueError):
        profile.crosstab_long(spark.range(30).select("id", F.col("id").alias("b")), "id", "b", max_cells=899)


def test_contracts_of_columns_and_rows(spark):
    df = spark.createDataFrame([(i, i % 3, "x") for i in range(9)], "encounter_id int, age int, final_disposition string")
    assert contracts.only_columns(df, "encounter_id", ["age"]).columns == ["encounter_id", "age"]
    for bad in (["final_disposition"], ["nope"]):
        with pytest.raises(contracts.ContractError):
            contracts.only_columns(df, "encounter_id", bad)
    assert [r[0] for r in contracts.capped(df, 2, "encounter_id").select("encounter_id").collect()] == [0, 1] and contracts.capped(df, None).count() == 9
    with pytest.raises(contracts.ContractError):
        contracts.capped(df, 0)
    assert sorted(r["encounter_id"] for r in contracts.first_by_key(df, "age", "encounter_id").collect()) == [0, 1, 2]


def test_mixed_lists(spark):
    cells = ["[1, {'a': 2}, 'x', {'a': None}]", "[{'a': 1}]", "{'a': 3}", "[1, 2]", "nothing", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    loose, strict = ([[None if d is None else d.get("a") for d in r[0]] for r in df.orderBy("i").select(nested.parse_nested(F.col("c"), strict=s)).collect()] for s in (False, True))
    assert loose == [["2", None], ["1"], ["3"], [], [], []] and strict == [[None, "2", None, None], ["1"], [], [None, None], [], []]
    py = [[None if d is None else d.get("a") for d in r[0]] for r in df.orderBy("i").select(nested.parse_literals(F.col("c"), strict=True)).collect()]
    assert py == strict


def test_schema_of_extractions(spark):
    full = {"symptoms": [{"name": "A", "polarity": "present", "severity": "mild", "duration_minutes": 3, "onset": "sudden"}], "arrival_mode": "ems", "patient_origin": "offsite", "time_prior_to_arrival_minutes": None, "suspected_substance_exposure": "yes", "mental_status": "normal", "confidence": 0.5}
    less = {k: v for k, v in full.items() if k != "mental_status"} | {"extra": 1, "symptoms": [{"name": "A", "severity": "awful", "polarity": "present", "onset": "sudden", "more": 1}]}
    texts = [json.dumps(full), json.dumps(less), "", None, "[1]", "broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [list(r[0]) for r in df.orderBy("i").select(extract.schema_violations(F.col("t"))).collect()]
    assert got[0] == [] and set(got[1]) == {"missing:mental_status", "unknown:extra", "missing:symptoms.duration_minutes", "unknown:symptoms.more", "value:symptoms.severity"}
    assert got[2:] == [["unreadable"]] * 4
    assert df.where("i = 0").select(extract.read_extraction(F.col("t"), strict=True)).first()[0]["mental_status"] == "normal"
    with pytest.raises(Exception, match="no JSON object"):
        df.select(extract.read_extraction(F.col("t"), strict=True)).collect()
    record = df.where("i = 0").select(extract.read_extraction(F.col("t")).alias("r"))
    assert record.select(extract.entity_summary(F.col("r"))).first()[0] == "symptoms: a | origin: offsite | arrival: ems"


def test_tfidf_weights(spark):
    """Against the formula: ln((1 + n) / (1 + df)) + 1 times the count, rows of unit length; a term of all texts keeps a weight."""
    texts = ["all one one", "all two", "all two three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows, terms = cluster.term_rows(df, "t", min_df=1)
    units = [t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])] for t in texts]
    assert {r["term"] for r in terms.collect()} == {u for x in units for u in x}
    weight = {u: math.log(4 / (1 + sum(u in x for x in units))) + 1 for x in units for u in x}
    for r in rows.collect():
        own = {u: units[r["id"]].count(u) * weight[u] for u in set(units[r["id"]])}
        norm = math.sqrt(sum(v * v for v in own.values()))
        assert np.allclose(sorted(r["x"]), sorted(v / norm for v in own.values()))


def test_projections_and_clusters(spark):
    """Known structure comes out: three far blobs, and two directions that carry the variance."""
    r = random.Random(2)
    pts = [(i, [100.0 * (i % 3) + r.random(), -50.0 * (i % 3) + r.random(), r.random(), r.random()]) for i in range(90)]
    df = spark.createDataFrame(pts, "k long, v array<double>")
    named = {x["k"]: x["cluster"] for x in model.kmeans(df, "v", 3)[1].select("k", "cluster").collect()}
    assert len(set(named.values())) == 3 and all(len({named[i] for i in range(g, 90, 3)}) == 1 for g in range(3))
    assert {x["cluster"] for x in model.gaussian_mixture(df, "v", 3).collect()} <= {0, 1, 2}
    x = np.array([v for _, v in pts])
    flat = np.array([p["projected"] for p in model.pca(df, "v", 2).orderBy("k").collect()])
    centered = x - x.mean(axis=0)
    want = centered @ np.linalg.svd(centered, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(flat - flat.mean(axis=0)), np.abs(want), atol=1e-6)
    texts = [(i, " ".join(["red apple pie", "blue sea wave"][i % 2] for _ in range(3))) for i in range(10)]
    e = {t["k"]: np.array(t["embedding"]) for t in model.tfidf_svd(spark.createDataFrame(texts, "k long, t string"), "k", "t", components=2).collect()}
    assert abs(e[0] @ e[2] - 1) < 1e-9 and abs(e[0] @ e[1]) < 1e-9


def test_console_summary(spark):
    said = []
    report.console_summary(spark.createDataFrame([("rows", 3.0), ("longer_name", None)], "metric string, value double"), "run", said.append)
    assert said == ["---", "run", "rows:        3.000000", "longer_name: ", "---"]


def test_merging_and_appending(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 5.0)], "k int, x double")
    assert {r["k"]: r["x"] for r in nested.merge_summaries(a, [b], "k").collect()} == {1: 5.0, 2: None}
    assert one(spark, features.append_arrays(F.array(F.lit(1)), F.array(F.lit(2.5)))) == [1.0, 2.5]


def test_best_assignment():
    """The greatest gain, and of equal ones the first of all permutations; fifty labels in a moment."""
    import itertools
    import time

    r = random.Random(8)
    for _ in range(400):
        k = r.randint(1, 6)
        gain = [[r.randint(0, r.choice([1, 3, 20])) for _ in range(k)] for _ in range(k)]
        want = max(itertools.permutations(range(k)), key=lambda p: sum(gain[i][p[i]] for i in range(k)))
        assert consensus.best_assignment(gain) == list(want)
    p = r.sample(range(50), 50)
    gain = [[100 if p[i] == j else r.randint(0, 30) for j in range(50)] for i in range(50)]
    began = time.perf_counter()
    assert consensus.best_assignment(gain) == p
    assert sorted(consensus.best_assignment([[0] * 50 for _ in range(50)])) == list(range(50)) and time.perf_counter() - began < 2


def greedy(groups, k):
    load, out = [0] * k, {}
    for g, n in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        i = load.index(min(load))
        load[i] += n
        out[g] = i
    return out


def test_turns_are_the_greedy_rule():
    r = random.Random(6)
    for _ in range(500):
        loads, sizes = [r.randint(0, 30) for _ in range(r.randint(1, 6))], (r.randint(1, 9), r.randint(0, 40))
        plain, want = list(loads), []
        for _ in range(sizes[1]):
            i = plain.index(min(plain))
            plain[i] += sizes[0]
            want.append(i)
        got = [folds[j % len(folds)] for _, n, folds in evaluate.greedy_turns(loads, *sizes) for j in range(n)]
        assert got == want and loads == plain
    loads = [0, 10**15, 3]
    assert len(evaluate.greedy_turns(loads, 1, 10**12)) <= 3


def test_group_folds_by_runs(spark):
    r = random.Random(9)
    groups = {f"g{i:03}": r.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(200)} | {"big": 300, "__NA__": 4}
    rows = [(None if g == "__NA__" else g,) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "g string").repartition(5)
    for k in (1, 3, 7):
        got = {x["g"]: x["fold"] for x in evaluate.group_folds(df, "g", k).collect()}
        assert got == greedy(groups, k)
    assert evaluate.group_folds(df.limit(0), "g", 4).count() == 0
    assert {x["fold"] for x in evaluate.group_folds(spark.createDataFrame([("a",), ("b",)], "g string"), "g", 9).collect()} == {0, 1}


def test_nested_profile(spark):
    """All kinds of cells of two columns in one pass, against Python's reading of the same cells."""
    cells = ["[{'a': 1, 'b': 'x'}, {'a': 2.5, 'b': ' x '}]", "{'a': None, 'c': True}", "[1, {'b': 'y'}, 'z']", "", None, "nonsense", "[{'b': \"it's\"}]", "[]", "[{'minute': 3, 'd': [1, 2]}]"]
    df = spark.createDataFrame([(c, f"[{{'b': '{i}'}}]") for i, c in enumerate(cells)], "n string, m string")
    assert nested.discover_nested(df.withColumn("plain", F.lit("x")), share=0.5) == ["n", "m"]
    got = {(r["column"], r["key"]): (r["n_numeric"], r["n_other"], r["types"], r["values"]) for r in nested.nested_profile(df, ["n", "m"], top=2).collect()}
    assert got == {
        ("n", "a"): (2, 1, ["BIGINT", "DECIMAL", "VOID"], []), ("n", "b"): (0, 4, ["STRING"], ["x", "it's"]), ("n", "c"): (1, 0, ["BOOLEAN"], []),
        ("n", "d"): (0, 1, ["ARRAY"], ["[1,2]"]), ("m", "b"): (0, 9, ["STRING"], ["0", "1"]),
    }
    assert nested.nested_profile(df.limit(0), ["n"]).count() == 0


def test_forest(spark):
    """Two classes that one cut parts, and a class of its own in a corner: a forest finds both out of fold."""
    r = random.Random(3)
    rows = [(i, [r.random(), r.random()]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 2 if v[0] > 0.7 and v[1] > 0.7 else int(v[0] > 0.5), i % 3) for i, v in rows], "k long, v array<double>, y int, fold int")
    out = model.cross_validate(df, "v", "y", "fold", lambda: model.classifier("forest", 2, 3))
    assert out.count() == 300 and out.where("prediction = y").count() > 270
    assert all(abs(sum(x["probs"]) - 1) < 1e-9 for x in out.limit(20).collect())
