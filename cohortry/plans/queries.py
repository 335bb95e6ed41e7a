"""The registered queries over the star-schema tables, one for each operator or group of operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import cluster, consensus, contracts, evaluate, extract, features, metric, model, nested, network, profile, report, rules, simulate, vectors
from ..session import table
from . import encounter

R6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# ---- profiles


def crosstab_nation_balance(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") / 2000).cast("long").alias("bucket"))
    return _rounded(profile.crosstab_long(s, "s_nationkey", "bucket"), "row_pct")


def missingness_docs_labels(spark: SparkSession, sf: str) -> DataFrame:
    joined = contracts.one_to_one_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "left")
    return _rounded(profile.missingness(joined), "missing_pct")


def numeric_summary_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    got = profile.numeric_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _rounded(got, "std", "min", "p01", "p05", "p50", "p95", "p99", "max").withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


def categorical_summary_part(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.categorical_summary(table(spark, sf, "part"), ["p_brand", "p_type"]), "missing_pct")


def value_counts_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "events"), "event_type").orderBy(F.desc("count"), "event_type")


def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.share_of_total(table(spark, sf, "events"), "event_type"), "pct")


def key_overlap_tables(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels, orders, customer = (table(spark, sf, t) for t in ("documents", "labels", "orders", "customer"))
    a = profile.key_overlap(docs, labels, "doc_id", "doc_id", "documents", "labels")
    b = profile.key_overlap(orders, customer, "o_custkey", "c_custkey", "orders", "customer")
    return _rounded(a.unionByName(b), "left_coverage_pct", "right_coverage_pct")


def pattern_scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    words = {"mentions_license": r"\blicense\b", "mentions_token": r"token", "mentions_digits": r"[0-9]{4}", "mentions_shout": r"!!"}
    return profile.pattern_scan(table(spark, sf, "documents"), ["text", "source"], words)


def group_sizes_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.value_counts(joined, "lang", "quality")


def mode_consistency(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    said = X.priority_class(F.col("text"), [("assistant", "license"), ("user", r"\?"), ("system", r"\bthe\b")], "unknown")
    own = c.select("role", said.alias("said")).withColumn("matches", F.col("role") == F.col("said"))
    return profile.value_counts(own, "role", "said", "matches")


# ---- contracts and joins


def one_to_one_join_encounter(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels").withColumn("lang", F.lit("xx"))
    return contracts.fold_join({"documents": docs, "labels": labels, "region": table(spark, sf, "region")}, "doc_id")


def left_join_customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left").fillna({"n_orders": 0})


def dup_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.missing_values(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def distinct_first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.first_by_key(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


# ---- text


def column_slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.slugify(F.concat(F.lit(" "), F.col("p_type"), F.lit(" #/ "), F.col("p_brand"), F.lit("! "))).alias("slug"))


def normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    t = X.normalize_ws(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("h"))


def text_corpus(spark: SparkSession, sf: str) -> DataFrame:
    t = X.labelled_text([("lang", F.col("lang")), ("source", F.col("source")), ("text", F.col("text"))])
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("corpus"), F.md5(X.plain_text([F.col("lang"), F.col("text")])).alias("plain"))


def conversation_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    t = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"])), " ")
    return c.select("conv_id", F.size("l").cast("long").alias("turns"), F.md5(t).alias("corpus"))


FESTIVAL = ["the ", "tion", "token", "license", "dance"]
COMMUNITY = ["que", "sch", "home", "street"]


def term_hits_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weak scores: term hits, an arrival flag, and a place taken from the text."""
    d = table(spark, sf, "documents").withColumn("hpi", F.concat(F.lit("came from "), F.col("source"), F.lit(" with "), F.col("lang"), F.lit(", "), F.col("text")))
    place = F.regexp_extract(F.lower("hpi"), "from ([^,]+) with", 1)
    a, b = X.term_hits(F.col("text"), FESTIVAL), X.term_hits(F.col("text"), COMMUNITY)
    arrival, near, far = X.matches(F.col("lang"), "en"), X.matches(place, "src1|src2"), X.matches(place, "src3|src4")
    score = 1.5 * arrival + 1.1 * a + 1.0 * near - 0.9 * b - 1.0 * far
    return d.select("doc_id", place.alias("place"), a.alias("festival_hits"), b.alias("community_hits"), F.round(score, 6).alias("score"))


def date_parts_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", *features.date_parts(F.col("o_orderdate"), "o"))


def vitals_shorthand(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    q = F.col("l_quantity").cast("double")
    t = report.vitals_shorthand(q + 0.25, q * 2, q + 100, F.when(q > 25, q), q * 1.3, F.lit(36.0) + F.floor(q / 10) / 10, F.lit(15), F.lit(0))
    return l.select("l_orderkey", "l_linenumber", t.alias("vitals"))


# ---- features


def one_hot_segment(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", *features.one_hot(c, "c_mktsegment"))


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("n_chars"))
    return _rounded(features.impute_median(joined, ["quality", "toxic", "n_chars"]), "quality", "toxic", "n_chars")


def standardize_ddof0(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.standardize(table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(3.0).alias("constant")), ["c_acctbal", "constant"]), "c_acctbal", "constant")


def train_fold_standardize(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 5).cast("int").alias("fold"))
    got = features.standardize(s, ["s_acctbal"], fit=s.where("fold != 0"), least=1e-6)
    return _rounded(got, "s_acctbal")


# ---- nested


def nested_len_hist(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("items"))
    o = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.array().cast("array<int>")))
    return profile.value_counts(o.select(F.size("items").cast("long").alias("length")), "length")


def nested_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    cells = encounter.event_cells(spark, sf).select(nested.parse_nested(F.col("cell")).alias("items"))
    return nested.event_counts(cells, "items", "event_type")


def _summary(spark: SparkSession, sf: str, full: bool) -> DataFrame:
    cells = encounter.event_cells(spark, sf).select("user_id", nested.parse_nested(F.col("cell")).alias("items"))
    got = nested.summarize_nested(cells, "user_id", "items", "ev", ["value"], {"event_type": ["click", "purchase"]}, full)
    return _rounded(got, *[c for c in got.columns if c != "user_id"])


def nested_summary_full(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, True)


def nested_summary_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, False)


def parse_nested_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cell = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "  ").when(k % 5 == 2, F.concat(F.lit("{'k': "), k.cast("string"), F.lit("}"))).when(k % 5 == 3, F.concat(F.lit("[{'k': None}, {'k': "), k.cast("string"), F.lit("}]"))).otherwise("not a list")
    own = e.select("event_id", cell.alias("cell")).withColumn("items", nested.parse_nested(F.col("cell"))).withColumn("strict", nested.parse_nested(F.col("cell"), strict=True))
    return own.select("event_id", F.size("items").cast("long").alias("n"), F.size("strict").cast("long").alias("n_strict"), F.get("items", F.size("items") - 1)["k"].try_cast("long").alias("last_k"))


def props_key_types(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.array(F.from_json("props", "map<string,string>")).alias("items"))
    return nested.key_types(e, "items")


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    return nested.top_categories(table(spark, sf, "events"), "user_id", "event_type", 2).select("user_id", "event_type", "count", F.col("rank").cast("long").alias("rank"))


# ---- rules and extraction


def symptom_triples(spark: SparkSession, sf: str) -> DataFrame:
    return rules.with_triples(encounter.notes(spark, sf), F.col("note")).select("c_custkey", F.inline("triples"))


def prototype_match(spark: SparkSession, sf: str) -> DataFrame:
    n = rules.with_triples(encounter.notes(spark, sf), F.col("note")).withColumn("v", rules.symptom_vector(F.col("triples")))
    got = rules.prototype_match(n, "v")
    return got.select("c_custkey", F.col("evidence").cast("long").alias("evidence"), R6("max_similarity").alias("max_similarity"), R6("confidence").alias("confidence"), "label", "residual")


def extraction_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """JSON made from keys, read with defaults: absent fields, negative and unreadable minutes, nameless symptoms."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    text = F.concat(F.lit('{"symptoms":[{"name":"'), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" Sym"), (k % 3).cast("string"), F.lit(" "))), F.lit('","severity":"mild","duration_minutes":'), F.when(k % 5 == 0, "-3").when(k % 5 == 1, "null").otherwise(F.concat((k % 50).cast("string"), F.lit(".25"))), F.lit('}]'), F.when(k % 2 == 0, ',"arrival_mode":"ems"').otherwise(""), F.when(k % 3 == 0, ',"confidence":0.5').otherwise(""), F.lit("}"))
    r = c.select("c_custkey", extract.read_extraction(text).alias("r"))
    first = F.get(F.col("r")["symptoms"], F.lit(0))
    return r.select("c_custkey", F.size(F.col("r")["symptoms"]).cast("long").alias("n_symptoms"), F.lower(F.trim(first["name"])).alias("name"), first["duration_minutes"].alias("minutes"), F.col("r")["arrival_mode"].alias("arrival_mode"), F.col("r")["mental_status"].alias("mental_status"), F.col("r")["confidence"].alias("confidence"))


def nested_types(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, kinds of values and frequent texts of cells written as lists of dicts."""
    e = table(spark, sf, "events")
    cell = F.concat(F.lit("["), F.col("props"), F.lit(", {'kind': '"), F.col("event_type"), F.lit("', 'ok': True, 'note': None}]"))
    got = nested.nested_profile(e.select(cell.alias("cell"), "props"), ["cell", "props"])
    return got.select("column", "key", "n_numeric", "n_other", F.array_join("types", ",").alias("types"), F.array_join("values", ",").alias("values"))


def network_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient of the weighted loss of a linear model over all line items, summed from blocks."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    x = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    y = (F.col("l_returnflag") == "R").cast("int")
    rows = l.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), x.alias("features"), y.alias("label"), F.when(y == 1, 2.0).otherwise(0.75).alias("weight"))
    net = network.Network(3, 2, (), params=np.array([0.1, -0.2, 0.3, 0.1, -0.4, 0.2, 0.05, -0.05]))
    loss, total, g, _ = network.gradient_sum(network.blocks(rows, "k", rows=4096), net, 0)
    return spark.createDataFrame([(i, round(float(v) / total, 6)) for i, v in enumerate([*g, loss])], "place int, value double")


# ---- vectors


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))


def knn_mean_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    return _rounded(vectors.knn_mean_distance(e, e, "vec_id", "v", 12), "knn_distance")


def knn_pivot_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same by cells and bounds, as it runs where the fitted side is too large to be sent."""
    e = _embeddings(spark, sf)
    got = metric.knn_join(e, e, "vec_id", "v", 12, block=128)
    return _rounded(got.select("vec_id", (F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / 12).alias("knn_distance")), "knn_distance")


def knn_to_anchor(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    return _rounded(vectors.knn_mean_distance(e, e.where("label < 3"), "vec_id", "v", 18), "knn_distance")


def _centers(e: DataFrame) -> list[list[float]]:
    return vectors.dense_centroids(e, "label", "v", list(range(10)))


def centroid_affinity(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    got = vectors.affinity(e, "v", _centers(e))
    return got.select("vec_id", *[F.round(F.get("affinity", F.lit(i)), 6).alias(f"a{i}") for i in range(10)])


def cosine_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    s = vectors.similarities(F.col("v"), _centers(e))
    own = e.select("vec_id", s.alias("s"))
    return own.select("vec_id", F.round(F.array_max("s"), 6).alias("similarity"), N.argmax(F.col("s")).cast("long").alias("prototype"))


# ---- consensus


def _stage1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7 - 3).cast("double").alias("h"), encounter.hash_unit(F.col("doc_id"), "dp").alias("dp"), encounter.hash_unit(F.col("doc_id"), "dn").alias("dn"), encounter.hash_unit(F.col("doc_id"), "k").alias("k"))
    pos, neg = F.col("h") >= 2, F.col("h") <= -2
    return consensus.stage1_scores(d, "h", "dp", "dn", "k").withColumn("pos", pos).withColumn("neg", neg)


def stage1_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _stage1(spark, sf).select("doc_id", R6("score_raw").alias("score_raw"), R6("prob").alias("prob"))


def stage1_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The first stage over distances of vectors: to both anchors and to all rows, then scores, threshold and label."""
    e = _embeddings(spark, sf).select("vec_id", "v", (F.col("vec_id") % 7 - 3).cast("double").alias("h"))
    work = e.withColumn("pos", F.col("h") >= 2).withColumn("neg", F.col("h") <= -2)
    for name, fit, k in (("dp", work.where("pos"), 12), ("dn", work.where("neg"), 12), ("k", work, 18)):
        work = work.join(vectors.knn_mean_distance(e, fit, "vec_id", "v", k, name), "vec_id")
    # written once, as means and deviations are taken first
    got = consensus.stage1_scores(metric.scratch(work.select("vec_id", "h", "dp", "dn", "k"), "distances"), "h", "dp", "dn", "k")
    return got.select("vec_id", R6("dp").alias("d_pos"), R6("dn").alias("d_neg"), R6("score_raw").alias("score_raw"), R6("prob").alias("prob"))


def threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    s = _stage1(spark, sf).withColumn("prob", F.round("prob", 9))
    t = consensus.threshold_search(s, "prob", "pos", "neg")
    cut = s.withColumn("label", (F.col("prob") >= t).cast("int"))
    return consensus.anchor_balanced_accuracy(cut, "label", "pos", "neg").select(F.round(F.lit(t), 6).alias("threshold"), R6("balanced_accuracy").alias("balanced_accuracy"))


MODELS = [f"m{i}" for i in range(5)]


def label_alignment(spark: SparkSession, sf: str) -> DataFrame:
    got = consensus.align_labels(encounter.voters(spark, sf), "m0", MODELS, 3)
    return got.select("model", F.array_join(F.col("permutation").cast("array<string>"), "").alias("permutation"), "matches")


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    v = encounter.voters(spark, sf)
    best = consensus.best_permutations(v, "m0", MODELS, 3)
    return v.select("doc_id", *[consensus.relabel(F.col(m), best[m]).alias(m) for m in MODELS])


def consensus_votes(spark: SparkSession, sf: str) -> DataFrame:
    got = consensus.votes(_aligned(spark, sf), MODELS, 3)
    ranks = consensus.size_ranks(got, "cluster_consensus", 3).select("cluster_consensus", "drug_index")
    return got.join(F.broadcast(ranks), "cluster_consensus").select("doc_id", F.col("cluster_consensus").cast("long").alias("cluster_consensus"), R6("confidence").alias("confidence"), F.concat(F.lit("Drug_"), F.col("drug_index").cast("string")).alias("drug"))


def ari_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(consensus.pairwise_ari(encounter.voters(spark, sf), MODELS), "ari")


def blend_outputs(spark: SparkSession, sf: str) -> DataFrame:
    got = consensus.votes(encounter.voters(spark, sf).withColumn("prob", encounter.hash_unit(F.col("doc_id"), "pr")), MODELS, 3)
    u = [0.1 + encounter.hash_unit(F.col("doc_id"), f"a{i}") for i in range(3)]
    got = got.withColumn("aff", F.array(*[c / (u[0] + u[1] + u[2]) for c in u])).withColumn("lab", (F.col("prob") >= 0.4).cast("int"))
    out = consensus.blend(got, "prob", "lab", "vote_shares", "aff", [2, 0, 1])
    return out.select("doc_id", "label_name", R6("label_confidence").alias("label_confidence"), *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])


def shift_metrics(spark: SparkSession, sf: str) -> DataFrame:
    v = encounter.voters(spark, sf).withColumn("a", encounter.hash_unit(F.col("doc_id"), "x")).withColumn("b", encounter.hash_unit(F.col("doc_id"), "y"))
    return _rounded(consensus.shift_metrics(v, "m0", "base", "a", "b"), "flip_rate", "mean_abs_shift")


# ---- folds and metrics


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "labels").select((F.col("quality") + F.col("toxic")).cast("int").alias("y"))
    return _rounded(evaluate.class_weights(y, "y", [0, 1, 2, 3]), "weight")


def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 5).withColumn("fold", F.col("fold").cast("long"))


def fold_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fold_class_counts(stratified_folds(spark, sf), "fold", "quality", [0, 1])


def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.group_folds(table(spark, sf, "documents"), "source", 5)


def metrics_basic(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.with_prediction(encounter.scored(spark, sf), "probs")
    return _rounded(evaluate.basic_metrics(s, "y", "prediction"), "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")


def class_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.with_prediction(encounter.scored(spark, sf), "probs")
    return _rounded(evaluate.class_metrics(s, "y", "prediction").withColumn("class", F.col("class").cast("long")), "precision", "recall", "f1")


def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.auroc(encounter.scored(spark, sf), F.col("toxic") == 1, F.col("score")), "auroc")


def macro_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.macro_auroc(encounter.scored(spark, sf), "y", "probs", 3), "macro_auroc")


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.average_precision(encounter.scored(spark, sf), F.col("toxic") == 1, F.col("score")), "average_precision")


def logloss(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.log_loss(encounter.scored(spark, sf), "y", "probs"), "log_loss")


def fold_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    s = stratified_folds(spark, sf).groupBy("fold").agg(F.avg("quality").alias("share"), F.avg("doc_id").alias("key"))
    return _rounded(evaluate.aggregate_folds(s, ["share", "key"]), "mean", "std", "min")


# ---- reports and simulation


def top_k_examples(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_examples(table(spark, sf, "documents"), "lang", "n_chars", "doc_id", 5).select("lang", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def hash_sample_examples(spark: SparkSession, sf: str) -> DataFrame:
    return report.sampled_examples(table(spark, sf, "documents"), "lang", "n_chars", "doc_id", 5, 42).select("lang", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def category_order(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "No_Festival").when(F.col("o_orderkey") % 9 == 1, "Other").otherwise(F.concat(F.lit("Drug_"), (F.col("o_orderkey") % 12).cast("string"))).alias("label"))
    counts = profile.value_counts(labels, "label")
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*report.category_order(F.col("label")))).cast("long"))


def retry_simulation_expected(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("trial"), *[simulate.hashed_uniform(F.col("o_orderkey"), F.lit(i)).alias(f"u{i}") for i in range(4)])
    totals = calls.groupBy("trial").agg(F.sum(simulate.call_seconds([F.col(f"u{i}") for i in range(4)], 3.0, 0.3)).alias("s"))
    return _rounded(simulate.time_summary(totals, "s"), "mean", "p50", "p90", "p95", "p99")


def metric_value_summary(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "customer").agg(F.count("*").alias("rows"), F.countDistinct("c_mktsegment").alias("segments"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    return report.metric_table(one)


# ---- models: their library's random numbers cannot be had elsewhere


def kmeans_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return model.kmeans(_embeddings(spark, sf).select("vec_id", "v"), "v", 3, key="vec_id", rounds=8)[1].select("vec_id", "cluster")


def gmm_plane(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture over the first two numbers of each vector, ten rounds from eight of k-means."""
    plane = _embeddings(spark, sf).select("vec_id", F.slice("v", 1, 2).alias("p"))
    rows = plane.select(F.col("vec_id").alias("id"), F.col("p").alias("v"))
    return cluster.expectation_maximization(rows, 3, 42, rounds=10, tolerance=0.0, start_rounds=8).transform(plane, "p").select("vec_id", "cluster")


def gmm_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return model.gaussian_mixture(model.pca(_embeddings(spark, sf).select("vec_id", "v"), "v", 8), "projected", 3).select("vec_id", "cluster")


def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    return model.pca(_embeddings(spark, sf).select("vec_id", "v"), "v", 8).select("vec_id", "projected")


def ward_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds over the table until 200 clusters are left, so that they are in use on small tables too."""
    return model.ward(_embeddings(spark, sf).select("vec_id", "v"), "vec_id", "v", 3, local=200).select("vec_id", "cluster")


def tfidf_svd(spark: SparkSession, sf: str) -> DataFrame:
    return model.tfidf_svd(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", components=8, vocabulary=2000)


def classifier_folds(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).select("vec_id", "v", (F.col("label") % 3).alias("y"))
    folds = evaluate.stratified_folds(e, "vec_id", "y", 3)
    return model.cross_validate(folds, "v", "y", "fold", lambda: model.classifier("mlp", 64, 3)).select("vec_id", "y", "fold", "prediction")


QUERIES = {
    f.__name__: f
    for f in (
        crosstab_nation_balance, missingness_docs_labels, numeric_summary_lineitem, categorical_summary_part, value_counts_event_type, share_of_total, key_overlap_tables,
        pattern_scan_documents, group_sizes_with_nulls, mode_consistency, one_to_one_join_encounter, left_join_customer_orders, dup_key_check, missing_keys, distinct_first_by_key,
        column_slugify, normalize_ws, text_corpus, conversation_corpus, term_hits_score, date_parts_orders, vitals_shorthand, one_hot_segment, impute_median, standardize_ddof0,
        train_fold_standardize, nested_len_hist, nested_event_counts, nested_summary_full, nested_summary_reduced, parse_nested_cells, props_key_types, top_categories,
        symptom_triples, prototype_match, extraction_coerce, nested_types, network_gradient, knn_mean_distance, knn_pivot_join, knn_to_anchor, centroid_affinity, cosine_prototypes, stage1_scores, stage1_embeddings, threshold_search,
        label_alignment, consensus_votes, ari_pairs, blend_outputs, shift_metrics, class_weights, stratified_folds, fold_class_counts, group_folds, metrics_basic,
        class_precision_recall, auroc, macro_auroc, avg_precision, logloss, fold_aggregate, top_k_examples, hash_sample_examples, category_order, retry_simulation_expected,
        metric_value_summary, kmeans_ensemble, gmm_plane, gmm_clusters, pca_projection, ward_clusters, tfidf_svd, classifier_folds,
    )
}
