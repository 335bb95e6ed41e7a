"""Whole workflows over a set of encounter tables, composed of the operators.

Tables are a dict of DataFrames that share a key. Steps that must look at data first (categories, anchors, thresholds,
model fits) do so by small aggregates; everything else stays a lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import consensus, contracts, evaluate, extract, features, model, nested, network, profile, report, rules, vectors
from ..sources import answers

# Terms of the weak score, its weights, and places in a history's "from ... with".
FESTIVAL_TERMS = ["festival", "main stage", "campground", "vip tent", "beach shuttle", "medical tent", "rave", "dance", "dj"]
COMMUNITY_TERMS = ["community patient", "home", "workplace", "shopping area", "street", "restaurant", "gym"]
FESTIVAL_PLACES = "main stage|campground|vip tent|festival|beach shuttle"
COMMUNITY_PLACES = "home|workplace|shopping area|street|restaurant|gym"


def profile_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Missingness and summaries of each table, and the overlap of shared identifiers of each two."""
    out: dict[str, DataFrame] = {}
    for name, t in tables.items():
        out[f"{name}__missingness"] = profile.missingness(t)
        if profile.numeric_columns(t):
            out[f"{name}__numeric_summary"] = profile.numeric_summary(t)
        if profile.other_columns(t):
            out[f"{name}__categorical_summary"] = profile.categorical_summary(t)
    names, overlaps = sorted(tables), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for c in sorted(set(contracts.id_columns(tables[a])) & set(contracts.id_columns(tables[b]))):
                one = profile.key_overlap(tables[a], tables[b], c, c, a, b).withColumn("id_column", F.lit(c))
                overlaps = one if overlaps is None else overlaps.unionByName(one)
    if overlaps is not None:
        out["id_overlap"] = overlaps
    return out


def profile_report(profiles: dict[str, DataFrame], title: str = "Profile", rows: int = 50) -> str:
    """The profiles as Markdown."""
    return "\n\n".join([f"# {title}", *(f"## {n}\n\n{report.markdown_table(t, rows)}" for n, t in profiles.items())])


def weak_scores(df: DataFrame, text: Column, arrival: Column, history: Column) -> DataFrame:
    """Columns of the weak score, and ``heuristic_score``."""
    from ..functions import text as X

    place = F.regexp_extract(F.lower(F.coalesce(history, F.lit(""))), "from ([^,]+) with", 1)
    out = df.withColumns(
        {
            "festival_term_hits": X.term_hits(text, FESTIVAL_TERMS), "community_term_hits": X.term_hits(text, COMMUNITY_TERMS), "arrival_festival": X.matches(F.lower(arrival), "festival"),
            "location_festival": X.matches(place, FESTIVAL_PLACES), "location_community": X.matches(place, COMMUNITY_PLACES),
        }
    )
    c = F.col
    return out.withColumn("heuristic_score", 1.5 * c("arrival_festival") + 1.1 * c("festival_term_hits") + c("location_festival") - 0.9 * c("community_term_hits") - c("location_community"))


def nested_features(df: DataFrame, key: str, columns: list[str], full: bool = True, top: int = 8, literals: bool = False) -> DataFrame:
    """One row of features a record for all nested columns: a pass to find keys and values, then summaries in each row."""
    out = df.select(key)
    for c in columns:
        parse = nested.parse_literals if literals else nested.parse_nested
        items = df.select(key, parse(F.col(f"`{c}`")).alias("items"))
        kinds = nested.key_types(items, "items").collect()
        pairs = items.select(F.explode("items").alias("e")).select(F.explode("e").alias("key", "value"))
        categorical = [r["key"] for r in kinds if r["is_categorical"]]
        tops: dict[str, list[str]] = {k: [] for k in categorical}
        if categorical:
            for r in nested.top_categories(pairs.where(F.col("key").isin(categorical)), "key", "value", top).orderBy("key", "rank").collect():
                tops[r["key"]].append(r["value"])
        numeric = sorted(r["key"] for r in kinds if r["is_numeric"])
        prefix = contracts.slug(c)
        out = out.join(nested.summarize_nested(items, key, "items", prefix, numeric, tops, full), key, "left")
    return out


@dataclass
class TwoStage:
    """Results of both stages."""

    stage1: DataFrame
    votes: DataFrame
    labels: DataFrame
    stability: DataFrame
    threshold: float


def stage_one(df: DataFrame, key: str, vector: str, score: str, positive: Column, negative: Column) -> tuple[DataFrame, float]:
    """Anchors, distances to them and density, scores, a searched threshold with its guard, and ``label``."""
    work = consensus.anchors_with_fallback(df, score, positive, negative)
    d = {n: vectors.knn_mean_distance(work, fit, key, vector, k, n) for n, fit, k in (("d_pos", work.where("anchor_pos"), 12), ("d_neg", work.where("anchor_neg"), 12), ("d_all", work, 18))}
    for one in d.values():
        work = work.join(one, key)
    work = work.cache()  # read by each of the searches below
    scored = consensus.stage1_scores(work, score, "d_pos", "d_neg", "d_all")
    t = consensus.guarded_threshold(scored, "prob", consensus.threshold_search(scored, "prob", "anchor_pos", "anchor_neg"))
    return scored.withColumn("label", (F.col("prob") >= t).cast("int")), t


def stage_two(df: DataFrame, key: str, vector: str, k: int = 3, components: int = 28, hierarchical=model.ward) -> tuple[DataFrame, DataFrame]:
    """(aligned, agreed): the labels of five clusterings by key, aligned to the first, and their votes.

    ``hierarchical`` is the last of the five, ``model.ward`` or ``model.bisecting``.
    """
    inside = df.select(key, vector)
    width = len(inside.first()[vector])
    small = model.pca(inside, vector, min(components, width)).select(key, "projected").cache()
    runs = {f"kmeans_{s}": model.kmeans(small, "projected", k, (s,))[1] for s in (13, 47, 97)}
    runs |= {"gmm": model.gaussian_mixture(small, "projected", k), "hierarchical": hierarchical(small, key, "projected", k)}
    votes = small
    for name, got in runs.items():
        votes = votes.join(got.select(key, F.col("cluster").alias(name)), key)
    votes = votes.cache()
    names = list(runs)
    best = consensus.best_permutations(votes, names[0], names, k)
    aligned = votes.select(key, "projected", *[consensus.relabel(F.col(m), best[m]).alias(m) for m in names])
    return aligned, consensus.votes(aligned, names, k).cache()


def two_stage(df: DataFrame, key: str, vector: str, score: str, positive: Column, negative: Column, k: int = 3, components: int = 28, hierarchical=model.ward) -> TwoStage:
    """Weak labels, then the consensus of five clusterings among positive rows, then blended probabilities."""
    one, t = stage_one(df, key, vector, score, positive, negative)
    one = one.cache()
    aligned, agreed = stage_two(one.where("label = 1"), key, vector, k, components, hierarchical)
    order = [r["cluster_consensus"] for r in consensus.size_ranks(agreed, "cluster_consensus", k).orderBy("drug_index").collect()]
    centers = vectors.dense_centroids(agreed.join(one.select(key, vector), key), "cluster_consensus", vector, list(range(k)))
    soft = vectors.affinity(one, vector, centers)
    shares = agreed.select(key, "vote_shares", "cluster_consensus", "confidence")
    whole = soft.join(shares, key, "left").withColumn("vote_shares", F.coalesce("vote_shares", "affinity"))
    names = [c for c in aligned.columns if c not in (key, "projected")]
    return TwoStage(one, agreed, consensus.blend(whole, "prob", "label", "vote_shares", "affinity", order), consensus.pairwise_ari(aligned, names), t)


def leakage_sensitivity(base: TwoStage, wider: DataFrame, key: str, vector: str, score: str, positive: Column, negative: Column, k: int = 3, least: int = 12, components: int = 28, hierarchical=model.ward) -> DataFrame:
    """(check, value): how far labels move when vectors come from ``wider``, which holds text that may tell the outcome.

    Both stages run again on ``wider``. The first is compared over all rows; the second over the rows that the base labels
    positive, its clusters aligned to the base's. With fewer than ``least`` such rows the second stage's values are null.
    """
    other, _ = stage_one(wider, key, vector, score, positive, negative)
    both = base.stage1.select(key, "label", "prob").join(other.select(key, F.col("label").alias("label_w"), F.col("prob").alias("prob_w")), key)
    first = consensus.shift_metrics(both, "label_w", "label", "prob_w", "prob").first()
    flips = agreement = None
    inside = base.stage1.where("label = 1").select(key)
    if inside.limit(least).count() >= least:
        _, again = stage_two(wider.join(inside, key, "left_semi"), key, vector, k, components, hierarchical)
        two = base.votes.select(key, F.col("cluster_consensus").alias("a")).join(again.select(key, F.col("cluster_consensus").alias("b")), key)
        two = two.withColumn("b", consensus.relabel(F.col("b"), consensus.best_permutation(two, "a", "b", k))).cache()
        flips = two.agg(F.avg((F.col("a") != F.col("b")).cast("double"))).first()[0]
        agreement = consensus.adjusted_rand(two, "a", "b").first()["ari"]
    rows = [
        ("stage1_label_flip_rate", first["flip_rate"]), ("stage1_mean_abs_prob_shift", first["mean_abs_shift"]),
        ("stage2_flip_rate_on_base_positives", flips), ("stage2_ari_on_base_positives", agreement),
    ]
    return both.sparkSession.createDataFrame(rows, "check string, value double")


def leakage_safe(tables: dict[str, DataFrame], key: str, whole: str, narrow: dict[str, list[str]]) -> DataFrame:
    """One table for labels that must not see the outcome: ``whole`` without leaking columns, and of ``narrow`` tables only the columns listed.

    Keys must be unique on all sides; a listed column that looks like leakage is refused, and so is what remains in the end.
    """
    out = contracts.without_leakage(tables[whole], keep=(key,))
    for name, allowed in narrow.items():
        out = contracts.one_to_one_join(out, contracts.prefixed(contracts.only_columns(tables[name], key, allowed), out.columns, key, name), key)
    return contracts.without_leakage(out, keep=(key,))


def example_report(df: DataFrame, label: str, confidence: str, key: str, fields: list[str], k: int = 5, mode: str = "top", categories: list[str] | None = None, prefix: str | None = None, seed: int = 42, title: str = "Examples") -> str:
    """Markdown of ``k`` rows a category, the most confident or (``mode="sample"``) drawn by a hash, after a table of the categories' sizes.

    ``categories`` that no row has are an error; without them all are shown, or those that start with ``prefix``.
    """
    if mode not in ("top", "sample"):
        raise contracts.ContractError(f"no such mode: {mode}")
    if k <= 0:
        raise contracts.ContractError(f"the number of examples must be above 0, not {k}")
    contracts.require_columns(df, [label, confidence, key, *fields])
    chosen = report.choose_categories(df, label, categories, prefix)
    own = df.where(F.col(label).isin(chosen))
    some = report.top_examples(own, label, confidence, key, k) if mode == "top" else report.sampled_examples(own, label, confidence, key, k, seed)
    sizes = profile.value_counts(own, label).orderBy(*report.category_order(F.col(label)))
    return report.examples_report(some, label, [key, confidence, *fields], title) + "\n\n## Sizes\n\n" + report.markdown_table(sizes, 10_000)


def symptom_labels(df: DataFrame, key: str, text: Column, text_vector: str | None = None, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """Triples, vectors and prototype labels of notes; with the name of an embedding column, low-confidence rows are clustered and labelled by cluster."""
    extra = [text_vector] if text_vector else []
    work = rules.with_triples(df.select(key, text.alias("note"), *extra), F.col("note")).withColumn("v", rules.symptom_vector(F.col("triples")))
    out = rules.residual_labels(work, key, "v", text_vector, seeds=seeds) if text_vector else rules.prototype_match(work, "v")
    return out.withColumn("triples", F.to_json("triples"))


def extraction_labels(df: DataFrame, key: str, columns: list[str], client=extract.rule_client, k: int = 4, seed: int = 42, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, errors): prompts to records to features to clusters, with confidence 1 / (1 + distance to the center).

    With the path of a ``log`` no prompt that it answers is asked for again.
    """
    prompts = df.select(key, extract.prompt_record(columns).alias("prompt"))
    got = answers.extract_once(prompts, key, "prompt", client, log) if log else extract.extract_with(prompts, key, "prompt", client).cache()
    records = got.select(key, extract.read_extraction(F.col("response")).alias("r"))
    cols = extract.multi_hot(records, "r") + extract.numeric_block(F.col("r"))
    wide = records.select(key, *[F.col("r")[c].alias(c) for c in extract.DEFAULTS], *cols)
    hot = [h for c in extract.DEFAULTS for h in features.one_hot(wide, c, null_column=False)]
    names = [c for c in wide.columns if c != key and c not in extract.DEFAULTS]
    full = wide.select(key, *[F.col(f"`{c}`") for c in names], *hot)
    names = [c for c in full.columns if c != key]
    ready = features.assemble(features.standardize(full, names), key, names).cache()
    fitted, rows = model.kmeans(ready, "features", max(1, min(k, ready.count())), (seed,))
    d = F.array_min(vectors.distances(F.col("features"), [[float(x) for x in c] for c in fitted.clusterCenters()]))
    near = rows
    name = F.concat(F.lit("Drug_"), (F.col("cluster") + 1).cast("string"))
    labels = near.select(key, name.alias("label"), N.inverse_distance_confidence(d).alias("confidence"), "cluster")
    return labels, got.where("error is not null").select(key, "error")


def cross_validated(df: DataFrame, key: str, label: str, classes: list, exclude: tuple[str, ...] = (), folds: int = 5, kind: str = "logistic", seed: int = 42, hidden: tuple[int, ...] = (256, 256, 256)) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, metrics by fold) of a classifier on assembled features; labels must be among ``classes``.

    ``kind`` is one of ``model.classifier``, or "network": classes count by weight, and the checkpoint that does best on the fold
    left out is kept, so that its metrics are those of a chosen checkpoint.
    """
    contracts.require_unique(contracts.require_labels(df, label, classes), key)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    y = df.select(key, index.alias("y"))
    wide = features.feature_frame(df, key, (*exclude, label)).cache()
    names = [c for c in wide.columns if c != key]
    k = evaluate.usable_folds(y, "y", folds)
    rows = evaluate.stratified_folds(y, key, "y", k, seed).join(wide, key).cache()
    weights = evaluate.class_weights(y, "y", list(range(len(classes)))).select("y", "weight")
    out = None
    for f in range(k):
        own = features.standardize(rows, names, fit=rows.where(F.col("fold") != f), least=1e-6)
        ready = features.assemble(own, key, names).join(rows.select(key, "y", "fold"), key).join(F.broadcast(weights), "y")
        ready = ready.withColumn("label", F.col("y").cast("double"))
        if kind == "network":
            valid = ready.where(F.col("fold") == f).cache()
            macro_f1 = lambda net, d=valid: evaluate.basic_metrics(net.transform(d), "y", "prediction").first()["macro_f1"]
            fitted = network.fit(ready.where(F.col("fold") != f), key, network.Network(len(names), len(classes), hidden, seed=seed + f), macro_f1)[0]
            one = fitted.transform(valid).select(key, "y", "fold", "probs", "prediction")
        else:
            ready = model.with_vector(ready, "features", "vec").drop("features").withColumnRenamed("vec", "features")
            train, valid = ready.where(F.col("fold") != f), ready.where(F.col("fold") == f)
            fitted = model.classifier(kind, len(names), len(classes), seed, "weight" if kind == "logistic" else None).fit(train)
            one = fitted.transform(valid).select(key, "y", "fold", model.vector_to_array("probability").alias("probs"), F.col("prediction").cast("int").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    out, scores = out.cache(), None
    for f in range(k):
        own = out.where(F.col("fold") == f)
        m = evaluate.basic_metrics(own, "y", "prediction").join(evaluate.log_loss(own, "y", "probs"), how="cross").join(evaluate.macro_auroc(own, "y", "probs", len(classes)), how="cross").withColumn("fold", F.lit(f))
        scores = m if scores is None else scores.unionByName(m)
    return out, scores
