"""The stages one after the other, against plain versions of each."""

import corpus_pipeline as p
from cohortry.llm.mixing import mix
from tests_brute import brute_classes, brute_kept, brute_lines


def test_stages(spark, small):
    docs = small
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, "")
        if name == "quality rules":
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert got == {k: t for k, t in rows.items() if brute_kept(t)} and len(got) < len(rows)
        elif name == "line dedup":
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert got == brute_lines(rows, 10)
        elif name == "n-gram Jaccard join":
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert got == {k: rows[k] for k, (_, c) in brute_classes(list(rows.items())).items() if k == c}
        elif name == "mixing sources to target weights":
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(got) < set(rows) and len(got) > 0.5 * len(rows)
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(rows)
            break
        assert tuple(docs.columns) == p.COLUMNS
        rows, docs = got, spark.createDataFrame([r.asDict() for r in docs.collect()], docs.schema)


def test_run(spark, sf):
    assert p.run(spark, sf).count() > 50


def test_near_duplicates_keep_what_has_no_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (2, text), (None, text), (None, "no id and no copy"), (5, "a b c d e f"), (5, "u v w x y z"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, text), (None, "no id and no copy"), (5, "a b c d e f"), (5, "u v w x y z"), (6, None), (7, "")], key=repr)


def test_odd_and_empty(spark, odd, none):
    docs = odd.select(*p.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in p.quality_rules(spark, docs, "").collect()), key=repr) == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if brute_kept(r["text"])), key=repr)
    for docs in (odd.select(*p.COLUMNS), none.select(*p.COLUMNS)):
        for name, stage in p.STAGES[1:]:
            before = docs.collect()
            out = stage(spark, docs, "")
            rows = out.collect()
            if name == "SentencePiece encoding and decoding":
                assert len(rows) == len(before) and all(r["n_tokens"] == len(r["ids"]) for r in rows)
                break
            assert tuple(out.columns) == p.COLUMNS
            texts = {(r["doc_id"], r["text"] or "") for r in before}
            if name == "line dedup":
                assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            elif name == "n-gram Jaccard join":
                # one of the copies, one of the long texts, and every row that has no copy
                assert {(r["doc_id"], r["text"] or "") for r in rows} == {x for x in texts if x[0] not in (2, 7)}
            else:
                assert {(r["doc_id"], r["text"] or "") for r in rows} <= texts
            docs = spark.createDataFrame(rows, out.schema)
    assert mix(none).count() == 0


def test_mixing_as_sql(spark, small, tmp_path):
    """The stage's sample is that of the query's SQL over the same rows."""
    import duckdb

    from cohortry.llm.queries import ORACLES

    small.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = db.execute(f"SELECT doc_id FROM ({ORACLES['op6_mixing']}) WHERE sampled").fetchall()
    assert sorted(r["doc_id"] for r in p.mixing(spark, small, "").collect()) == sorted(k for (k,) in got)


def test_clashing_columns(spark, small):
    docs = small.limit(40).cache()
    wide = docs
    for name in ("key", "component_id", "kept", "rk", "node", "t", "k0", "topic", "sampled", "n_tokens", "ids", "kept_text", "TEXT2"):
        wide = wide.selectExpr("*", f"5 as {name}")
    for _, stage in p.STAGES:
        a, b = (sorted(map(repr, stage(spark, d, "").collect())) for d in (docs, wide))
        assert a == b
