import hashlib
import re
import time
from collections import defaultdict

from cohortry.llm.line_dedup import drop_common_lines
from cohortry.llm.queries import op8_line_dedup


def _key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least):
    """(kept text, lines, dropped lines) of each of ``rows`` (id, text): a line counts by its distinct ids that are not null."""
    held = defaultdict(set)
    for i, t in rows:
        for k in {_key(x) for x in (t or "").split("\n")} - {""}:
            held[k] |= {i} - {None}
    lines = [(t or "").split("\n") for _, t in rows]
    return [("\n".join(x for x in own if len(held[_key(x)]) < least), len(own), sum(len(held[_key(x)]) >= least for x in own)) for own in lines]


def _got(df):
    return sorted((r["kept_text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


def test_matches_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = dict(zip([i for i, _ in rows], brute(rows, 3)))
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in drop_common_lines(small, min_docs=3).collect()}
    assert got == want and any(w[2] for w in want.values())


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for least in (2, 3):
        got = drop_common_lines(odd, min_docs=least)
        assert _got(got) == sorted(brute(rows, least))
        assert set(odd.columns) <= set(got.columns)
    assert drop_common_lines(none).count() == 0


def test_documents_count_and_not_rows(spark):
    """Ten rows of one id are one document; rows without an id are none, but lose what others have too often."""
    rows = [(1, f"mine\nown {i}") for i in range(10)] + [(None, "no id\nshared")] * 12 + [(i, "shared\nx") for i in range(20, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_common_lines(df)
    assert _got(got) == sorted(brute(rows, 10))
    kept = [r["kept_text"] for r in got.collect()]
    assert sum("mine" in k for k in kept) == 10 and sum(k == "no id" for k in kept) == 12 and kept.count("") == 10


def test_edges_of_lines(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["A\n\nB\n", " a\t\nc", "\x0bA ", "É", "é", "É"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in drop_common_lines(df, min_docs=3).collect()}
    assert got[0] == ("\nB\n", 4, 1) and got[1] == ("c", 2, 1) and got[2] == ("", 1, 1) and got[3] == ("É", 1, 0)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "mine", 7, "a", "b", "c", "d")], "doc_id long, text string, kept_text string, n_lines int, __drop string, __kept string, row string, `k1` string")
    r = drop_common_lines(df).first()
    assert r["kept_text"] == "x" and r["n_lines"] == 1 and r["__drop"] == "a" and r["__kept"] == "b" and r["row"] == "c" and r["k1"] == "d"


def test_least_characters(spark):
    df = spark.createDataFrame([(i, f" ab \nabc\n{i}") for i in range(5)], "doc_id long, text string")
    assert {r["n_dropped"] for r in drop_common_lines(df, min_docs=5, min_chars=3).collect()} == {1}


def test_a_very_long_text(spark):
    """A text of many lines, half of them common: time grows with its length."""
    took = []
    for n in (100_000, 200_000):
        long = "\n".join(f"common {i % 50_000}" if i % 2 else f"own {i}" for i in range(n))
        rows = [(1, long), (2, "\n".join(f"common {i}" for i in range(1, 50_000, 2)))]
        df = spark.createDataFrame(rows, "doc_id long, text string").cache()
        df.count()
        began = time.perf_counter()
        got = _got(drop_common_lines(df, min_docs=2))
        took.append(time.perf_counter() - began)
        assert got == sorted(brute(rows, 2))
    assert took[1] < 4 * took[0] + 3


def test_query(spark, sf, small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = dict(zip([i for i, _ in rows], brute(rows, 10)))
    for r in op8_line_dedup(spark, sf).collect():
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]][0].encode()).hexdigest()
