"""Collocations against counts of every phrase in plain Python, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortry.llm import collocations as module
from cohortry.llm.collocations import collocations, phrase_counts
from cohortry.llm.queries import ORACLES, op12_collocations


def brute(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * own[p[i : i + k]]}
        found = []
        for p, a in cands.items():
            if p not in drop:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((lang, " ".join(p), a, own[p[:k]], own[p[k:]], n[lang], s))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(found[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, docs=120):
    r = random.Random(seed)
    words = ["Of", "the", "in", "new", "york", "é", "a b", "x"]
    fixed = ["new york in the", "of the new york x", "the the the the the the", "É é a b"]
    part = [" ", "  ", "\t", ". ", ", ", "\n", "\x0b", " ; "]
    text = lambda: "".join(r.choice([*words, *fixed]) + r.choice(part) for _ in range(r.randint(0, 30)))
    return [(r.choice(["en", "en", "en", None, "und", "fr"]), r.choice([None, "", text(), text(), text(), text()])) for _ in range(docs)]


@pytest.mark.parametrize("seed,least,top,bits", [(1, 5, 2000, 1 << 26), (2, 3, 7, 1 << 15), (3, 1, 2000, 1 << 15)])
def test_as_brute_force(spark, monkeypatch, seed, least, top, bits):
    if seed == 2:  # many small sections, words forgotten at once
        monkeypatch.setattr(module, "_SECTION", 64), monkeypatch.setattr(module, "_WORDS", 4)
    rows = made(seed)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("w1", F.lit("x"))
    assert got(collocations(df, least=least, top=top, bits=bits)) == brute(rows, least, top)


def test_sections_hold_whole_pieces(monkeypatch):
    monkeypatch.setattr(module, "_SECTION", 10)
    texts = [b"a b c. d e f g h i j k l m. n", b"", b"o", b"p q. "]
    one = [w for s in module._sections(texts) for w in [*module.words_of(s), b"\n"]]
    many = [w for t in texts for w in [*module.words_of(t), b"\n"]]
    pieces = lambda ws: [p for p in b" ".join(ws).split(b"\n") if p.strip()]
    assert pieces(one) == pieces(many)


def test_odd_rows(odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(collocations(odd, least=2)) == brute(rows, 2, 2000)
    assert collocations(none).count() == 0
    counts = {(r["lang"], r["m"]): r["f"] for r in phrase_counts(odd, least=10**9).df.collect()}
    assert counts == {("en", 0): 7 * 3 + 30_000 + 3 + 1, ("fr", 0): 30_001, ("es", 0): 7}  # a language without words has no row


def test_large_numbers_are_exact(spark):
    a, n, l, r = 10**13 + 7, 10**16 + 3, 10**13 + 9, 10**13 + 11  # noqa: E741
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(module._floor_ratio(*[F.col(c) for c in "anlr"]).alias("s")).first()
    assert row["s"] == 1000 * a * n // (l * r)


def test_as_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(ORACLES["op12_collocations"]).fetchall())
    assert got(op12_collocations(spark, sf)) == want and want
    low = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(collocations(low, least=4)) == sorted(db.execute(ORACLES["op12_collocations"].replace(">= 100", ">= 4")).fetchall())


def test_memory_of_a_task_is_bounded():
    """A batch of 8 MB of rare words, as Spark sends them: a task takes it in sections, whose arrays and batches stay small."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(r.choices(words, k=2000)).encode() for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "t"])
    assert batch.nbytes > 7 << 20
    tracemalloc.start()
    try:
        most = max(b.nbytes for b in module._windows(SimpleNamespace(value=b"\xff" * (1 << 12)), 1 << 15, 5)(iter([batch])))
        assert most < 8 << 20 and tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
