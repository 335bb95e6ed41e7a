import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm.pieces import SPACE, Cuts, PieceTable, atoms_of, best_path, decode, encode, segment
from cohortry.llm.queries import PIECE_MODEL, op3_sentencepiece

needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model file")


@pytest.fixture(scope="module")
def table():
    return PieceTable.load(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=PIECE_MODEL)


def _texts():
    r = random.Random(8)
    parts = ["the", " ", "  ", "\n", "ing", "Ünï", "日本", "🎉", ".", "!!", "123", "x" * 9, "aaaa", "▁", "“", "e.g.", "\x00", "\t", "ß"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(150)] + ["y" * 400 + "ab" * 40, "", " "]


@needs_model
@pytest.mark.parametrize("frequent", [1 << 19, 2])
def test_ids_are_those_of_the_library(spark, table, library, frequent):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = encode(df, table, frequent=frequent, block_atoms=50, check=True).collect()
    for r in rows:
        want = library.encode(texts[r["doc_id"]])
        assert list(r["ids"]) == want and r["n_tokens"] == len(want) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in decode(spark.createDataFrame(rows).select("doc_id", "ids"), table).collect()}
    assert back == {i: t.replace(SPACE, " ") for i, t in enumerate(texts)}


@needs_model
def test_documents(spark, sf, small, library):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in op3_sentencepiece(spark, sf).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]]) and r["round_trip"]


@needs_model
def test_odd_rows(spark, odd, none, table, library):
    rows = encode(odd.withColumn("ids", F.lit("mine")), table).collect()
    assert sorted(list(r["ids"]) for r in rows) == sorted(library.encode(r["text"] or "") for r in odd.collect())
    assert encode(none, table).count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), table).orderBy("doc_id").collect()[0]["text"] is None


def best(word, scores, low):
    """Of all ways to cut the word, the highest sum."""
    n, top = len(word), None
    for cut in itertools.product((0, 1), repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), n]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores or len(p) == 1 for p in parts):
            s = sum(scores.get(p, low) for p in parts)
            top = s if top is None or s > top else top
    return top


def test_viterbi_is_the_best_path(spark):
    r = random.Random(6)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(40)} - {"c"})
    scores = [-r.random() * 10 for _ in pieces]
    t = PieceTable(["<unk>", *pieces], [0.0, *scores], "unigram", [False, *(True for _ in pieces)])
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)})
    got = {x["word"]: x["ids"] for x in segment(spark.createDataFrame([(w,) for w in words], ["word"]), t).collect()}
    own = dict(zip(pieces, scores))
    low = min(scores) - 10
    for w in words:
        names = [t.pieces[i] for i in got[w]]
        assert len("".join(n if n != "<unk>" else "?" for n in names)) == len(w)
        assert abs(sum(own.get(n, low) for n in names) - best(w, own, low)) < 1e-9, w


def test_viterbi_on_a_long_word(spark):
    """Ends beyond 4,095; with and without characters that are no piece."""
    t = PieceTable(["<unk>", "ab", "a", "b"], [0.0, -1.0, -2.0, -2.0], "unigram", [False, True, True, True])
    words = ["ab" * 2100, "ab" * 2050 + "?" + "ab" * 40]
    got = {x["word"]: x["ids"] for x in segment(spark.createDataFrame([(w,) for w in words], ["word"]), t).collect()}
    assert got[words[0]] == [1] * 2100 and got[words[1]] == [1] * 2050 + [0] + [1] * 40


def test_the_fold_of_long_words_is_the_best_path():
    """The fold over arrays against all ways to cut, ties included: the first of equal paths from the left."""
    r = random.Random(16)
    for _ in range(150):
        own = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -float(r.randint(1, 6)) for _ in range(14)}
        low = min(own.values()) - 10
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 10)))
        at = [(i, k) for i in range(len(w)) for k in range(1, 5) if w[i : i + k] in own and i + k <= len(w)]
        start, size = np.array([i for i, _ in at], np.int64), np.array([k for _, k in at], np.int64)
        path = best_path(len(w), start, size, np.array([own[w[i : i + k]] for i, k in at]), low)
        assert "".join(w[a:z] for a, z in path) == w
        assert abs(sum(own.get(w[a:z], low) for a, z in path) - best(w, own, low)) < 1e-9


def test_atoms_are_cut_where_no_piece_crosses():
    cuts = Cuts({("a", "b"), ("b", "a"), (SPACE, "a")})
    a = atoms_of(["ab ba1ab", "", "cc"], cuts, False)
    assert [a.word(i) for i in range(len(a.start))] == ["ab", SPACE, "ba", "1", "ab", "c", "c"] and a.before.tolist() == [0, 5, 5, 7]
    many = Cuts({(chr(300 + i), chr(301 + i)) for i in range(5000)})
    assert many.dense is None and many.between(np.array([300, 301, 305, 306])).tolist() == [False, True, False]


@needs_model
def test_long_atoms_are_those_of_the_library(spark, table, library):
    """Words of letters alone, of up to 40,000 characters, in time that grows with their length."""
    r = random.Random(12)
    took = []
    for n in (10_000, 20_000, 40_000):
        word = "".join(r.choice("etaoinshr") for _ in range(n))
        df = spark.createDataFrame([(1, word), (2, "日本語テキスト。" * (n // 8)), (3, word[:61]), (4, word[:60])], "doc_id long, text string")
        began = time.perf_counter()
        rows = encode(df, table, check=True).collect()
        took.append(time.perf_counter() - began)
        for x in rows:
            assert list(x["ids"]) == library.encode({1: word, 2: "日本語テキスト。" * (n // 8), 3: word[:61], 4: word[:60]}[x["doc_id"]]) and x["round_trip"]
    assert took[2] < 2.5 * took[1] + 2, took


@needs_model
def test_clashing_columns(spark, table, library):
    df = spark.createDataFrame([(1, "some words", "x", 2, "w"), (1, "some words", "x", 2, "w")], "doc_id long, text string, ids string, n_tokens int, word string")
    assert [list(r["ids"]) for r in encode(df, table).collect()] == [library.encode("some words")] * 2
