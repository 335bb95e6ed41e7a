import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm.components import components
from cohortry.llm.ngram_join import _Join, mark_of, ngram_classes, ngram_sets
from cohortry.llm.queries import op7_ngram_jaccard


def grams(t, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class Classes(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def classed(rows, num=3, den=4):
    """(id, size, class) of each of ``rows`` (id, text); rows are told apart by their place, so that ids may be null or repeat."""
    sets = [grams(t) for _, t in rows]
    held = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            held[g].append(k)
    common = Counter(p for ks in held.values() for p in itertools.combinations(ks, 2))
    classes = Classes()
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            classes.join(a, b)
    first = {}
    for k, (i, _) in enumerate(rows):
        root = classes.find(k)
        first[root] = min((x for x in (first.get(root), i) if x is not None), default=None)
    return [(i, len(sets[k]), first[classes.find(k)]) for k, (i, _) in enumerate(rows)]


def brute(rows):
    """{id: (size, class)} of rows whose ids are unique."""
    return {i: (n, c) for i, n, c in classed(rows)}


def got(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_classes(df, **kw).collect()}


def got_rows(df, **kw):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_classes(df, **kw).collect()], key=repr)


def near_copies(n, seed, change):
    """Texts around one base, each with some words changed: many pairs near the threshold, and a passage that all share."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = [x if r.random() > change else f"c{r.randrange(10**6)}" for x in base]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("kw", [{}, {"few": 1, "block": 30, "listed": 20}, {"bloom_bits": 1 << 16, "listed": 1}])
def test_matches_brute_force(small, kw):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = brute(rows)
    assert got(small, **kw) == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("change", [0.01, 0.03, 0.05])
def test_large_groups_of_near_copies(spark, change):
    rows = near_copies(160, 4, change)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, few=10, block=40) == brute(rows)


def test_threshold_is_inclusive(spark):
    # 7 common of 7 + 7 shingles is below; 6 of 8 in the union is exactly 3/4
    a = " ".join(f"a{i}" for i in range(11))  # 7 shingles
    b = " ".join([*(f"a{i}" for i in range(10)), "z"])  # 6 of them in common, union 8
    c = " ".join([*(f"a{i}" for i in range(9)), "y", "z"])  # 5 in common with a, union 9
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    assert got(df) == {1: (7, 1), 2: (7, 1), 3: (7, 3)} == brute([(1, a), (2, b), (3, c)])


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    # rows of one id are one document: its texts' sets are those of one class
    assert got_rows(odd) == sorted(classed(rows), key=repr)
    assert ngram_classes(none).count() == 0


def test_null_and_repeated_ids(spark):
    """A chain whose middle has no id, a class without any id, repeated rows, and one id with two texts."""
    w = [f"a{i}" for i in range(60)]
    chain = [" ".join(w), " ".join([*w[:-7], *(f"b{i}" for i in range(7))]), " ".join([*(f"c{i}" for i in range(6)), *w[6:-7], *(f"b{i}" for i in range(7))])]
    lone = " ".join(f"n{i}" for i in range(30))
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (None, lone), (None, lone + " z"), (None, lone), (7, "x y z u v w"), (7, "x y z u v w"), (9, "q r s t u v"), (9, chain[0] + " end")]
    want = classed(rows)
    assert want[2][2] == 1 and want[3][2] is None and classed([rows[0], rows[2]])[1][2] == 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_rows(df) == sorted(want, key=repr)
    assert got_rows(df, few=1, block=2, hot=1) == sorted(want, key=repr)


def test_hot_ngrams_are_dealt_out(spark):
    """A passage in most documents, so that it stands in their prefixes, in parts of a few nodes."""
    r = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"t{i}x{k}" for k in range(r.randint(0, 30)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, hot=5, few=10, block=40) == brute(rows)


def test_blocks_hold_no_node_that_nobody_asked_for(spark):
    """A bitmap of few bits lets other rows through; none of them goes into the block product."""
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(12))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = _Join(df, "doc_id", "text", 5, 3, 4, 1 << 18, 1 << 15, 64, 500, 200_000)
    read = join.read().df.where("gram is null")
    reps = read.select("node", "rk")
    asked = reps.orderBy("node").limit(300).select("node")
    assert join.sets(asked, reps).df.count() > 300
    assert sorted(r["node"] for r in join.dense_sets(asked, reps).df.collect()) == sorted(r["node"] for r in asked.collect())


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, 6, "a"), (2, long + " end", 7, 8, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long, component_id long, rk string")
    assert got(df) == {1: (59_996, 1), 2: (59_997, 1)}


def test_hashes_keep_words_apart():
    assert [len(x) for n in range(5) for x in ngram_sets([b"a " * n], 5)] == [0, 1, 1, 1, 1]
    assert ngram_sets([b""], 5)[0].size == 0 and ngram_sets([], 5) == []
    a, b, c, d, e = ngram_sets([b"ab c", b"a bc", b"AB\tC", b"", b"one two three four five six"], 5)
    assert a.tolist() != b.tolist() and a.tolist() == c.tolist() and len(d) == 0 and len(e) == 2
    many = ngram_sets([f"w{i} x".encode() for i in range(5000)], 5)
    assert len(np.unique(np.concatenate(many))) == 5000


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (None, 3)]
    classes = Classes()
    for a, b in edges:
        if a is not None and a != b:
            classes.join(a, b)
    out = components(spark.createDataFrame(edges, "a long, b long")).df
    assert {x["node"]: x["root"] for x in out.collect()} == {k: classes.find(k) for k in list(classes)}
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)


def test_query(spark, sf, small):
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7_ngram_jaccard(spark, sf).collect()} == want


def test_ngrams_of_the_same_documents_are_one(spark):
    """All n-grams of a repeated line are held by the same documents: their pairs are made once, with a weight."""
    rows = [(g, x, 9, x, 1) for g in (1, 2, 3) for x in (10, 20)] + [(4, x, 9, x, 1) for x in (10, 20, 30)] + [(5, x, 9, 10, 1) for x in (10, 40)]
    found = _Join.several(spark.createDataFrame(rows, "gram long, node long, n long, root long, w long"), 1)
    assert sorted((r["gram"], r["w"], r["k"]) for r in found.df.collect()) == [(1, 3, 2), (4, 1, 3)]


def test_marks_bound_the_difference():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    for moved in (0, 3, 90, 400):
        b = np.concatenate([a[moved:], r.integers(0, 1 << 63, moved // 2).astype(np.uint64)])
        apart = sum(bin(int(x)).count("1") for x in (mark_of(a) ^ mark_of(b)).view(np.uint64))
        assert 0.4 * (moved + moved // 2) <= apart <= moved + moved // 2


def test_blocks_of_like_sizes(spark):
    """A common phrase in texts of many sizes: blocks whose sizes allow no link do not meet, and all links are found."""
    r, rows = random.Random(8), []
    for i in range(60):
        own = "the same five words here " * (1 + i % 2) + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([4, 9, 30, 90])))
        rows += [(3 * i, own), (3 * i + 1, own + " end"), (3 * i + 2, own + " another end of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, few=2, block=5) == brute(rows)


def test_groups_that_many_tasks_hold_once_make_no_pairs(spark, monkeypatch):
    """Half of each text is common to 40, of which a task sees one: no n-gram of it may stand in a prefix, and no pair is made of it."""
    from cohortry.llm import ngram_join as module

    made = {}

    class Counting(module.Written):
        def __init__(self, df, label, *args):
            super().__init__(df, label, *args)
            made[label] = made.get(label, 0) + self.df.count()

    monkeypatch.setattr(module, "Written", Counting)
    common = " ".join(f"c{i}" for i in range(100))
    rows = [(i, common + " " + " ".join(f"w{i}x{j}" for j in range(100))) for i in range(40)]
    rows.append((40, rows[7][1] + " more"))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert got(df) == brute(rows)
    assert made["incidence"] <= 2 * 50 and made["pairs"] <= 1


def test_place_of_the_first_common_ngram(spark):
    """Pairs around the threshold, of which each has its first common n-gram as late as the threshold allows, or one place later."""
    r = random.Random(5)
    rows, at = [], 0
    for n in (8, 30, 61, 200):
        for change in (0, 1, n // 8, n // 7, n // 6, n // 4):
            for cut in (0, n // 7, n // 4):
                base = [f"t{at}_{j}" for j in range(n)]
                other = [f"s{at}_{j}" if j < change else w for j, w in enumerate(base)][: n - cut]
                rows += [(2 * at, " ".join(base)), (2 * at + 1, " ".join(other))]
                at += 1
    r.shuffle(rows)
    for kw in ({}, {"listed": 1, "few": 1}):
        assert got(spark.createDataFrame(rows, "doc_id long, text string"), **kw) == brute(rows)
