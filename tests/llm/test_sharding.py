import math
import zlib
from collections import Counter, defaultdict

import pytest

import cohortry.llm.sharding as sharding
from cohortry.llm.queries import op1_kd_shards
from cohortry.llm.sharding import kd_shards


def _check(docs, rows, shards, id_col="doc_id"):
    want = sorted(((r[id_col], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r[id_col], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    return sizes


def brute(rows, dims, shards, tie):
    """Shards by text: a k-d tree over distinct texts in plain code. ``rows`` are (text, values of dims); no group is split."""
    groups = defaultdict(list)
    for text, values in rows:
        groups[text or ""].append(values)
    size = {t: (len(t.encode()) + 1) * len(g) for t, g in groups.items()}
    columns = [{t: math.log2(len(t.encode()) + 1) for t in groups}]
    for d in range(dims):
        values = [v[d] for g in groups.values() for v in g if v[d] is not None]
        if values and isinstance(values[0], str):
            a, z = min(values).encode(), max(values).encode()
            skip = next((i for i, (p, q) in enumerate(zip(a, z)) if p != q), min(len(a), len(z)))
            code = lambda v, skip=skip: int.from_bytes(v.encode()[skip : skip + 6].ljust(6, b"\0"), "big")
        else:
            code = float
        columns.append({t: min((code(v[d]) for v in g if v[d] is not None), default=None) for t, g in groups.items()})
    scaled = []
    for c in columns:
        have = [v for v in c.values() if v is not None]
        lo, hi = min(have, default=0), max(have, default=0)
        scaled.append({t: 0 if v is None or hi <= lo else math.floor((v - lo) / (hi - lo) * (2**20 - 1)) for t, v in c.items()})
    out = {}

    def split(own, leaves, first):
        if leaves == 1 or not own:
            out.update(dict.fromkeys(own, first))
            return
        dim = max(range(len(scaled)), key=lambda i: (max(scaled[i][t] for t in own) - min(scaled[i][t] for t in own), -i))
        order = sorted(own, key=lambda t: (scaled[dim][t], tie[t]))
        want, done, at = sum(size[t] for t in own) * (leaves // 2) / leaves, 0, 0
        while done + size[order[at]] <= want:
            done += size[order[at]]
            at += 1
        at += done + size[order[at]] - want < want - done
        split(order[:at], leaves // 2, first)
        split(order[at:], leaves - leaves // 2, first + leaves // 2)

    split(list(groups), shards, 0)
    return out


def _ties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "pmod(xxhash64(xxhash64(t), hash(t), 0L), 4294967296L) as tie")
    return {r["t"]: r["tie"] for r in df.collect()}


@pytest.mark.parametrize("shards", [2, 7, 16])
def test_against_a_plain_tree(spark, small, shards, monkeypatch):
    monkeypatch.setattr(sharding, "_MISS", 0.0)
    docs = small.collect()
    want = brute([(r["text"], (r["source"], r["lang"], r["n_chars"])) for r in docs], 3, shards, _ties(spark, {r["text"] or "" for r in docs}))
    got = {r["doc_id"]: r["shard"] for r in kd_shards(small, shards=shards, slack=100.0).collect()}
    assert got == {r["doc_id"]: want[r["text"] or ""] for r in docs}


def test_sizes_are_near_equal(small):
    sizes = _check(small, kd_shards(small, shards=16).collect(), 16)
    largest = max(len((r["text"] or "").encode()) for r in small.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_against_a_direct_median_split(spark):
    """One dimension and unit sizes: cuts are those of sorting."""
    rows = [(i, chr(200 + i), (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r["doc_id"]: r["shard"] for r in kd_shards(df, dims=("n",), shards=4).collect()}
    order = [got[r[0]] for r in sorted(rows, key=lambda r: r[2])]
    assert order == sorted(order)
    assert max(order.count(s) for s in range(4)) - min(order.count(s) for s in range(4)) <= 1


def test_equal_texts_share_a_shard(spark):
    """Copies with other sources and languages stay together below the slack; nothing else is split."""
    rows = [(i, f"text {i // 3} " + "x" * (i // 3 % 50), f"src{i % 5}", "en" if i % 2 else "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd_shards(df, shards=8).collect()
    sizes = _check(df, got, 8)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"] // 3].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_only_a_group_above_the_slack_is_split(spark):
    rows = [(i, "same text", "s", "en") for i in range(900)] + [(1000 + i, f"other {i // 2}", "s", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd_shards(df, shards=8).collect()
    sizes = _check(df, got, 8)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    of = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 1000:
            of[r["doc_id"] // 2].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_a_hot_row_of_one_id(spark):
    """Rows equal in all columns, and rows with a null id, are dealt out like others."""
    rows = [(7, "hot")] * 600 + [(None, "null id")] * 300 + [(i, f"{i}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = kd_shards(df, shards=4).collect()
    sizes = _check(df, got, 4)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert len(Counter(r["shard"] for r in got if r["doc_id"] == 7)) > 1


def test_clashing_columns_and_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 2_000_000, 3, 4), (2, "y", 5, 6)], "doc_id long, text string, shard int, size int")
    _check(df, kd_shards(df, shards=2).collect(), 2)


def test_target_bytes(small):
    total = sum(len((r["text"] or "").encode()) + 1 for r in small.collect())
    got = kd_shards(small, target_bytes=total // 5).collect()
    assert {r["shard"] for r in got} == set(range(6))


def test_odd_rows(odd, none):
    _check(odd, kd_shards(odd, shards=4).collect(), 4)
    assert kd_shards(none, shards=4).count() == 0


def test_query(spark, sf):
    got = op1_kd_shards(spark, sf)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.count() == 200


def test_long_shared_prefixes_part_by_what_follows(spark):
    """Sources that agree in 200 characters are still a dimension: the first half of their order fills the first shard."""
    rows = [(i, f"text number {i:04}", "https://host.example/" + "x" * 180 + f"/{chr(97 + i % 20)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r["shard"] for r in kd_shards(df, dims=("source",), shards=2).collect()}
    by = {}
    for i, _, s in rows:
        by.setdefault(s[-1], set()).add(got[i])
    assert sum(len(v) > 1 for v in by.values()) <= 1 and sorted(map(len, (set(k for k, v in by.items() if v == {n}) for n in (0, 1))))[0] >= 9

