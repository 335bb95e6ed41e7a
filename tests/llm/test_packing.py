"""Packing against all subsets, the plan's law, and the tokenizer's own library."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.llm.bytelevel import ByteLevel, vocabulary
from cohortry.llm.packing import Placer, closest, pack, pack_plan
from cohortry.llm.queries import op11_bin_slack_packing

JSON = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokens():
    return ByteLevel.load(JSON)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_ids_are_the_library_s(tokens, library):
    r = random.Random(3)
    alphabet = "aZé9 \n\t'sß中　́.!_-<|endoftext|>"
    texts = ["", "plain words", "<|endoftext|>", "a<|endoftext|> b"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [chr(c) + " x" + chr(c) for c in r.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 3000)]
    for t in texts:
        assert tokens.ids(t, True).tolist() == library.encode(t, add_special_tokens=False).ids
    library.encode_special_tokens = True
    for t in texts:
        assert tokens.ids(t, False).tolist() == library.encode(t, add_special_tokens=False).ids
        assert b"".join(tokens.tokens[i] for i in tokens.ids(t, False)) == t.encode()
    library.encode_special_tokens = False


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 40))
def test_closest_is_the_best_of_all(counts, room):
    got = closest(sorted(counts, reverse=True), counts, room)
    assert all(k <= counts[n] for n, k in got.items())
    best = max(s for ks in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, ks))) <= room)
    assert sum(n * k for n, k in got.items()) == best


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 9), min_size=1, max_size=8))
def test_plan_places_each_token_once_and_fills_all_but_one(histogram):
    segments, windows = pack_plan(histogram, 16)
    place, used = Placer(segments), defaultdict(list)
    for n, k in histogram.items():
        for rank in range(k):
            parts = place.parts(n, rank)
            assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] == n
            for _, size, window, at in parts:
                used[window].append((at, size))
    assert sorted(used) == list(range(windows))
    full = 0
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:]))
        full += spans[-1][0] + spans[-1][1] == 16
    assert full >= windows - 1


def test_plan_repeats_patterns_whatever_the_counts():
    r = random.Random(5)
    counts = {n: r.randint(1, 10**9) for n in range(1, 2049)}
    segments, windows = pack_plan(counts, 2048)
    assert windows == -(-sum(n * k for n, k in counts.items()) // 2048)
    assert len(segments) < 200_000
    one, windows = pack_plan({1100: 10**9}, 2048)  # nothing goes with it but parts of itself
    assert windows == -(-1100 * 10**9 // 2048) and len(one) < 10_000


def held(rows, texts, library, capacity, end_id):
    """Each document's ids come back from its pieces, each window is gapless."""
    own, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        own[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, many in texts.items():
        want = Counter()
        for t in many:
            want.update(enumerate([*library.encode(t or "", add_special_tokens=False).ids, end_id]))
        got = Counter()
        for start, ids, _ in own[k]:
            got.update((start + i, x) for i, x in enumerate(ids))
        assert got == want
    assert sorted(windows) == list(range(len(windows)))
    short = 0
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        short += spans[-1][0] + spans[-1][1] < capacity
    assert short <= 1


def test_odd_rows(odd, none, tokens, library):
    for capacity in (7, 2048):
        rows = pack(odd.withColumn("ids", F.lit(1)).withColumn("Window", F.lit(2)), tokens, capacity=capacity, end_id=1).collect()
        texts = defaultdict(list)
        for r in odd.collect():
            texts[r["doc_id"]].append(r["text"])
        held(rows, texts, library, capacity, 1)
    assert pack(none, tokens).count() == 0


def test_query(spark, sf, small, library):
    rows = op11_bin_slack_packing(spark, sf).collect()
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["start"]] = r
    for d in small.collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        while at < len(ids):
            r = pieces[d["doc_id"]].pop(at)
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids) and not pieces[d["doc_id"]]
    total = sum(r["length"] for r in rows)
    assert max(r["sequence_id"] for r in rows) + 1 == -(-total // 2048)
