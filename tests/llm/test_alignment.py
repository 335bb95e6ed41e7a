"""Alignment by the definition, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import alignment as module
from cohortry.llm.alignment import Aligned, ByteSide, PieceSide, align
from cohortry.llm.bytelevel import ByteLevel, vocabulary
from cohortry.llm.queries import PIECE_MODEL, op13_token_alignment

JSON = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sides():
    return ByteSide(ByteLevel.load(JSON)), PieceSide.load(PIECE_MODEL)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def plain(text, libraries):
    """([(id, start, end)] of A, of B) in bytes, or None."""
    t, p = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in prints}
    back.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in prints)})
    out = []
    for pairs in ([(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids], [(i, bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()) for i in p.encode(text) for s in [p.id_to_piece(i)]]):
        if b"".join(x for _, x in pairs) != raw:
            return None
        at, own = 0, []
        for i, x in pairs:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return out


def brute(texts, libraries):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    made, counts = [], Counter()
    for text in texts:
        sides = plain(text, libraries)
        groups = []
        if sides:
            a, b = sides
            at = [0, 0]
            for end in sorted({e for *_, e in a} & {e for *_, e in b}):
                own = []
                for k, side in enumerate((a, b)):
                    to = at[k]
                    while to < len(side) and side[to][2] <= end:
                        to += 1
                    own.append([i for i, *_ in side[at[k] : to]])
                    at[k] = to
                groups.append((*own, end))
        links = [(x, y) for ga, gb, _ in groups for x in ga for y in gb]
        counts.update(dict.fromkeys(links, 1))
        made.append((sides, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for sides, groups, links in made:
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb, _ in groups)
        na, nb = (len(sides[0]), len(sides[1])) if sides else (0, 0)
        out.append((na, nb, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), said))
    return out


TEXTS = ["plain words here", "  two  spaces ", "<|endoftext|> a <s>", "▁ as text", "x", "", None, "ﬁ ligature", "日本語のテキスト", "\u0000\x01", "a\n\nb\tc", "😀😀 é", "plain words here"]


def made(seed, n):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choice("ab é\n.,the日😀<|>_-▁" + " " * 8) for _ in range(r.randint(0, 80))) for _ in range(n)]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.mark.parametrize("frequent", [1 << 20, 50, 0])
def test_as_brute_force(spark, sides, libraries, monkeypatch, frequent):
    if frequent < 100:  # small slices, rows and products
        monkeypatch.setattr(module, "_SLICE", 500), monkeypatch.setattr(module, "_PRODUCT", 8)
    texts = made(frequent, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("pairs", F.lit(1)).withColumn("N_A", F.lit(2))
    got = {r["doc_id"]: tuple(r[c] for c in (*FIELDS, "groups")) for r in align(df, *sides, keep=True, frequent=frequent).collect()}
    want = brute(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want
    assert got[3][0] == 0 < got[2][0]  # the model's sign for a space is read back as a space: no tokens


def test_long_groups_and_many_rows(spark, sides, libraries, monkeypatch):
    texts = ["日本" * 300 + "x", "ab" * 900, " ".join(f"w{i}" for i in range(300)), "".join(chr(0x4E00 + i) for i in range(200))]
    a, b = sides
    many = Aligned(a, b, texts)
    doc, pair, times = many.links()
    for k, text in enumerate(texts):
        links = Counter()
        for ga, gb in (x.split("|") for x in brute([text], libraries)[0][6].split(";")):
            links.update(int(x) * len(b.size) + int(y) for x in ga.split(",") for y in gb.split(","))
        assert dict(zip(pair[doc == k].tolist(), times[doc == k].tolist())) == links
    own = [plain(t, libraries) for t in texts]
    want = sum(1 for x, y in own for _, s, e in x for _, s2, e2 in y if s < e2 and s2 < e)
    assert len(many.overlaps()) == want


def test_rows_of_one_document_add_up(spark, sides, libraries):
    def run(row):
        module._ROW, old = row, module._ROW
        try:
            out = []
            import pyarrow as pa
            from unittest import mock

            with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 3)):
                for b in module._aligner(*sides, False)([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some plain words and more of them", "x"])], names=["id", "t"])]):
                    out += b.to_pylist()
            return out
        finally:
            module._ROW = old

    one, many = run(1 << 20), run(2)
    assert len(one) == 2 and len(many) > 4
    assert sum(r["n_links"] for r in one) == sum(r["n_links"] for r in many)
    assert [p for r in many for p in r["pairs"]] == [p for r in one for p in r["pairs"]] and len({r["uid"] for r in many}) == 2


def test_odd_rows(odd, none, sides, libraries):
    rows = odd.collect()
    got = sorted((str(r["doc_id"]), *[r[c] for c in FIELDS], r["groups_sha256"]) for r in align(odd, *sides).collect())
    want = brute([r["text"] for r in rows], libraries)
    assert got == sorted((str(r["doc_id"]), *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want))
    assert align(none, *sides).count() == 0


def test_query(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in (*FIELDS, "groups_sha256")) for r in op13_token_alignment(spark, sf).collect()}
    want = brute([r["text"] for r in docs], libraries)
    assert got == {r["doc_id"]: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, want)}
