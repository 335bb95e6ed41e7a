"""Alignment of the tokens that two tokenizers make of the same text, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import ByteLevel
from .common import Written, bounded_batches

#: Bytes of text aligned at a time; links of one group that are made at a time; pairs in one row.
_SLICE, _PRODUCT, _ROW = 2 << 20, 1 << 21, 1 << 20


class Side:
    """One tokenizer: ids of texts, and the bytes of each id as slices of one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        # decimal ids with a byte to spare for what follows
        digits = [f"{i}," for i in range(len(tokens))]
        self.d_size = np.array([len(d) for d in digits], np.int64)
        self.d_start = np.cumsum(self.d_size) - self.d_size
        self.digits = np.frombuffer("".join(digits).encode(), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError


class ByteSide(Side):
    """A byte-level tokenizer over a space and the text; its special strings are plain text."""

    def __init__(self, tokens: ByteLevel):
        self.own = tokens
        super().__init__(tokens.tokens)

    def encode(self, texts):
        return [self.own.ids(" " + t, specials=False) for t in texts]


class PieceSide(Side):
    """A SentencePiece model, which puts the space in front itself: a piece's bytes with U+2581 as a space, and <0xHH> as its byte."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = model
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)])
        super().__init__([byte(i) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])

    @classmethod
    def load(cls, path: str) -> "PieceSide":
        with open(path, "rb") as f:
            return cls(f.read())

    @cached_property
    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def encode(self, texts):
        return [np.array(x, np.int64) for x in self._processor.encode(texts, num_threads=1)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_processor"}


def _slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _kept(side: Side, ids: list[np.ndarray], raw: list[bytes]) -> list[bool]:
    """Whether the tokens' joined bytes are the text."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    own = _slices(side.flat, side.start[every], side.size[every]).tobytes()
    ends = np.cumsum([int(side.size[x].sum()) for x in ids])
    if own == b"".join(raw) and ends.tolist() == np.cumsum([len(r) for r in raw]).tolist():
        return [True] * len(raw)
    return [own[e - int(side.size[x].sum()) : e] == r for e, x, r in zip(ends, ids, raw)]


class Aligned:
    """Tokens of both sides of some documents: ``ids``, ``start`` in bytes from the first document on, ``doc``, ``group``, and the covering token of the other side."""

    def __init__(self, a: Side, b: Side, texts: list[str]):
        import pandas as pd

        raw = [b" " + t.encode() for t in texts]
        ia, ib = a.encode(texts), b.encode(texts)
        ok = [x and y and bool(t) for x, y, t in zip(_kept(a, ia, raw), _kept(b, ib, raw), texts)]
        self.docs, self.sides = len(texts), (a, b)
        self.ids = [np.concatenate([np.zeros(0, np.int64), *[x for x, k in zip(ids, ok) if k]]) for ids in (ia, ib)]
        self.doc = [np.repeat(np.flatnonzero(ok), [len(x) for x, k in zip(ids, ok) if k]) for ids in (ia, ib)]
        # documents whose tokens do not keep the text have none, so starts run on over the rest; a document's first tokens start together
        size = [s.size[i] for s, i in zip((a, b), self.ids)]
        self.start = [np.cumsum(z) - z for z in size]
        keyed = [pd.DataFrame({"start": s, "other": np.arange(len(s))}) for s in self.start]
        self.cover, self.group = [], []
        for s, own, other in ((0, 0, 1), (1, 1, 0)):
            # byte offsets run on from document to document, so that the key holds the document too
            got = pd.merge_asof(keyed[own][["start"]], keyed[other], on="start")["other"].to_numpy()
            self.cover.append(got)
            # a token that starts where its covering one does begins a group: there both sides have ended
            self.group.append(np.cumsum(self.start[other][got] == self.start[own]) - 1 if len(got) else np.zeros(0, np.int64))
        groups = int(self.group[0][-1]) + 1 if len(self.group[0]) else 0
        self.n = [np.bincount(g, minlength=groups) for g in self.group]
        self.first = [np.cumsum(n) - n for n in self.n]
        self.group_doc = self.doc[0][self.first[0]] if groups else np.zeros(0, np.int64)

    def overlaps(self) -> np.ndarray:
        """(a, b) places of tokens that share a byte, once each: what either direction's covering token gives."""
        a = np.stack([np.arange(len(self.ids[0])), self.cover[0]], axis=1)
        b = np.stack([self.cover[1], np.arange(len(self.ids[1]))], axis=1)
        return np.unique(np.concatenate([a, b]), axis=0)

    def per_doc(self, values: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights=values, minlength=self.docs).astype(np.int64)

    def written(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: decimal ids of each group, A before B."""
        (na, nb), (fa, fb) = self.n, self.first
        total = len(self.ids[0]) + len(self.ids[1])
        start, size, end = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        flat = np.concatenate([s.digits for s in self.sides])
        for k, (s, shift) in enumerate(zip(self.sides, (0, len(self.sides[0].digits)))):
            g = self.group[k]
            at = np.arange(len(g)) + (fb[g] if k == 0 else fa[g] + na[g])
            start[at], size[at] = s.d_start[self.ids[k]] + shift, s.d_size[self.ids[k]]
        end[fa + na + fb - 1], end[fa + na + fb + nb - 1] = ord("|"), ord(";")
        out = _slices(flat, start, size)
        stop = np.cumsum(size)
        out[stop - 1] = end
        bounds = np.r_[0, np.cumsum(self.per_doc(size, self._owners()))] if total else np.zeros(self.docs + 1, np.int64)
        whole = out.tobytes()
        return [whole[x : max(x, y - 1)].decode() for x, y in zip(bounds, bounds[1:])]

    def _owners(self) -> np.ndarray:
        """The document of each token, in the written order (documents are in order, and so are groups)."""
        return np.repeat(self.group_doc, self.n[0] + self.n[1])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, times): distinct linked id pairs of each document, ordered; pair is A's id times the size of B plus B's id."""
        width = len(self.sides[1].size)
        (na, nb), (fa, fb), (ia, ib) = self.n, self.first, self.ids
        doc, pair, times = [], [], []
        product = na * nb
        one = np.flatnonzero(product == 1)
        doc.append(self.group_doc[one]), pair.append(ia[fa[one]] * width + ib[fb[one]]), times.append(np.ones(len(one), np.int64))
        some = np.flatnonzero((product > 1) & (product <= 4096))
        cuts = np.flatnonzero(np.diff(np.cumsum(product[some]) // _PRODUCT)) + 1
        for own in np.split(some, cuts):
            m = np.repeat(nb[own], na[own])  # links of each A token
            ta = np.repeat(fa[own] - (np.cumsum(na[own]) - na[own]), na[own]) + np.arange(int(na[own].sum()))
            before = np.cumsum(m) - m
            tb = np.repeat(np.repeat(fb[own], na[own]) - before, m) + np.arange(int(m.sum()))
            doc.append(np.repeat(self.group_doc[own], product[own])), pair.append(np.repeat(ia[ta], m) * width + ib[tb]), times.append(np.ones(len(tb), np.int64))
        for g in np.flatnonzero(product > 4096):
            # a long group: ids once, with their counts
            (ua, ca), (ub, cb) = (np.unique(i[f[g] : f[g] + n[g]], return_counts=True) for i, f, n in ((ia, fa, na), (ib, fb, nb)))
            doc.append(np.full(len(ua) * len(ub), self.group_doc[g])), pair.append((ua[:, None] * width + ub).ravel()), times.append((ca[:, None] * cb).ravel())
        doc, pair, times = np.concatenate(doc), np.concatenate(pair), np.concatenate(times)
        key = doc * (len(self.sides[0].size) * width) + pair
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return doc[order][new], pair[order][new], np.add.reduceat(times[order], new) if len(new) else times


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _aligner(a: Side, b: Side, keep: bool):
    """Batches (id, text) to (uid, id, numbers, digest, pairs, times): one row a document, and more with pairs alone where a document has very many."""

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            step = max(1, whole.num_rows * _SLICE // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                got = Aligned(a, b, part.column(1).to_pylist())
                doc, pair, times = got.links()
                bounds = np.searchsorted(doc, np.arange(got.docs + 1))
                na, nb = (np.bincount(d, minlength=got.docs) for d in got.doc)
                numbers = [na, nb, np.bincount(got.group_doc, minlength=got.docs), got.per_doc(got.n[0] * got.n[1], got.group_doc)]
                text = got.written()
                said = text if keep else [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
                owner, spans, head = [], [], []
                for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    for s in range(int(x), max(int(y), int(x) + 1), _ROW):
                        owner.append(i), spans.append((s, min(int(y), s + _ROW))), head.append(s == x)
                own, first = np.array(owner, np.int64), np.array(head)
                off = pa.array(np.r_[0, [y for _, y in spans]].astype(np.int32))
                cols = [pa.array(uid + own), part.column(0).take(pa.array(own)), *[pa.array(np.where(first, v[own], 0).astype(np.int64)) for v in numbers], pa.array([said[i] if h else None for i, h in zip(owner, head)], pa.string())]
                cols += [pa.ListArray.from_arrays(off, pa.array(v.astype(np.int32))) for v in (pair, times)]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", *_NUMBERS, "said", "pairs", "times"])
                uid += got.docs

    return run


def _scorer(known):
    """Adds up what is known of each row's pairs; others stay for a join."""

    def run(batches):
        keys, counts, best = known.value
        for b in batches:
            lists = b.column("pairs")
            off = lists.offsets.to_numpy().astype(np.int64)
            pair = lists.values.to_numpy()[off[0] : off[-1]]
            lt = b.column("times")
            times = lt.values.to_numpy()[lt.offsets[0].as_py() : lt.offsets[-1].as_py()].astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            run_of = lambda v: np.r_[0, np.cumsum(v)]
            every = [run_of(v) for v in (np.where(hit & best[at], times, 0), np.where(hit, times * counts[at], 0)) ] if len(keys) else [np.zeros(len(pair) + 1, np.int64)] * 2
            lo, hi = off[:-1] - off[0], off[1:] - off[0]
            rest = np.flatnonzero(~hit)
            cut = pa.array(np.r_[np.searchsorted(rest, lo), len(rest)].astype(np.int32))
            cols = [b.column(c) for c in ("uid", "id", *_NUMBERS, "said")] + [pa.array(e[hi] - e[lo]) for e in every]
            cols += [pa.ListArray.from_arrays(cut, pa.array(v[rest].astype(np.int32))) for v in (pair, times)]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", *_NUMBERS, "said", "n_best", "count_sum", "pairs", "times"])

    return run


def align(docs: DataFrame, a: Side, b: Side, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, frequent: int = 1 << 20) -> DataFrame:
    """Of each document ``id_col``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, and ``groups`` (``keep``) or ``groups_sha256``.

    Tokens are byte ranges of a space and the text. Each token's start finds the covering token of the other side (``merge_asof`` over a batch, whose key
    runs on from document to document); where a covering token starts at the same byte a group begins, so that groups are cut where tokens of both sides end.
    Links are all pairs of an A and a B token of one group. The count of an id pair is the number of documents that hold it linked. ``n_best`` counts the
    links whose pair has its A id's highest count, ties included, and ``count_sum`` adds up the counts of all links. Counts are over all documents.

    The ``frequent`` pairs of the highest counts at most go to all tasks; rarer ones are joined, so that no pair is left out and no frequent one is a hot key.
    A table of the highest count of each A id has as many rows as A has ids.

    Null and empty texts, and those whose joined token bytes differ from the text on either side (as a model that changes characters makes), have no tokens:
    zeros and an empty string. Null ids stay; repeated rows are documents each, and each counts. Very long texts are aligned whole, in memory that grows with the text;
    links of long groups are made from distinct ids. An empty table gives an empty one; other columns, and their names, do not matter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    width = len(b.size)
    if len(a.size) * width >= 1 << 31:
        raise ValueError("pairs of ids must fit 31 bits")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    head = f"uid long, id {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, said string"
    # written once: texts are not tokenized again, and a document's number stays what it is
    held = Written(source.mapInArrow(_aligner(a, b, keep), f"{head}, pairs array<int>, times array<int>"), "aligned", compression="zstd")
    counts = Written(held.df.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a_id = F.floor(F.col("pair") / width).cast("int").alias("a")
    top = counts.df.groupBy(a_id).agg(F.max("n").alias("top"))
    scored = Written(counts.df.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "scored")
    counts.drop()
    # the lowest power of two that leaves no more than ``frequent`` pairs from it on
    least, left = 1, {r["p"]: r["count"] for r in scored.df.groupBy((F.length(F.bin("n")) - 1).alias("p")).count().collect()}
    while sum(left.values()) > frequent:
        least = 2 ** (min(left) + 1)
        del left[min(left)]
    rows = scored.df.where(F.col("n") >= least).toArrow()
    keys, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], n[order], best[order]))
    summed = held.df.mapInArrow(_scorer(known), f"{head}, n_best long, count_sum long, pairs array<int>, times array<int>")
    sums = ["n_best", "count_sum"]
    if least > 1:
        # the rarer ones, each with fewer than ``least`` documents
        part = Written(summed, "summed")
        rare = part.df.select("uid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(scored.df.where(F.col("n") < least), "pair")
        rare = rare.select("uid", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        nothing = [F.lit(0).cast("long").alias(c) for c in _NUMBERS]
        some = rare.groupBy("uid").agg(*[F.sum(c).alias(c) for c in sums])
        summed = part.df.select("uid", F.struct("id").alias("id"), *_NUMBERS, "said", *sums).unionByName(some.select("uid", F.lit(None).cast(f"struct<id:{kind}>").alias("id"), *nothing, F.lit(None).cast("string").alias("said"), *sums))
    else:
        summed = summed.select("uid", F.struct("id").alias("id"), *_NUMBERS, "said", *sums)
    whole = summed.groupBy("uid").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in (*_NUMBERS, *sums)], F.max("said").alias("said"))
    return whole.select(F.col("id.id").alias(id_col), *_NUMBERS, *sums, F.col("said").alias("groups" if keep else "groups_sha256"))
