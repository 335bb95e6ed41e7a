"""N-gram Jaccard join: classes of documents whose sets of word n-grams are similar, exactly.

The product of the document by n-gram incidence matrix with its transpose holds every overlap. It is made in blocks of
n-grams, and only where it can matter:

* Texts with equal n-gram sets are one node of the graph.
* Only a prefix of each set is used: of two sets that reach the threshold, the prefixes (a quarter of the set and one
  more, for 0.75) under one common order share an n-gram. The order puts n-grams that many texts hold last, by a
  bitmap of counts over the whole table and a list of the most frequent; both are hints of bounded size, and any order gives the same result.
* Blocks of n-grams accumulate overlap counts of pairs, and pairs whose count and sizes show that they cannot reach the
  threshold are dropped. The others are verified on whole sets.
* First each n-gram pairs its texts with one leader. Texts already in one class need no pair: n-grams that only one
  class holds are then left out, and pairs are made across classes alone. While that would still be many pairs,
  another round with other leaders runs first. No pair that could join two classes is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches, cleaned
from .components import components
from .hashing import ROOT, mixed, powers

_CHUNK = 1_000_000
#: Bits of the mark of a set, a power of two.
_BITS = 2048
#: Sets of an n-gram that is put behind others, and leading bits of hashes that the bitmap of such n-grams tells apart.
_OFTEN, _OFTEN_BITS = 4, 26


#: A random 64-bit value for each byte, the same for A-Z as for a-z, and none for white space.
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0


def ngram_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; fewer words give one of the whole sequence.

    All texts are hashed together: a word's hash is the difference of two prefix sums of byte values times powers, taken
    back to the same power for all words.
    """
    if not raws:
        return []
    text = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    up, down = powers(len(text))
    space = _SPACE[text]
    sums = np.cumsum(_VALUE[text] * up)
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:])
    words = mixed((sums[end] - sums[start - 1]) * down[start])
    bounds = np.cumsum([1, *(len(r) + 1 for r in raws)])
    at = np.searchsorted(start, bounds)
    n = len(words)
    windows = max(0, n - width + 1)
    grams = np.full(windows, width, np.uint64)
    for i in range(width):
        grams = mixed((grams ^ words[i : i + windows]) * np.uint64(ROOT))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            first = np.empty(len(own), bool)
            first[0] = True
            np.not_equal(own[1:], own[:-1], out=first[1:])
            own = own[first]
        elif b > a:
            own = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                own = mixed((own ^ words[i : i + 1]) * np.uint64(ROOT))
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
    return out


def node_of(grams: np.ndarray) -> int | None:
    """A signed 64-bit name of a set; null for the empty one."""
    import xxhash

    if not len(grams):
        return None
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def _sets(b: pa.RecordBatch, width: int):
    """(row key, set) of the rows of (row key, text, ...), hashed in slices of some 256 KB: a byte of text takes some 40 bytes while it is hashed."""
    step = max(1, b.num_rows * (1 << 18) // max(1, b.nbytes))
    for at in range(0, b.num_rows, step):
        s = b.slice(at, step)
        yield from zip(s.column(0).to_pylist(), ngram_sets(s.column(1).to_pylist(), width))


def mark_of(grams: np.ndarray) -> np.ndarray:
    """The parity of a set's n-grams in each of ``_BITS`` places: the marks of two sets differ in no more places than the sets in n-grams."""
    odd = np.bincount((grams & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marks(heavy: np.ndarray) -> np.ndarray:
    """Which leading 20 bits ``heavy`` n-grams have: a first test before the search."""
    out = np.zeros(1 << 20, bool)
    out[heavy >> np.uint64(44)] = True
    return out


def _rare_first(grams: np.ndarray, often: np.ndarray | None) -> np.ndarray:
    """N-grams whose bit of ``often`` is not set, and then the others."""
    if often is None:
        return grams
    slot = (grams >> np.uint64(64 - _OFTEN_BITS)).view(np.int64)
    on = (often[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return np.concatenate([grams[~on], grams[on]])


def prefix_of(grams: np.ndarray, num: int, den: int, heavy: np.ndarray, weight: np.ndarray, marks: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of a set in the common order, unlisted ones by hash, those marked in ``often`` behind the others, then ``heavy`` ones by weight and hash; and their weights, 0 if unlisted."""
    n = len(grams)
    p = n + (-num * n // den) + 1  # n - ceil(num n / den) + 1
    may = np.flatnonzero(marks[grams >> np.uint64(44)])
    if len(may):
        at = np.minimum(np.searchsorted(heavy, grams[may]), len(heavy) - 1)
        on = heavy[at] == grams[may]
        if on.any():
            own, w = grams[may[on]], weight[at[on]]
            light = np.delete(grams, may[on])
            if len(light) < p:
                order = np.lexsort((own, w))
                light = _rare_first(light, often)
                return np.concatenate([light, own[order]])[:p], np.concatenate([np.zeros(len(light), np.int64), w[order]])[:p]
            grams = light
    return _rare_first(grams, often)[:p], np.zeros(p, np.int64)


def _slot(bits: int):
    """1 to ``bits``: bit ``slot + 32767`` of the bitmap, as the bitmap functions number buckets from 1."""
    return F.pmod(F.xxhash64("rk"), F.lit(bits)) + 1


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, one of them set for each row key: its size does not depend on the number of keys."""
    rows = keys.select(_slot(bits).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    out = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["m"], np.uint8)
    return out


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, listed: int, bloom_bits: int, few: int, block: int, hot: int):
        self.few, self.block, self.hot = few, block, hot
        self.spark = docs.sparkSession
        bounded_batches(self.spark)
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("t"))
        # a row is found again by its id and text together: ids may be null or repeat
        self.docs = rows.select(F.xxhash64("id", "t").alias("rk"), "t", "id")
        self.width, self.num, self.den, self.listed, self.bits = width, num, den, listed, bloom_bits
        self.id_type = self.docs.schema["id"].dataType.simpleString()

    def _sizes(self, a: str, b: str) -> str:
        return f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})"

    def _early(self) -> str:
        """True of the first common n-gram of a pair that reaches the threshold: all the common ones are there from its place on, in either set."""
        need = f"cast(ceil({self.num} * cast(na + nb as long) / {self.num + self.den}) as long)"
        return f"na - pa >= {need} and nb - pb >= {need}"

    def _can(self) -> str:
        """False for pairs whose overlap, the prefixes' common n-grams and all that may follow, stays below the threshold."""
        rest = lambda n: f"(cast(ceil({self.num} * {n} / {self.den}) as long) - 1)"
        return f"{self.num + self.den} * (c + greatest({rest('na')}, {rest('nb')})) >= {self.num} * (na + nb)"

    def read(self) -> Written:
        """Rows of documents (id, rk, n, node), and rows of n-grams that a task found in several sets (gram, n)."""
        width = self.width

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            seen, own, held = set(), [], 0

            def counts():
                g, c = np.unique(np.concatenate(own), return_counts=True)
                g, c = g[c > 2], c[c > 2]
                none = pa.nulls(len(g), pa.int64())
                return pa.RecordBatch.from_arrays([pa.nulls(len(g), arrow.field(0).type), none, pa.array(c, pa.int64()), none, pa.array(g.view(np.int64))], schema=arrow)

            for b in batches:
                ns, nodes = [], []
                for _, grams in _sets(b, width):
                    node = node_of(grams)
                    ns.append(len(grams)), nodes.append(node)
                    if node is not None and node not in seen:
                        seen.add(node)
                        own.append(grams)
                        held += len(grams)
                        if held > _CHUNK:
                            yield counts()
                            own, held = [], 0
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(ns), pa.int64())], schema=arrow)
            if own:
                yield counts()

        schema = self.spark.createDataFrame([], f"id {self.id_type}, rk long, n long, node long, gram long").schema
        return Written(self.docs.mapInArrow(run, schema), "ngrams")

    def heavy(self, read: DataFrame):
        """The ``listed`` n-grams with the highest counts, as sorted arrays for all executors: an ordering hint of bounded size."""
        top = read.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "gram").limit(self.listed).toArrow()
        g, w = top.column("gram").to_numpy().view(np.uint64), top.column("w").to_numpy()
        order = np.argsort(g)
        return self.spark.sparkContext.broadcast((g[order], w[order]))

    def often(self):
        """A bitmap of n-grams that at least ``_OFTEN`` sets hold, by their leading bits: an ordering hint as well, whose size does not depend on the table.

        Sets are counted over the whole table, as counts inside a task miss n-grams that many tasks hold once, and groups of such n-grams grow with the table.
        Hashes are sent by their leading 10 bits, as sorted runs of the next 32; texts read by several tasks count several times.
        """
        width = self.width

        def runs(batches):
            seen, own, held = set(), [], 0
            first = np.arange(1024, dtype=np.uint64) << np.uint64(54)

            def out():
                g = np.sort(np.concatenate(own))
                cut = np.r_[np.searchsorted(g, first), len(g)]
                data = (g >> np.uint64(22)).astype(np.uint32)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(1024, dtype=np.int32)), pa.array([data[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=["r", "run"])

            for b in batches:
                for _, grams in _sets(b, width):
                    node = node_of(grams)
                    if node is not None and node not in seen:
                        seen.add(node)
                        own.append(grams)
                        held += len(grams)
                        if held > _CHUNK // 2:
                            yield out()
                            own, held = [], 0
            if own:
                yield out()

        least = _OFTEN - 1

        def several(group):
            x = np.sort(np.concatenate([np.frombuffer(run.as_buffer(), np.uint32) for run in group.column("run")]))
            bits = np.zeros(1 << (_OFTEN_BITS - 10), bool)
            bits[x[least:][x[least:] == x[: len(x) - least]] >> np.uint32(42 - _OFTEN_BITS)] = True
            return pa.table({"r": group.column("r")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        with cleaned(self.spark):
            rows = self.docs.mapInArrow(runs, "r int, run binary").groupBy("r").applyInArrow(several, "r int, bits binary").collect()
        out = np.zeros((1024, 1 << (_OFTEN_BITS - 13)), np.uint8)
        for r in rows:
            out[r["r"]] = np.frombuffer(r["bits"], np.uint8)
        return self.spark.sparkContext.broadcast(out.tobytes())

    def incidence(self, heavy, often) -> Written:
        """(gram, node, n, pos, lead, n_lead): prefix n-grams that several nodes hold, each with its place in the node's prefix and its smallest node.

        An n-gram that may stand in the prefixes of over ``hot`` nodes is dealt out in parts by a hash of the node. Each
        part has a lead of its own, and keeps its rows even where it has one node.
        """
        width, num, den, hot = self.width, self.num, self.den, self.hot

        def prefixes(batches):
            seen = set()
            table, weight = heavy.value
            marks, frequent = _marks(table), np.frombuffer(often.value, np.uint8)
            for b in batches:
                # part << 32 | n in one column, as each column of a row costs 8 bytes
                grams, nodes, ns, held = [], [], [], 0

                def out():
                    k = np.fromiter(map(len, grams), np.int64, len(grams))
                    pos = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    cols = (np.concatenate(grams).view(np.int64), np.repeat(np.array(nodes, np.int64), k), np.concatenate(ns), pos.astype(np.int32))
                    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "node", "n", "pos"])

                for _, g in _sets(b, width):
                    node = node_of(g)
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    own, w = prefix_of(g, num, den, table, weight, marks, frequent)
                    grams.append(own), nodes.append(node)
                    # from 1 on in parts, 0 for an n-gram in one piece
                    ns.append(np.where(w > hot, 1 + (node & 0x7FFFFFFF) % (w // hot + 1), 0) << 32 | len(g))
                    held += len(own)
                    if held > 200_000:
                        yield out()
                        grams, nodes, ns, held = [], [], [], 0
                if grams:
                    yield out()

        def shared(batches):
            """Of rows sorted by (gram, part, node): those whose neighbour has the same gram and part, with their first node. One row is held back."""
            last = np.empty((0, 5), np.int64)
            lead = (0, 0, 0, 0, False)  # gram, part, node, n of the current part's first row; whether the last row was let out
            names = ["gram", "node", "n", "pos", "lead", "n_lead"]

            def make(rows, after):
                nonlocal lead
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
                first[0] = not (lead[4] and lead[0] == rows[0, 0] and lead[1] == rows[0, 1])
                at = np.maximum.accumulate(np.where(first, np.arange(len(rows)), -1))
                node = np.where(at >= 0, rows[at, 2], lead[2])
                n = np.where(at >= 0, rows[at, 3], lead[3])
                same = rows[:, 1] > 0
                same[1:] |= ~first[1:]
                same[:-1] |= ~first[1:]
                same[0] |= not first[0]
                same[-1] |= after is not None and bool((after == rows[-1, :2]).all())
                lead = (rows[-1, 0], rows[-1, 1], node[-1], n[-1], True)
                return pa.RecordBatch.from_arrays([pa.array(rows[same, 0]), pa.array(rows[same, 2]), pa.array(rows[same, 3].astype(np.int32)), pa.array(rows[same, 4].astype(np.int32)), pa.array(node[same]), pa.array(n[same].astype(np.int32))], names=names)

            for b in batches:
                if not b.num_rows:
                    continue
                gram, node, n, pos = (b.column(i).to_numpy() for i in range(4))
                rows = np.concatenate([last, np.stack([gram, n >> 32, node, n & 0xFFFFFFFF, pos], axis=1)])
                keep = np.ones(len(rows), bool)  # several tasks may have sent the same node
                keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
                rows = rows[keep]
                if len(rows) > 1:
                    yield make(rows[:-1], rows[-1, :2])
                last = rows[-1:]
            if len(last):
                yield make(last, None)

        p = self.docs.mapInArrow(prefixes, "gram long, node long, n long, pos int")
        part = F.shiftright("n", 32)
        p = p.repartition("gram", part).sortWithinPartitions("gram", part, "node")
        return Written(p.mapInArrow(shared, "gram long, node long, n int, pos int, lead long, n_lead int"), "incidence")

    def sets(self, nodes: DataFrame, reps: DataFrame) -> Written:
        """(node, grams, mark): the whole sets of ``nodes``, and their marks, and of up to a sixteenth of all others. Of all texts only those that a bitmap of their row keys lets through are hashed again."""
        asked = Written(nodes.join(reps, "node"), "asked")
        bits, width = self.bits, self.width
        bloom = self.spark.sparkContext.broadcast(_bloom(asked.df.select("rk"), bits).tobytes())

        def read(batches):
            mask = np.frombuffer(bloom.value, np.uint8)
            seen = set()
            for b in batches:
                h = b.column(2).to_numpy() + 32767
                on = np.flatnonzero(mask[h // 8] >> (h % 8).astype(np.uint8) & 1)
                if not len(on):
                    continue
                b = b.take(pa.array(on))
                for at in range(0, len(on), 500):
                    rows = []
                    for k, g in _sets(b.slice(at, 500), width):
                        if len(g) and (own := (k, node_of(g))) not in seen:
                            seen.add(own)
                            rows.append((*own, g))
                    if rows:
                        off = np.cumsum([0, *(len(g) for *_, g in rows)]).astype(np.int32)
                        flat = np.concatenate([g for *_, g in rows]).view(np.int64)
                        marks = np.concatenate([mark_of(g) for *_, g in rows])
                        at_mark = np.arange(len(rows) + 1, dtype=np.int32) * (_BITS // 64)
                        lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(x)) for o, x in ((off, flat), (at_mark, marks))]
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in rows], pa.int64()), pa.array([x for _, x, _ in rows], pa.int64()), *lists], names=["rk", "node", "grams", "mark"])

        found = self.docs.select("rk", "t", _slot(bits).alias("h")).mapInArrow(read, "rk long, node long, grams array<long>, mark array<long>")
        if asked.df.count() * 16 > bits:
            # a full bitmap lets through much that nobody asked for; the few that a sparse one lets through meet no pair
            found = found.join(asked.df, ["rk", "node"], "left_semi")
        out = Written(found.select("node", "grams", "mark"), "sets")
        asked.drop(), bloom.destroy()
        size = out.df.agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes")).first()
        if size["rows"] > 1.1 * size["nodes"]:
            # rows equal in id and text, read by several tasks; a few repeated sets cost less than to deal all of them anew, and change no result
            every, out = out, Written(out.df.dropDuplicates(["node"]), "sets")
            every.drop()
        return out

    def verified(self, pairs: DataFrame, reps: DataFrame) -> Written:
        """Of ``pairs`` (a, b, na, nb) those that reach the threshold on whole sets. Pairs whose marks differ in too many places are left out first, as a mark is much smaller than a set."""
        held = Written(pairs, "pairs")
        found = self.sets(held.df.select(F.col("a").alias("node")).union(held.df.select("b")).distinct(), reps)
        a, b = (found.df.select(F.col("node").alias(k), F.col("mark").alias(f"m{k}")) for k in "ab")
        apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        n = (F.col("na") + F.col("nb")).cast("long")
        near = Written(held.df.join(a, "a").join(b, "b").where((self.num + self.den) * (n - apart) >= 2 * self.num * n).select("a", "b", "na", "nb"), "near")
        a, b = (found.df.select(F.col("node").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
        both = near.df.join(a, "a").join(b, "b")
        common = F.size(F.array_intersect("ga", "gb")).cast("long")
        links = Written(both.where((self.num + self.den) * common >= self.num * (F.col("na") + F.col("nb")).cast("long")).select("a", "b").distinct(), "links")
        held.drop(), found.drop(), near.drop()
        return links

    def classes(self, stars: int = 5) -> DataFrame:
        read = self.read()
        docs = read.df.where("gram is null").select("id", "rk", "n", "node")
        heavy = self.heavy(read.df)
        reps = Written(docs.where("node is not null").groupBy("node").agg(F.min("rk").alias("rk")), "reps")
        often = self.often()
        inc = self.incidence(heavy, often)
        heavy.destroy(), often.destroy()
        rows = inc.df.count()
        star = inc.df.where("node != lead").where(self._sizes("n", "n_lead"))
        star = star.select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("n_lead").alias("na"), F.col("n").alias("nb"))
        links = [self.verified(self.counted(star).where(self._can()), reps.df)]
        roots = components(links[0].df)
        before, base = float("inf"), inc
        for at in range(1, stars + 1):
            # n-grams that one class holds never matter again, as classes only grow: each round reads what the one before left
            known = base.df.select("gram", "node", "n", "pos", F.lit(1).cast("long").alias("w") if at == 1 else "w").join(roots.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
            several = self.several(known, at)
            across = Written(known.drop("w").join(several.df, "gram"), "across")
            by = across.df.groupBy("gram", "root").count().groupBy("gram").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
            left = by.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
            # another round of leaders only while rounds halve what is left
            last = at == stars or left <= max(500_000, rows // 2) or left > before / 2
            before = left
            if left and last:
                links += self.across_links(across.df, reps.df)
            elif left:
                lead = Written(across.df.where(F.xxhash64("node", F.lit(at)) == F.col("o")).select("gram", "w", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")), "leads")
                star = across.df.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")).join(lead.df, "gram").where("ra != rb").where(self._sizes("na", "nb"))
                links.append(self.verified(self.counted(star.select("a", "b", "na", "nb", "w"), "w").where(self._can()), reps.df))
                lead.drop()
            if left:
                old, every = roots, links[0].df
                for x in links[1:]:
                    every = every.union(x.df)
                roots = components(every)
                old.drop()
            several.drop(), base.drop()
            base = across
            if last or not left:
                break
        base.drop()
        named = docs.join(roots.df, "node", "left").select("id", "n", F.coalesce("root", "node").alias("root"))
        first = Written(named.where("root is not null").groupBy("root").agg(F.min("id").alias("first")), "first")
        for old in (reps, *links):
            old.drop()
        return named.join(first.df, "root", "left").select("id", "n", F.coalesce("first", "id").alias("first"))

    def dense_sets(self, nodes: DataFrame, reps: DataFrame) -> Written:
        """The sets of ``nodes`` and of no other node, as blocks are made for so many."""
        every = self.sets(nodes, reps)
        own = Written(every.df.join(nodes, "node", "left_semi"), "denses")
        every.drop()
        return own

    @staticmethod
    def several(known: DataFrame, at: int) -> Written:
        """(gram, w, o, k) of n-grams that nodes of several classes hold: how many n-grams the row stands for, the least hash of its nodes, and their number.

        N-grams that the same nodes hold, as all of a repeated line, are one from the first round on: their pairs are made once, and count ``w`` times. Equal lists are told by
        their number of nodes and the sums of two hashes of 64 bits. Halves of hashes are added up, so that no sum overflows. The first one in the common order stands for all:
        it comes before the others in each node that holds them.
        """
        half = lambda h: [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
        sums = [x.alias(f"s{i}") for i, x in enumerate(half(F.xxhash64("node")) + half(F.xxhash64("node", F.lit("list"))))] if at == 1 else []
        place = "pos" if "pos" in known.columns else "gram"  # without places the smallest one stands for all
        got = known.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.xxhash64("node", F.lit(at))).alias("o"), F.count("*").alias("k"), F.max("w").alias("w"), F.min(place).alias("place"), *sums).where("r0 != r1")
        if sums:
            got = got.groupBy("k", "s0", "s1", "s2", "s3").agg(F.min_by("gram", "place").alias("gram"), F.sum("w").alias("w"), F.min("o").alias("o"))
        return Written(got.select("gram", "w", "o", "k"), "grams")

    @staticmethod
    def counted(pairs: DataFrame, weight: str | None = None) -> DataFrame:
        """Pairs once each, with the number of their common n-grams: a row counts 1, or ``weight``."""
        return pairs.groupBy("a", "b").agg((F.sum(weight) if weight else F.count("*")).alias("c"), F.max("na").cast("long").alias("na"), F.max("nb").cast("long").alias("nb"))

    def across_links(self, across: DataFrame, reps: DataFrame) -> list[Written]:
        """Links between nodes of different classes, all of those that join two classes.

        N-grams that few nodes hold are joined where they stand early enough in both sets to be the first common one of a link, and these pairs verified. N-grams that more nodes
        hold would give pairs with the square of their nodes. The nodes that have one are dealt into blocks of like sizes, and for every
        two blocks whose sizes allow a link a task multiplies the two parts of the whole incidence matrix, n-grams of two nodes or more, and lets
        out a spanning forest of the pairs that reach the threshold. Two nodes that share such an n-gram meet there; all
        other pairs share light n-grams only.
        """
        dense = Written(across.where(F.col("k") > self.few).groupBy("node").agg(F.max("n").alias("n")), "dense")
        light = across.where(F.col("k") <= self.few).join(dense.df.select("node", F.lit(True).alias("dense")), "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
        light = Written(light.select("gram", "node", "n", "pos", "root", "dense"), "light")
        x, y = (light.df.select("gram", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"), F.col("root").alias(f"r{k}"), F.col("dense").alias(f"d{k}")) for k in "ab")
        pairs = x.join(y, "gram").where("a < b and ra != rb and not (da and db)").where(self._sizes("na", "nb")).where(self._early())
        out = [self.verified(pairs.select("a", "b", "na", "nb").distinct(), reps)]
        light.drop()
        # of two sets that link the smaller has num / den of the other's size: those of one class of sizes meet their own class and its neighbours
        base = math.log(max(self.den / self.num, 1.05)) * (1 + 1e-9) if self.num else math.inf
        of_size = F.floor(F.ln("n") / F.lit(base)).cast("int")
        classes = dense.df.groupBy(of_size.alias("s")).agg(F.count("*").alias("nodes"), F.sum("n").alias("grams")).collect()  # some 50 rows
        if not classes:
            dense.drop()
            return out
        span, total = {}, 0
        for r in sorted(classes, key=lambda r: r["s"]):
            blocks = max(-(-r["nodes"] // self.block), -(-r["grams"] // 500_000))
            span[r["s"]] = (total, total := total + blocks)
        near = [(s, a, b - a, span.get(s - 1, (a, b))[0], span.get(s + 1, (a, b))[1] - 1) for s, (a, b) in span.items()]
        met = self.spark.createDataFrame(near, "s int, start int, blocks int, lo int, hi int")
        found = self.dense_sets(dense.df.select("node"), reps)
        own = found.df.withColumn("n", F.size("grams")).withColumn("s", of_size).join(F.broadcast(met), "s")
        own = own.withColumn("i", F.col("start") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence("lo", "hi")))
        spread = own.select("node", "grams", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("second"))
        num, den = self.num, self.den

        def multiply(f):
            import pandas as pd

            f = f.drop_duplicates("node")
            second = f["second"].to_numpy(bool)
            nodes, sets = f["node"].to_numpy(), [np.asarray(g, np.int64) for g in f["grams"]]
            size = np.array([len(g) for g in sets])
            row = np.repeat(np.arange(len(sets)), size)
            grams, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            several = held > 1
            place = np.cumsum(several) - 1
            on = several[col]
            row, col = row[on], place[col[on]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            count = np.zeros((len(sets), len(sets)), np.float32)
            width = 2048
            for lo in range(0, int(several.sum()), width):
                a, b = np.searchsorted(col, (lo, lo + width))
                m = np.zeros((len(sets), width), np.float32)
                m[row[a:b], col[a:b] - lo] = 1
                count += m @ m.T
            link = (num + den) * count.astype(np.float64) >= num * (size[:, None] + size[None, :])
            if second.any() and f["x"].iat[0] != f["y"].iat[0]:
                link &= second[:, None] != second[None, :]
            np.fill_diagonal(link, False)
            # a spanning forest, breadth first
            seen, edges = np.zeros(len(sets), bool), []
            for start in np.flatnonzero(link.any(axis=1)):
                todo = [] if seen[start] else [int(start)]
                seen[start] = True
                while todo:
                    u = todo.pop()
                    new = np.flatnonzero(link[u] & ~seen)
                    seen[new] = True
                    edges += [(nodes[u], nodes[v]) for v in new]
                    todo += new.tolist()
            return pd.DataFrame({"a": np.array([a for a, _ in edges], np.int64), "b": np.array([b for _, b in edges], np.int64)})

        out.append(Written(spread.groupBy("x", "y").applyInPandas(multiply, "a long, b long"), "links"))
        found.drop(), dense.drop()
        return out


def ngram_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4, listed: int = 1 << 18, bloom_bits: int = 1 << 26, few: int = 64, block: int = 500, hot: int = 200_000
) -> DataFrame:
    """``id_col``, ``n_shingles`` (size of the set) and ``component_id`` (smallest id reachable by links, itself included).

    Rows link when their sets' Jaccard similarity is at least ``num / den``, compared in integers. Rows without words
    (null or empty texts) have an empty set and link with nothing; texts of fewer than ``width`` words have one n-gram,
    the whole sequence. Repeated rows and rows of equal sets are one class. Rows with a null id link like others and take
    the class's smallest id, or null where no row of it has one. Very long texts are read whole. Pairs that tie at the threshold link. Other
    columns are not read and may have any names. An empty table gives an empty one. Sets are told apart by 64-bit hashes of n-grams.
    ``listed`` bounds the ordering hint, ``bloom_bits`` the filter before verification, ``few`` the nodes of an n-gram that is
    joined, ``block`` those of a block of the product, and ``hot`` those of an n-gram that one task sorts; none of them changes the result.
    """
    got = _Join(docs, id_col, text_col, width, num, den, listed, bloom_bits, few, block, hot).classes()
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
