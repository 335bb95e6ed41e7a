"""A feed-forward network trained over the whole table: gradients of blocks worked out in tasks, summed by a tree, applied on the driver.

Rows are dealt once to blocks by a hash of their key and written as matrices. A step takes a share of the blocks; each block is a batch of its own for batch
normalization (as in training over several devices, whose statistics are local), so that results do not depend on how blocks meet tasks. Dropout draws
by seed, step and block: a task that is run again draws the same.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metric import matrix, scratch

_EPS = 1e-5


@dataclass
class Network:
    """Linear layers of ``hidden`` sizes, each with batch normalization (``normal``), ReLU and dropout, and a linear head.

    ``params`` is one flat vector; ``running`` has means and variances for use after training.
    """

    inputs: int
    classes: int
    hidden: tuple[int, ...] = (256, 256, 256)
    dropout: float = 0.1
    normal: bool = True
    seed: int = 42
    params: np.ndarray = field(default=None, repr=False)
    running: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        sizes = [self.inputs, *self.hidden, self.classes]
        self.shapes = []
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            self.shapes += [(a, b), (b,)] + ([(b,), (b,)] if self.normal and i < len(self.hidden) else [])
        self.ends = np.cumsum([math.prod(s) for s in self.shapes])
        if self.params is None:
            r = np.random.default_rng(self.seed)
            parts = []
            for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
                reach = 1 / math.sqrt(a)
                parts += [r.uniform(-reach, reach, (a, b)).ravel(), r.uniform(-reach, reach, b)]
                parts += [np.ones(b), np.zeros(b)] if self.normal and i < len(self.hidden) else []
            self.params = np.concatenate(parts)
        if self.running is None:
            self.running = np.concatenate([np.r_[np.zeros(h), np.ones(h)] for h in self.hidden]) if self.hidden else np.zeros(0)

    def _parts(self, flat: np.ndarray) -> Iterator[np.ndarray]:
        return iter([flat[e - math.prod(s) : e].reshape(s) for s, e in zip(self.shapes, self.ends)])

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, draw: np.random.Generator | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """(summed weighted loss, its gradient, batch means and variances) of one batch; dropout only with ``draw``."""
        p, h, back, stats = self._parts(self.params), x, [], []
        for _ in self.hidden:
            a, b = next(p), next(p)
            z = h @ a + b
            keep = None
            if self.normal:
                g, s = next(p), next(p)
                mean, var = z.mean(axis=0), z.var(axis=0)
                stats += [mean, var]
                unit = (z - mean) / np.sqrt(var + _EPS)
                z_out = g * unit + s
            else:
                g = unit = var = None
                z_out = z
            out = np.maximum(z_out, 0)
            if draw is not None and self.dropout:
                keep = (draw.random(out.shape) >= self.dropout) / (1 - self.dropout)
                out = out * keep
            back.append((h, a, z_out > 0, keep, g, unit, var))
            h = out
        a, b = next(p), next(p)
        logits = h @ a + b
        logits -= logits.max(axis=1, keepdims=True)
        total = np.log(np.exp(logits).sum(axis=1))
        loss = float((w * (total - logits[np.arange(len(y)), y])).sum())
        d = np.exp(logits - total[:, None])
        d[np.arange(len(y)), y] -= 1
        d *= w[:, None]
        grads = [d.sum(axis=0), h.T @ d]
        d = d @ a.T
        for h, a, on, keep, g, unit, var in reversed(back):
            d = d * on if keep is None else d * keep * on
            if g is not None:
                grads += [d.sum(axis=0), (d * unit).sum(axis=0)]
                d = g / np.sqrt(var + _EPS) * (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0))
            grads += [d.sum(axis=0), h.T @ d]
            d = d @ a.T
        return loss, np.concatenate([v.ravel() for v in reversed(grads)]), np.concatenate([*stats, np.zeros(0)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p, h, at = self._parts(self.params), x, 0
        for n in self.hidden:
            h = h @ next(p) + next(p)
            if self.normal:
                g, s = next(p), next(p)
                mean, var = self.running[at : at + n], self.running[at + n : at + 2 * n]
                h = g * (h - mean) / np.sqrt(var + _EPS) + s
            h, at = np.maximum(h, 0), at + 2 * n
        z = h @ next(p) + next(p)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame, features: str = "features", probs: str = "probs") -> DataFrame:
        """Adds ``probs`` and ``prediction`` (the first of the largest)."""
        own = df.sparkSession.sparkContext.broadcast(self)

        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                yield pd.Series(list(own.value.probabilities(matrix(v)))) if len(v) else pd.Series([], dtype=object)

        with_probs = df.withColumn(probs, F.pandas_udf(run, "array<double>")(F.col(features)))
        return with_probs.withColumn("prediction", (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, params=self.params, running=self.running, shape=[self.inputs, self.classes, int(self.normal), self.seed, *self.hidden], dropout=[self.dropout])
        return held.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Network":
        z = np.load(io.BytesIO(blob))
        s = z["shape"].tolist()
        return cls(s[0], s[1], tuple(s[4:]), float(z["dropout"][0]), bool(s[2]), s[3], z["params"], z["running"])

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(bytearray(self.to_bytes()),)], "network binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "Network":
        return cls.from_bytes(bytes(spark.read.parquet(path).first()["network"]))


def blocks(df: DataFrame, key: str, features: str = "features", label: str = "label", weight: str | None = "weight", rows: int = 256) -> DataFrame:
    """(block, n, x, y, w): rows dealt to blocks of some ``rows`` by a hash of the key, as matrices of doubles; written.

    A block has as many rows as chance deals it; its size does not follow the table's.
    """
    n = df.count()
    many = max(1, round(n / rows))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.select(F.pmod(F.xxhash64(F.col(key)), F.lit(many)).alias("block"), F.col(key).cast("string").alias("k"), F.col(features).alias("f"), F.col(label).cast("int").alias("y"), w.alias("w"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", kind="stable")
        return pd.DataFrame({"block": [f["block"].iat[0]], "n": [len(f)], "x": [matrix(f["f"]).tobytes()], "y": [f["y"].to_numpy(np.int32).tobytes()], "w": [f["w"].to_numpy(np.float64).tobytes()]})

    return scratch(own.groupBy("block").applyInPandas(pack, "block long, n int, x binary, y binary, w binary"), "blocks")


def gradient_sum(dealt: DataFrame, net: Network, step: int, fan: int = 16, drop: bool = True) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(loss, weight, gradient, statistics), each summed over the blocks, the last by blocks: a row a task, then ``fan`` rows, then one."""
    spark = dealt.sparkSession
    held = spark.sparkContext.broadcast(net)
    size = 3 + len(net.params) + (len(net.running) if net.normal else 0)

    def each(batches):
        own, total = held.value, np.zeros(size)
        for b in batches:
            for block, n, x, y, w in zip(*(b.column(i).to_pylist() for i in range(5))):
                draw = np.random.Generator(np.random.Philox(key=[own.seed, (step << 32) ^ block])) if drop else None
                w = np.frombuffer(w, np.float64)
                loss, g, stats = own.gradient(np.frombuffer(x, np.float64).reshape(n, -1), np.frombuffer(y, np.int32), w, draw)
                total += np.concatenate([[loss, w.sum(), 1.0], g, stats])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for g in b.column(0).to_pylist():
                total += np.frombuffer(g, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = dealt.select("block", "n", "x", "y", "w").mapInArrow(each, "g binary")
    if dealt.rdd.getNumPartitions() > fan:
        parts = parts.repartition(fan).mapInArrow(add, "g binary")
    got = np.sum([np.frombuffer(bytes(r["g"]), np.float64) for r in parts.collect()], axis=0) if size else np.zeros(0)
    held.destroy()
    return float(got[0]), float(got[1]), got[3 : 3 + len(net.params)], got[3 + len(net.params) :] / max(1.0, got[2])


def fit(
    train: DataFrame, key: str, net: Network, score: Callable[[Network], float], weight: str | None = "weight", rows: int = 256, share: float = 1.0, steps: int = 60, rate: float = 3e-3, decay: float = 1e-2,
    clip: float = 1.0, every: int = 10, patience: int = 4, momentum: float = 0.1,
) -> tuple[Network, float, int]:
    """(network, score, steps run): the best of the checkpoints that ``score`` has seen, every ``every`` steps.

    The loss is the weighted mean of cross entropies. A step takes the blocks that a hash of block and step deals it, some ``share`` of all, and moves against their
    gradient by Adam with decoupled weight decay, after its norm is cut to ``clip``. Training ends after ``patience`` checkpoints without a better score.
    """
    dealt = blocks(train, key, weight=weight, rows=rows)
    first, second = np.zeros_like(net.params), np.zeros_like(net.params)
    best, top, since, step = None, float("-inf"), 0, 0
    for step in range(1, steps + 1):
        u = F.pmod(F.xxhash64("block", F.lit(step), F.lit(net.seed)), F.lit(1 << 20)) / float(1 << 20)
        loss, total, g, stats = gradient_sum(dealt if share >= 1 else dealt.where(u < share), net, step)
        if total > 0:
            g = g / total
            size = float(np.sqrt(g @ g))
            if clip and size > clip:
                g = g * (clip / size)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            params = net.params * (1 - rate * decay) - rate * move
            running = net.running if not net.normal else (1 - momentum) * net.running + momentum * stats
            net = Network(net.inputs, net.classes, net.hidden, net.dropout, net.normal, net.seed, params, running)
        if step % every == 0 or step == steps:
            now = score(net)
            if np.isfinite(now) and now > top:
                best, top, since = net, now, 0
            else:
                since += 1
                if since >= patience:
                    break
    return (best or net), top, step
