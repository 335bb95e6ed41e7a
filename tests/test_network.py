"""The network: its gradient by finite differences, weights against repeated rows, independence of partitions, and training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import network
from cohortry.operators.network import Network


def data(n=40, dim=3, classes=3, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dim)), r.integers(0, classes, n).astype(np.int32), r.uniform(0.5, 2, n)


@pytest.mark.parametrize("normal", [True, False])
def test_gradient_by_finite_differences(normal):
    x, y, w = data()
    net = Network(3, 3, (5, 4), dropout=0.3, normal=normal)
    draw = lambda: np.random.default_rng(7)
    _, g, stats = net.gradient(x, y, w, draw())
    assert len(stats) == (18 if normal else 0)
    for i in range(0, len(net.params), 3):
        p = net.params.copy()
        values = []
        for h in (1e-5, -1e-5):
            net.params = p.copy()
            net.params[i] += h
            values.append(net.gradient(x, y, w, draw())[0])
        net.params = p
        assert abs((values[0] - values[1]) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i])), i


def test_weights_are_repeated_rows():
    x, y, _ = data()
    w = np.where(y == 1, 3.0, 1.0)
    net = Network(3, 3, (5,), dropout=0, normal=False)
    a = net.gradient(x, y, w)
    times = w.astype(int)
    b = net.gradient(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1])


def frame(spark, n=300, seed=4):
    r = np.random.default_rng(seed)
    y = (np.arange(n) % 10 == 0).astype(int)
    x = np.stack([r.normal(2.5 * y, 0.5), r.normal(size=n)], axis=1)
    return spark.createDataFrame([(i, [float(a) for a in v], int(k), 5.0 if k else 0.56) for i, (v, k) in enumerate(zip(x, y))], "k long, features array<double>, label int, weight double")


def test_sum_does_not_depend_on_partitions(spark):
    dealt = network.blocks(frame(spark), "k", rows=20)
    net = Network(2, 2, (6,), dropout=0.2)
    assert dealt.agg(F.sum("n")).first()[0] == 300 and dealt.count() > 8
    one, many = network.gradient_sum(dealt.coalesce(1), net, 3), network.gradient_sum(dealt.repartition(9), net, 3, fan=2)
    assert np.isclose(one[0], many[0]) and np.isclose(one[1], many[1]) and np.allclose(one[2], many[2]) and np.allclose(one[3], many[3])
    other = network.gradient_sum(dealt.coalesce(1), net, 4)
    assert not np.allclose(one[2], other[2])  # another step drops other units


def test_training_keeps_the_best_checkpoint(spark, tmp_path):
    df = frame(spark)
    train, valid = df.where("k % 4 != 0"), df.where("k % 4 = 0")
    recall = lambda net: net.transform(valid).where("label = 1").agg(F.avg((F.col("prediction") == 1).cast("double"))).first()[0]
    net, top, steps = network.fit(train, "k", Network(2, 2, (8,)), recall, rows=60, share=0.7, steps=24, rate=0.05, every=6, patience=2)
    assert top >= 0.9 and 6 <= steps <= 24 and recall(net) == top
    net.save(spark, str(tmp_path / "net"))
    again = Network.load(spark, str(tmp_path / "net"))
    assert np.allclose(again.params, net.params) and np.allclose(again.running, net.running) and again.hidden == (8,)
    got = again.transform(valid).first()
    assert abs(sum(got["probs"]) - 1) < 1e-9


def test_empty_table(spark):
    df = frame(spark).limit(0)
    net, top, steps = network.fit(df, "k", Network(2, 2, (3,)), lambda n: 0.5, steps=2, every=1)
    assert top == 0.5 and steps == 2 and net.transform(df).count() == 0
