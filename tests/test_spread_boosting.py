"""A booster whose rows are spread over tasks: shards dealt by number, margins built anew, histograms by blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from vigilo.plans import boosting as B


def test_shards_are_dealt_one_by_one_and_margins_built_anew(spark, monkeypatch):
    """Many shards over few tasks: each task has as many, and CUT does not change a tree."""
    rng = np.random.default_rng(2)
    x, w = rng.integers(0, 5, (900, 4)).astype(float), np.ones(900)
    y = ((x[:, 0] > 2) ^ (rng.random(900) < 0.2)).astype(float)
    df = spark.createDataFrame([(0, i, x[i].tolist(), float(y[i]), 1.0) for i in range(900)], "group int, id bigint, f array<double>, label double, weight double")
    df = df.withColumn("features", array_to_vector("f")).drop("f")
    spec = B.Spec(rounds=6, leaves=6)
    held = []
    first = B.Tasks.__init__

    def began(self, *a):
        first(self, *a)
        held.append(self.state.mapPartitions(lambda p: [len(list(p))]).collect())

    monkeypatch.setattr(B.Tasks, "__init__", began)
    plain = B.fit_many(df, [spec], shard_rows=100)[0]
    monkeypatch.setattr(B, "CUT", 2)
    again = B.fit_many(df, [spec], shard_rows=100)[0]
    assert held[0] == [1] * 9
    assert B.dumped(plain) == B.dumped(again)


def test_histograms_by_blocks_of_rows(monkeypatch):
    rng = np.random.default_rng(3)
    sizes, n = np.array([2, 30, 2]), 1_000
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    slot, g, h = rng.integers(-1, 3, n), rng.normal(size=n), rng.random(n)
    whole = B.histograms(bins, sizes, slot, 3, g, h)
    monkeypatch.setattr(B, "SPREAD_ROWS", 64)
    assert B.histograms(bins, sizes, slot, 3, g, h) == pytest.approx(whole)
