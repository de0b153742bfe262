"""Models, folds and grids learn from every training row, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators.explain import ensemble_tables
from vigilo.plans import models as M
from vigilo.plans import tuning as TU

N = C.SAMPLE_TARGET + 50_000


@pytest.fixture(scope="module")
def train(spark):
    i = F.col("id")
    return spark.range(N).select(
        i.alias(C.KEY), (20.0 + i * 37 % 61).alias("AGE_YRS"), F.when(i % 3 == 0, "F").otherwise("M").alias("SEX"),
        (i % 7 == 0).cast("tinyint").alias("HOSPITAL"), (i * i % 5 == 1).cast("tinyint").alias(C.LABEL),
        (i / 5 % C.CV_FOLDS).cast("int").alias("fold")).persist()


def test_a_model_is_fitted_on_every_row(spark, train):
    model = M.fit(train, "cart", maxDepth=1)
    trees, _ = ensemble_tables(model.stages[-1], spark)
    assert trees[0]["cover"][0] == pytest.approx(N)         # balanced weights add up to the rows


def test_every_fold_is_prepared_from_all_other_rows(train):
    folds = TU.Folds(train)
    try:
        assert [v.count() for v in folds.vectors] == [train.where(F.col("fold") != f).count() for f in range(C.CV_FOLDS)]
        assert sum(v.count() for v in folds.vectors) == N * (C.CV_FOLDS - 1)
    finally:
        folds.close()


def test_a_grid_is_searched_on_every_row(spark, train, monkeypatch):
    seen = []

    def scores(spark, data, name, grid, points, k, parallelism, fixed):
        seen.append(data.count())
        return np.zeros((len(points), k))

    monkeypatch.setitem(TU.FOLD_SCORES, "cart", scores)
    monkeypatch.setattr(M, "fit", lambda train, name, rows=None, **over: seen.append(train.count() if rows is None else rows))
    TU.grid_search(spark, train, "cart", grid={"max_depth": [1]}, k=2)
    assert seen == [N, N]


def test_a_caller_may_bound_a_fit(spark, train):
    model = M.fit(train, "cart", rows=1_000, maxDepth=1)
    trees, _ = ensemble_tables(model.stages[-1], spark)
    assert trees[0]["cover"][0] == pytest.approx(1_000, abs=2)
