"""The bound on rows holds for a fit alone, and no class is lost to it."""

import pytest
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators import explore as X
from vigilo.operators.sampling import bounded_rows, sample_and_split, stratified_sample, validation_holdout
from vigilo.plans import models as M
from vigilo.plans import workflow as WF
from vigilo.plans.materialize import materialized_merged, materialized_split


def test_views_read_every_row(spark, sf):
    merged = materialized_merged(spark, sf)
    n_orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert merged.count() == n_orders
    rates = X.rate_table(merged, "SEX", 1).collect()
    assert sum(r["n"] for r in rates) == merged.where("SEX IS NOT NULL").count()


def test_bound_keeps_both_classes(spark, sf):
    train = WF.train_rows(spark, sf)
    pos, n = train.where(F.col(C.LABEL) == 1).count(), train.count()
    rows = pos // 2                      # fewer than the positives alone
    got = {r[0]: r[1] for r in bounded_rows(train, rows).groupBy(C.LABEL).count().collect()}
    assert abs(got[1] - pos * rows / n) <= 1 and abs(got[0] - (n - pos) * rows / n) <= 1
    assert bounded_rows(train, n).count() == n
    m = M.fit(train, "logistic", rows=rows)
    assert M.score(m, WF.test_rows(spark, sf), "logistic").count() == WF.test_rows(spark, sf).count()


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_is_refused(spark, sf, label):
    with pytest.raises(ValueError, match="both classes"):
        M.fit(WF.train_rows(spark, sf).where(F.col(C.LABEL) == label), "logistic")


def test_split_of_the_whole_table_and_of_a_sample(spark, sf):
    merged = materialized_merged(spark, sf)
    whole = sample_and_split(merged)
    assert whole.count() == merged.count() == materialized_split(spark, sf).count()
    pos = merged.where(F.col(C.LABEL) == 1).count()
    cut = sample_and_split(merged, target=pos + 50)
    keys = {r[0] for r in cut.select(C.KEY).collect()}
    assert keys == {r[0] for r in stratified_sample(merged, target=pos + 50).select(C.KEY).collect()}


def test_validation_rows_are_not_fitted(spark, sf):
    train = WF.train_rows(spark, sf)
    _, _, val = WF.held_out(spark, sf, "logistic")
    fit_rows = validation_holdout(train).where("NOT is_val")
    assert val.select(C.KEY).intersect(fit_rows.select(C.KEY)).count() == 0
    assert val.count() + fit_rows.count() == train.count()
