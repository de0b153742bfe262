"""Models that are cross-validated on the same folds prepare each fold's rows once."""

from pyspark.sql import functions as F

from vigilo import catalog as CAT
from vigilo import config as C
from vigilo.plans import boosting as B
from vigilo.plans import features as FT
from vigilo.plans import models as M


def reports(spark, n=300):
    rows = [(i, 20.0 + (i * 37) % 61 if i % 11 else None, ("F", "M", None)[i % 3], int(i % 7 == 0), int((i * i) % 5 == 1), (i // 3) % C.CV_FOLDS)
            for i in range(n)]
    return spark.createDataFrame(rows, f"{C.KEY} bigint, AGE_YRS double, SEX string, HOSPITAL tinyint, {C.LABEL} tinyint, fold int").coalesce(2)


def test_each_fold_is_prepared_once_for_all_models(spark, monkeypatch):
    train, fits = reports(spark).cache(), []
    real = FT.FeaturePreparer._fit
    monkeypatch.setattr(FT.FeaturePreparer, "_fit", lambda self, df: fits.append(1) or real(self, df))
    monkeypatch.setattr(CAT, "_CV", {})
    monkeypatch.setattr(CAT, "CV_MODELS", ("logistic", "cart"))
    monkeypatch.setattr(CAT.WF, "train_rows", lambda spark, sf: train)
    got = {(r["model"], r[C.KEY]): r["p"] for r in CAT.cv_scored(spark, "none").collect()}
    assert len(fits) == C.CV_FOLDS
    assert len(got) == 2 * 300
    for name in ("logistic", "cart"):                     # as a fit of its own on each fold's other rows
        for f in range(C.CV_FOLDS):
            model = M.fit(train.where(F.col("fold") != f), name)
            for r in M.score(model, train.where(F.col("fold") == f), name).collect():
                assert got[name, r[C.KEY]] == r["p"]
    train.unpersist()


def test_no_task_fits_two_boosters(spark):
    n = 12
    bins = spark.createDataFrame([(g, b"rows") for g in range(4)], "group int, bins binary")
    table = spark.createDataFrame([(b, b % 4) for b in range(n)], "booster int, group int")
    dealt = B.one_each(bins, table, n).select("booster", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["booster"] for r in dealt) == list(range(n))
    assert len({r["task"] for r in dealt}) == n

