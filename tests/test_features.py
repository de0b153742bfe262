"""Preparation stage: exact median, population sd, drop-first one-hot."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.plans import features
from vigilo.plans.features import FeaturePreparer, FeaturePreparerModel, default_preparer
from vigilo.plans.materialize import materialized_split


def test_median_popsd_onehot(spark, tmp_path):
    train = spark.createDataFrame(
        [(1.0, "a", 1), (2.0, "b", 0), (4.0, "c", 1), (9.0, "a", 0), (None, "b", 1)],
        "x double, c string, f int")
    model = FeaturePreparer(numCols=["x"], binCols=["f"], catCols=["c"]).fit(train)
    assert model.getOrDefault("medians") == [3.0]                 # not the approximate 2.0
    vals = [1.0, 2.0, 4.0, 9.0, 3.0]
    mean = sum(vals) / 5
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / 5)        # population sd
    assert math.isclose(model.getOrDefault("stds")[0], sd)
    assert model.feature_names() == ["x", "f", "c_b", "c_c"]      # first category dropped
    test = spark.createDataFrame([(1, None, "a", 0), (2, 1.0, "z", 1), (3, 2.0, "c", 1)],
                                 "VAERS_ID int, x double, c string, f int")
    got = model.long(test).toPandas().set_index(["VAERS_ID", "feature"])["value"]
    assert got[(2, "c_b")] == 0.0 and got[(2, "c_c")] == 0.0     # unknown category → all zeros
    assert got[(3, "c_c")] == 1.0 and got[(1, "c_b")] == 0.0      # first category dropped
    assert math.isclose(got[(1, "x")], (3.0 - mean) / sd)          # NULL → training median


def test_population_sd_of_three(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    m = FeaturePreparer(numCols=["x"]).fit(train)
    assert round(m.getOrDefault("stds")[0], 6) == 1.247219


def test_pipeline_roundtrip(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    m = PipelineModel([FeaturePreparer(numCols=["x"], catCols=["c"]).fit(train)])
    path = str(tmp_path / "prep")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert isinstance(back.stages[0], FeaturePreparerModel)
    assert back.stages[0].feature_names() == m.stages[0].feature_names()
    a = [r.features.toArray().tolist() for r in m.transform(train).collect()]
    b = [r.features.toArray().tolist() for r in back.transform(train).collect()]
    assert a == b


@pytest.mark.parametrize("short_list", [1_000, 0], ids=["listed", "joined"])
def test_looked_up_categories_equal_the_dense_form(spark, sf, short_list, monkeypatch):
    monkeypatch.setattr(features, "SHORT_LIST", short_list)
    split = materialized_split(spark, sf)
    prep = default_preparer(split.columns).fit(split.where("split = 'train'"))
    dense = split.select(C.KEY, F.array(*prep.feature_exprs()).alias("x"))
    got = prep.transform(split).select(C.KEY, vector_to_array("features").alias("y"))
    both = dense.join(got, C.KEY)
    assert both.count() == split.count() == both.where(F.col("x") == F.col("y")).count()
    assert set(prep.transform(split).columns) == {*split.columns, "features"}
    assert prep.transform(split).schema["features"].metadata == {}      # trees split by threshold


@pytest.mark.parametrize("short_list", [1_000, 0], ids=["listed", "joined"])
def test_one_category_none_and_unknown(spark, short_list, monkeypatch):
    monkeypatch.setattr(features, "SHORT_LIST", short_list)
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "x", 2.0), (3, None, "x", None)], "id int, c string, one string, v double")
    prep = FeaturePreparer(numCols=["v"], binCols=[], catCols=["c", "one"]).fit(df)
    assert prep.feature_names() == ["v", "c_a", "c_b"]              # 'Unknown' sorts first and is dropped
    new = spark.createDataFrame([(4, "zzz", "y", 1.5), (5, "b", None, 1.5), (6, "Unknown", "x", 1.5)], df.schema)
    got = {r["id"]: r["features"].toArray().tolist()[1:] for r in prep.transform(new).collect()}
    assert got == {4: [0.0, 0.0], 5: [0.0, 1.0], 6: [0.0, 0.0]}
    assert prep.transform(new.limit(0)).count() == 0


def test_very_many_categories(spark):
    n = 100_000
    df = spark.range(0, 120_000).select(
        F.col("id").alias(C.KEY), F.concat(F.lit("c"), (F.col("id") % n).cast("string")).alias("wide"),
        (F.col("id") % 10).cast("double").alias("v"), F.when(F.col("id") % n < 30_000, 1.0).otherwise(0.0).alias("label"), F.lit(1.0).alias("weight"))
    prep = FeaturePreparer(numCols=["v"], binCols=[], catCols=["wide"]).fit(df)
    assert len(prep.feature_names()) == n
    feats = prep.transform(df).select(C.KEY, "features", "label", "weight").persist()
    first = feats.first()["features"]
    assert isinstance(first, SparseVector) and first.size == n
    model = LogisticRegression(maxIter=5, weightCol="weight", standardization=False).fit(feats)
    right = model.transform(feats).where("prediction = label").count()
    feats.unpersist()
    assert model.coefficients.size == n and right > 0.95 * 120_000
