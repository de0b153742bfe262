"""Per-session cache of fitted models over the materialised split.

The registered model queries share fits: the training rows, fitted
pipelines and the explanation sample are computed once per input and
session, at the defaults of ``models.fit``, which are the reference's settings.
"""

from __future__ import annotations

import threading

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators.sampling import explain_sample, validation_holdout
from vigilo.plans import models as M
from vigilo.plans.features import default_preparer
from vigilo.plans.materialize import input_signature, materialized_split
from vigilo.session import scratch_path

_LOCK = threading.Lock()
_FITS: dict[tuple, PipelineModel] = {}
_SCORES: dict[tuple, str] = {}


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialized_split(spark, sf).where(F.col("split") == "train")


def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialized_split(spark, sf).where(F.col("split") == "test")


def fitted(spark: SparkSession, sf: str, name: str) -> PipelineModel:
    key = (spark.sparkContext.applicationId, input_signature(spark, sf), name)
    with _LOCK:
        m = _FITS.get(key)
    if m is None:
        m = M.fit(train_rows(spark, sf), name, prep_model=shared_preparation(spark, sf))
        with _LOCK:
            _FITS[key] = m
    return m


def shared_preparation(spark: SparkSession, sf: str):
    """One fitted preparation of the training rows, shared by every model."""
    key = (spark.sparkContext.applicationId, input_signature(spark, sf), "_prep")
    with _LOCK:
        p = _FITS.get(key)
    if p is None:
        train = M.with_label(train_rows(spark, sf))
        p = default_preparer(train.columns).fit(train)
        with _LOCK:
            _FITS[key] = p
    return p


def held_out(spark: SparkSession, sf: str, name: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """R4 + C14: a model fitted on the training rows outside the validation
    hold-out, those rows, and the hold-out, which it has not seen."""
    rows = validation_holdout(train_rows(spark, sf))
    key = (spark.sparkContext.applicationId, input_signature(spark, sf), name, "held out")
    with _LOCK:
        m = _FITS.get(key)
    if m is None:
        m = M.fit(rows.where(~F.col("is_val")).drop("is_val"), name)
        with _LOCK:
            _FITS[key] = m
    return m, rows.where("NOT is_val").drop("is_val"), rows.where("is_val").drop("is_val")


def scored_by(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A model's scores of the test rows, written once: metrics and curves
    scan five narrow columns instead of scoring again."""
    key = (spark.sparkContext.applicationId, input_signature(spark, sf), name, "scores")
    with _LOCK:
        path = _SCORES.get(key)
    if path is None:
        path = scratch_path(spark, "scores")
        M.score(fitted(spark, sf, name), test_rows(spark, sf), name).write.parquet(path)
        with _LOCK:
            _SCORES[key] = path
    return spark.read.parquet(path)


def scored_test(spark: SparkSession, sf: str, names=M.ALL_MODELS) -> DataFrame:
    parts = [scored_by(spark, sf, n) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explain_rows(spark: SparkSession, sf: str) -> DataFrame:
    """R5 over the test rows: the explanation sample with its row ids."""
    return explain_sample(test_rows(spark, sf))
