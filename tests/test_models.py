"""Model invariants on the small scale factor."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.plans import models as M
from vigilo.plans import workflow as WF
from vigilo.plans.features import balanced_weights


def _design(spark, sf, name):
    m = WF.fitted(spark, sf, name)
    train = M.with_label(balanced_weights(WF.train_rows(spark, sf)))
    rows = m.transform(train).select(vector_to_array("features").alias("x"), "label", "weight",
                                     vector_to_array("probability")[1].alias("p")).collect()
    X = np.array([r["x"] for r in rows])
    y = np.array([r["label"] for r in rows])
    w = np.array([r["weight"] for r in rows])
    p = np.array([r["p"] for r in rows])
    return m, X, y, w, p


def test_probabilities_in_unit_interval(spark, sf):
    s = WF.scored_test(spark, sf)
    r = s.agg(F.min("p"), F.max("p"), F.count_if(F.col("p").isNull())).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == 0


def test_unpenalised_logistic_score_equations(spark, sf):
    _, X, y, w, p = _design(spark, sf, "logistic")
    g = X.T @ (w * (p - y)) / w.sum()
    assert abs(np.sum(w * (p - y))) / w.sum() < 1e-3          # intercept equation
    assert np.max(np.abs(g)) < 1e-2


def test_ridge_matches_c_form_optimum(spark, sf):
    m, X, y, w, p = _design(spark, sf, "ridge")
    beta = m.stages[-1].coefficients.toArray()
    grad = beta + C.PENALTY_C * (X.T @ (w * (p - y)))           # ½‖β‖² + C Σ w·loss
    assert np.max(np.abs(grad)) < 1e-2 * max(1.0, np.max(np.abs(beta)))


def test_save_load_gives_equal_predictions(spark, sf, tmp_path):
    m = WF.fitted(spark, sf, "lightgbm")
    path = str(tmp_path / "gbt")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path)
    test = WF.test_rows(spark, sf)
    a = {r[C.KEY]: r["p"] for r in M.score(m, test, "x").collect()}
    b = {r[C.KEY]: r["p"] for r in M.score(back, test, "x").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
