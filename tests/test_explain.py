"""TreeSHAP: brute-force Shapley values with the same path-dependent
conditional expectations, and additivity on a fitted boosted model."""

import itertools
import math

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilo.operators.explain import (
    _tree_shap_batch, _tree_shap_row, ensemble_tables, leaf_values, tree_attributions)


def cond_expect(tree, x, S, j=0):
    if tree["left"][j] < 0:
        return tree["value"][j]
    f = tree["feature"][j]
    l, r = tree["left"][j], tree["right"][j]
    if f in S:
        return cond_expect(tree, x, S, l if x[f] <= tree["thr"][j] else r)
    cov = tree["cover"]
    return (cov[l] * cond_expect(tree, x, S, l) + cov[r] * cond_expect(tree, x, S, r)) / cov[j]


def brute_shap(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for S in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += w * (cond_expect(tree, x, set(S) | {i}) - cond_expect(tree, x, set(S)))
    return phi


def _model(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c), float(d), int(a + b * c > 1.2 or d > 0.8))
            for a, b, c, d in rng.random((400, 4))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label int")
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    return GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df), df


def test_tree_shap_matches_brute_force(spark):
    model, df = _model(spark)
    trees, weights = ensemble_tables(model, spark)
    for x in [np.array(r.features.toArray()) for r in df.limit(5).collect()]:
        for t in trees:
            phi = np.zeros(4)
            _tree_shap_row(x, t, phi, 1.0)
            assert np.allclose(phi, brute_shap(t, x, 4), atol=1e-9)


def test_additivity_on_log_odds(spark):
    model, df = _model(spark)
    rows = df.withColumn("row_id", F.row_number().over(Window.orderBy("a", "b", "c", "d")).cast("int"))
    attr, base = tree_attributions(spark, model, rows, ["a", "b", "c", "d"])
    tot = attr.groupBy("row_id").agg(F.sum("shap").alias("s"))
    logit = model.transform(rows).select("row_id", (2 * vector_to_array("rawPrediction")[1]).alias("z"))
    err = tot.join(logit, "row_id").select(F.max(F.abs(F.col("s") + base - F.col("z")))).first()[0]
    assert err < 1e-9


def test_batch_matches_row_by_row(spark):
    model, df = _model(spark)
    trees, _ = ensemble_tables(model, spark)
    X = np.array([r.features.toArray() for r in df.limit(50).collect()])
    for t in trees:
        want = np.zeros_like(X)
        for b in range(len(X)):
            _tree_shap_row(X[b], t, want[b], 1.0)
        assert np.allclose(_tree_shap_batch(X, t, 1.0), want, atol=1e-12)


def test_leaf_values_match_model(spark):
    model, df = _model(spark)
    trees, weights = ensemble_tables(model, spark)
    X = np.array([r.features.toArray() for r in df.limit(50).collect()])
    margin = sum(w * leaf_values(X, t) for t, w in zip(trees, weights))
    raw = np.array([r.rawPrediction[1] for r in model.transform(df.limit(50)).collect()])
    assert np.allclose(margin, raw, atol=1e-9)
