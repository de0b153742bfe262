"""The data-parallel network: gradients, determinism, schedule, history."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vigilo.operators import evaluate as E
from vigilo.plans import network as N


def crossed(n=1500, seed=0, signal=True):
    """Rows whose label is the sign of a product: no line separates it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.normal(size=n) > 0) if signal else rng.random(n) < 0.5
    return pd.DataFrame({"id": np.arange(n), "f": list(x), "label": y.astype(float), "is_val": np.arange(n) % 5 == 0})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(crossed()).withColumn("features", array_to_vector("f")).drop("f").persist()


def small(**over):
    return N.NetworkClassifier(**{**dict(idCol="id", hidden=[8, 6], maxIter=2, shardRows=300, batchRows=64, stepSize=5e-3), **over})


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    layers = [5, 7, 4, 1]
    flat, x, y = N.first_weights(layers, 3), rng.normal(size=(20, 5)), (rng.random(20) < 0.4).astype(float)
    loss, gradient = N.loss_and_gradient(flat, layers, x, y)
    assert loss == pytest.approx(N.row_losses(N.logit(flat, layers, x), y).sum())
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        slope = (N.loss_and_gradient(flat + step, layers, x, y)[0] - N.loss_and_gradient(flat - step, layers, x, y)[0]) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=1e-5)


def test_gradient_under_dropout_equals_finite_differences():
    rng = np.random.default_rng(2)
    layers, x, y = [3, 6, 5, 1], rng.normal(size=(10, 3)), np.ones(10)
    flat = N.first_weights(layers, 4)

    def at(v):
        return N.loss_and_gradient(v, layers, x, y, 0.5, np.random.default_rng(9))

    for k in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert at(flat)[1][k] == pytest.approx((at(flat + step)[0] - at(flat - step)[0]) / 2e-6, abs=1e-5)


def test_the_fit_equals_a_plain_loop_over_its_batches(rows):
    est = small(dropout=0.3)
    train = rows.where("NOT is_val")
    got = est.fit(train)
    shards = -(-train.count() // 300)
    packs = sorted(N.packed(train, "id", shards, 64, 42).collect(), key=lambda r: (r["shard"], r["batch"]))
    batch = {(r["shard"], r["batch"]): (np.frombuffer(r["x"], np.float32).reshape(-1, 4).astype(float), np.frombuffer(r["y"], np.float32).astype(float))
             for r in packs}
    sizes = {s: sum(k[0] == s for k in batch) for s in sorted({k[0] for k in batch})}
    assert sum(len(y) for _, y in batch.values()) == train.count() and len(sizes) > 2
    layers = [4, 8, 6, 1]
    flat = N.first_weights(layers, 42)
    mean, square, steps, rate = 0.0, 0.0, 0, 5e-3 * math.sqrt(len(sizes))
    for epoch in (1, 2):
        order = {s: np.random.default_rng([42, epoch, s]).permutation(n) for s, n in sizes.items()}
        for step in range(max(sizes.values())):
            gradient, n = 0.0, 0
            for s, o in order.items():
                if step < len(o):
                    x, y = batch[s, int(o[step])]
                    gradient = gradient + N.loss_and_gradient(flat, layers, x, y, 0.3, np.random.default_rng([42, epoch, step, s]))[1]
                    n += len(y)
            gradient, steps = gradient / n, steps + 1
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient ** 2
            flat = flat - rate * (mean / (1 - 0.9 ** steps)) / (np.sqrt(square / (1 - 0.999 ** steps)) + 1e-8)
    assert np.allclose(got.getOrDefault("weights"), flat, rtol=1e-9, atol=1e-12)


def test_partitioning_does_not_change_the_weights(rows):
    first = small().fit(rows).getOrDefault("weights")
    assert first == small().fit(rows.repartition(7)).getOrDefault("weights")
    assert first == small().fit(rows.orderBy(F.rand(3)).coalesce(1)).getOrDefault("weights")
    assert first != small(seed=43).fit(rows).getOrDefault("weights")


def test_it_learns_what_a_line_cannot(rows):
    test = rows.where("is_val")

    def auc(model):
        scored = model.transform(test).select(F.lit("m").alias("model"), F.col("label").cast("int").alias("y"),
                                              vector_to_array("probability")[1].alias("p"))
        return E.ranking_metrics(scored).first()["roc_auc"]

    network = small(hidden=[32, 32], maxIter=15, stepSize=1e-2, dropout=0.1).fit(rows)
    line = LogisticRegression().fit(rows.where("NOT is_val"))
    assert auc(network) > auc(line) + 0.2


@pytest.mark.parametrize("epochs", [1, 2])
def test_history_equals_the_exact_metrics(spark, rows, epochs):
    model = small(maxIter=epochs, dropout=0.0, stepSize=1e-2).fit(rows)
    row = model.history_table(spark, "mlp").where(F.col("epoch") == epochs).first()
    table = model.history_table(spark, "mlp").orderBy("val_loss").first()
    assert table["epoch"] == epochs                # the last epoch is the best, so its weights were kept
    for is_val, name in ((False, "train"), (True, "val")):
        scored = model.transform(rows.where(F.col("is_val") == is_val)).select(
            F.lit("m").alias("model"), F.col("label").cast("int").alias("y"),
            F.round(vector_to_array("probability")[1], 6).alias("p"), vector_to_array("probability")[1].alias("q"))
        assert row[f"{name}_auc"] == pytest.approx(E.ranking_metrics(scored).first()["roc_auc"], abs=1e-6)   # which has six places
        plain = scored.agg(F.avg(-(F.col("y") * F.log("q") + (1 - F.col("y")) * F.log(1 - F.col("q")))),
                           F.avg(((F.col("q") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()
        assert row[f"{name}_loss"] == pytest.approx(plain[0], rel=1e-6) and row[f"{name}_acc"] == pytest.approx(plain[1])


def test_early_stop_on_rows_it_does_not_learn_from(spark):
    noise = spark.createDataFrame(crossed(400, 5, signal=False)).withColumn("features", array_to_vector("f"))
    est = small(hidden=[32], maxIter=30, patience=3, stepSize=3e-2, dropout=0.0)
    model = est.fit(noise)
    history = model.history_table(spark, "mlp")
    n = history.count()
    best = E.best_epoch(history).first()["best_epoch"]
    assert n < 30 and best == n - 3 and E.early_stop_epoch(history, 3).first()["stop_epoch"] == n
    # The weights are those of the best epoch.
    assert est.copy({est.maxIter: best}).fit(noise).getOrDefault("weights") == model.getOrDefault("weights")


def test_plateau_halves_after_patience():
    rule = N.Plateau(2, 0.5)
    assert [rule.after(x) for x in (1.0, 0.9, 0.9, 0.95, 0.91, 0.9, 0.9, 0.9, 0.5)] == [1, 1, 1, 1, 0.5, 1, 1, 0.5, 1]


def test_no_validation_rows_odd_values_and_empty(spark, rows, tmp_path):
    train = rows.where("NOT is_val")
    model = small(maxIter=1).fit(train)
    row = model.history_table(spark, "mlp").first()
    assert row["val_loss"] is None and row["train_loss"] > 0
    with pytest.raises(ValueError, match="no training rows"):
        small().fit(rows.where("is_val"))
    again = train.limit(40).withColumn("id", F.lit(1)).withColumn("extra", F.lit("x"))     # one id for all
    assert len(small(maxIter=1).fit(again).getOrDefault("weights")) == 4 * 8 + 8 + 8 * 6 + 6 + 6 + 1
    path = str(tmp_path / "net")
    model.write().overwrite().save(path)
    back = N.NetworkModel.load(path)
    a, b = (sorted((r["id"], r["probability"][1]) for r in m.transform(rows).collect()) for m in (model, back))
    assert a == b and all(0 <= p <= 1 for _, p in a)
