"""Leaf-wise boosting: equal to a split-at-a-time tree; prefixes; packing."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators import explain as XP
from vigilo.plans import boosting as B
from vigilo.plans import models as M
from vigilo.plans import tuning as TU
from vigilo.plans import workflow as WF
from vigilo.plans.features import default_preparer
from vigilo.operators.evaluate import ranking_metrics


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 9, n), rng.integers(0, 2, n), rng.normal(size=n).round(1),
                         np.full(n, 3.0), rng.integers(0, 2, n)])
    y = (x[:, 0] * (x[:, 1] > 4) + x[:, 2] + 0.5 * rng.normal(size=n) > 0.6).astype(float)
    w = np.where(y == 1, 1.7, 1.0)
    return x, y, w


def table(spark, x, y, w):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "f": list(x), "label": y, "weight": w}))
    return df.select("id", array_to_vector("f").alias("features"), "label", "weight")


def grouped(df, group=0):
    return df.select(F.lit(group).alias("group"), "id", "features", "label", "weight")


def plain_tree(x, y, w, spec):
    """One tree by splitting, again and again, the leaf that gains most; every threshold between two values is tried."""
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)

    def best(rows):
        out = (1e-9, None)
        if len(rows) < 2 * spec.leaf_rows:
            return out
        whole = g[rows].sum() ** 2 / h[rows].sum()
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for a, b in zip(values, values[1:]):
                left, right = rows[x[rows, f] <= a], rows[x[rows, f] > a]
                if min(len(left), len(right)) >= spec.leaf_rows and min(h[left].sum(), h[right].sum()) >= spec.leaf_hessian:
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - whole
                    if gain > out[0] * (1 + 1e-9):
                        out = (gain, (f, left, right))
        return out

    leaves = [(np.arange(len(y)), 0)]
    gains = [best(leaves[0][0])]
    while len(leaves) < spec.leaves:
        k = int(np.argmax([gain if cut and (not spec.depth or d < spec.depth) else -1 for (gain, cut), (_, d) in zip(gains, leaves)]))
        gain, cut = gains[k]
        if not cut or (spec.depth and leaves[k][1] >= spec.depth):
            break
        d = leaves[k][1] + 1
        leaves[k:k + 1], gains[k:k + 1] = [(cut[1], d), (cut[2], d)], [best(cut[1]), best(cut[2])]
    values = np.zeros(len(y))
    for rows, _ in leaves:
        values[rows] = np.log(p / (1 - p)) - g[rows].sum() / h[rows].sum() * spec.rate
    return len(leaves), values


@pytest.mark.parametrize("spec", [B.Spec(rounds=1), B.Spec(rounds=1, leaves=6, leaf_rows=5), B.Spec(rounds=1, depth=3, leaf_rows=10)],
                         ids=["default", "small", "depth"])
@pytest.mark.parametrize("shard_rows", [10_000, 90], ids=["one task", "shards"])
def test_one_tree_equals_splitting_the_best_leaf(spark, spec, shard_rows):
    x, y, w = made(500)
    x[:, 0] = x[:, 0].round(1)                     # fewer values than bins: the plain tree tries them all
    n_leaves, values = plain_tree(x, y, w, spec)
    tree = B.fit_many(grouped(table(spark, x, y, w)), [spec], shard_rows=shard_rows)[0][0]
    assert (tree["left"] < 0).sum() == n_leaves
    assert np.allclose(XP.leaf_values(x, tree), values)
    assert tree["cover"][0] == 500 and (tree["cover"][tree["left"] < 0] >= spec.leaf_rows).all()


def test_shards_and_partitions_do_not_change_the_trees(spark):
    df = table(spark, *made(700, 1))
    spec = B.Spec(rounds=30, leaves=8)             # beyond the first cut of the lineage
    one = B.fit_many(grouped(df), [spec])[0]
    many = B.fit_many(grouped(df.repartition(5)), [spec], shard_rows=120)[0]
    assert len(one) == len(many) == 30
    for a, b in zip(one, many):
        assert (a["feature"] == b["feature"]).all() and np.allclose(a["thr"], b["thr"]) and np.allclose(a["value"], b["value"])


@pytest.mark.parametrize("shard_rows", [10_000, 150], ids=["one task", "shards"])
def test_boosters_in_step_equal_boosters_alone(spark, shard_rows):
    a, b = table(spark, *made(400, 2)), table(spark, *made(300, 3))
    specs = [B.Spec(0, 6, 7), B.Spec(1, 3, 5, rate=0.3), B.Spec(0, 4, 31, depth=2), B.Spec(1, 6, 7)]
    together = B.fit_many(grouped(a).unionByName(grouped(b, 1)), specs, shard_rows=shard_rows)
    for spec, trees in zip(specs, together):
        alone = B.fit_many(grouped([a, b][spec.group], spec.group), [spec], shard_rows=shard_rows)[0]
        assert len(trees) == spec.rounds
        for t, u in zip(trees, alone):
            assert (t["feature"] == u["feature"]).all() and np.allclose(t["value"], u["value"])


def test_first_rounds_are_the_shorter_booster(spark):
    df = grouped(table(spark, *made(400, 4)))
    long, short = (B.fit_many(df, [B.Spec(rounds=r)])[0] for r in (12, 5))
    assert all((t["thr"] == u["thr"]).all() and (t["value"] == u["value"]).all() for t, u in zip(long, short))


def test_it_learns_and_attributions_add_up(spark, tmp_path):
    x, y, w = made(1500, 5)
    df = table(spark, x, y, w)
    model = B.LeafwiseBooster(maxIter=25, numLeaves=12).fit(df.where("id < 1000"))
    scored = model.transform(df.where("id >= 1000"))
    auc = ranking_metrics(scored.select(F.lit("m").alias("model"), F.col("label").cast("int").alias("y"),
                                        vector_to_array("probability")[1].alias("p"))).first()["roc_auc"]
    assert auc > 0.85
    rows = scored.limit(40).withColumn("row_id", F.col("id").cast("int"))
    attr, base = XP.tree_attributions(spark, model, rows, [f"f{k}" for k in range(6)])
    total = {r["row_id"]: base + r["s"] for r in attr.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    for r in rows.collect():
        p = r["probability"][1]
        assert total[r["row_id"]] == pytest.approx(np.log(p / (1 - p)), abs=1e-8)
    gain = model.featureImportances.toArray()
    assert gain.sum() == pytest.approx(1) and gain[4] == 0        # a constant has no split
    path = str(tmp_path / "booster")
    model.write().overwrite().save(path)
    back = B.LeafwiseModel.load(path)
    assert [r["probability"] for r in back.transform(df).orderBy("id").collect()] == \
        [r["probability"] for r in model.transform(df).orderBy("id").collect()]


def test_many_values_become_quantiles(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 3, 3000)])
    edges = B.bin_edges(grouped(table(spark, x, np.zeros(3000), np.ones(3000))))[0]
    assert 200 < len(edges[0]) < B.MOST_BINS and edges[1].tolist() == [0.5, 1.5]
    counts = np.bincount(np.searchsorted(edges[0], x[:, 0]))
    assert counts.max() < 40


def test_few_rows_and_repeated_ids(spark):
    x, y, w = made(30, 7)
    trees = B.fit_many(grouped(table(spark, x, y, w)), [B.Spec(rounds=3)])[0]     # too few rows for a split
    assert all(len(t["left"]) == 1 for t in trees)
    p = (w * y).sum() / w.sum()
    assert trees[0]["value"][0] == pytest.approx(np.log(p / (1 - p)))
    same = table(spark, *made(300, 8)).withColumn("id", F.lit(5))
    assert len(B.fit_many(grouped(same), [B.Spec(rounds=2)], shard_rows=50)[0]) == 2
    with pytest.raises(ValueError, match="no training rows"):
        B.LeafwiseBooster().fit(same.limit(0))


# ---- grids by prefix -----------------------------------------------------------

def separate_f1(spark, train, name, k, point):
    """F1 of each fold by a fit of its own."""
    data = TU.stratified_folds(train.drop("fold"), k)
    out = []
    for fold in range(k):
        others = M.with_label(M.weighted(data.where(F.col("fold") != fold), name))
        prep = default_preparer(train.columns).fit(others)
        model = M.classifier(name, **TU.spark_params(name, point)).fit(prep.transform(others))
        scored = prep.transform(M.with_label(data.where(F.col("fold") == fold))).select("features", "label")
        scored = model.transform(scored).withColumn("prediction", (vector_to_array("probability")[1] > 0.5).cast("double"))
        out.append(TU.positive_f1(scored))
    return out


def test_booster_grid_equals_separate_fits(spark, sf):
    train = WF.train_rows(spark, sf)
    grid = {"n_estimators": [4, 9], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    results, best, point = TU.grid_search(spark, train, "lightgbm", grid, k=2)
    rows = {tuple(sorted(r["params"].items())): r for r in results.collect()}
    assert len(rows) == 8
    for p in ({"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3}, {"n_estimators": 9, "max_depth": 3, "learning_rate": 0.1},
              {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.1}):
        f1 = separate_f1(spark, train, "lightgbm", 2, p)
        r = rows[tuple(sorted((g, str(v)) for g, v in p.items()))]
        assert r["mean_f1"] == pytest.approx(np.mean(f1)) and r["std_f1"] == pytest.approx(np.std(f1))
    assert len(best.stages[-1].trees()) == point["n_estimators"]


def test_forest_grid_prefixes(spark, sf):
    train = WF.train_rows(spark, sf)
    results, best, _ = TU.grid_search(spark, train, "random_forest", {"n_estimators": [3, 8], "max_depth": [3]}, k=2)
    rows = {r["params"]["n_estimators"]: r for r in results.collect()}
    # All trees vote as Spark's own model does, on the same partitions (its bootstrap follows them).
    data = TU.stratified_folds(train.drop("fold"), 2)
    whole = [TU.positive_f1(M.classifier("random_forest", numTrees=8, maxDepth=3).fit(seen).transform(unseen))
             for _, seen, unseen in TU.in_folds(data, "random_forest", 2)]
    assert rows["8"]["mean_f1"] == pytest.approx(np.mean(whole)) and set(rows) == {"3", "8"}
    # A prefix votes as the first trees alone do.
    model = M.fit(train, "random_forest", numTrees=8, maxDepth=3)
    test = model.stages[0].transform(M.with_label(WF.test_rows(spark, sf))).select("features", "label")
    trees, _ = XP.ensemble_tables(model.stages[-1], spark, shares=True)
    got = TU.prefix_f1(test, [trees, trees[:3]], [3, 8], mean=True)
    x = np.vstack([r["features"].toArray() for r in test.collect()])
    y = np.array([r["label"] for r in test.collect()]) == 1
    yes = np.mean([XP.leaf_values(x, t) for t in trees[:3]], axis=0) > 0.5
    f1 = 2 * (yes & y).sum() / (2 * (yes & y).sum() + (yes != y).sum()) if (yes & y).any() else 0.0
    assert got[0, 0] == pytest.approx(f1) == got[1, 0]


def test_grids_have_the_reference_sizes():
    assert {n: len(TU.prefix_groups(g, [dict(zip(g, v)) for v in itertools.product(*g.values())])[0])
            for n, g in TU.GRIDS.items()} == {"cart": 16, "random_forest": 3, "lightgbm": 6}
    assert (C.BOOST_ROUNDS, C.FOREST_TREES, C.MLP_HIDDEN) == (300, 200, [128, 128])
