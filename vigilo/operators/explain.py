"""Attributions and their read-outs (W1, W3–W8, plus linear attributions).

An *attribution table* is long: (row_id, feature, value, shap) — one row per
explained example and feature — with a base value kept beside it. Every
read-out below is a relational query on that table, so the same code serves
the linear stand-in (checked against SQL) and tree attributions.

W1 (tree-ensemble attributions) is exact path-dependent TreeSHAP
(Lundberg, Erion & Lee, 2018, Algorithm 2) run in ``mapInPandas``: rows
stream through the executors in Arrow batches, the (small) node tables of
the ensemble travel with the function, and per row the cost is
O(trees · leaves · depth²).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import r6
from vigilo.session import scratch_path


# ------------------------------------------------------------------ linear

def linear_attributions(values: DataFrame, weights: DataFrame) -> DataFrame:
    """φ = w · (x − mean x) per (row, feature); means over the explained rows.

    ``values``: (row_id, feature, value); ``weights``: (feature, weight).
    Both side tables have one row per feature and are broadcast.
    """
    means = values.groupBy("feature").agg(F.avg("value").alias("_mean"))
    j = (values.join(F.broadcast(means), "feature")
               .join(F.broadcast(weights), "feature"))
    return j.select("row_id", "feature", "value",
                    (F.col("weight") * (F.col("value") - F.col("_mean"))).alias("shap"))


def linear_base(values: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """Base value: intercept + Σ w · mean x (one row)."""
    means = values.groupBy("feature").agg(F.avg("value").alias("_mean"))
    return (means.join(F.broadcast(weights), "feature")
                 .agg((F.lit(intercept) + F.sum(F.col("weight") * F.col("_mean"))).alias("base")))


# ------------------------------------------------------------------ read-outs

def mean_abs_attribution(attr: DataFrame, k: int = C.TOP_FEATURES) -> DataFrame:
    """Mean |shap| per feature, top k (ties: feature name)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
                .orderBy(F.desc("mean_abs_shap"), F.asc("feature")).limit(k))


def attribution_pairs(attr: DataFrame, primary: str, color: str | None = None) -> DataFrame:
    """(row_id, x, shap, color) for a dependence plot; one equi-join on row."""
    p = attr.where(F.col("feature") == primary).select("row_id", F.col("value").alias("x"), "shap")
    c = attr.where(F.col("feature") == (color or primary)).select("row_id", F.col("value").alias("color"))
    return p.join(c, "row_id")


def waterfall(attr: DataFrame, base: DataFrame | float, row_id: int, k: int = C.WATERFALL_ROWS) -> DataFrame:
    """One row's top k−1 features by |shap| plus an 'other' remainder,
    stacked from the base value (others first, then the largest last).

    Windows are partitioned by row_id, i.e. over one row's features.
    """
    one = attr.where(F.col("row_id") == row_id)
    w_rank = Window.partitionBy("row_id").orderBy(F.desc(F.abs("shap")), F.asc("feature"))
    ranked = one.withColumn("rank", F.row_number().over(w_rank))
    top = ranked.where(F.col("rank") < k).select("row_id", "rank", "feature", "value", "shap")
    rest = (ranked.where(F.col("rank") >= k).groupBy("row_id")
                  .agg(F.count(F.lit(1)).alias("_n"), F.sum("shap").alias("shap"))
                  .select("row_id", F.lit(k).alias("rank"),
                          F.concat(F.col("_n").cast("string"), F.lit(" other features")).alias("feature"),
                          F.lit(None).cast("double").alias("value"), "shap"))
    bars = top.unionByName(rest)
    w_cum = (Window.partitionBy("row_id").orderBy(F.desc("rank"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if isinstance(base, DataFrame):                                    # a one-row table
        base = base.first()["base"]
    stacked = bars.withColumn("end", F.lit(float(base)) + F.sum("shap").over(w_cum))
    return stacked.select("row_id", "rank", "feature", r6("value").alias("value"), r6("shap").alias("shap"),
                          r6(F.col("end") - F.col("shap")).alias("start"), r6("end").alias("end"))


def force_split(attr: DataFrame, row_id: int) -> DataFrame:
    """One row's attributions split into pushes up and down."""
    one = attr.where(F.col("row_id") == row_id)
    return (one.withColumn("direction", F.when(F.col("shap") > 0, F.lit("higher"))
                                         .when(F.col("shap") < 0, F.lit("lower")).otherwise(F.lit("none")))
               .select("row_id", "feature", r6("value").alias("value"), r6("shap").alias("shap"), "direction")
               .orderBy("direction", F.desc(F.abs("shap"))))


def attribution_by_raw_feature(attr: DataFrame, raw_map: DataFrame) -> DataFrame:
    """Per raw column, attributions summed over its encoded columns per
    row, then averaged; the map comes from the fitted preparation (exact
    names, never prefix or substring matches)."""
    per_row = (attr.join(F.broadcast(raw_map), "feature")
                   .groupBy("row_id", "raw_feature").agg(F.sum("shap").alias("s")))
    return per_row.groupBy("raw_feature").agg(r6(F.avg("s")).alias("mean_shap")).withColumn(
        "direction", F.when(F.col("mean_shap") > 0, F.lit("pushes toward death"))
                      .otherwise(F.lit("pushes toward survival")))


def attribution_long(attr: DataFrame, k: int = C.TOP_FEATURES) -> DataFrame:
    """Beeswarm source — the long table cut to the k top features."""
    top = mean_abs_attribution(attr, k).select("feature")
    return attr.join(F.broadcast(top), "feature", "left_semi")


# ------------------------------------------------------------------ TreeSHAP

def ensemble_tables(model, spark: SparkSession, shares: bool = False) -> tuple[list[dict], list[float]]:
    """Node arrays of every tree of a fitted tree ensemble, and tree weights.

    With ``shares`` the values of classification trees are the node's share of
    class 1 (what a forest averages) instead of its class. The model is written to the shared scratch folder with its own writer and
    its node table read back (size: trees × nodes, small by construction).
    """
    if type(model).__name__ == "LeafwiseModel":          # keeps its trees itself
        trees = model.trees()
        return trees, [1.0] * len(trees)
    path = scratch_path(spark, "ensemble")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:                       # ensembles: (treeID, nodeData)
        data = data.select("treeID", "nodeData.*")
    else:                                                # a single tree: node columns
        data = data.withColumn("treeID", F.lit(0))
    # regression trees (boosting) keep [count, sum, sum²]; classification
    # trees keep per-class counts — either way the node's weighted cover
    regression = type(model).__name__.startswith("GBT")
    stats = F.col("impurityStats")
    cover = F.get(stats, 0) if regression else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    value = F.get(stats, 1) / cover if shares else F.col("prediction")
    nodes = data.select(
        "treeID", "id", value.alias("prediction"), "leftChild", "rightChild", cover.alias("cover"),
        "split.featureIndex", F.get(F.col("split.leftCategoriesOrThreshold"), 0).alias("thr"),
    ).toPandas()
    try:
        weights = [float(w) for w in model.treeWeights]
    except AttributeError:
        weights = [1.0]
    trees = []
    for t in range(len(weights)):
        d = nodes[nodes["treeID"] == t].sort_values("id")
        n = int(d["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ("value", "cover", "thr")}
        arr.update({k: np.full(n, -1, dtype=np.int64) for k in ("left", "right", "feature")})
        idx = d["id"].to_numpy()
        arr["value"][idx] = d["prediction"].to_numpy()
        arr["cover"][idx] = d["cover"].to_numpy()
        arr["thr"][idx] = d["thr"].fillna(0).to_numpy()
        arr["left"][idx] = d["leftChild"].to_numpy()
        arr["right"][idx] = d["rightChild"].to_numpy()
        arr["feature"][idx] = d["featureIndex"].to_numpy()
        trees.append(arr)
    return trees, weights


def margin_scale(model) -> float:
    """Log-odds of a unit of the summed trees: Spark's boosted classifier has
    P = 1/(1+e^(−2m)) for a margin m, the leaf-wise booster P = 1/(1+e^(−m))."""
    return 2.0 if type(model).__name__.startswith("GBT") else 1.0


def _tree_expected(tree: dict) -> float:
    leaves = tree["left"] < 0
    return float(np.sum(tree["value"][leaves] * tree["cover"][leaves]) / tree["cover"][0])


def _tree_shap_row(x: np.ndarray, tree: dict, phi: np.ndarray, scale: float) -> None:
    """Exact path-dependent TreeSHAP for one row and one tree (adds into phi)."""
    left, right, feat, thr = tree["left"], tree["right"], tree["feature"], tree["thr"]
    value, cover = tree["value"], tree["cover"]

    def extend(path, pz, po, pi):
        d, z, o, w = path
        n = len(d)
        d = d + [pi]; z = z + [pz]; o = o + [po]; w = w + [1.0 if n == 0 else 0.0]
        for i in range(n - 1, -1, -1):
            w[i + 1] += po * w[i] * (i + 1) / (n + 1)
            w[i] = pz * w[i] * (n - i) / (n + 1)
        return [d, z, o, w]

    def unwind(path, i):
        d, z, o, w = (list(a) for a in path)
        n = len(d) - 1
        nxt = w[n]
        for j in range(n - 1, -1, -1):
            if o[i] != 0:
                t = w[j]
                w[j] = nxt * (n + 1) / ((j + 1) * o[i])
                nxt = t - w[j] * z[i] * (n - j) / (n + 1)
            else:
                w[j] = w[j] * (n + 1) / (z[i] * (n - j))
        for j in range(i, n):
            d[j], z[j], o[j] = d[j + 1], z[j + 1], o[j + 1]
        return [d[:n], z[:n], o[:n], w[:n]]

    def unwound_sum(path, i):
        d, z, o, w = path
        n = len(d) - 1
        total, nxt = 0.0, w[n]
        for j in range(n - 1, -1, -1):
            if o[i] != 0:
                t = nxt * (n + 1) / ((j + 1) * o[i])
                total += t
                nxt = w[j] - t * z[i] * (n - j) / (n + 1)
            else:
                total += (w[j] / z[i]) * (n + 1) / (n - j)
        return total

    def recurse(j, path, pz, po, pi):
        path = extend(path, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(path[0])):
                wsum = unwound_sum(path, i)
                phi[path[0][i]] += scale * wsum * (path[2][i] - path[1][i]) * value[j]
            return
        f = feat[j]
        hot, cold = (left[j], right[j]) if x[f] <= thr[j] else (right[j], left[j])
        iz, io = 1.0, 1.0
        if f in path[0][1:]:
            k = path[0].index(f, 1)
            iz, io = path[1][k], path[2][k]
            path = unwind(path, k)
        recurse(hot, path, iz * cover[hot] / cover[j], io, f)
        recurse(cold, path, iz * cover[cold] / cover[j], 0.0, f)

    recurse(0, [[], [], [], []], 1.0, 1.0, -1)


def _tree_shap_batch(X: np.ndarray, tree: dict, scale: float) -> np.ndarray:
    """Path-dependent TreeSHAP for a batch of rows at once (B × M result).

    The recursion visits every node once; the path's features and
    zero-fractions are the same for all rows, only the one-fractions (0/1)
    and the path weights differ, so they are carried as length-B vectors.
    """
    B, M = X.shape
    phi = np.zeros((B, M))
    left, right, feat, thr = tree["left"], tree["right"], tree["feature"], tree["thr"]
    value, cover = tree["value"], tree["cover"]

    def extend(d, z, o, w, pz, po, pi):
        n = len(d)
        d = d + [pi]
        z = z + [pz]
        o = o + [po]
        w = [x.copy() for x in w] + [np.full(B, 1.0 if n == 0 else 0.0)]
        for i in range(n - 1, -1, -1):
            w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (n + 1)
            w[i] = pz * w[i] * (n - i) / (n + 1)
        return d, z, o, w

    def unwind(d, z, o, w, i):
        n = len(d) - 1
        w = [x.copy() for x in w]
        nxt = w[n].copy()
        oi, zi = o[i], z[i]
        nz = oi != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(n - 1, -1, -1):
                t = w[j]
                a = np.where(nz, nxt * (n + 1) / ((j + 1) * np.where(nz, oi, 1.0)), 0.0)
                b = w[j] * (n + 1) / (zi * (n - j)) if zi != 0 else np.zeros(B)
                w[j] = np.where(nz, a, b)
                nxt = np.where(nz, t - w[j] * zi * (n - j) / (n + 1), nxt)
        d = d[:i] + d[i + 1:]
        z = z[:i] + z[i + 1:]
        o = o[:i] + o[i + 1:]
        return d, z, o, w[:n]

    def unwound_sum(z, o, w, i):
        n = len(w) - 1
        oi, zi = o[i], z[i]
        nz = oi != 0
        total = np.zeros(B)
        nxt = w[n].copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(n - 1, -1, -1):
                t = np.where(nz, nxt * (n + 1) / ((j + 1) * np.where(nz, oi, 1.0)), 0.0)
                alt = (w[j] / zi) * (n + 1) / (n - j) if zi != 0 else np.zeros(B)
                total = total + np.where(nz, t, alt)
                nxt = np.where(nz, w[j] - t * zi * (n - j) / (n + 1), nxt)
        return total

    def recurse(j, d, z, o, w, pz, po, pi):
        d, z, o, w = extend(d, z, o, w, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(d)):
                phi[:, d[i]] += scale * unwound_sum(z, o, w, i) * (o[i] - z[i]) * value[j]
            return
        f = int(feat[j])
        go_left = (X[:, f] <= thr[j]).astype(float)
        iz, io = 1.0, np.ones(B)
        if f in d[1:]:
            k = d.index(f, 1)
            iz, io = z[k], o[k]
            d, z, o, w = unwind(d, z, o, w, k)
        l, r = left[j], right[j]
        recurse(l, d, z, o, w, iz * cover[l] / cover[j], io * go_left, f)
        recurse(r, d, z, o, w, iz * cover[r] / cover[j], io * (1.0 - go_left), f)

    recurse(0, [], [], [], [], 1.0, np.ones(B), -1)
    return phi


def leaf_values(X: np.ndarray, tree: dict) -> np.ndarray:
    """Each row's leaf value in one tree; a node's rows are dealt to its children.

    Fastest where ``X`` is laid out feature by feature.
    """
    out = np.empty(len(X))
    left, right, feature, thr, value = (tree[c] for c in ("left", "right", "feature", "thr", "value"))
    waiting = [(0, np.arange(len(X)))]
    while waiting:
        node, rows = waiting.pop()
        if left[node] < 0:
            out[rows] = value[node]
            continue
        go = X[:, feature[node]][rows] <= thr[node]
        for child, own in ((left[node], rows[go]), (right[node], rows[~go])):
            if len(own):
                waiting.append((child, own))
    return out


def tree_attributions(spark: SparkSession, ensemble, rows: DataFrame, names: list[str],
                      features_col: str = "features") -> tuple[DataFrame, float]:
    """(row_id, feature, value, shap) and the base value, in log-odds.

    Attributions and base are scaled by :func:`margin_scale` and satisfy
    base + Σ shap = log-odds for every row.
    """
    output_scale = margin_scale(ensemble)
    trees, weights = ensemble_tables(ensemble, spark)
    base = output_scale * sum(w * _tree_expected(t) for t, w in zip(trees, weights))
    n_feat = len(names)
    name_arr = np.array(names, dtype=object)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack([np.asarray(v, dtype=float) for v in pdf["x"]])
            phi = np.zeros_like(X)
            for t, w in zip(trees, weights):
                phi += _tree_shap_batch(X, t, output_scale * w)
            ids = pdf["row_id"].to_numpy()
            yield pd.DataFrame({"row_id": np.repeat(ids, n_feat).astype("int32"),
                                "feature": np.tile(name_arr, len(ids)), "value": X.ravel(),
                                "shap": phi.ravel()})

    # Few rows, much work for each: deal them over the cores.
    src = rows.select("row_id", vector_to_array(features_col).alias("x")).repartition(
        spark.sparkContext.defaultParallelism)
    out = src.mapInPandas(run, "row_id int, feature string, value double, shap double")
    return out, base
