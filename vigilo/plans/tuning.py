"""Cross-validation, grid search and training histories.

* ``cross_validate`` — k fits, each on the other folds, each scored on its
  own fold; the scored table feeds ``evaluate.fold_scores`` so all five
  metrics come from one pass (Spark's CrossValidator reports one metric).
* ``grid_search`` — every point of a grid on the same prepared folds with the
  positive-class F1, returning mean and sd per parameter combination and
  the best pipeline refitted on all training rows. The first trees of a forest
  or of a booster are one of fewer trees, so points that differ in
  ``n_estimators`` alone share a fit and are scored together, by tree prefixes.
* ``boosting_history`` — loss, accuracy and AUC after every boosting round,
  from tree outputs summed in the tasks into counts by (round, score).

Boosters of all folds and points are fitted in step (``boosting.fit_many``).
"""

from __future__ import annotations

import itertools
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import round_half_even
from vigilo.operators.distributed import hash_rank, md5_hash
from vigilo.operators.sampling import fit_rows
from vigilo.operators.explain import ensemble_tables, leaf_values, margin_scale
from vigilo.plans import boosting as B
from vigilo.plans import models as M
from vigilo.plans import network as N
from vigilo.plans.features import default_preparer
from vigilo.session import scratch_path

# ---- fixed values: the reference's grid parameter names → Spark ML names ----
PARAM_NAMES = {
    "cart": {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"},
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth"},
    "lightgbm": {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize"},
}
GRIDS = {"cart": C.CART_GRID, "random_forest": C.FOREST_GRID, "lightgbm": C.BOOST_GRID}
HISTORY_ROWS = 131_072           # rows whose scores a task counts together: 90 MB at 83 features
GRID_FOLDS = {"cart": C.CV_FOLDS, "random_forest": C.FOREST_CV_FOLDS, "lightgbm": C.CV_FOLDS}


def stratified_folds(train: DataFrame, k: int, seed: int = C.SEED) -> DataFrame:
    """R3 for any k: fold = hash rank within class, dealt round-robin."""
    ranked = hash_rank(train.withColumn("_h", md5_hash(C.KEY, seed, f"fold{k}")), "_h", [C.LABEL], C.KEY)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_n", "_n_all")


class Folds:
    """Preparation and prepared vectors of each fold's other rows, for every model that is fitted on them.

    Neither depends on the model, so medians and categories are found and the
    vectors built once a fold. The vectors (``rows`` bounds them as in
    :func:`models.fit`) are held until :meth:`close`, on disk where memory ends.
    """

    def __init__(self, train: DataFrame, k: int = C.CV_FOLDS, rows: int | None = None):
        if "fold" not in train.columns or k != C.CV_FOLDS:
            train = stratified_folds(train.drop("fold"), k)
        self.train, self.k = train, k

        def prepared(f):
            others = M.with_label(fit_rows(train.where(F.col("fold") != f), rows).where(F.col(C.LABEL).isNotNull()))
            prep = default_preparer(train.columns).fit(others)
            return prep, prep.transform(others).select(C.KEY, C.LABEL, "label", "features").persist()

        with ThreadPool(k) as pool:
            made = pool.map(prepared, range(k))
        self.preps, self.vectors = [p for p, _ in made], [v for _, v in made]

    def unseen(self, fold: int) -> DataFrame:
        return self.train.where(F.col("fold") == fold)

    def close(self) -> None:
        for v in self.vectors:
            v.unpersist()


def booster_folds(folds: Folds, points: list[dict]) -> list[list[B.LeafwiseModel]]:
    """Model of each fold and point, fitted on the other folds' rows."""
    parts = [M.weighted(v, "lightgbm").select(F.lit(f).alias("group"), F.col(C.KEY).alias("id"), "features", "label", "weight")
             for f, v in enumerate(folds.vectors)]
    specs = [M.classifier("lightgbm", **p).spec(f) for f in range(folds.k) for p in points]
    widths = [len(p.feature_names()) for p in folds.preps]
    together = reduce(DataFrame.unionByName, parts).persist()
    try:
        trees = B.fit_many(together, specs, C.SEED)
    finally:
        together.unpersist()
    n = len(points)
    return [[B.LeafwiseModel.of(t, widths[f]) for t in trees[f * n:(f + 1) * n]] for f in range(folds.k)]


def cross_validate(train: DataFrame, name: str, k: int = C.CV_FOLDS, rows: int | None = None,
                   folds: Folds | None = None, **over) -> DataFrame:
    """Out-of-fold scored rows (model, fold, VAERS_ID, y, p, pred).

    ``folds`` may be the folds of the same rows, prepared for several models;
    the caller closes them.
    """
    own = folds or Folds(train, k, rows)
    try:
        if name == "lightgbm":
            models = [PipelineModel([p, m[0]]) for p, m in zip(own.preps, booster_folds(own, [over]))]
        else:
            with ThreadPool(own.k) as pool:
                models = pool.map(lambda f: M.fit_vectors(own.vectors[f], name, own.preps[f], **dict(over)), range(own.k))
    finally:
        if folds is None:
            own.close()
    # Written once: the metrics scan narrow rows several times and do not score again.
    path = scratch_path(train.sparkSession, "fold-scores")
    parts = [M.score(m, own.unseen(f), name, keep=["fold"]) for f, m in enumerate(models)]
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return train.sparkSession.read.parquet(path)


def positive_f1(scored: DataFrame) -> float:
    """F1 of class 1 over (label, prediction), 0 where undefined."""
    y, d = F.col("label"), F.col("prediction")
    r = scored.agg(F.count_if((y == 1) & (d == 1)).alias("tp"), F.count_if(y != d).alias("wrong")).first()
    return f1_of(r["tp"], r["wrong"])


def f1_of(tp: int, wrong: int) -> float:
    return 2 * tp / (2 * tp + wrong) if tp else 0.0


def prefix_f1(rows: DataFrame, ensembles: list[list[dict]], sizes: list[int], mean: bool) -> np.ndarray:
    """F1 of class 1 (ensemble × size) when only an ensemble's first ``size`` trees vote.

    One pass over the rows (features, label): class 1 where the sum of log-odds,
    or with ``mean`` the mean share, of the trees lies above its middle.
    """
    level = 0.5 if mean else 0.0

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.asfortranarray(np.vstack(pdf["x"].to_numpy())), pdf["label"].to_numpy() == 1
            out = []
            for e, trees in enumerate(ensembles):
                total = np.zeros(len(x))
                for k, t in enumerate(trees):
                    total += leaf_values(x, t)
                    if k + 1 in sizes:
                        yes = total / (k + 1 if mean else 1) > level
                        out.append((e, k + 1, int((yes & y).sum()), int((yes != y).sum())))
            yield pd.DataFrame(out, columns=["e", "size", "tp", "wrong"])

    counts = (rows.select(vector_to_array("features").alias("x"), "label").mapInPandas(run, "e int, size int, tp long, wrong long")
              .groupBy("e", "size").agg(F.sum("tp").alias("tp"), F.sum("wrong").alias("wrong")).collect())
    out = np.zeros((len(ensembles), len(sizes)))
    for r in counts:
        out[r["e"], sizes.index(r["size"])] = f1_of(r["tp"], r["wrong"])
    return out


def grid_search(spark: SparkSession, train: DataFrame, name: str, grid: dict | None = None,
                k: int | None = None, rows: int | None = None, parallelism: int = 8, **fixed):
    """C10 + C11: (results DataFrame, best refitted PipelineModel, best params).

    Preparation is fitted once per fold, on the other folds; every point of
    the grid then trains on the same vectors. All training rows are used, or
    as many as a caller's ``rows`` leaves (:func:`models.fit`).
    """
    grid = grid or GRIDS[name]
    k = k or GRID_FOLDS[name]
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    data = stratified_folds(fit_rows(train, rows).drop("fold"), k)
    scores = FOLD_SCORES[name](spark, data, name, grid, points, k, parallelism, fixed)
    mean, sd = scores.mean(axis=1), scores.std(axis=1)
    res = spark.createDataFrame(
        [(name, {g: str(v) for g, v in p.items()}, float(m), float(d), k) for p, m, d in zip(points, mean, sd)],
        "model string, params map<string,string>, mean_f1 double, std_f1 double, n_splits int")
    best = points[int(np.argmax(mean))]
    return res, M.fit(train, name, rows=rows, **{**fixed, **spark_params(name, best)}), best


def spark_params(name: str, point: dict) -> dict:
    return {PARAM_NAMES[name][g]: v for g, v in point.items()}


def in_folds(data: DataFrame, name: str, k: int):
    """(fold, prepared rows of the others, prepared rows of the fold), each held while it is used."""
    weighted = M.with_label(M.weighted(data, name))
    for fold in range(k):
        others = weighted.where(F.col("fold") != fold)
        prep = default_preparer(data.columns).fit(others)
        seen = prep.transform(others).select("features", "label", "weight").persist()
        unseen = prep.transform(weighted.where(F.col("fold") == fold)).select("features", "label").persist()
        try:
            # Every fit is many short jobs: no more tasks than its rows need.
            tasks = max(1, seen.count() // 20_000)
            yield fold, seen.coalesce(tasks), unseen.coalesce(tasks)
        finally:
            seen.unpersist()
            unseen.unpersist()


def each_point(spark, data, name, grid, points, k, parallelism, fixed) -> np.ndarray:
    """F1 of each point and fold, by a fit each."""
    scores = np.zeros((len(points), k))
    for fold, seen, unseen in in_folds(data, name, k):
        def fold_f1(point):
            return positive_f1(M.classifier(name, **{**fixed, **spark_params(name, point)}).fit(seen).transform(unseen))

        with ThreadPool(parallelism) as pool:            # Spark shares its slots among the fits' jobs
            scores[:, fold] = pool.map(fold_f1, points)
    return scores


def prefix_groups(grid: dict, points: list[dict]) -> tuple[list[dict], list[int]]:
    """Points with the most trees, and the numbers of trees: other points are prefixes of these."""
    sizes = sorted(set(grid.get("n_estimators", [])))
    return [p for p in points if not sizes or p["n_estimators"] == sizes[-1]], sizes


def spread_out(points: list[dict], largest: list[dict], sizes: list[int], found: np.ndarray) -> list[float]:
    """Each point's value from (largest point × size)."""
    def rest(p):
        return {g: v for g, v in p.items() if g != "n_estimators"}

    return [found[[rest(q) for q in largest].index(rest(p)), sizes.index(p["n_estimators"]) if sizes else 0] for p in points]


def forest_prefixes(spark, data, name, grid, points, k, parallelism, fixed) -> np.ndarray:
    """F1 of each point and fold: a forest for each depth, scored by its first trees."""
    largest, sizes = prefix_groups(grid, points)
    scores = np.zeros((len(points), k))
    for fold, seen, unseen in in_folds(data, name, k):
        def fold_f1(point):
            model = M.classifier(name, **{**fixed, **spark_params(name, point)}).fit(seen)
            trees, _ = ensemble_tables(model, spark, shares=True)
            return prefix_f1(unseen, [trees], sizes or [len(trees)], mean=True)[0]

        with ThreadPool(parallelism) as pool:
            scores[:, fold] = spread_out(points, largest, sizes, np.array(pool.map(fold_f1, largest)))
    return scores


def booster_prefixes(spark, data, name, grid, points, k, parallelism, fixed) -> np.ndarray:
    """F1 of each point and fold: all folds' boosters with the most rounds in one fit, scored by their first trees."""
    largest, sizes = prefix_groups(grid, points)
    folds = Folds(data, k)
    try:
        fitted = booster_folds(folds, [{**fixed, **spark_params(name, p)} for p in largest])
    finally:
        folds.close()
    scores = np.zeros((len(points), k))
    for fold in range(k):
        unseen = folds.preps[fold].transform(M.with_label(data.where(F.col("fold") == fold))).select("features", "label")
        trees = [m.trees() for m in fitted[fold]]
        scores[:, fold] = spread_out(points, largest, sizes, prefix_f1(unseen, trees, sizes or [len(trees[0])], mean=False))
    return scores


FOLD_SCORES = {"cart": each_point, "random_forest": forest_prefixes, "lightgbm": booster_prefixes}


def grid_top5(results: DataFrame) -> DataFrame:
    """T4: five best combinations by mean F1, rounded to 4 places."""
    return (results.orderBy(F.desc("mean_f1"), F.asc(F.col("params").cast("string"))).limit(5)
                   .select("model", "params", round_half_even("mean_f1", 4).alias("mean_f1"),
                           round_half_even("std_f1", 4).alias("std_f1")))


def grid_pivot(results: DataFrame, row: str = "max_depth", col: str = "min_samples_leaf") -> DataFrame:
    """T5: mean F1 laid out as row-parameter × column-parameter."""
    t = results.select(F.col("params")[row].cast("int").alias(row),
                       F.col("params")[col].cast("int").alias(col), "mean_f1")
    vals = sorted({r[0] for r in t.select(col).distinct().collect()})    # grid values, few
    return t.groupBy(row).pivot(col, vals).agg(F.first("mean_f1")).orderBy(row)


def grid_best(results: DataFrame) -> DataFrame:
    """Per model the folds, best CV F1 and each best parameter as text
    (ties: parameters as text, ascending)."""
    best = results.groupBy("model").agg(
        F.min_by(F.struct("params", "mean_f1", "n_splits"),
                 F.struct(-F.col("mean_f1"), F.col("params").cast("string"))).alias("b"))
    return best.select("model", F.col("b.n_splits").alias("cv_folds"),
                       F.format_number(round_half_even(F.col("b.mean_f1"), 4), 4).alias("best_cv_f1"),
                       F.explode(F.col("b.params")).alias("param", "value"))


def boosting_history(spark: SparkSession, model, seen: DataFrame, val: DataFrame, name: str = "lightgbm") -> DataFrame:
    """C14: (model, epoch, loss, accuracy and AUC of training and validation rows) after each round.

    A task sums the tree outputs of up to ``HISTORY_ROWS`` rows round by round and
    sends, for each round, its packed counts by score (to six places), not its rows.
    They are written once, as the network's are.
    """
    prep, booster = model.stages[0], model.stages[-1]
    trees, weights = ensemble_tables(booster, spark)
    scale = margin_scale(booster)

    def played(is_val, kept):
        x, y = np.asfortranarray(np.concatenate([x for x, _ in kept])), np.concatenate([y for _, y in kept])
        z, out = np.zeros(len(x)), []
        for k, (t, w) in enumerate(zip(trees, weights)):
            z += scale * w * leaf_values(x, t)
            out.append((k + 1, is_val, *N.score_sums(z, y), N.score_counts(z, y)))
        return pd.DataFrame(out, columns=["epoch", "is_val", "loss", "correct", "n", "counts"])

    def run(batches):
        held = {False: [], True: []}
        for pdf in batches:
            for is_val, part in pdf.groupby("is_val"):
                kept = held[bool(is_val)]
                kept.append((np.vstack(part["x"].to_numpy()), part["y"].to_numpy()))
                if sum(len(y) for _, y in kept) >= HISTORY_ROWS:
                    yield played(bool(is_val), kept)
                    kept.clear()
        for is_val, kept in held.items():
            if kept:
                yield played(is_val, kept)

    both = seen.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    rows = prep.transform(M.with_label(both)).select(
        "is_val", F.col("label").alias("y"), vector_to_array("features").alias("x"))
    path = scratch_path(spark, "boosting-scores")
    rows.mapInPandas(run, N.SCORED).write.parquet(path)
    return N.history_of(spark.read.parquet(path)).select(F.lit(name).alias("model"), *N.SERIES)
