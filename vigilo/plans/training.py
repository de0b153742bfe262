"""The training job end to end: extracts → split table → models → result tables.

Mirrors the reference's training scripts as one Spark application. Every
artifact is a Parquet table (results partitioned by ``model``) or a saved
pipeline under ``out`` — a folder on the shared file system — so the
dashboard views can read them back instead of recomputing. The tables of the
fitted models are published in one commit, and a tuned model replaces its
pipeline and all its rows in one commit of its own (:mod:`vigilo.sources.commits`),
so a reader never sees its new metrics beside old curves. ``run_training``
reads the stand-in extracts, ``run_training_csv`` three CSV extracts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators import evaluate as E
from vigilo.operators import explain as XP
from vigilo.operators.distributed import held
from vigilo.operators.sampling import explain_sample, sample_and_split, validation_holdout
from vigilo.plans import models as M
from vigilo.plans import tuning as TU
from vigilo.plans.features import default_preparer
from vigilo.plans.materialize import materialized_split
from vigilo.plans.sample import assemble
from vigilo.sources import artifacts as AR
from vigilo.sources import csv_scan as CS
from vigilo.sources.commits import Commit


CV_MODELS = tuple(m for m in M.ALL_MODELS if m != "mlp")     # as the reference cross-validates


def run_training(spark: SparkSession, sf_dir: str, out: str, **options) -> DataFrame:
    """:func:`train_split` over the stand-in extracts."""
    return train_split(spark, materialized_split(spark, sf_dir), out, **options)


def run_training_csv(spark: SparkSession, reports: str, symptoms: str, vaccines: str, out: str,
                     multiline: bool = True, **options) -> DataFrame:
    """:func:`train_split` over three CSV extracts, each parsed once into Parquet."""
    merged = assemble(held(CS.scan_reports(spark, reports, multiline), "reports"),
                      held(CS.scan_symptoms(spark, symptoms, multiline), "symptoms"),
                      held(CS.scan_vaccines(spark, vaccines, multiline), "vaccines")).merged
    AR.write_table(sample_and_split(merged), f"{out}/split", "split")
    return train_split(spark, AR.read_table(spark, f"{out}/split"), out, **options)


def train_split(spark: SparkSession, split: DataFrame, out: str, models=M.ALL_MODELS,
                settings: dict | None = None, cv_models=CV_MODELS, explain_model: str = "lightgbm",
                grids: dict | None = None, history_models=("lightgbm", "mlp"), ready: dict | None = None) -> DataFrame:
    """Fit, tune, evaluate, explain and persist; returns (artifact, rows).

    ``grids`` maps a model to its parameter grid (None: the reference's); the
    refitted best replaces the model, and its rows in the result tables.
    ``ready`` may hold what was already computed on this split: ``models`` by
    name, ``grids`` (results of a grid search by name) and ``cv`` (fold scores).
    """
    settings = settings or {}
    ready = {"models": {}, "grids": {}, "cv": None} | (ready or {})
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    written: list[str] = []
    commit = Commit(spark, out)

    def put(name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        written.append(name)
        return commit.table(name, df, partition_by)

    put("sample", split.drop("split", "fold"))                                   # S4
    put("y_test", test.select(C.KEY, C.LABEL))                                   # S5
    raw_cols = [c for c in C.NUM_FEATURES + C.BIN_COLS + C.CAT_FEATURES if c in split.columns]
    sym = [c for c in split.columns if c.startswith(C.SYM_PREFIX)]
    put("X_test_original", test.select(C.KEY, *raw_cols, *sym))

    prep = default_preparer(train.columns).fit(M.with_label(train))               # M1–M6, once
    fitted = {}
    for name in models:                                                          # C1–C7
        fitted[name] = ready["models"].get(name) or M.fit(train, name, prep_model=prep, **dict(settings.get(name, {})))
        commit.model(name, fitted[name])                                         # S7
    scored = None
    for name, m in fitted.items():                                               # C8
        s = M.score(m, test, name)
        scored = s if scored is None else scored.unionByName(s)
    # Metrics and curves read the scores, they do not score again.
    scored = put("scores", scored, "model")
    put("metrics", E.test_metrics(scored), "model")                              # S8
    put("roc_points", E.roc_points(scored), "model")
    put("pr_points", E.pr_points(scored), "model")
    put("confusion", E.confusion(scored), "model")
    put("coefficients", M.coefficients(spark, fitted), "model")                 # C13
    trees = {n: m for n, m in fitted.items() if n in M.TREES}
    if trees:
        put("importances", importance_table(spark, trees), "model")             # C12
    if "cart" in fitted:
        put("tree_text", AR.tree_rules(spark, fitted["cart"].stages[-1], M.feature_names(fitted["cart"])))  # S11
    commit.publish()
    for name in [n for n in (grids or {}) if n in fitted]:                       # C10, C11, S9
        commit = Commit(spark, out)
        results, best, _ = ready["grids"].get(name) or TU.grid_search(spark, train, name, grids[name])
        put("grid", results, "model")
        fitted[name] = best
        commit.model(name, best)
        tuned = M.score(best, test, name)
        put("metrics", E.test_metrics(tuned), "model")
        put("roc_points", E.roc_points(tuned), "model")
        put("pr_points", E.pr_points(tuned), "model")
        put("confusion", E.confusion(tuned), "model")
        put("importances", importance_table(spark, {name: best}), "model")
        if name == "cart":
            put("tree_text", AR.tree_rules(spark, best.stages[-1], M.feature_names(best)))
        commit.publish()
    commit = Commit(spark, out)
    histories = []
    for name in [n for n in history_models if n in fitted]:                      # R4, C14
        if name == "mlp":
            histories.append(M.training_history(spark, fitted[name], name))
            continue
        rows = validation_holdout(train)
        seen, unseen = (rows.where(F.col("is_val") == v).drop("is_val") for v in (False, True))
        m = M.fit(seen, name, **dict(settings.get(name, {})))
        histories.append(TU.boosting_history(spark, m, seen, unseen))
    if histories:
        put("history", reduce(DataFrame.unionByName, histories), "model")
    folds = ready["cv"]
    validated = [n for n in cv_models if n in fitted] if folds is None else []
    if validated:                                                                # C9
        shared = TU.Folds(train)
        try:
            scores = [TU.cross_validate(train, n, folds=None if {"k", "rows"} & set(settings.get(n, {})) else shared,
                                        **dict(settings.get(n, {}))) for n in validated]
        finally:
            shared.close()
        folds = reduce(DataFrame.unionByName, [E.fold_scores(s) for s in scores])
    if folds is not None:
        put("cv_folds", folds, "model")

    if explain_model in fitted:                                                  # W1
        m = fitted[explain_model]
        rows = m.stages[0].transform(explain_sample(test))
        put("X_test", m.stages[0].long(rows, keep=("row_id",)))
        attr, base = XP.tree_attributions(spark, m.stages[-1], rows, M.feature_names(m))
        put("shap", attr)
        put("shap_base", attr.agg(F.lit(base).alias("base")))
        names = M.feature_names(m)
        put("feature_names", spark.createDataFrame(list(enumerate(names)), "position int, feature string"))

    commit.publish()
    counts = [(name, AR.read_table(spark, f"{out}/{name}").count()) for name in dict.fromkeys(written)]
    return spark.createDataFrame(counts, "artifact string, rows long")


def importance_table(spark: SparkSession, trees: dict) -> DataFrame:
    """C12 by model: split counts for the boosted model, impurity gain for the others."""
    gain = {n: m for n, m in trees.items() if n != "lightgbm"}
    parts = [M.importances(spark, gain)] if gain else []
    if "lightgbm" in trees:
        parts.append(M.split_importances(spark, "lightgbm", trees["lightgbm"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
