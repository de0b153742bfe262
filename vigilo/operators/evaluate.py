"""Classifier evaluation over a scored table.

A *scored* table has one row per (model, example): ``model``, ``y`` (0/1),
``p`` (probability of class 1) and ``pred`` (0/1), plus optional grouping
columns such as ``fold``. Metrics are computed per group in one pass:

* counts (E1–E3) and log loss (E6) are plain aggregates;
* ROC-AUC (E4) and average precision (E5) need, per distinct score, the
  positives/negatives at strictly higher scores: a distributed prefix sum
  over the (group, score) aggregate, then one more aggregate —
  AUC = Σ neg·(TP_above + pos/2) / (P·N) (ties averaged),
  AP  = Σ pos·precision / P (step-wise, no interpolation);
* curve points (E7, E8) come from the same prefix sums, which also number
  the points and carry the next one, needed to drop collinear ROC points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import model_label, r6, round_half_even
from vigilo.operators.distributed import prefix_sums
from vigilo.operators.explore import box_stats

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _div0(a, b):
    """Zero-division → 0, as the reference's metric calls are told to do."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(scored: DataFrame, groups=("model",)) -> DataFrame:
    """Tn, fp, fn, tp per group (one aggregate)."""
    y, d = F.col("y"), F.col("pred")
    return scored.groupBy(*groups).agg(
        F.count_if((y == 0) & (d == 0)).alias("tn"),
        F.count_if((y == 0) & (d == 1)).alias("fp"),
        F.count_if((y == 1) & (d == 0)).alias("fn"),
        F.count_if((y == 1) & (d == 1)).alias("tp"))


def class_metrics(scored: DataFrame, groups=("model",)) -> DataFrame:
    """E2 + E3: accuracy, precision, recall, F1, specificity."""
    cm = confusion(scored, groups)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return cm.select(
        *groups,
        r6((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        r6(prec).alias("precision"),
        r6(rec).alias("recall"),
        r6(_div0(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        r6(_div0(tn, tn + fp)).alias("specificity"))


def score_steps(scored: DataFrame, groups=("model",)) -> DataFrame:
    """Per (group, distinct score): pos, neg, and inclusive running totals
    ``pos_cum``/``neg_cum`` from the highest score down, plus class totals,
    the point's number and the next point's ``pos_next``/``neg_next``."""
    g = list(groups)
    steps = scored.groupBy(*g, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"),
        F.sum((1 - F.col("y")).cast("long")).alias("neg")).withColumn("_one", F.lit(1))
    cum = prefix_sums(steps, "p", ["pos", "neg", "_one"], g, descending=True, next_cols=["pos", "neg"])
    return cum.drop("_one", "_one_total").withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg", "_one_cum": "point"})


def ranking_metrics(scored: DataFrame, groups=("model",)) -> DataFrame:
    """E4 + E5: exact ROC-AUC (ties averaged) and average precision.

    NULL when a group holds one class only.
    """
    s = score_steps(scored, groups)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("pos_cum") - F.col("pos")
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    agg = s.groupBy(*groups).agg(
        F.sum(neg * (above + pos / 2)).alias("_auc_num"),
        F.sum(pos * prec).alias("_ap_num"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(
        *groups,
        r6(F.when(both, F.col("_auc_num") / (F.col("n_pos").cast("double") * F.col("n_neg")))).alias("roc_auc"),
        r6(F.when(F.col("n_pos") > 0, F.col("_ap_num") / F.col("n_pos"))).alias("avg_precision"))


def log_loss(scored: DataFrame, groups=("model",), eps: float = C.PROB_CLIP) -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped to [eps, 1−eps]."""
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("y")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return scored.groupBy(*groups).agg(r6(F.avg(ll)).alias("log_loss_val"))


def merge_by_group(parts: list[DataFrame], groups) -> DataFrame:
    """Combine small per-group aggregates that have different columns: union
    them (missing columns NULL) and take each column's one non-NULL value."""
    g = list(groups)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in g]
    return out.groupBy(*g).agg(*[F.max(c).alias(c) for c in cols])


def test_metrics(scored: DataFrame, groups=("model",)) -> DataFrame:
    """The reference's per-model result row: seven metrics."""
    g = list(groups)
    return merge_by_group([class_metrics(scored, g).drop("specificity"),
                           ranking_metrics(scored, g), log_loss(scored, g)], g)


def roc_points(scored: DataFrame, groups=("model",)) -> DataFrame:
    """ROC points at each distinct threshold, collinear interior points
    dropped, with the (0, 0) start point (threshold NULL)."""
    g = list(groups)
    s = score_steps(scored, g)
    keep = ((F.col("point") == 1) | F.col("pos_next").isNull()
            | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
    pts = s.where(keep).select(
        *g, r6(F.col("neg_cum") / F.col("n_neg")).alias("fpr"),
        r6(F.col("pos_cum") / F.col("n_pos")).alias("tpr"), r6("p").alias("threshold"))
    start = s.select(*g).distinct().select(
        *g, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(start)


def pr_points(scored: DataFrame, groups=("model",)) -> DataFrame:
    """precision/recall at each distinct threshold down to the first that
    reaches full recall, plus the end point (precision 1, recall 0)."""
    g = list(groups)
    s = score_steps(scored, g)
    pts = s.where(F.col("pos_cum") - F.col("pos") < F.col("n_pos")).select(
        *g, r6(F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
        r6(F.col("pos_cum") / F.col("n_pos")).alias("recall"), r6("p").alias("threshold"))
    end = s.select(*g).distinct().select(
        *g, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(end)


def fold_scores(scored: DataFrame) -> DataFrame:
    """C9 read-out: (model, fold, metric, value) for the five CV metrics."""
    g = ["model", "fold"]
    wide = merge_by_group([class_metrics(scored, g), ranking_metrics(scored, g)], g)
    return wide.unpivot(g, METRICS, "metric", "value")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean ± population sd of each metric across folds."""
    return folds.groupBy("model", "metric").agg(
        r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


def cv_box(folds: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Distribution of one metric across folds, per model."""
    return box_stats(folds.where(F.col("metric") == metric), "value", "model")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Per-model metrics rounded to 4 places, best AUC first."""
    cols = ["roc_auc", "avg_precision", "f1", "precision", "recall", "accuracy", "log_loss_val"]
    return (metrics.select(model_label("model").alias("Model"),
                           *[round_half_even(c, 4).alias(c) for c in cols])
                   .orderBy(F.desc("roc_auc"), F.asc("Model")))


def best_model(metrics: DataFrame) -> DataFrame:
    """Arg-max of ROC-AUC (ties: model name ascending)."""
    return (metrics.select(F.col("model").alias("best_model"), F.col("roc_auc").alias("best_auc"))
                   .orderBy(F.desc("best_auc"), F.asc("best_model")).limit(1))


def metric_bars(metrics: DataFrame) -> DataFrame:
    """(Model, metric, value) for the AUC and F1 bar charts, ascending."""
    return (metrics.select(model_label("model").alias("Model"), "roc_auc", "f1")
                   .unpivot(["Model"], ["roc_auc", "f1"], "metric", "value")
                   .orderBy("metric", "value", "Model"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch with the lowest validation loss (first on ties) and its AUC."""
    return history.groupBy("model").agg(
        F.min_by(F.struct("epoch", "val_auc"), F.struct("val_loss", "epoch")).alias("b")
    ).select("model", F.col("b.epoch").alias("best_epoch"), F.col("b.val_auc").alias("best_val_auc"))


def early_stop_epoch(history: DataFrame, patience: int = C.MLP_PATIENCE) -> DataFrame:
    """First epoch after which ``patience`` epochs brought no new minimum
    of the validation loss (the last epoch if that never happens).

    The window is per model over its epoch history (one row per epoch).
    """
    w = Window.partitionBy("model").orderBy("epoch")
    prev_min = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = history.withColumn("improved", prev_min.isNull() | (F.col("val_loss") < prev_min))
    last_improve = F.max(F.when(F.col("improved"), F.col("epoch"))).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stale = flagged.withColumn("_since", F.col("epoch") - last_improve)
    return stale.groupBy("model").agg(
        F.coalesce(F.min(F.when(F.col("_since") >= patience, F.col("epoch"))), F.max("epoch"))
        .alias("stop_epoch"))
