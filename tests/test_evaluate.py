"""Metrics against brute force (ties, single class, curve points)."""

import itertools
import math

import numpy as np
import pandas as pd

from vigilo.operators import evaluate as E


def scored(spark, y, p):
    pdf = pd.DataFrame({"model": "m", "y": y, "p": p})
    pdf["pred"] = (pdf.p >= 0.5).astype(int)
    return spark.createDataFrame(pdf)


def brute_auc(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def brute_ap(y, p):
    P = sum(y)
    total, prev_r = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for s, v in zip(p, y) if s >= t and v == 1)
        fp = sum(1 for s, v in zip(p, y) if s >= t and v == 0)
        r = tp / P
        total += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return total


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400).tolist()
    p = (rng.integers(0, 20, 400) / 20).tolist()          # many ties
    r = E.ranking_metrics(scored(spark, y, p)).first()
    assert math.isclose(r["roc_auc"], round(brute_auc(y, p), 6), abs_tol=1e-6)
    assert math.isclose(r["avg_precision"], round(brute_ap(y, p), 6), abs_tol=1e-6)


def test_single_class_auc_is_null(spark):
    r = E.ranking_metrics(scored(spark, [1, 1, 1], [0.2, 0.5, 0.9])).first()
    assert r["roc_auc"] is None


def test_confusion_and_zero_division(spark):
    r = E.class_metrics(scored(spark, [0, 0, 1], [0.1, 0.2, 0.3])).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert math.isclose(r["accuracy"], round(2 / 3, 6))


def roc_reference(y, p):
    """sklearn-style roc_curve(drop_intermediate=True), written out."""
    th = sorted(set(p), reverse=True)
    fps = [sum(1 for s, v in zip(p, y) if s >= t and v == 0) for t in th]
    tps = [sum(1 for s, v in zip(p, y) if s >= t and v == 1) for t in th]
    keep = [0] + [i for i in range(1, len(th) - 1)
                  if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0 or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0] \
        + [len(th) - 1]
    P, N = sum(y), len(y) - sum(y)
    return sorted([(0.0, 0.0)] + [(round(fps[i] / N, 6), round(tps[i] / P, 6)) for i in sorted(set(keep))])


def test_roc_points_drop_collinear(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300).tolist()
    p = (rng.integers(0, 30, 300) / 30).tolist()
    got = sorted((r["fpr"], r["tpr"]) for r in E.roc_points(scored(spark, y, p)).collect())
    assert got == roc_reference(y, p)


def test_pr_points_end_point_and_full_recall(spark):
    y = [1, 0, 1, 0, 0, 1]
    p = [0.9, 0.8, 0.7, 0.6, 0.2, 0.3]
    got = sorted((r["precision"], r["recall"]) for r in E.pr_points(scored(spark, y, p)).collect())
    # thresholds .9 .8 .7 .6 .3 (recall reaches 1 at .3; .2 is cut) + (1, 0)
    want = sorted([(1.0, round(1 / 3, 6)), (0.5, round(1 / 3, 6)), (round(2 / 3, 6), round(2 / 3, 6)),
                   (0.5, round(2 / 3, 6)), (0.6, 1.0), (1.0, 0.0)])
    assert got == want


def test_early_stop_and_best_epoch(spark):
    losses = [1.0, 0.8, 0.7, 0.71, 0.72, 0.69, 0.75, 0.76, 0.77]
    hist = spark.createDataFrame([("m", i + 1, v, 0.5 + i / 100) for i, v in enumerate(losses)],
                                 "model string, epoch int, val_loss double, val_auc double")
    assert E.best_epoch(hist).first()["best_epoch"] == 6
    assert E.early_stop_epoch(hist, patience=3).first()["stop_epoch"] == 9
    assert E.early_stop_epoch(hist, patience=2).first()["stop_epoch"] == 5
