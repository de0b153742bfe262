"""Counts of a history are packed, added in parts, and give the AUC of the rows themselves."""

import numpy as np
import pytest

from vigilo.plans import network as N


def test_counts_come_back_as_packed():
    for score, p, q in [([], [], []), ([0], [3], [0]), ([5, 300, 70_000, 1_000_000], [1, 0, 260, 70_000], [0, 5, 1, 2])]:
        got = N.unsqueezed(N.squeezed(*(np.array(c, dtype=np.int64) for c in (score, p, q))))
        assert [c.tolist() for c in got] == [score, p, q]


def test_packed_counts_take_about_a_byte_a_row():
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=100_000), (rng.random(100_000) < 0.2).astype(float)
    counts = N.score_counts(z, y)
    assert len(counts) < 1.5 * len(z)
    score, p, q = N.unsqueezed(counts)
    assert p.sum() == y.sum() and q.sum() == len(y) - y.sum() and (np.diff(score) > 0).all()


def test_history_of_several_tasks_equals_the_rows(spark):
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=3_000), (rng.random(3_000) < 0.3).astype(float)
    rows = []
    for epoch, shift in ((1, 0.0), (2, 0.8)):
        for is_val, part in ((False, slice(0, 2_000)), (True, slice(2_000, 3_000))):
            at, of = z[part] + shift * y[part], y[part]
            rows += [(epoch, is_val, *N.score_sums(at[k::7], of[k::7]), bytearray(N.score_counts(at[k::7], of[k::7]))) for k in range(7)]
    got = {r["epoch"]: r for r in N.history_of(spark.createDataFrame(rows, N.SCORED).repartition(5)).collect()}
    for epoch, shift in ((1, 0.0), (2, 0.8)):
        for name, part in (("train", slice(0, 2_000)), ("val", slice(2_000, 3_000))):
            s, of = np.rint(N.sigmoid(z[part] + shift * y[part]) * N.SCORE_STEPS), y[part]
            wins = (s[of == 1][:, None] > s[of == 0]).sum() + (s[of == 1][:, None] == s[of == 0]).sum() / 2
            assert got[epoch][f"{name}_auc"] == pytest.approx(wins / ((of == 1).sum() * (of == 0).sum()), rel=1e-12)


def test_a_set_of_one_class_has_no_auc(spark):
    z = np.array([0.1, 0.2])
    rows = [(1, v, *N.score_sums(z, np.zeros(2)), bytearray(N.score_counts(z, np.zeros(2)))) for v in (False, True)]
    assert N.history_of(spark.createDataFrame(rows, N.SCORED)).select("train_auc", "val_auc").first() == (None, None)
