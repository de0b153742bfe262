"""Rows of a node are dealt once; one task for a bounded fit; leaf values."""

import numpy as np

from vigilo import config as C
from vigilo.operators import explain as XP
from vigilo.plans import boosting as B


def test_rows_dealt_to_children_once():
    rng = np.random.default_rng(1)
    sizes = np.array([2, 7, 2, 40])
    bins = np.stack([rng.integers(0, s, 500) for s in sizes], axis=1).astype(np.uint8)
    y, w = rng.integers(0, 2, 500).astype(float), rng.random(500) + 0.5
    shard = B.begun({"group": 0, "shard": 0, "n": 500, "bins": bins.tobytes(), "y": y.tobytes(), "w": w.tobytes()}, {0: -0.4}, {0: 1})
    tree = {"left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "feature": np.array([3, 0, 1, 0, 0]),
            "bin": np.array([20, 0, 3, 0, 0])}
    leaf = np.where(bins[:, 3] <= 20, 1, np.where(bins[:, 1] <= 3, 3, 4))
    assert (B.descend(shard.columns, tree) == leaf).all()
    held = B.Held([shard])
    root = {c: x[:1] * 0 - (c in ("left", "right")) for c, x in tree.items()}
    held.sums({0: (0, root, [0])}, {0: sizes}, {0: 0})
    known = held.known[0, 0][1]
    first = {c: x[:3].copy() for c, x in tree.items()}
    first["left"][2] = first["right"][2] = -1
    held.sums({0: (0, first, [1])}, {0: sizes}, {0: 0})
    one = known[1]
    got = held.sums({0: (0, tree, [3, 4])}, {0: sizes}, {0: 0})[0]
    assert known[1] is one and sorted(known) == [0, 1, 2, 3, 4]
    slot = np.where(leaf == 3, 0, np.where(leaf == 4, 1, -1))
    assert (got == B.histograms(bins, sizes, slot, 2, *B.gradients(shard, 0))).all()


def test_a_bounded_fit_needs_no_job_for_each_level():
    assert B.SHARD_ROWS >= 1.1 * C.SAMPLE_TARGET


def test_leaf_values_of_rows_dealt_node_by_node():
    tree = {"left": np.array([1, 3, -1, -1, -1]), "right": np.array([2, 4, -1, -1, -1]), "feature": np.array([1, 0, -1, -1, -1]),
            "thr": np.array([0.5, 2.0, 0, 0, 0]), "value": np.array([0, 0, 1.0, 2.0, 3.0])}
    x = np.array([[2.0, 0.5], [2.1, 0.5], [0.0, 0.6], [np.nan, 0.0], [0.0, np.nan]])
    assert XP.leaf_values(x, tree).tolist() == [2.0, 3.0, 1.0, 3.0, 1.0] and len(XP.leaf_values(x[:0], tree)) == 0
