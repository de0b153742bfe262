"""Hard negatives: equal to brute force; the index and its bounds lose no pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.llm import hard_negatives as H

DDL = "vec_id bigint, embedding array<float>, label int"
SMALL = H.Settings(block_rows=40, block_anchors=3, step=2, sample=16)


def by_hand(rows, s):
    """(anchor, positive, rank, negative, positive score, negative score), sorted."""
    good = [(i, lb, [math.floor(x * s.scale) for x in v]) for i, v, lb in rows
            if lb is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = 2 ** 63

    def key(x):
        return (-x[0], last if x[1] is None else x[1])

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    anchors = {}
    for i, lb, v in good:
        if i is not None and i % 10 == 0:
            anchors[i] = min(anchors.get(i, (lb, v)), (lb, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(dot(v, u), i, lb) for i, lb, u in good if i != a]
        positives = sorted([(sc, i) for sc, i, lb in scored if lb == label], key=key)[:s.positives]
        others = sorted([(sc, i) for sc, i, lb in scored if lb != label], key=key)
        for p, pid in positives:
            window = [(n, nid) for n, nid in others if s.low * p <= 100 * n <= 100 * p][:s.negatives]
            out += [(a, pid, r + 1, nid, p, n) for r, (n, nid) in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, rows, s=SMALL, ddl=DDL):
    df = spark.createDataFrame(rows, ddl)
    return sorted([tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), s).collect()], key=repr)


def made(n, dims, labels, seed, spread=1.0, centres=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 2
    x = (middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(k, [float(v) for v in x[k]], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("rows", [
    made(230, 7, 3, 1), made(150, 4, 2, 2, spread=0.05, centres=3), made(60, 9, 30, 3), made(90, 3, 1, 4),
    made(120, 5, 4, 5, spread=3.0)], ids=["plain", "clusters", "rare labels", "one label", "wide"])
def test_equals_brute_force(spark, rows):
    assert mined(spark, rows) == by_hand(rows, SMALL)


def test_ties_repeats_and_missing_values(spark):
    base = [(k, [float(k % 3), 1.0, -1.0], k % 2) for k in range(50)]                       # many equal scores
    rows = base + base[:12] + [(None, [2.0, 1.0, 0.0], 0), (None, [2.0, 1.0, 0.0], 1), (60, None, 0), (61, [1.0, None, 0.0], 1),
                               (62, [1.0, float("nan"), 0.0], 1), (63, [1.0, float("inf"), 0.0], 0), (70, [1.0, 1.0, 1.0], None),
                               (80, [], 0), (90, [1.0], 1), (100, [-1.0, -1.0, 5.0, 4.0], 0), (110, [0.0, 0.0, 0.0], 1)]
    plain = by_hand(rows, SMALL)
    assert mined(spark, rows) == plain and plain


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(v)) for v in rng.integers(-2 ** 18, 2 ** 18, size=6)], int(k % 2)) for k in range(80)]
    assert mined(spark, rows) == by_hand(rows, SMALL)


def test_no_rows_no_anchors_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(k, [1.0, 2.0], 0) for k in range(1, 9)]) == []      # no anchor
    assert mined(spark, [(10, [1.0, 2.0], 0)]) == []                          # no other row
    rows = made(40, 3, 2, 7)
    wide = [(*r, 1.5, 3, "x", True, 0, 1) for r in rows]
    ddl = DDL + ", score double, window int, vector string, _anchor boolean, row_block int, rank int"
    assert mined(spark, wide, ddl=ddl) == by_hand(rows, SMALL)


def test_blocks_do_not_matter(spark):
    rows = made(200, 6, 3, 8)
    one = mined(spark, rows, H.Settings(block_rows=10_000, block_anchors=10_000))
    assert one == mined(spark, rows, H.Settings(block_rows=17, block_anchors=2, step=1, sample=4, few=0.9))
    assert one == by_hand(rows, H.Settings())


def test_join_finds_every_pair_above_its_threshold_and_leaves_dimensions_out():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(400, 24)) * np.geomspace(300, 1, 24)).astype(np.int64)    # weight in few dimensions
    q = x[:30] + rng.integers(-2, 3, size=(30, 24))
    s = H.Settings(step=4, few=0.0)
    qd, xd = H.prepared(q, x)
    index, norms = H.Index(xd, s), H.suffix_norms(qd, s.step)
    exact = q @ x.T
    for share in (0.5, 0.9, 0.99, 1.1):
        least = np.quantile(exact, min(share, 1.0), axis=1) * max(1.0, share)
        i, j, score = index.join(qd, norms, least)
        wanted = {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None]))}
        assert set(zip(i.tolist(), j.tolist())) == {(int(a), int(b)) for a, b in wanted}
        assert (score == exact[i, j]).all()
    lead = (index.norms * norms.max(axis=0) >= least.min()).sum(axis=1)
    assert (lead < norms.shape[1] - 1).any()      # some dimensions are covered by the bound


def test_query_shape(spark):
    from vigilo.llm.queries import QUERIES
    df = QUERIES["op11_l2ap_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                               "positive_score": "bigint", "negative_score": "bigint"}
    rows = df.collect()
    assert rows and all(80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score for r in rows)
