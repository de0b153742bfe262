"""Recall and exactness against brute force."""

import numpy as np
from pyspark.sql import functions as F

from vigilo.llm import ann as A

DDL = "vec_id bigint, embedding array<float>"


def brute(ids, x, queries, k):
    """Nearest distinct ids by cosine, ties to the smaller id."""
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        score = (x[q] * x).sum(axis=1) / (norm[q] * norm)
        best = {}
        for i, s in zip(ids, score):
            if i != ids[q]:
                best[i] = max(s, best.get(i, -2))
        out[ids[q]] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_of_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(vectors.select("vec_id", "embedding").collect())
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    settings = A.Settings(rows_per_partition=150, block_rows=64, block_queries=8)
    got = by_query(A.nearest(vectors, F.col("vec_id") % 50 == 0, 5, settings).collect())
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 50 == 0], 5)
    assert set(got) == set(want)
    true = {(q, i) for q, near in want.items() for i, _ in near}
    assert len(true & {(q, i) for q, near in got.items() for i, _ in near}) >= 0.9 * len(true)
    for q, near in got.items():
        assert len(near) == 5
        for i, s in near:
            a, b = x[ids.index(q)], x[ids.index(i)]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_one_partition_is_exact_with_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (120, 4)).astype(float)  # many equal directions
    x[(x == 0).all(axis=1)] = 1
    ids = list(range(110)) + list(range(10))  # ten ids twice, with other vectors
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], DDL)
    got = by_query(A.nearest(vectors, F.col("vec_id") >= 100, 5).collect())
    want = brute(ids, x, [i for i, v in enumerate(ids) if v >= 100], 5)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}


def test_unusable_vectors_take_no_part(spark):
    good = [(i, [1.0, float(i), 0.5]) for i in range(1, 4)]
    bad = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]),
           (54, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (55, []), (56, [1.0, 2.0])]
    vectors = spark.createDataFrame(good + bad, DDL).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    got = A.nearest(vectors, F.lit(True), 5).collect()
    assert {r.query_id for r in got} == {r.vec_id for r in got} == {1, 2, 3}
    assert len(got) == 6  # all candidates, if fewer
    assert A.nearest(spark.createDataFrame(bad[:1], DDL), F.lit(True)).count() == 0
    assert A.nearest(spark.createDataFrame([], DDL), F.lit(True)).count() == 0
    assert A.nearest(vectors, F.lit(None).cast("boolean")).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 4
    x = A.unit(np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in centres]))
    graph = A.neighbour_graph(x, 5)
    part = A.balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.05 * 100 + 1
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_a_frequent_vector_is_dealt_over_blocks(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(30)]
    settings = A.Settings(block_rows=50, block_queries=16)
    got = by_query(A.nearest(spark.createDataFrame(rows, DDL), F.col("vec_id") % 50 == 0, 5, settings).collect())
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[100]] == [0, 1, 2, 3, 4]


def test_five_are_found_where_partitions_hold_fewer(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[:, 0] = np.where(np.arange(60) < 57, 1, -1)  # three rows in a partition of their own

    by_sign = A.Router.__new__(A.Router)
    by_sign.scale, by_sign.p = 1.0, [np.array([[1.0, -1], [0, 0], [0, 0], [0, 0]]), np.zeros(2), np.eye(2), np.zeros(2)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DDL)
    monkeypatch.setattr(A, "learn", lambda *args: (by_sign, 2, 1))
    got = by_query(A.nearest(vectors, F.col("vec_id") % 29 == 0, 5).collect())
    every = brute(list(range(60)), x, [0, 29, 58], 5)
    own = brute(list(range(57)), x[:57], [0, 29], 5)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {
        q: [i for i, _ in n] for q, n in {**own, 58: every[58]}.items()}
