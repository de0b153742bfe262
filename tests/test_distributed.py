"""The distributed helpers against plain single-machine answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilo.operators import distributed as D
from vigilo.operators.evaluate import roc_points
from vigilo.operators.distributed import exact_modes, exact_percentiles, hash_rank, md5_hash, prefix_sums
from vigilo.operators.explore import decile_rate, quantile_edges


def test_median_of_four(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 9]] + [(None,)], "v double")
    assert exact_percentiles(df, "v", [0.5]).first()["q"] == 3.0


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "v": rng.integers(0, 200, 3000) / 7.0})
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_percentiles(spark.createDataFrame(pdf), "v", probs, ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        want = np.percentile(part["v"].to_numpy(), [p * 100 for p in probs])
        have = got[got.g == g].sort_values("p")["q"].to_numpy()
        assert np.allclose(have, want, rtol=0, atol=1e-9)


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat([0, 1], 500), "k": np.tile(np.arange(500), 2).astype(float),
                        "x": rng.integers(0, 10, 1000)})
    out = prefix_sums(spark.createDataFrame(pdf), "k", ["x"], ["g"], descending=True, n_blocks=7).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.sort_values("k", ascending=False)["x"].cumsum().to_numpy()
        have = out[out.g == g].sort_values("k", ascending=False)["x_cum"].to_numpy()
        assert (have == want).all()


def test_hash_rank_equals_row_number(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("VAERS_ID"),
                                     F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("s"))
    h = df.withColumn("_h", md5_hash("VAERS_ID", 42))
    mine = hash_rank(h, "_h", ["s"], "VAERS_ID", 3).select("VAERS_ID", "_rank", "_n")
    plain = h.select("VAERS_ID", F.row_number().over(Window.partitionBy("s").orderBy("_h", "VAERS_ID")).alias("r"))
    j = mine.join(plain, "VAERS_ID")
    assert j.count() == 5000                      # NULL stratum kept
    assert j.where(F.col("_rank") != F.col("r")).count() == 0


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("2",), ("1",), ("2",), ("1",), ("3",)], "x string")
    assert exact_modes(df, ["x"]).first()["mode"] == "1"


def test_quantile_edges_duplicates_and_lowest(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in [0, 0, 0, 0, 0, 0, 1, 2, 3, 4]], "x double, DIED int")
    edges = quantile_edges(df, "x")
    assert edges == sorted(set(edges)) and edges[0] == 0.0 and edges[-1] == 4.0
    t = decile_rate(df, "x").toPandas()
    assert t["n"].sum() == 10                     # every value, the lowest included, in a bucket
    assert t.sort_values("bucket")["n"].iloc[0] == 6


@pytest.mark.parametrize("descending", [False, True])
def test_next_row_is_carried_across_blocks(spark, descending, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat(["a", None, "b"], 400), "k": np.concatenate([rng.permutation(1000)[:400] for _ in range(3)]).astype(float),
                        "x": rng.integers(0, 9, 1200)})
    pdf = pdf[(pdf.g != "b") | (pdf.k < 40)]                    # a group with rows in few blocks
    monkeypatch.setattr(D, "BLOCK_ROWS", 37)                    # so the number of blocks follows the rows
    df = spark.createDataFrame(pdf.where(pdf.notna(), None), "g string, k double, x long")
    out = prefix_sums(df, "k", ["x"], ["g"], descending=descending, next_cols=["x", "k"]).toPandas()
    assert len(out) == len(pdf)
    for g in ("a", "b", None):
        part = (pdf[pdf.g == g] if g else pdf[pdf.g.isna()]).sort_values("k", ascending=not descending)
        have = (out[out.g == g] if g else out[out.g.isna()]).sort_values("k", ascending=not descending)
        assert have["x_cum"].tolist() == part["x"].cumsum().tolist() and set(have["x_total"]) == {part["x"].sum()}
        assert have["k_next"].tolist()[:-1] == part["k"].tolist()[1:] and have["x_next"].tolist()[:-1] == part["x"].tolist()[1:]
        assert pd.isna(have["k_next"].iloc[-1])


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 50)
    df = spark.range(0, 1000).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("x"))
    out = D.block_index(df, "k", -(-1000 // D.BLOCK_ROWS))
    sizes = [r["count"] for r in out.groupBy("_blk").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * D.BLOCK_ROWS
    assert prefix_sums(df.limit(0), "k", ["x"]).count() == 0
    one = exact_percentiles(df.groupBy("k").agg(F.sum("x").alias("n")), "k", [0.5], count_col="n").first()["q"]
    assert one == 499.5


def test_roc_points_need_no_join_of_points(spark):
    rng = np.random.default_rng(8)
    scored = spark.createDataFrame(pd.DataFrame({"model": "m", "y": rng.integers(0, 2, 500), "p": rng.integers(0, 60, 500) / 60.0}))
    df = roc_points(scored)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
