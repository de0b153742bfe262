"""Metamorphic checks: results do not depend on how the input
is partitioned or ordered, nor on the block count of the distributed helpers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigilo.operators import evaluate as E
from vigilo.operators.distributed import exact_percentiles, prefix_sums
from vigilo.operators.explore import rate_table


def _frame(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "v": rng.integers(0, 50, n) / 4.0,
                        "model": "m", "y": rng.integers(0, 2, n), "p": rng.integers(0, 40, n) / 40.0})
    pdf["pred"] = (pdf.p >= 0.5).astype(int)
    return spark.createDataFrame(pdf)


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_percentiles_ignore_partitioning_and_blocks(spark):
    df = _frame(spark)
    a = _rows(exact_percentiles(df, "v", [0.1, 0.5, 0.9], ["g"]), "g", "p")
    b = _rows(exact_percentiles(df.repartition(7).orderBy(F.rand(1)), "v", [0.1, 0.5, 0.9], ["g"]), "g", "p")
    assert a == b


def test_prefix_sums_ignore_block_count(spark):
    df = _frame(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    a = _rows(prefix_sums(df, "v", ["c"], ["g"], n_blocks=3), "g", "v")
    b = _rows(prefix_sums(df.repartition(5), "v", ["c"], ["g"], n_blocks=41), "g", "v")
    assert a == b


def test_metrics_ignore_row_order(spark):
    df = _frame(spark)
    a = _rows(E.test_metrics(df), "model")
    b = _rows(E.test_metrics(df.repartition(9).orderBy(F.rand(7))), "model")
    assert a == b


def test_rate_table_ignores_partitioning(spark):
    df = _frame(spark).withColumnRenamed("y", "DIED")
    a = _rows(rate_table(df, "g", 10), "g")
    b = _rows(rate_table(df.repartition(11), "g", 10), "g")
    assert a == b
