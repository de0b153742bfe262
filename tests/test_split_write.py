"""The split table's write: what it sets for the session, and the order of its rows."""

import pytest
from pyspark.sql import functions as F

from vigilo.plans.materialize import SCAN_BYTES, settings, write_by

SCAN, WRITERS = "spark.sql.files.maxPartitionBytes", "spark.sql.maxConcurrentOutputFileWriters"


def test_rows_keep_their_order_and_a_task_reads_few(spark, tmp_path, monkeypatch):
    from vigilo.plans import materialize
    spark.range(200_000).coalesce(1).write.option("parquet.block.size", 100_000).option("compression", "none").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(materialize, "SCAN_BYTES", 200_000)
    before = spark.conf.get(SCAN), spark.conf.get(WRITERS)
    df = spark.read.parquet(f"{tmp_path}/in").select(
        "id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.spark_partition_id().alias("task"))
    write_by(df, "split", f"{tmp_path}/out", 2)
    assert (spark.conf.get(SCAN), spark.conf.get(WRITERS)) == before
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("task").distinct().count() > 1
    assert sorted(r["id"] for r in out.select("id").collect()) == list(range(200_000))
    assert out.where((F.col("split") == "test") != (F.col("id") % 3 == 0)).isEmpty()
    ordered = spark.range(50).coalesce(1).select("id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    write_by(ordered, "split", f"{tmp_path}/t", 2)
    for split, rest in (("test", {0}), ("train", {1, 2})):
        assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/t/split={split}").collect()] == [k for k in range(50) if k % 3 in rest]


def test_settings_come_back_after_an_error_and_a_smaller_scan_is_kept(spark, tmp_path):
    before = spark.conf.get(SCAN), spark.conf.get(WRITERS)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"), F.lit("a").alias("split"))
    with pytest.raises(Exception, match="no"):
        write_by(bad, "split", f"{tmp_path}/bad", 2)
    assert (spark.conf.get(SCAN), spark.conf.get(WRITERS)) == before
    seen = []

    class Rows:
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get(SCAN))
            raise KeyError

    for own, there in (("1m", f"{1 << 20}b"), ("128m", f"{SCAN_BYTES}b")):
        with settings(spark, {SCAN: own}), pytest.raises(KeyError):
            write_by(Rows(), "split", "", 2)
        assert seen.pop() == there
