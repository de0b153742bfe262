"""Materialise the merged, split table once per input, in the shared folder.

Views and metrics all start from the split table. Computing it runs the
whole ETL; several operators also run small parameter jobs (quantile
bounds, block offsets) first, and each job would replay that lineage. The
table is therefore written once as Parquet under ``spark.checkpoint.dir``
(a shared file system on a cluster), partitioned by ``split``, and read
back: lineage is cut, the files survive executor loss, and every view gets
column pruning, pushed-down filters and partition pruning on train/test —
which an RDD checkpoint would not give.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.plans.sample import build_split
from vigilo.session import compiled_methods, scratch_path

SPLITS = 2                   # train and test
SCAN_BYTES = 16 << 20        # of Parquet read by a task, about a million lines: 0.2 GB as they are sorted

_LOCK = threading.Lock()
_CACHE: dict[tuple, DataFrame] = {}


def input_signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Identity of an input: its path with the length and time of every file
    and folder in it, listed by Hadoop, so any store that Spark reads will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return (sf_dir,)
    out = []
    for table in fs.listStatus(root):
        files = fs.listStatus(table.getPath()) if table.isDirectory() else [table]
        out += [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files]
    return (sf_dir, tuple(sorted(out)))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what runs inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_by(df: DataFrame, column: str, path: str, values: int) -> None:
    """``df`` as Parquet, a folder for each of a column's few ``values``, without spilling.

    A task keeps a file open for each value, so the wide rows are not sorted by
    it. The first vaccine of a report sorts the lines that a task has read, so
    that a task reads ``SCAN_BYTES`` at most.
    """
    spark = df.sparkSession
    scan = "spark.sql.files.maxPartitionBytes"
    read = min(SCAN_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(values), scan: f"{read}b"}):
        df.write.mode("overwrite").partitionBy(column).parquet(path)


def materialized_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split table (merged table + split + fold), written once per input."""
    compiled_methods(spark)                              # its rows are wide, and so are those of all that read it
    key = (spark.sparkContext.applicationId, input_signature(spark, sf_dir))
    with _LOCK:
        hit = _CACHE.get(key)
        if hit is None:
            path = scratch_path(spark, "split")
            write_by(build_split(spark, sf_dir), "split", path, SPLITS)
            hit = spark.read.parquet(path)
            _CACHE[key] = hit
    return hit


def materialized_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole merged table: the split table without its split columns."""
    return materialized_split(spark, sf_dir).drop("split", "fold")


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized_split(spark, sf_dir).where(F.col("split") == "test")
