"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED = "8000"                # bytes of bytecode; the JVM never compiles a longer method


def compiled_methods(spark: SparkSession) -> None:
    """Let wide rows run in compiled code.

    Spark puts a stage's columns and features into one generated method; over
    8,000 bytes the JVM interprets it for ever, some 70 µs a row here. Below this
    limit Spark drops the fused method for small ones, with the same results.
    A caller's own limit is kept.
    """
    if spark.conf.get(METHOD_LIMIT) == "65535":         # Spark's default: the longest method there can be
        spark.conf.set(METHOD_LIMIT, COMPILED)


def get_spark(master: str | None = None, app: str = "vigilo",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session configured the way the library expects.

    Query-semantics settings are fixed everywhere (UTC session time zone,
    adaptive execution with skew-join splitting, Arrow transfer, no web UI).
    Master, shuffle width and driver memory are set only where the caller
    passes a master (tests, bench); otherwise they are what the job was
    submitted with, and AQE sizes shuffle partitions from the data.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(METHOD_LIMIT, COMPILED)
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("VIGILO_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system; it is
    read, never overridden. Only a session whose executors are the driver's
    own process (``local[…]``, as in tests) gets a fresh folder on this
    machine; any other session without a shared folder is refused, because
    each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        conf_dir = tempfile.mkdtemp(prefix="vigilo-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigilo-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name in the application's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything the application wrote by :func:`scratch_path`.

    Call it when no DataFrame read from there is needed any more.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        fs.delete(root, True)
