"""Wide rows run in methods that the JVM compiles."""

from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.plans import features as FT
from vigilo.session import COMPILED, METHOD_LIMIT, compiled_methods


def wide_rows(spark):
    sym = [f"SYM_t{k}" for k in range(30)]
    rows = spark.range(40).select(
        F.col("id").alias(C.KEY), *[(F.col("id") * (k + 1) % 7).cast("double").alias(c) for k, c in enumerate(C.NUM_FEATURES)],
        *[(F.col("id") % (k + 2) == 0).cast("tinyint").alias(c) for k, c in enumerate(C.BIN_COLS + sym)],
        *[F.concat(F.lit("v"), (F.col("id") % (k + 2)).cast("string")).alias(c) for k, c in enumerate(C.CAT_FEATURES)])
    return FT.default_preparer(rows.columns).fit(rows).transform(rows).select(C.KEY, "features")


def test_vectors_are_the_same_within_the_limit(spark):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.set(METHOD_LIMIT, "65535")
        fused = {r[0]: r[1] for r in wide_rows(spark).collect()}
        compiled_methods(spark)
        assert spark.conf.get(METHOD_LIMIT) == COMPILED
        assert {r[0]: r[1] for r in wide_rows(spark).collect()} == fused
        spark.conf.set(METHOD_LIMIT, "7000")
        compiled_methods(spark)
        assert spark.conf.get(METHOD_LIMIT) == "7000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def test_the_split_table_brings_the_limit(spark, monkeypatch):
    from vigilo.plans import materialize
    before = spark.conf.get(METHOD_LIMIT)
    monkeypatch.setattr(materialize, "build_split", lambda *_: spark.range(4).select("id", (F.col("id") % 2).alias("split")))
    try:
        spark.conf.set(METHOD_LIMIT, "65535")
        materialize.materialized_split(spark, "/nowhere/compiled-rows")
        assert spark.conf.get(METHOD_LIMIT) == COMPILED
    finally:
        spark.conf.set(METHOD_LIMIT, before)
