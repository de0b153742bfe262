"""Exact sample, split and fold sizes; invariance under repartitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators.distributed import hash_cuts, md5_hash, up_to_cut
from vigilo.operators.sampling import bounded_rows, explain_sample, stratified_sample, stratified_split, validation_holdout
from vigilo.plans.materialize import materialized_merged
from vigilo.plans.sample import assemble_stand_in


def test_exact_sample_size(spark, sf):
    merged = assemble_stand_in(spark, sf).merged
    pos = merged.where(F.col(C.LABEL) == 1).count()
    neg = merged.count() - pos
    target = pos + 100
    s = stratified_sample(merged, target=target)
    assert s.where(F.col(C.LABEL) == 1).count() == pos
    assert s.where(F.col(C.LABEL) == 0).count() == min(target - pos, neg)
    assert stratified_sample(merged, target=pos - 5).where(F.col(C.LABEL) == 0).count() == 0   # n0 clamped


def test_sample_is_invariant_to_partitioning(spark, sf):
    merged = assemble_stand_in(spark, sf).merged
    a = {r[0] for r in stratified_sample(merged, target=300).select(C.KEY).collect()}
    b = {r[0] for r in stratified_sample(merged.repartition(7), target=300).select(C.KEY).collect()}
    assert a == b


def test_split_and_fold_sizes(spark, sf):
    merged = assemble_stand_in(spark, sf).merged
    s = stratified_split(merged).groupBy(C.LABEL, "split", "fold").count().collect()
    for label in (0, 1):
        rows = [r for r in s if r[C.LABEL] == label]
        n = sum(r["count"] for r in rows)
        test = sum(r["count"] for r in rows if r["split"] == "test")
        assert test == int(n * C.TEST_SHARE + 0.5)
        folds = [r["count"] for r in rows if r["split"] == "train"]
        assert len(folds) == C.CV_FOLDS and max(folds) - min(folds) <= 1


def _rank_form(df, salt, strata, key=C.KEY):
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", md5_hash(key, C.SEED, salt)).withColumn("_r", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*strata)))


def _keys(df):
    return {r[0] for r in df.select(C.KEY).collect()}


def test_cuts_equal_the_plain_rank(spark):
    df = spark.range(0, 4000).select(F.col("id").alias(C.KEY), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2)
                                     .cast("int").alias(C.LABEL), F.rand(1).alias("wide"))
    hashed = df.withColumn("_h", md5_hash(C.KEY, C.SEED))
    for keep in (0, 1, 57, 1714, 5000):
        cuts = hash_cuts(hashed, "_h", lambda n, _: F.least(n, F.lit(keep)), C.KEY, [C.LABEL])
        got = hashed.where(up_to_cut(cuts, "_h", C.KEY, [C.LABEL]))
        assert _keys(got) == _keys(_rank_form(df, "", [C.LABEL]).where(F.col("_r") <= keep))
    held = validation_holdout(df)
    assert _keys(held.where("is_val")) == _keys(_rank_form(df, "val", []).where("_r <= 800"))
    bound = bounded_rows(df.where(f"{C.LABEL} IS NOT NULL"), 1000)
    ranked = _rank_form(df.where(f"{C.LABEL} IS NOT NULL"), "fit", [C.LABEL])
    assert _keys(bound) == _keys(ranked.where(F.col("_r") <= F.ceil(F.col("_n") * F.lit(1000 / 3428))))
    shown = explain_sample(df, n=25)
    assert {(r[C.KEY], r["row_id"]) for r in shown.collect()} == {
        (r[C.KEY], r["_r"] - 1) for r in _rank_form(df, "explain", []).where("_r <= 25").collect()}


def test_samples_move_no_rows(spark, sf):
    merged = materialized_merged(spark, sf)
    for df in (stratified_sample(merged, target=400), validation_holdout(merged), bounded_rows(merged, 300)):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = explain_sample(merged)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange hashpartitioning" not in plan


def test_empty_tables(spark, sf):
    none = materialized_merged(spark, sf).limit(0)
    assert stratified_sample(none).count() == validation_holdout(none).count() == explain_sample(none).count() == 0
