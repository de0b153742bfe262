"""Read-outs of model tables, checked on tables derived from the given data.

A fitted model's coefficients, grid or history cannot be recomputed in SQL.
The operators that read such tables can: here they run on tables of the same
shape whose values are rates of the merged reports, on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo import config as C
from vigilo import oracle as O
from pyspark.ml.functions import vector_to_array

from vigilo.catalog import (
    _BIN_D, ATTR_SQL, CAT_FILLED, CAT_LIST, KEPT_SQL, MED_SQL, NUM_LIST, STD_SQL, TRAIN, register)
from vigilo.functions.clean import r6, round_half_even
from vigilo.operators import evaluate as E
from vigilo.operators import explain as XP
from vigilo.operators import explore as X
from vigilo.plans import models as M
from vigilo.plans import tuning as TU
from vigilo.plans import workflow as WF
from vigilo.plans.formula import formula_inputs, formula_weights
from vigilo.plans.materialize import materialized_merged

# ---------------------------------------------------------------- coefficients

COEFS_SQL = f"""coefs AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank FROM (
    SELECT SEX AS model, STATE AS feature, {O.rnd('avg(DIED)', 1)} - CAST(0.2 AS DOUBLE) AS value
    FROM sample_base WHERE SEX IS NOT NULL AND STATE IS NOT NULL GROUP BY SEX, STATE))"""


def _coefs(spark, sf):
    """(model, feature, value, rank): a rate's distance from 0.2, per sex and state."""
    t = materialized_merged(spark, sf).where("SEX IS NOT NULL AND STATE IS NOT NULL")
    t = t.groupBy(F.col("SEX").alias("model"), F.col("STATE").alias("feature")).agg(
        (round_half_even(F.avg(C.LABEL), 1) - F.lit(0.2)).alias("value"))
    w = Window.partitionBy("model").orderBy(F.desc(F.abs("value")), "feature")   # ≤ states per sex
    return t.withColumn("rank", F.row_number().over(w))


@register("zero_coef_share_derived", O.base(COEFS_SQL) + f"""
 SELECT model, count(*) FILTER (WHERE abs(value) < {C.ZERO_COEF_EPS}) AS n_zero, count(*) AS n_features,
        {O.rnd(f'count(*) FILTER (WHERE abs(value) < {C.ZERO_COEF_EPS}) / count(*) * 100', 1)} AS zero_pct
 FROM coefs GROUP BY model""")
def q_zero_coef_share_derived(spark, sf):
    return X.zero_coef_share(_coefs(spark, sf))


@register("top_coefficients_derived", O.base(COEFS_SQL) + f" SELECT * FROM coefs WHERE rank <= {C.TOP_FEATURES}")
def q_top_coefficients_derived(spark, sf):
    return M.top_by_rank(_coefs(spark, sf))


# ---------------------------------------------------------------- history

HISTORY_SQL = f"""hist AS (
  SELECT V_ADMINBY AS model, (RECV_YEAR - 1990) * 12 + CAST(right(RECV_YEAR_MONTH, 2) AS INTEGER) AS epoch,
         {O.r6('avg(DIED)')} AS val_loss, {O.r6('avg(HOSPITAL)')} AS val_auc
  FROM sample_base WHERE V_ADMINBY IS NOT NULL AND RECV_YEAR_MONTH IS NOT NULL GROUP BY 1, 2)"""


def _history(spark, sf):
    """(model, epoch, val_loss, val_auc): monthly rates per place of vaccination."""
    t = materialized_merged(spark, sf).where("V_ADMINBY IS NOT NULL AND RECV_YEAR_MONTH IS NOT NULL")
    epoch = (F.col("RECV_YEAR") - 1990) * 12 + F.substring("RECV_YEAR_MONTH", 6, 2).cast("int")
    return t.groupBy(F.col("V_ADMINBY").alias("model"), epoch.alias("epoch")).agg(
        r6(F.avg(C.LABEL)).alias("val_loss"), r6(F.avg("HOSPITAL")).alias("val_auc"))


@register("best_epoch_derived", O.base(HISTORY_SQL) + """
 SELECT model, epoch AS best_epoch, val_auc AS best_val_auc FROM (
   SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_loss, epoch) AS r FROM hist) WHERE r = 1""")
def q_best_epoch_derived(spark, sf):
    return E.best_epoch(_history(spark, sf))


@register("early_stop_epoch_derived", O.base(HISTORY_SQL, """imp AS (
   SELECT *, min(val_loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hist)""",
   """since AS (SELECT *, epoch - max(CASE WHEN m IS NULL OR val_loss < m THEN epoch END)
              OVER (PARTITION BY model ORDER BY epoch) AS stale FROM imp)""") + f"""
 SELECT model, coalesce(min(CASE WHEN stale >= {C.MLP_PATIENCE} THEN epoch END), max(epoch)) AS stop_epoch FROM since GROUP BY model""")
def q_early_stop_epoch_derived(spark, sf):
    return E.early_stop_epoch(_history(spark, sf))


# ---------------------------------------------------------------- grid

GRID_SQL = f"""grid AS (
  SELECT 'cart' AS model, CAST(VAX_DOSE_SERIES AS INTEGER) AS max_depth, RECV_YEAR AS min_samples_leaf,
         {O.r6('avg(DIED)')} AS mean_f1, {O.r6('stddev_pop(DIED)')} AS std_f1
  FROM sample_base WHERE TRY_CAST(VAX_DOSE_SERIES AS INTEGER) IS NOT NULL AND RECV_YEAR IS NOT NULL GROUP BY ALL)""", \
    """ranked AS (SELECT *, row_number() OVER (ORDER BY mean_f1 DESC,
       '{max_depth -> ' || max_depth || ', min_samples_leaf -> ' || min_samples_leaf || '}') AS r FROM grid)"""


def _grid(spark, sf):
    """(model, params, mean_f1, std_f1, n_splits): rates by dose and year."""
    dose = F.col("VAX_DOSE_SERIES").try_cast("int")
    t = materialized_merged(spark, sf).where(dose.isNotNull() & F.col("RECV_YEAR").isNotNull())
    t = t.groupBy(dose.alias("d"), F.col("RECV_YEAR").alias("y")).agg(
        r6(F.avg(C.LABEL)).alias("mean_f1"), r6(F.stddev_pop(C.LABEL)).alias("std_f1"))
    params = F.create_map(F.lit("max_depth"), F.col("d").cast("string"), F.lit("min_samples_leaf"), F.col("y").cast("string"))
    return t.select(F.lit("cart").alias("model"), params.alias("params"), "mean_f1", "std_f1", F.lit(5).alias("n_splits"))


@register("grid_top5_derived", O.base(*GRID_SQL) + f""" SELECT model, max_depth, min_samples_leaf,
 {O.rnd('mean_f1', 4)} AS mean_f1, {O.rnd('std_f1', 4)} AS std_f1 FROM ranked WHERE r <= 5""")
def q_grid_top5_derived(spark, sf):
    return TU.grid_top5(_grid(spark, sf)).select(
        "model", F.col("params")["max_depth"].cast("int").alias("max_depth"),
        F.col("params")["min_samples_leaf"].cast("int").alias("min_samples_leaf"), "mean_f1", "std_f1")


@register("grid_pivot_derived", O.base(*GRID_SQL) + " SELECT max_depth, CAST(min_samples_leaf AS VARCHAR) AS min_samples_leaf, mean_f1 FROM grid")
def q_grid_pivot_derived(spark, sf):
    """The pivoted grid, read back in long form."""
    wide = TU.grid_pivot(_grid(spark, sf))
    return wide.unpivot(["max_depth"], [c for c in wide.columns if c != "max_depth"], "min_samples_leaf", "mean_f1").where(
        "mean_f1 IS NOT NULL")


@register("grid_best_derived", O.base(*GRID_SQL) + """, b AS (
   SELECT model, 5 AS cv_folds, format('{:.4f}', round_even(mean_f1 * 10000, 0) / 10000) AS best_cv_f1, max_depth, min_samples_leaf FROM ranked WHERE r = 1)
 SELECT model, cv_folds, best_cv_f1, 'max_depth' AS param, CAST(max_depth AS VARCHAR) AS value FROM b
 UNION ALL SELECT model, cv_folds, best_cv_f1, 'min_samples_leaf', CAST(min_samples_leaf AS VARCHAR) FROM b""")
def q_grid_best_derived(spark, sf):
    return TU.grid_best(_grid(spark, sf))


# ---------------------------------------------------------------- attributions by raw column

RAW_OF = {"AGE_YRS": "age", "HOSPITAL": "stay", "X_STAY": "stay", "L_THREAT": "course", "RECOVD": "course"}


@register("attribution_by_raw_feature_derived", O.base(
    *ATTR_SQL, "effects AS (SELECT v.row_id, v.feature, w.weight * v.value AS shap FROM vals v JOIN w USING (feature))",
    "raw_map AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RAW_OF.items())
    + ") t(feature, raw_feature))",
    f"""per_raw AS (SELECT raw_feature, {O.r6('avg(s)')} AS mean_shap FROM (
      SELECT row_id, raw_feature, sum(shap) AS s FROM effects JOIN raw_map USING (feature) GROUP BY ALL) GROUP BY raw_feature)""") + """
 SELECT *, CASE WHEN mean_shap > 0 THEN 'pushes toward death' ELSE 'pushes toward survival' END AS direction FROM per_raw""")
def q_attribution_by_raw_feature_derived(spark, sf):
    # Effects that are not centred, so that their means differ from 0.
    attr = (formula_inputs(WF.explain_rows(spark, sf)).join(F.broadcast(formula_weights(spark)), "feature")
            .withColumn("shap", F.col("weight") * F.col("value")))
    raw_map = spark.createDataFrame(list(RAW_OF.items()), "feature string, raw_feature string")
    return XP.attribution_by_raw_feature(attr, raw_map)


# ---------------------------------------------------------------- fitted linear models

SCORE_SQL = O.base(MED_SQL, STD_SQL, KEPT_SQL) + f""",
tr AS (SELECT * FROM {TRAIN}),
wt AS (SELECT DIED, n / (CAST(2 AS DOUBLE) * n_c) AS w FROM (
  SELECT DIED, count(*) AS n_c, sum(count(*)) OVER () AS n FROM tr GROUP BY DIED)),
x AS (
  SELECT l.VAERS_ID, l.feature, (coalesce(l.v, m.med) - s.mean) / s.std AS v
  FROM (SELECT * FROM (SELECT VAERS_ID, {NUM_LIST} FROM tr) UNPIVOT INCLUDE NULLS (v FOR feature IN ({NUM_LIST}))) l
  JOIN med m ON l.feature = m.feature JOIN std s ON l.feature = s.feature
  UNION ALL
  SELECT VAERS_ID, feature, coalesce(v, 0) FROM (SELECT * FROM (SELECT VAERS_ID, {_BIN_D} FROM tr)
    UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (VAERS_ID)))))
  UNION ALL SELECT VAERS_ID, feature, CAST(v AS DOUBLE) FROM ({O.flags_long('tr')})
  UNION ALL
  SELECT t.VAERS_ID, k.feature || '_' || k.category, CAST(t.category = k.category AS DOUBLE)
  FROM (UNPIVOT (SELECT VAERS_ID, {CAT_FILLED} FROM tr) ON {CAT_LIST} INTO NAME feature VALUE category) t
  JOIN kept k ON t.feature = k.feature)
 SELECT md.model, x.feature, {O.rnd('sum(wt.w * tr.DIED * x.v) / sum(wt.w)', 4)} AS score
 FROM x JOIN tr ON x.VAERS_ID = tr.VAERS_ID JOIN wt ON tr.DIED = wt.DIED
 CROSS JOIN (VALUES ('logistic'), ('ridge')) md(model) GROUP BY md.model, x.feature"""


@register("score_equations", SCORE_SQL)
def q_score_equations(spark, sf):
    """A fitted linear model's score equations: the weighted sum of each
    feature over the probabilities (plus β / C under the ridge penalty) is
    that over the labels, which SQL can sum. Fitted to a tight tolerance."""
    train = M.weighted(WF.train_rows(spark, sf), "logistic")
    out = None
    for name in ("logistic", "ridge"):
        model = M.fit(WF.train_rows(spark, sf), name, prep_model=WF.shared_preparation(spark, sf), tol=1e-12)
        prep, names = model.stages[0], M.feature_names(model)
        scored = model.transform(train)
        p = vector_to_array("probability")[1]
        sums = scored.agg(F.sum("weight").alias("w"), *[
            F.sum(F.col("weight") * p * e).alias(f"s{i}") for i, e in enumerate(prep.feature_exprs())])
        beta = model.stages[-1].coefficients.toArray() / C.PENALTY_C if name == "ridge" else [0.0] * len(names)
        rows = sums.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature"), ((F.col(f"s{i}") + F.lit(float(b))) / F.col("w")).alias("v"))
            for i, (n, b) in enumerate(zip(names, beta))])).alias("f")).select(
                F.lit(name).alias("model"), "f.feature", round_half_even("f.v", 4).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out
