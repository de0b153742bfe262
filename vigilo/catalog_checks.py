"""Conditions that fitted models and written artifacts must meet, with SQL.

DuckDB cannot fit a model, but it can say what must hold of one: how many rows
each model scores, that attributions add up to the log-odds, that a reloaded
model scores alike, that a lasso's subgradients meet its penalty. Each query
counts or sums on the model's side; its SQL counts or sums the given tables.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo import oracle as O
from vigilo.catalog import (CV_MODELS, _grid_rows, _scenarios, cv_scored, q_mlp_history, q_training_history, q_tree_rules, q_what_if,
                            register)
from vigilo.catalog_derived import SCORE_SQL
from vigilo.functions.clean import round_half_even
from vigilo.operators import explain as XP
from vigilo.operators import evaluate as E
from vigilo.plans import models as M
from vigilo.plans import whatif as WI
from vigilo.plans import workflow as WF
from vigilo.session import scratch_path
from vigilo.sources import artifacts as AR
from vigilo.sources.commits import Commit


def _models(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") md(model)"


# ---------------------------------------------------------------- scores

@register("score_check", O.base() + f"""
 SELECT md.model, count(*) AS n, CAST(sum(DIED) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS misjudged
 FROM split_base CROSS JOIN {_models(M.ALL_MODELS)} WHERE split = 'test' GROUP BY md.model""")
def q_score_check(spark, sf):
    """Every model scores every test row once, in [0, 1], and decides at 0.5."""
    p, pred = F.col("p"), F.col("pred")
    return WF.scored_test(spark, sf).groupBy("model").agg(
        F.count_distinct(C.KEY).alias("n"), F.sum(F.col("y").cast("long")).alias("positives"),
        F.count_if(~p.between(0, 1) | p.isNull()).alias("outside"),
        F.count_if((p >= C.DECISION_THRESHOLD) != (pred == 1)).alias("misjudged"))


@register("cart_balance", O.base() + f"""
 SELECT n_train, {O.rnd('0.5', 6)} AS share FROM (SELECT count(*) AS n_train FROM split_base WHERE split = 'train')""")
def q_cart_balance(spark, sf):
    """A leaf's probability is the weighted share of its training rows, so the
    weighted mean probability is that of the labels: a half under balanced weights."""
    train = M.weighted(WF.train_rows(spark, sf), "cart")
    scored = WF.fitted(spark, sf, "cart").transform(train)
    return scored.agg(F.count(F.lit(1)).alias("n_train"), round_half_even(
        F.sum(F.col("weight") * vector_to_array("probability")[1]) / F.sum("weight"), 6).alias("share"))


@register("lasso_conditions", SCORE_SQL.replace("('logistic'), ('ridge')", "('lasso')"))
def q_lasso_conditions(spark, sf):
    """A fitted lasso's optimality: at a coefficient that is not 0 the gradient
    of the loss balances the penalty's sign, at one that is 0 some number in
    [-1, 1] does. With u that number, Σ w p x + u / C is the Σ w y x that SQL
    sums; outside [-1, 1] it could not be."""
    model = M.fit(WF.train_rows(spark, sf), "lasso", prep_model=WF.shared_preparation(spark, sf), tol=1e-12)
    prep, names = model.stages[0], M.feature_names(model)
    scored = model.transform(M.weighted(WF.train_rows(spark, sf), "lasso"))
    p, y, w = vector_to_array("probability")[1], F.col(C.LABEL), F.col("weight")
    sums = scored.agg(F.sum("weight").alias("w"), *[
        F.sum(w * p * e).alias(f"s{i}") for i, e in enumerate(prep.feature_exprs())], *[
        F.sum(w * (y - p) * e).alias(f"d{i}") for i, e in enumerate(prep.feature_exprs())])
    beta = model.stages[-1].coefficients.toArray()

    def sign(i):
        if beta[i]:
            return F.lit(1.0 if beta[i] > 0 else -1.0)
        return F.least(F.greatest(F.col(f"d{i}") * C.PENALTY_C, F.lit(-1.0)), F.lit(1.0))

    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), ((F.col(f"s{i}") + sign(i) / C.PENALTY_C) / F.col("w")).alias("v"))
        for i, n in enumerate(names)])).alias("f")).select(
            F.lit("lasso").alias("model"), "f.feature", round_half_even("f.v", 4).alias("score"))


# ---------------------------------------------------------------- folds, grids, histories

@register("cv_check", O.base() + f"""
 SELECT md.model, fold, count(*) AS n, CAST(sum(DIED) AS BIGINT) AS positives
 FROM split_base CROSS JOIN {_models(CV_MODELS)} WHERE split = 'train' GROUP BY md.model, fold""")
def q_cv_check(spark, sf):
    """Each model scores every training row once, in the fold that it did not see."""
    return cv_scored(spark, sf).groupBy("model", "fold").agg(
        F.count_distinct(C.KEY).alias("n"), F.sum(F.col("y").cast("long")).alias("positives"))


@register("grid_check", """SELECT * FROM (VALUES ('cart', CAST(16 AS BIGINT), 5, CAST(0 AS BIGINT)), ('random_forest', 9, 3, 0),
 ('lightgbm', 18, 5, 0)) t(model, points, folds, outside)""")
def q_grid_check(spark, sf):
    """The reference's grids: their points and folds, every mean F1 in [0, 1]."""
    return _grid_rows(spark, sf).groupBy("model").agg(
        F.count_distinct(F.to_json("params")).alias("points"), F.max("n_splits").alias("folds"),
        F.count_if(~F.col("mean_f1").between(0, 1)).alias("outside"))


@register("history_check", O.base() + f"""
 SELECT model, CAST(floor(n * CAST({C.VALIDATION_SHARE} AS DOUBLE)) AS BIGINT) AS held_out, n - CAST(floor(n * CAST({C.VALIDATION_SHARE} AS DOUBLE)) AS BIGINT) AS learned,
        CAST(0 AS BIGINT) AS gaps
 FROM (SELECT count(*) AS n FROM split_base WHERE split = 'train') CROSS JOIN {_models(("lightgbm", "mlp"))}""")
def q_history_check(spark, sf):
    """Six series without a gap for both models, on the hold-out and the rows beside it."""
    _, seen, val = WF.held_out(spark, sf, "lightgbm")
    both = q_training_history(spark, sf).unionByName(q_mlp_history(spark, sf))
    missing = F.lit(False)
    for c in both.columns[2:]:
        missing = missing | F.col(c).isNull()
    return both.groupBy("model").agg(
        F.lit(val.count()).alias("held_out"), F.lit(seen.count()).alias("learned"),
        (F.count_if(missing) + F.max("epoch") - F.count_distinct("epoch")).alias("gaps"))


# ---------------------------------------------------------------- written artifacts

SAVED = ("logistic", "cart", "lightgbm", "mlp")


@register("model_roundtrip_check", O.base() + f"""
 SELECT md.model, count(*) AS n, CAST(0 AS BIGINT) AS differing
 FROM split_base CROSS JOIN {_models(SAVED)} WHERE split = 'test' GROUP BY md.model""")
def q_model_roundtrip_check(spark, sf):
    """Saved and loaded models score every test row as before."""
    out = None
    for name in SAVED:
        path = scratch_path(spark, "model")
        AR.save_model(WF.fitted(spark, sf, name), path)
        after = M.score(AR.load_model(path), WF.test_rows(spark, sf), name).select(C.KEY, F.col("p").alias("q"))
        both = WF.scored_by(spark, sf, name).join(after, C.KEY).groupBy("model").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") != F.col("q")).alias("differing"))
        out = both if out is None else out.unionByName(both)
    return out


@register("results_upsert_check", O.base() + """
 SELECT md.model, CAST(1 AS BIGINT) AS rows, md.model = 'ridge' AS rewritten, CAST(0 AS BIGINT) AS changed
 FROM (VALUES ('logistic'), ('ridge'), ('cart')) md(model)""")
def q_results_upsert_check(spark, sf):
    """A second write of one model's rows replaces them and leaves the others as they were."""
    path = scratch_path(spark, "metrics")
    first = E.test_metrics(WF.scored_test(spark, sf, ("logistic", "ridge", "cart")))
    AR.upsert_results(first, path)
    AR.upsert_results(E.test_metrics(WF.scored_test(spark, sf, ("ridge",))).withColumn("accuracy", F.lit(-1.0)), path)
    after = AR.read_table(spark, path).withColumn("now", F.col("accuracy"))
    both = after.select("model", "now", F.col("roc_auc").alias("auc")).join(first, "model")
    return both.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), (F.max("now") == -1).alias("rewritten"),
        F.count_if((F.col("auc") != F.col("roc_auc")) | ((F.col("now") != -1) & (F.col("now") != F.col("accuracy")))).alias("changed"))


@register("results_commit_check", O.base() + """
 SELECT md.model, count(*) AS n, CAST(0 AS BIGINT) AS early, md.model = 'ridge' AS rewritten, CAST(0 AS BIGINT) AS torn
 FROM split_base CROSS JOIN (VALUES ('logistic'), ('ridge'), ('cart')) md(model) WHERE split = 'test' GROUP BY md.model""")
def q_results_commit_check(spark, sf):
    """Scores and metrics of a model change in one commit: no row of either is
    seen before it (``early``), and after it both are of one version (``torn``)."""
    out = scratch_path(spark, "commits")
    scored = WF.scored_test(spark, sf, ("logistic", "ridge", "cart")).withColumn("version", F.lit(1))
    first = Commit(spark, out)
    first.table("scores", scored, "model")
    first.table("metrics", E.test_metrics(scored).withColumn("version", F.lit(1)), "model")
    first.publish()
    ridge = scored.where("model = 'ridge'").withColumn("version", F.lit(2))
    second = Commit(spark, out)
    second.table("scores", ridge, "model")
    second.table("metrics", E.test_metrics(ridge).withColumn("version", F.lit(2)), "model")
    versions = [AR.read_table(spark, f"{out}/{t}").select("model", "version") for t in ("scores", "metrics")]
    early = versions[0].unionByName(versions[1]).groupBy("model").agg(F.count_if(F.col("version") != 1).alias("early"))
    second.publish()
    metrics = AR.read_table(spark, f"{out}/metrics").select("model", F.col("version").alias("of_metrics"))
    return AR.read_table(spark, f"{out}/scores").join(metrics, "model").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), (F.max("version") == 2).alias("rewritten"),
        F.count_if(F.col("version") != F.col("of_metrics")).alias("torn")).join(early, "model")


@register("tree_rules_check", O.base() + """
 SELECT count(*) AS n, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS twice FROM split_base WHERE split = 'test'""")
def q_tree_rules_check(spark, sf):
    """The rules of the tree's text part the rows: each test row meets one of them."""
    rules = [r["rule"] for r in q_tree_rules(spark, sf).collect()]          # at most 16
    prep = WF.fitted(spark, sf, "cart").stages[0]
    # Names may differ by case alone (..._UNKNOWN, ..._Unknown): looked up here, never resolved as columns.
    features = dict(zip(prep.feature_names(), prep.feature_exprs()))
    met = F.lit(0)
    for rule in rules:
        holds = F.lit(True)
        for part in filter(None, rule.split(" & ")):
            name, op, value = part.rsplit(" ", 2)
            x, v = features[name], F.lit(float(value))
            holds = holds & (x <= v if op == "<=" else x > v)
        met = met + holds.cast("int")
    rows = WF.test_rows(spark, sf).select(met.alias("met"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("met") == 0).alias("uncovered"),
                    F.count_if(F.col("met") > 1).alias("twice"))


# ---------------------------------------------------------------- explanation and what-if

@register("tree_additivity", O.base() + f"""
 SELECT least(count(*), {C.EXPLAIN_ROWS}) AS n, CAST(0 AS BIGINT) AS off FROM split_base WHERE split = 'test'""")
def q_tree_additivity(spark, sf):
    """Base value and attributions add up to the log-odds of every explained row."""
    model = WF.fitted(spark, sf, "lightgbm")
    rows = model.stages[0].transform(WF.explain_rows(spark, sf))
    attr, base = XP.tree_attributions(spark, model.stages[-1], rows, M.feature_names(model))
    total = attr.groupBy("row_id").agg((F.sum("shap") + F.lit(base)).alias("total"))
    p = vector_to_array("probability")[1]
    odds = model.stages[-1].transform(rows).select("row_id", F.log(p / (1 - p)).alias("odds"))
    return total.join(odds, "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("total") - F.col("odds")) > 1e-6).alias("off"))


@register("what_if_check", O.base() + """
 SELECT DISTINCT coalesce(SEX, '?') || '|' || coalesce(VAX_DOSE_SERIES, '?') AS scenario, 'lightgbm' AS model, true AS consistent, true AS additive
 FROM split_base WHERE split = 'test'""")
def q_what_if_check(spark, sf):
    """Every observed scenario is scored once, its class and risk follow its
    probability, and its attributions add up to it."""
    t, model = WF.test_rows(spark, sf), WF.fitted(spark, sf, "lightgbm")
    rows = WI.apply_profile(_scenarios(spark, sf), WI.profile_values(t), t.schema)
    rows = rows.withColumn("row_id", F.abs(F.xxhash64("scenario") % 2 ** 30).cast("int"))
    attr, base = XP.tree_attributions(spark, model.stages[-1], model.stages[0].transform(rows), M.feature_names(model))
    total = attr.groupBy("row_id").agg((F.sum("shap") + F.lit(base)).alias("odds")).join(rows.select("row_id", "scenario"), "row_id")
    high = F.col("p") >= C.DECISION_THRESHOLD
    return q_what_if(spark, sf).join(total, "scenario").select(
        "scenario", "model",
        ((F.col("pred") == high.cast("int")) & ((F.col("risk") == "HIGH RISK") == high) & ((F.col("outcome") == "Died") == high)).alias("consistent"),
        (F.abs(1 / (1 + F.exp(-F.col("odds"))) - F.col("p")) < 1e-9).alias("additive"))


@register("dependence_check", O.base() + f"""
 SELECT 'AGE_YRS' AS feature, CAST({C.GRID_POINTS} AS BIGINT) AS points, CAST(0 AS BIGINT) AS outside
 UNION ALL SELECT 'SEX', count(DISTINCT SEX), 0 FROM split_base WHERE split = 'test'
 UNION ALL SELECT 'HOSPITAL', count(DISTINCT HOSPITAL), 0 FROM split_base WHERE split = 'test'""")
def q_dependence_check(spark, sf):
    """The curve has a point for each grid value or category, each a probability."""
    t, model = WF.test_rows(spark, sf), WF.fitted(spark, sf, "lightgbm")
    parts = [WI.dependence_curve(model, "lightgbm", t, f) for f in ("AGE_YRS", "SEX", "HOSPITAL")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("feature").agg(F.count_distinct("value").alias("points"), F.count_if(~F.col("p").between(0, 1)).alias("outside"))
