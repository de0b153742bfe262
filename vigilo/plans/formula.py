"""Fixed-formula scorers: stand-in models whose scores SQL can reproduce.

Evaluation operators are checked against DuckDB on these two logistic
formulas (one smooth, one coarse with many tied scores) before they are
used on fitted Spark ML models, whose scores SQL cannot recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import decide

# ---- fixed values: the two formula scorers (our own, not the reference's) ----
FORMULAS = {
    "formula_age": [("AGE_YRS", 0.05, 50.0, -50.0), ("HOSPITAL", 1.2, 0.0, 0.0),
                    ("L_THREAT", 0.8, 0.0, 0.0), ("RECOVD", -1.5, 0.0, 0.0),
                    ("X_STAY", 0.5, 0.0, 0.0)],
    "formula_flags": [("DISABLE", 0.7, 0.0, 0.0), ("OFC_VISIT", -0.4, 0.0, 0.0),
                      ("ER_ED_VISIT", 0.3, 0.0, 0.0)],
}
INTERCEPTS = {"formula_age": -1.0, "formula_flags": -0.5}


def _z(model: str):
    z = F.lit(INTERCEPTS[model])
    for col, w, fill, shift in FORMULAS[model]:
        z = z + F.lit(w) * (F.coalesce(F.col(col).cast("double"), F.lit(fill)) + F.lit(shift))
    return z


def formula_scores(df: DataFrame, keep=("split", "fold")) -> DataFrame:
    """(model, VAERS_ID, y, p, pred, *keep) for every row and formula."""
    keep = [c for c in keep if c in df.columns]
    parts = [df.select(F.lit(m).alias("model"), C.KEY, F.col(C.LABEL).cast("int").alias("y"),
                       (1 / (1 + F.exp(-_z(m)))).alias("p"), *keep)
             for m in FORMULAS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pred", decide("p"))


def formula_sql(src: str, keep: str = "split, fold") -> str:
    """The DuckDB twin of :func:`formula_scores` over table ``src``."""
    parts = []
    for m, terms in FORMULAS.items():
        z = f"CAST({INTERCEPTS[m]} AS DOUBLE)"
        for col, w, fill, shift in terms:
            z += (f" + CAST({w} AS DOUBLE) * (coalesce(CAST({col} AS DOUBLE), CAST({fill} AS DOUBLE))"
                  f" + CAST({shift} AS DOUBLE))")
        parts.append(f"SELECT '{m}' AS model, VAERS_ID, CAST(DIED AS INTEGER) AS y, "
                     f"1 / (1 + exp(-({z}))) AS p, {keep} FROM {src}")
    u = " UNION ALL ".join(parts)
    return f"SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM ({u})"


def formula_inputs(rows: DataFrame, model: str = "formula_age") -> DataFrame:
    """(row_id, feature, value): the formula's inputs after fill and shift."""
    pairs = F.array(*[F.struct(F.lit(col).alias("feature"),
                               (F.coalesce(F.col(col).cast("double"), F.lit(fill)) + F.lit(shift)).alias("value"))
                      for col, _, fill, shift in FORMULAS[model]])
    return rows.select("row_id", F.explode(pairs).alias("_p")).select("row_id", "_p.feature", "_p.value")


def formula_weights(spark, model: str = "formula_age") -> DataFrame:
    """(feature, weight) of a formula — a fixed table of ≤ 5 rows."""
    return spark.createDataFrame([(c, float(w)) for c, w, _, _ in FORMULAS[model]],
                                 "feature string, weight double")


def formula_inputs_sql(src: str, model: str = "formula_age") -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, '{col}' AS feature, coalesce(CAST({col} AS DOUBLE), CAST({fill} AS DOUBLE)) "
        f"+ CAST({shift} AS DOUBLE) AS value FROM {src}" for col, _, fill, shift in FORMULAS[model])


def formula_weights_sql(model: str = "formula_age") -> str:
    vals = ", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w, _, _ in FORMULAS[model])
    return f"SELECT * FROM (VALUES {vals}) t(feature, weight)"
