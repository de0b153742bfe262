"""Exploratory views over the sample table.

Every view is one aggregate over the fact table, with map-side combine,
followed by work on its small result. Parameters a view needs from the
data first (a min/max, quantile edges) are computed by a distributed job
and reach the driver as a handful of numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import (
    fill_unknown, outcome_text, pretty_symptom, r6, round_half_even, yes_no_text)
from vigilo.functions.names import present, sym_columns
from vigilo.operators.distributed import exact_modes, exact_percentiles, held
from vigilo.operators.reshape import outcome_unpivot

def n_rows():
    return F.count(F.lit(1))


def rate_table(df: DataFrame, key: str, min_n: int | None = None, digits: int = 2,
               order: str | None = "rate", label: str = C.LABEL) -> DataFrame:
    """A4: mean label, count, HAVING count ≥ min_n, rate in percent.

    NULL keys are dropped first (the reference's group-by drops them).
    """
    agg = (df.where(F.col(key).isNotNull())
             .groupBy(key)
             .agg(F.avg(label).alias("rate"), n_rows().alias("n")))
    if min_n is not None:
        agg = agg.where(F.col("n") >= min_n)                          # P15
    out = agg.withColumn("rate_pct", round_half_even(F.col("rate") * 100, digits))
    if order == "rate":
        out = out.orderBy(F.desc("rate_pct"), F.asc(key))
    elif order == "key":
        out = out.orderBy(key)
    return out


def rate_by_flag(df: DataFrame, flag: str, label: str = C.LABEL) -> DataFrame:
    """A5: rate table of a 0/1 feature with display labels (no HAVING)."""
    return (rate_table(df, flag, None, 2, "key", label)
            .withColumn("label", yes_no_text(flag)))


def risk_ratio(df: DataFrame, flag: str, label: str = C.LABEL) -> DataFrame:
    """rate% when flag=1 over rate% when flag=0 (floor 0.001), one row."""
    t = rate_by_flag(df, flag, label)
    one = t.agg(
        F.max(F.when(F.col(flag) == 1, F.col("rate_pct"))).alias("yes_rate_pct"),
        F.max(F.when(F.col(flag) == 0, F.col("rate_pct"))).alias("no_rate_pct"))
    return one.select(
        F.lit(flag).alias("feature"), "yes_rate_pct", "no_rate_pct",
        (F.col("yes_rate_pct") / F.greatest(F.col("no_rate_pct"), F.lit(C.RISK_RATIO_FLOOR)))
        .alias("ratio"))


def rate_by_category(df: DataFrame, col: str, min_n: int = C.MIN_SUPPORT["category"],
                     label: str = C.LABEL) -> DataFrame:
    """A4 + A14: rate table plus each group's share of the kept groups.

    The share's denominator is a scalar subquery over the rate table, so no
    task holds all groups of a column with many values.
    """
    t = rate_table(df, col, min_n, 2, None, label)
    total = t.agg(F.sum("n")).scalar()
    share = F.col("n") / total * 100
    return (t.withColumn("pct_of_total", round_half_even(share, 1))
             .orderBy(F.desc("rate_pct"), F.asc(col)))


def category_counts(df: DataFrame, col: str, min_n: int = C.MIN_SUPPORT["category"],
                    label: str = C.LABEL) -> DataFrame:
    """The same table ordered by volume."""
    return rate_by_category(df, col, min_n, label).orderBy(F.desc("n"), F.asc(col))


def kpi_summary(df: DataFrame, label: str = C.LABEL) -> DataFrame:
    """One global aggregate for the headline numbers."""
    n_flags = len(sym_columns(df.columns))
    return df.agg(
        n_rows().alias("total_recs"),
        (F.avg(label) * 100).alias("death_rate"),
        F.min("AGE_YRS").cast("int").alias("age_min"),
        F.max("AGE_YRS").cast("int").alias("age_max"),
        F.countDistinct("STATE").alias("n_states"),
        F.sum(label).cast("bigint").alias("deaths"),
    ).withColumn("n_flags", F.lit(n_flags).cast("bigint"))


def flag_totals_top15(df: DataFrame, k: int = C.FLAG_TOTALS_TOP, label: str = C.LABEL) -> DataFrame:
    """Flag totals over all rows and over positives, top k, long form.

    One aggregate computes both sums for every flag; the one-row result is
    exploded to (flag, total, deaths), cut to the top k and melted.
    """
    cols = sym_columns(df.columns)
    sums = df.agg(*[F.sum(F.col(c).cast("long")).alias(f"t_{c}") for c in cols],
                  *[F.sum(F.col(c).cast("long") * F.col(label)).alias(f"d_{c}") for c in cols])
    rows = sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("flag"), F.col(f"t_{c}").alias("total"),
                 F.col(f"d_{c}").alias("deaths")) for c in cols])).alias("r")).select("r.*")
    top = rows.orderBy(F.desc("total"), F.asc("flag")).limit(k)
    melted = top.select(
        pretty_symptom("flag").alias("Symptom"),
        F.explode(F.array(
            F.struct(F.lit("All Reports").alias("Group"), F.col("total").alias("Count")),
            F.struct(F.lit("Deaths").alias("Group"), F.col("deaths").alias("Count")))).alias("g"))
    return melted.select("Symptom", "g.Group", "g.Count")


def monthly_volume(df: DataFrame, months: int = C.MONTHS_SHOWN, label: str = C.LABEL) -> DataFrame:
    """Reports per month and outcome, the newest ``months`` months only."""
    m = "RECV_YEAR_MONTH"
    counts = (df.where(F.col(m).isNotNull())
                .groupBy(m, label).agg(n_rows().alias("Count")))
    newest = counts.select(m).distinct().orderBy(F.desc(m)).limit(months)
    return (counts.join(F.broadcast(newest), m, "left_semi")           # ≤ months rows
                  .withColumn("Outcome", outcome_text(label))
                  .orderBy(m, label))


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlations with pairwise NULL deletion, in one pass.

    With m = present, x and x² (0 where NULL) of every column, all pair sums
    are entries of one Gram matrix: Σ mₐm_b, Σ xₐm_b, Σ xₐ²m_b, Σ xₐx_b. Each
    task adds up the matrix of its rows; Spark sums the entries. Values are
    shifted by the column means first, so that large means cost no digits.
    """
    cols = present(cols or C.HEAT_COLS, df.columns)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    shift = [v or 0.0 for v in x.agg(*[F.avg(c) for c in x.columns]).first()]
    k = len(cols)

    def gram(batches):
        total = np.zeros((3 * k, 3 * k))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            m = ~np.isnan(v)
            v = np.where(m, v - shift, 0.0)
            z = np.hstack([m.astype(float), v, v * v])
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], names=["i", "j", "v"])

    sums = x.mapInArrow(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))

    def entry(name, row, col):                      # block (row, col) of the matrix, as pairs of columns
        return F.max(F.when((F.floor(F.col("i") / k) == row) & (F.floor(F.col("j") / k) == col), F.col("v"))).alias(name)

    pair = sums.groupBy((F.col("i") % k).alias("a"), (F.col("j") % k).alias("b")).agg(
        entry("n", 0, 0), entry("sa", 1, 0), entry("sb", 0, 1), entry("qa", 2, 0), entry("qb", 0, 2), entry("ab", 1, 1))
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    cov, va, vb = n * F.col("ab") - sa * sb, n * F.col("qa") - sa * sa, n * F.col("qb") - sb * sb
    names = F.array(*[F.lit(c) for c in cols])
    return pair.select(F.element_at(names, F.col("a") + 1).alias("row"), F.element_at(names, F.col("b") + 1).alias("col"),
                       r6(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))).alias("corr"))


def value_range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(col), F.max(col)).first()
    return r[0], r[1]


def histogram_by_label(df: DataFrame, col: str = "AGE_YRS", bins: int = C.AGE_BINS,
                       label: str = C.LABEL) -> DataFrame:
    """A10: equal-width histogram over [min, max] by outcome.

    The bounds are one distributed min/max (two numbers to the driver); each
    row then gets its bin in the same codegen span as the scan.
    """
    lo, hi = value_range(df, col)
    if lo is None:
        return df.limit(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_lo"),
                                  F.lit(0.0).alias("bin_hi"), F.col(label), F.lit(0).alias("n"))
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.where(x.isNotNull())
              .groupBy(b.alias("bin"), F.col(label))
              .agg(n_rows().alias("n"))
              .select("bin",
                      r6(F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      r6(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                      label, "n"))


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles (type 7), 1.5·IQR whiskers, min, max and n per group.

    Everything comes from one table of counts by (group, value); Spark joins
    the fences, a row for each group, by their measured size."""
    counts = held(df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
                  .groupBy(group, F.col(value).alias(value)).agg(n_rows().alias("_n")))
    qs = exact_percentiles(counts, value, [0.25, 0.5, 0.75], [group], "_n")
    wide = qs.groupBy(group).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    fences = wide.withColumns({
        "_lo": F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5,
        "_hi": F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5})
    v = F.col(value)
    j = counts.join(fences, group)
    return j.groupBy(group).agg(
        F.sum("_n").alias("n"),
        r6(F.first("q1")).alias("q1"), r6(F.first("median")).alias("median"),
        r6(F.first("q3")).alias("q3"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_hi"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def lag_box(df: DataFrame, value: str = "NUMDAYS", label: str = C.LABEL) -> DataFrame:
    """Onset-to-report lag by outcome (Survived / Died)."""
    return box_stats(df.withColumn("Outcome", outcome_text(label)), value, "Outcome")


def age_box_by_outcomes(df: DataFrame, value: str = "AGE_YRS") -> DataFrame:
    """A11 over U2: age by the ten 'Outcome=0/1' groups, from one unpivot."""
    return box_stats(outcome_unpivot(df, value), value, "Outcome")


DECILES = [i / 10 for i in range(11)]


def quantile_edges(df: DataFrame, col: str, probs=DECILES) -> list[float]:
    """Exact quantile edges, duplicates dropped (≤ len(probs) numbers)."""
    qs = exact_percentiles(df, col, probs).collect()
    return sorted(set(r["q"] for r in qs if r["q"] is not None))


def decile_rate(df: DataFrame, col: str, label: str = C.LABEL) -> DataFrame:
    """Rate by quantile bucket; right-closed, lowest value included."""
    edges = quantile_edges(df, col)
    if len(edges) < 2:
        edges = edges * 2 if edges else [0.0, 0.0]
    tail = F.array(*[F.lit(e) for e in edges[1:]])
    x = F.col(col)
    bucket = F.size(F.filter(tail, lambda e: e < x))
    lo = F.array(*[F.lit(e) for e in edges])
    t = (df.where(x.isNotNull())
           .groupBy(bucket.alias("bucket"))
           .agg(F.avg(label).alias("rate"), n_rows().alias("n")))
    return t.select(
        "bucket",
        r6(F.element_at(lo, F.col("bucket") + 1)).alias("lo"),
        r6(F.element_at(lo, F.col("bucket") + 2)).alias("hi"),
        "rate", "n",
        round_half_even(F.col("rate") * 100, 2).alias("rate_pct"))


def label_location_stats(df: DataFrame, col: str, label: str = C.LABEL) -> DataFrame:
    """Mean and exact median of a numeric column per outcome."""
    means = df.where(F.col(col).isNotNull()).groupBy(label).agg(F.avg(col).alias("mean"))
    med = exact_percentiles(df, col, [0.5], [label]).select(label, F.col("q").alias("median"))
    return means.join(F.broadcast(med), label).select(label, r6("mean").alias("mean"),
                                                      r6("median").alias("median"))


def flag_profile(df: DataFrame, flags: list[str], by_mode: set[str]) -> DataFrame:
    """(feature, value_num, value_cat) of 0/1 columns: their mode where asked
    for (0 on ties), else their median."""
    one = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(flags)],
                 *[F.sum(F.col(c).cast("bigint")).alias(f"s{i}") for i, c in enumerate(flags)])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(c in by_mode).alias("mode"), F.col(f"n{i}").alias("n"),
                 F.col(f"s{i}").alias("s")) for i, c in enumerate(flags)])).alias("f")).select("f.*").where("n > 0")
    zeros = F.col("n") - F.col("s")
    middle = (F.col("n") - 1) / 2
    median = ((F.floor(middle) >= zeros).cast("double") + (F.ceil(middle) >= zeros).cast("double")) / 2
    return rows.select("feature", F.when(F.col("mode"), (F.col("s") > zeros).cast("double")).otherwise(median).alias("value_num"),
                       F.lit(None).cast("string").alias("value_cat"))


def profile_row(df: DataFrame, numeric: list[str], categorical: list[str],
                mode_numeric: list[str] = ()) -> DataFrame:
    """Per-feature default — exact median for ``numeric`` columns, the
    most frequent value (smallest on ties) for ``categorical`` and
    ``mode_numeric`` ones. Long form (feature, value_num, value_cat).

    0/1 flags (tinyint) need only a count and a sum each, in one aggregate.
    The other medians share one distributed percentile job (grouped by
    feature), the other modes one counting job.
    """
    parts = []
    byte = {f.name for f in df.schema if f.dataType.simpleString() == "tinyint"}
    flags = [c for c in [*numeric, *mode_numeric] if c in byte]
    if flags:
        parts.append(flag_profile(df, flags, set(mode_numeric)))
    numeric = [c for c in numeric if c not in byte]
    mode_numeric = [c for c in mode_numeric if c not in byte]
    if numeric:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [], list(numeric), "feature", "v")
        med = exact_percentiles(long, "v", [0.5], ["feature"])
        parts.append(med.select("feature", r6("q").alias("value_num"),
                                F.lit(None).cast("string").alias("value_cat")))
    if mode_numeric:
        m = exact_modes(df, list(mode_numeric))
        parts.append(m.select("feature", F.col("mode").cast("double").alias("value_num"),
                              F.lit(None).cast("string").alias("value_cat")))
    if categorical:
        filled = df.select(*[fill_unknown(c).alias(c) for c in categorical])
        m = exact_modes(filled, list(categorical))
        parts.append(m.select("feature", F.lit(None).cast("double").alias("value_num"),
                              F.col("mode").alias("value_cat")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def linear_grid(df: DataFrame, col: str, points: int = C.GRID_POINTS,
                lo_q: float = C.GRID_LOW_Q, hi_q: float = C.GRID_HIGH_Q) -> DataFrame:
    """``points`` evenly spaced values from the lo_q to the hi_q quantile."""
    qs = exact_percentiles(df, col, [lo_q, hi_q]).groupBy().agg(
        F.max(F.when(F.col("p") == lo_q, F.col("q"))).alias("lo"),
        F.max(F.when(F.col("p") == hi_q, F.col("q"))).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    g = qs.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    val = F.when(F.col("i") == points - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * step)
    return g.select("i", r6(val).alias("value"))


def zero_coef_share(coefs: DataFrame, eps: float = C.ZERO_COEF_EPS) -> DataFrame:
    """Per model, how many coefficients are (numerically) zero."""
    return coefs.groupBy("model").agg(
        F.count_if(F.abs("value") < eps).alias("n_zero"),
        n_rows().alias("n_features")).withColumn(
        "zero_pct", round_half_even(F.col("n_zero") / F.col("n_features") * 100, 1))


def feature_catalogue(df: DataFrame) -> DataFrame:
    """Explorable columns present in the table, in menu order, with kind."""
    sym = sym_columns(df.columns)
    groups = [("num", C.EXPLORER_NUM), ("cat", C.EXPLORER_CAT), ("bin", C.EXPLORER_BIN), ("sym", sym)]
    have = set(df.columns)
    rows, pos = [], 0
    for kind, cols in groups:
        for c in cols:
            if c in have:
                rows.append((pos, c, C.EXPLORER_KINDS[kind]))
                pos += 1
    return df.sparkSession.createDataFrame(rows, "position int, feature string, kind string")
