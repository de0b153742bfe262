"""Registry of named queries: a Spark callable and, where SQL can say the
same thing, its DuckDB twin. ``__spark_entry__`` only re-exports these.

Every callable reads the driver's tables from ``sf_dir`` through the
stand-in extracts, so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo import oracle as O
from vigilo.functions.clean import (
    clip, date_parts, fill_unknown, na_to_null, normalise_manufacturer, to_number, yes_flag)
from vigilo.functions.names import safe_name_col
from vigilo.operators import explore as X
from vigilo.operators import reshape as R
from vigilo.operators import sampling as S
from vigilo.plans import sample as P
from vigilo.plans.materialize import materialized_merged, materialized_split
from vigilo.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def _reports_text(spark, sf):
    return fixtures.raw_reports(spark, sf).select(*[na_to_null(c).alias(c) for c in C.REPORT_COLUMNS])


def _split(spark, sf):
    return materialized_split(spark, sf)


def _test_rows(spark, sf):
    return _split(spark, sf).where(F.col("split") == "test")


FLAGS_SQL = ", ".join(C.BIN_COLS)
RAW_TEXT_SQL = "raw_text AS (SELECT " + ", ".join(f"{O.na(c)} AS {c}" for c in C.REPORT_COLUMNS) + " FROM raw_reports)"

# ---------------------------------------------------------------- cleaning


@register("flag_encode", O.base() + f" SELECT VAERS_ID, {FLAGS_SQL}, DIED FROM reports")
def q_flag_encode(spark, sf):
    t = _reports_text(spark, sf)
    return t.select(F.col(C.KEY).try_cast("bigint").alias(C.KEY),
                    *[yes_flag(c).alias(c) for c in C.BIN_COLS + [C.LABEL]])


@register("numeric_coerce", O.base(RAW_TEXT_SQL) + " SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID, "
          + ", ".join(f"{O.num(c)} AS {c}" for c in C.NUM_FEATURES) + " FROM raw_text")
def q_numeric_coerce(spark, sf):
    t = _reports_text(spark, sf)
    return t.select(F.col(C.KEY).try_cast("bigint").alias(C.KEY),
                    *[to_number(c).alias(c) for c in C.NUM_FEATURES])


@register("clip_range", O.base() + " SELECT VAERS_ID, NUMDAYS, HOSPDAYS FROM reports")
def q_clip_range(spark, sf):
    t = _reports_text(spark, sf)
    return t.select(F.col(C.KEY).try_cast("bigint").alias(C.KEY),
                    *[clip(to_number(c)).alias(c) for c in C.CLIPPED])


@register("date_parts", O.base() + " SELECT VAERS_ID, RECV_YEAR_MONTH, RECV_YEAR FROM reports")
def q_date_parts(spark, sf):
    t = _reports_text(spark, sf).select(F.col(C.KEY).try_cast("bigint").alias(C.KEY), "RECVDATE")
    return date_parts(t, "RECVDATE")


@register("normalise_alias", O.base() + f" SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID, "
          f"{O.manu(O.na('VAX_MANU'))} AS VAX_MANU FROM raw_vaccines")
def q_normalise_alias(spark, sf):
    v = P.clean_vaccines(fixtures.raw_vaccines(spark, sf))
    return v.select(C.KEY, normalise_manufacturer("VAX_MANU").alias("VAX_MANU"))


@register("fill_unknown", O.base() + " SELECT VAERS_ID, " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in C.CAT_FEATURES) + " FROM sample_base")
def q_fill_unknown(spark, sf):
    s = materialized_merged(spark, sf)
    return s.select(C.KEY, *[fill_unknown(c).alias(c) for c in C.CAT_FEATURES])


@register("safe_name", O.base() + f" SELECT SYMPTOM, {O.safe('SYMPTOM')} AS name FROM term_counts")
def q_safe_name(spark, sf):
    long = P.symptom_long(fixtures.raw_symptoms(spark, sf))
    return long.select("SYMPTOM").distinct().select("SYMPTOM", safe_name_col("SYMPTOM").alias("name"))


# ---------------------------------------------------------------- reshape

@register("unpivot_terms", O.base() + " SELECT VAERS_ID, SYMPTOM FROM sym_long")
def q_unpivot_terms(spark, sf):
    return P.symptom_long(fixtures.raw_symptoms(spark, sf))


@register("topk_terms", O.base() + " SELECT SYMPTOM, n FROM top_terms")
def q_topk_terms(spark, sf):
    return R.topk_terms(P.symptom_long(fixtures.raw_symptoms(spark, sf)))


@register("distinct_terms", O.base() + " SELECT count(DISTINCT SYMPTOM) AS n_unique_terms FROM sym_long")
def q_distinct_terms(spark, sf):
    return R.distinct_terms(P.symptom_long(fixtures.raw_symptoms(spark, sf)))


@register("topk_semi_filter", O.base() + " SELECT l.VAERS_ID, l.SYMPTOM FROM sym_long l "
          "SEMI JOIN top_terms t ON l.SYMPTOM = t.SYMPTOM")
def q_topk_semi_filter(spark, sf):
    long = P.symptom_long(fixtures.raw_symptoms(spark, sf))
    return R.topk_semi_filter(long, R.topk_terms(long))


def _with_flag_list(df):
    """The SYM_ columns of a wide table as one text: the sorted names that are 1."""
    sym = sorted(c for c in df.columns if c.startswith(C.SYM_PREFIX))
    names = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in sym]))
    return df.select(*[c for c in df.columns if c not in sym], F.array_join(names, ",").alias("flags"))


FLAG_LIST = "coalesce(f.flags, '') AS flags"


@register("indicator_pivot", O.base() + " SELECT VAERS_ID, feature AS name, CAST(v AS TINYINT) AS flag FROM ("
          + O.flags_long("flag_lists") + ")")
def q_indicator_pivot(spark, sf):
    """The pivoted table, read back in long form."""
    long = P.symptom_long(fixtures.raw_symptoms(spark, sf))
    wide = R.indicator_pivot(long, R.collect_top_terms(R.topk_terms(long)))
    sym = [c for c in wide.columns if c != C.KEY]
    return wide.unpivot([C.KEY], sym, "name", "flag")


@register("top_values", O.base() + " SELECT VAX_MANU, count(*) AS n FROM vax WHERE VAX_MANU IS NOT NULL "
          "GROUP BY VAX_MANU ORDER BY n DESC, VAX_MANU ASC LIMIT 5")
def q_top_values(spark, sf):
    return R.top_values(P.vaccines_first(fixtures.raw_vaccines(spark, sf)), "VAX_MANU")


@register("dedup_first", O.base() + " SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID, " + ", ".join(
    f"{O.na(c)} AS {c}" for c in C.VACCINE_COLUMNS[1:]) + f" FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY VAERS_ID ORDER BY {O.LINE_ORDER}) AS rn FROM raw_vaccines) WHERE rn = 1")
def q_dedup_first(spark, sf):
    return R.dedup_first(P.clean_vaccines(fixtures.raw_vaccines(spark, sf)), C.KEY, "_file_pos")


# ---------------------------------------------------------------- joins

@register("left_join_flags", O.base() + f" SELECT r.*, {FLAG_LIST} "
          "FROM reports r LEFT JOIN flag_lists f ON r.VAERS_ID = f.VAERS_ID")
def q_left_join_flags(spark, sf):
    reports = P.clean_reports(fixtures.raw_reports(spark, sf))
    long = P.symptom_long(fixtures.raw_symptoms(spark, sf))
    flags = R.indicator_pivot(long, R.collect_top_terms(R.topk_terms(long)))
    sym = [c for c in flags.columns if c != C.KEY]
    return _with_flag_list(reports.join(flags, C.KEY, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("tinyint") for c in sym}))


@register("left_join_dim", O.base() + " SELECT * FROM merged_base")
def q_left_join_dim(spark, sf):
    reports = P.clean_reports(fixtures.raw_reports(spark, sf))
    return reports.join(P.vaccines_first(fixtures.raw_vaccines(spark, sf)), C.KEY, "left")


# ---------------------------------------------------------------- sampling

SMALL_TARGET = 5_000  # so that R1's cut acts on the small tables too
WIDE_SAMPLE = f" SELECT s.*, {FLAG_LIST} FROM sample_base s LEFT JOIN flag_lists f ON s.VAERS_ID = f.VAERS_ID"


@register("stratified_sample", O.base(target=SMALL_TARGET) + WIDE_SAMPLE)
def q_stratified_sample(spark, sf):
    """Every positive and seeded negatives up to the target."""
    return _with_flag_list(S.stratified_sample(materialized_merged(spark, sf), target=SMALL_TARGET))


@register("stratified_split", O.base() + " SELECT VAERS_ID, DIED, split FROM split_base")
def q_stratified_split(spark, sf):
    return _split(spark, sf).select(C.KEY, C.LABEL, "split")


@register("stratified_folds", O.base() + " SELECT VAERS_ID, DIED, fold FROM split_base WHERE split = 'train'")
def q_stratified_folds(spark, sf):
    return _split(spark, sf).where(F.col("split") == "train").select(C.KEY, C.LABEL, "fold")


@register("validation_holdout", O.base() + f"""
 SELECT VAERS_ID, rk <= CAST(floor(n * CAST({C.VALIDATION_SHARE} AS DOUBLE)) AS BIGINT) AS is_val
 FROM (SELECT VAERS_ID, row_number() OVER (ORDER BY md5(CAST(VAERS_ID AS VARCHAR) || ':val{C.SEED}'), VAERS_ID) AS rk,
              count(*) OVER () AS n FROM split_base WHERE split = 'train')""")
def q_validation_holdout(spark, sf):
    train = _split(spark, sf).where(F.col("split") == "train")
    return S.validation_holdout(train).select(C.KEY, "is_val")


@register("explain_sample", O.base() + f"""
 SELECT VAERS_ID, CAST(rk - 1 AS INTEGER) AS row_id
 FROM (SELECT VAERS_ID, row_number() OVER (ORDER BY md5(CAST(VAERS_ID AS VARCHAR) || ':explain{C.SEED}'), VAERS_ID) AS rk
       FROM split_base WHERE split = 'test') WHERE rk <= {C.EXPLAIN_ROWS}""")
def q_explain_sample(spark, sf):
    return S.explain_sample(_test_rows(spark, sf)).select(C.KEY, "row_id")


# ---------------------------------------------------------------- exploration

def _rate_sql(key: str, min_n: int | None, digits: int, src: str = "sample_base", drop_null: bool = True) -> str:
    where = f"WHERE {key} IS NOT NULL" if drop_null else ""
    having = f"HAVING count(*) >= {min_n}" if min_n is not None else ""
    return (f" SELECT {key}, avg(DIED) AS rate, count(*) AS n, {O.rnd('avg(DIED) * 100', digits)} AS rate_pct"
            f" FROM {src} {where} GROUP BY {key} {having}")


@register("rate_by_sex", O.base() + _rate_sql("SEX", C.MIN_SUPPORT["SEX"], 2))
def q_rate_by_sex(spark, sf):
    return X.rate_table(materialized_merged(spark, sf), "SEX", C.MIN_SUPPORT["SEX"])


@register("rate_by_manufacturer", O.base() + _rate_sql("VAX_MANU", C.MIN_SUPPORT["VAX_MANU"], 2))
def q_rate_by_manufacturer(spark, sf):
    return X.rate_table(materialized_merged(spark, sf), "VAX_MANU", C.MIN_SUPPORT["VAX_MANU"])


@register("rate_by_dose", O.base() + _rate_sql("VAX_DOSE_SERIES", C.MIN_SUPPORT["VAX_DOSE_SERIES"], 2))
def q_rate_by_dose(spark, sf):
    return X.rate_table(materialized_merged(spark, sf), "VAX_DOSE_SERIES",
                        C.MIN_SUPPORT["VAX_DOSE_SERIES"], order="key")


@register("rate_by_state", O.base() + _rate_sql("STATE", C.MIN_SUPPORT["STATE"], 3))
def q_rate_by_state(spark, sf):
    return X.rate_table(materialized_merged(spark, sf), "STATE", C.MIN_SUPPORT["STATE"], digits=3)


def _category_sql(key: str) -> str:
    inner = _rate_sql(key, C.MIN_SUPPORT["category"], 2)
    return O.base(f"t AS ({inner})") + (
        f" SELECT *, {O.rnd('n / sum(n) OVER () * 100', 1)} AS pct_of_total FROM t")


@register("rate_by_category", _category_sql("STATE"))
def q_rate_by_category(spark, sf):
    return X.rate_by_category(materialized_merged(spark, sf), "STATE")


@register("category_counts", _category_sql("VAX_MANU"))
def q_category_counts(spark, sf):
    return X.category_counts(materialized_merged(spark, sf), "VAX_MANU")


@register("rate_by_flag", O.base(f"t AS ({_rate_sql('HOSPITAL', None, 2, drop_null=False)})") +
          " SELECT *, CASE WHEN HOSPITAL = 1 THEN 'Yes' WHEN HOSPITAL = 0 THEN 'No / Not Reported' END AS label FROM t")
def q_rate_by_flag(spark, sf):
    return X.rate_by_flag(materialized_merged(spark, sf), "HOSPITAL")


@register("risk_ratio", O.base(f"t AS ({_rate_sql('L_THREAT', None, 2, drop_null=False)})") + """
 SELECT 'L_THREAT' AS feature, max(CASE WHEN L_THREAT = 1 THEN rate_pct END) AS yes_rate_pct,
        max(CASE WHEN L_THREAT = 0 THEN rate_pct END) AS no_rate_pct,
        max(CASE WHEN L_THREAT = 1 THEN rate_pct END) / greatest(max(CASE WHEN L_THREAT = 0 THEN rate_pct END), CAST(0.001 AS DOUBLE)) AS ratio
 FROM t""")
def q_risk_ratio(spark, sf):
    return X.risk_ratio(materialized_merged(spark, sf), "L_THREAT")


@register("kpi_summary", O.base() + """
 SELECT count(*) AS total_recs, avg(DIED) * 100 AS death_rate,
        CAST(trunc(min(AGE_YRS)) AS INTEGER) AS age_min, CAST(trunc(max(AGE_YRS)) AS INTEGER) AS age_max,
        count(DISTINCT STATE) AS n_states, CAST(sum(DIED) AS BIGINT) AS deaths,
        (SELECT count(DISTINCT name) FROM (SELECT """ + O.safe("SYMPTOM") + """ AS name FROM top_terms)) AS n_flags
 FROM sample_base""")
def q_kpi_summary(spark, sf):
    return X.kpi_summary(materialized_merged(spark, sf))


@register("flag_totals_top15", O.base(
    "names AS (SELECT DISTINCT " + O.safe("SYMPTOM") + " AS name FROM top_terms)",
    """tot AS (SELECT nm.name, count(s.VAERS_ID) AS total, coalesce(sum(s.DIED), 0) AS deaths
            FROM names nm LEFT JOIN sym_named sn ON sn.name = nm.name
            LEFT JOIN sample_base s ON s.VAERS_ID = sn.VAERS_ID GROUP BY nm.name)""",
    "top AS (SELECT * FROM tot ORDER BY total DESC, name ASC LIMIT 15)") + """
 SELECT replace(regexp_replace(name, '^SYM_', ''), '_', ' ') AS Symptom, 'All Reports' AS "Group", total AS Count FROM top
 UNION ALL
 SELECT replace(regexp_replace(name, '^SYM_', ''), '_', ' ') AS Symptom, 'Deaths' AS "Group", CAST(deaths AS BIGINT) AS Count FROM top""")
def q_flag_totals_top15(spark, sf):
    return X.flag_totals_top15(materialized_merged(spark, sf))


@register("monthly_volume", O.base(
    "c AS (SELECT RECV_YEAR_MONTH, DIED, count(*) AS Count FROM sample_base WHERE RECV_YEAR_MONTH IS NOT NULL GROUP BY 1, 2)",
    f"m AS (SELECT DISTINCT RECV_YEAR_MONTH FROM c ORDER BY 1 DESC LIMIT {C.MONTHS_SHOWN})") + """
 SELECT c.*, CASE WHEN DIED = 1 THEN 'Died' WHEN DIED = 0 THEN 'Survived' END AS Outcome
 FROM c SEMI JOIN m ON c.RECV_YEAR_MONTH = m.RECV_YEAR_MONTH""")
def q_monthly_volume(spark, sf):
    return X.monthly_volume(materialized_merged(spark, sf))


def _corr_sql() -> str:
    cols = C.HEAT_COLS
    sel = []
    for a in cols:
        for b in cols:
            sel.append(f"SELECT '{a}' AS row, '{b}' AS col, {O.r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM sample_base")
    return O.base() + " " + " UNION ALL ".join(sel)


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return X.corr_matrix(materialized_merged(spark, sf))


@register("histogram_by_label", O.base(
    f"b AS (SELECT min(AGE_YRS) AS lo, (max(AGE_YRS) - min(AGE_YRS)) / {C.AGE_BINS} AS w FROM sample_base)") + f"""
 SELECT bin, {O.r6('lo + bin * w')} AS bin_lo, {O.r6('lo + (bin + 1) * w')} AS bin_hi, DIED, n FROM (
   SELECT CAST(least(floor((AGE_YRS - lo) / w), {C.AGE_BINS - 1}) AS INTEGER) AS bin, DIED, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w
   FROM sample_base, b WHERE AGE_YRS IS NOT NULL GROUP BY 1, 2)""")
def q_histogram_by_label(spark, sf):
    return X.histogram_by_label(materialized_merged(spark, sf), "AGE_YRS", C.AGE_BINS)


def _box_sql(src_cte: str, value: str, group: str) -> str:
    return O.base(src_cte, f"""q AS (SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
              quantile_cont({value}, 0.75) AS q3 FROM src WHERE {value} IS NOT NULL GROUP BY {group})""") + f"""
 SELECT s.{group}, count(*) AS n, {O.r6('any_value(q.q1)')} AS q1, {O.r6('any_value(q.median)')} AS median,
        {O.r6('any_value(q.q3)')} AS q3,
        min(CASE WHEN s.{value} >= q.q1 - (q.q3 - q.q1) * 1.5 THEN s.{value} END) AS whisker_lo,
        max(CASE WHEN s.{value} <= q.q3 + (q.q3 - q.q1) * 1.5 THEN s.{value} END) AS whisker_hi,
        min(s.{value}) AS min, max(s.{value}) AS max
 FROM src s JOIN q ON s.{group} = q.{group} WHERE s.{value} IS NOT NULL GROUP BY s.{group}"""


@register("box_stats", _box_sql(
    "src AS (SELECT NUMDAYS, CASE WHEN DIED = 1 THEN 'Died' WHEN DIED = 0 THEN 'Survived' END AS Outcome FROM sample_base)",
    "NUMDAYS", "Outcome"))
def q_box_stats(spark, sf):
    return X.lag_box(materialized_merged(spark, sf))


OUTCOME_UNION = " UNION ALL ".join(
    f"SELECT '{lab}=' || CAST({c} AS VARCHAR) AS Outcome, AGE_YRS FROM sample_base WHERE AGE_YRS IS NOT NULL"
    for c, lab in C.OUTCOME_LABELS)


@register("outcome_unpivot", O.base() + " " + OUTCOME_UNION)
def q_outcome_unpivot(spark, sf):
    return R.outcome_unpivot(materialized_merged(spark, sf), "AGE_YRS")


@register("box_stats_outcomes", _box_sql(f"src AS ({OUTCOME_UNION})", "AGE_YRS", "Outcome"))
def q_box_stats_outcomes(spark, sf):
    return X.age_box_by_outcomes(materialized_merged(spark, sf))


DECILE_LIST = "[" + ", ".join(repr(p) for p in X.DECILES) + "]"


@register("decile_rate", O.base(
    f"e AS (SELECT list_sort(list_distinct(quantile_cont(AGE_YRS, {DECILE_LIST}))) AS edges FROM sample_base)",
    "b AS (SELECT len(list_filter(e.edges[2:], lambda x: x < s.AGE_YRS)) AS bucket, s.DIED, e.edges "
    "FROM sample_base s, e WHERE s.AGE_YRS IS NOT NULL)") + f"""
 SELECT CAST(bucket AS INTEGER) AS bucket, {O.r6('any_value(edges)[bucket + 1]')} AS lo,
        {O.r6('any_value(edges)[bucket + 2]')} AS hi, avg(DIED) AS rate, count(*) AS n,
        {O.rnd('avg(DIED) * 100', 2)} AS rate_pct
 FROM b GROUP BY bucket""")
def q_decile_rate(spark, sf):
    return X.decile_rate(materialized_merged(spark, sf), "AGE_YRS")


@register("label_location_stats", O.base() + f"""
 SELECT DIED, {O.r6('avg(AGE_YRS)')} AS mean, {O.r6('quantile_cont(AGE_YRS, 0.5)')} AS median
 FROM sample_base WHERE AGE_YRS IS NOT NULL GROUP BY DIED""")
def q_label_location_stats(spark, sf):
    return X.label_location_stats(materialized_merged(spark, sf), "AGE_YRS")


def _profile_sql(median_cols_sql: str, mode_num_sql: str | None) -> str:
    cat = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in C.CAT_FEATURES)
    flags = O.flags_long("test_rows")
    medians = f"""SELECT feature, {O.r6('quantile_cont(v, 0.5)')} AS value_num, CAST(NULL AS VARCHAR) AS value_cat FROM"""
    modes = """SELECT feature, CAST(first(v ORDER BY c DESC, v ASC) AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_cat FROM
      (SELECT feature, v, count(*) AS c FROM"""
    parts = [f"""{medians}
      (UNPIVOT (SELECT VAERS_ID, {median_cols_sql} FROM split_base WHERE split = 'test')
       ON COLUMNS(* EXCLUDE (VAERS_ID)) INTO NAME feature VALUE v) GROUP BY feature"""]
    if mode_num_sql:
        parts.append(f"""{modes}
        (UNPIVOT (SELECT VAERS_ID, {mode_num_sql} FROM split_base WHERE split = 'test')
         ON COLUMNS(* EXCLUDE (VAERS_ID)) INTO NAME feature VALUE v) GROUP BY feature, v) GROUP BY feature""")
        parts.append(f"{modes} ({flags}) GROUP BY feature, v) GROUP BY feature")
    else:
        parts.append(f"{medians} ({flags}) GROUP BY feature")
    parts.append(f"""SELECT feature, CAST(NULL AS DOUBLE) AS value_num, first(v ORDER BY c DESC, v ASC) AS value_cat FROM
      (SELECT feature, v, count(*) AS c FROM
        (UNPIVOT (SELECT VAERS_ID, {cat} FROM split_base WHERE split = 'test')
         ON COLUMNS(* EXCLUDE (VAERS_ID)) INTO NAME feature VALUE v) GROUP BY feature, v) GROUP BY feature""")
    return O.base("test_rows AS (SELECT VAERS_ID FROM split_base WHERE split = 'test')") + " " + " UNION ALL ".join(parts)


_NUMS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.NUM_FEATURES)
_BINS_D = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.BIN_COLS)
_BINS_S = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in C.BIN_COLS)


@register("profile_row", _profile_sql(f"{_NUMS}, {_BINS_D}", None))
def q_profile_row(spark, sf):
    t = _test_rows(spark, sf)
    sym = [c for c in t.columns if c.startswith(C.SYM_PREFIX)]
    return X.profile_row(t, C.NUM_FEATURES + C.BIN_COLS + sym, C.CAT_FEATURES)


@register("profile_row_mode_flags", _profile_sql(_NUMS, _BINS_S))
def q_profile_row_mode_flags(spark, sf):
    t = _test_rows(spark, sf)
    sym = [c for c in t.columns if c.startswith(C.SYM_PREFIX)]
    return X.profile_row(t, C.NUM_FEATURES, C.CAT_FEATURES, C.BIN_COLS + sym)


@register("distinct_sorted", O.base() + " SELECT DISTINCT VAX_MANU FROM sample_base WHERE VAX_MANU IS NOT NULL")
def q_distinct_sorted(spark, sf):
    return X.distinct_sorted(materialized_merged(spark, sf), "VAX_MANU")


@register("linear_grid", O.base(
    f"q AS (SELECT quantile_cont(AGE_YRS, {C.GRID_LOW_Q}) AS lo, quantile_cont(AGE_YRS, {C.GRID_HIGH_Q}) AS hi "
    "FROM split_base WHERE split = 'test')") + f"""
 SELECT CAST(i AS INTEGER) AS i, {O.r6(f'CASE WHEN i = {C.GRID_POINTS - 1} THEN hi ELSE lo + i * ((hi - lo) / {C.GRID_POINTS - 1}) END')} AS value
 FROM q, range(0, {C.GRID_POINTS}) r(i)""")
def q_linear_grid(spark, sf):
    return X.linear_grid(_test_rows(spark, sf), "AGE_YRS")


# ---------------------------------------------------------------- evaluation
# Checked on fixed-formula scores (plans/formula.py) so SQL can follow;
# the same functions evaluate the fitted Spark ML models (see models.py).

from vigilo.operators import evaluate as E  # noqa: E402
from vigilo.plans.formula import formula_scores, formula_sql  # noqa: E402


def _scored(spark, sf, split="test"):
    return formula_scores(_split(spark, sf).where(F.col("split") == split))


SCORED_TEST = f"scored AS ({formula_sql(chr(10) + 'split_base WHERE split = ' + repr('test'))})"
SCORED_TRAIN = f"scored AS ({formula_sql(chr(10) + 'split_base WHERE split = ' + repr('train'))})"


def _cm_sql(g: str) -> str:
    return (f"SELECT {g}, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, "
            f"count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp "
            f"FROM scored GROUP BY {g}")


def _div0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE ({a}) / ({b}) END)"


def _metrics_sql(g: str) -> str:
    return (f"SELECT {g}, {O.r6('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {O.r6(_div0('tp', 'tp + fp'))} AS precision, "
            f"{O.r6(_div0('tp', 'tp + fn'))} AS recall, {O.r6(_div0('2 * tp', '2 * tp + fp + fn'))} AS f1, "
            f"{O.r6(_div0('tn', 'tn + fp'))} AS specificity FROM ({_cm_sql(g)})")


def _cum_sql(g: str) -> str:
    return f"""steps AS (SELECT {g}, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY {g}, p),
cum AS (SELECT *, sum(pos) OVER w AS pos_cum, sum(neg) OVER w AS neg_cum,
               sum(pos) OVER (PARTITION BY {g}) AS n_pos, sum(neg) OVER (PARTITION BY {g}) AS n_neg
        FROM steps WINDOW w AS (PARTITION BY {g} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _ranking_sql(g: str) -> str:
    auc = "sum(neg * (pos_cum - pos + pos / 2)) / (CAST(any_value(n_pos) AS DOUBLE) * any_value(n_neg))"
    return (f"SELECT {g}, {O.r6(f'CASE WHEN any_value(n_pos) > 0 AND any_value(n_neg) > 0 THEN {auc} END')} AS roc_auc, "
            f"{O.r6('CASE WHEN any_value(n_pos) > 0 THEN sum(pos * (pos_cum / (pos_cum + neg_cum))) / any_value(n_pos) END')} "
            f"AS avg_precision FROM cum GROUP BY {g}")


LOGLOSS_SQL = ("SELECT model, " + O.r6("avg(-(y * ln(pc) + (1 - y) * ln(1 - pc)))") + " AS log_loss_val FROM "
               "(SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS pc FROM scored) GROUP BY model")
TEST_METRICS_SQL = (f"tm AS (SELECT * FROM ({_metrics_sql('model')}) a JOIN ({_ranking_sql('model')}) b USING (model) "
                    f"JOIN ({LOGLOSS_SQL}) c USING (model))")
LABEL_SQL = ("(CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MODEL_LABELS.items())
             + " ELSE array_to_string(list_transform(string_split(replace(model, '_', ' '), ' '), "
               "lambda w: upper(w[1]) || lower(w[2:])), ' ') END)")


@register("confusion", O.base(SCORED_TEST) + " " + _cm_sql("model"))
def q_confusion(spark, sf):
    return E.confusion(_scored(spark, sf))


@register("class_metrics", O.base(SCORED_TEST) + " " + _metrics_sql("model"))
def q_class_metrics(spark, sf):
    return E.class_metrics(_scored(spark, sf))


@register("roc_auc", O.base(SCORED_TEST, _cum_sql("model")) + " SELECT model, roc_auc FROM (" + _ranking_sql("model") + ")")
def q_roc_auc(spark, sf):
    return E.ranking_metrics(_scored(spark, sf)).select("model", "roc_auc")


@register("average_precision", O.base(SCORED_TEST, _cum_sql("model")) + " SELECT model, avg_precision FROM (" + _ranking_sql("model") + ")")
def q_average_precision(spark, sf):
    return E.ranking_metrics(_scored(spark, sf)).select("model", "avg_precision")


@register("log_loss", O.base(SCORED_TEST) + " " + LOGLOSS_SQL)
def q_log_loss(spark, sf):
    return E.log_loss(_scored(spark, sf))


@register("roc_points", O.base(SCORED_TEST, _cum_sql("model"), """idx AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY model) AS last_i,
         lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg FROM cum WINDOW w AS (PARTITION BY model ORDER BY p DESC))""") + f"""
 SELECT model, {O.r6('neg_cum / n_neg')} AS fpr, {O.r6('pos_cum / n_pos')} AS tpr, {O.r6('p')} AS threshold FROM idx
 WHERE i = 1 OR i = last_i OR npos <> pos OR nneg <> neg
 UNION ALL SELECT DISTINCT model, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM steps""")
def q_roc_points(spark, sf):
    return E.roc_points(_scored(spark, sf))


@register("pr_points", O.base(SCORED_TEST, _cum_sql("model")) + f"""
 SELECT model, {O.r6('pos_cum / (pos_cum + neg_cum)')} AS precision, {O.r6('pos_cum / n_pos')} AS recall, {O.r6('p')} AS threshold
 FROM cum WHERE pos_cum - pos < n_pos
 UNION ALL SELECT DISTINCT model, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM steps""")
def q_pr_points(spark, sf):
    return E.pr_points(_scored(spark, sf))


FOLDS_SQL = ("folds AS (UNPIVOT (SELECT * EXCLUDE (specificity, avg_precision) FROM (" + _metrics_sql("model, fold")
             + ") a JOIN (" + _ranking_sql("model, fold") + ") b USING (model, fold)) "
             "ON accuracy, precision, recall, f1, roc_auc INTO NAME metric VALUE value)")


@register("cv_scores", O.base(SCORED_TRAIN, _cum_sql("model, fold"), FOLDS_SQL) + " SELECT * FROM folds")
def q_cv_scores(spark, sf):
    return E.fold_scores(_scored(spark, sf, "train"))


@register("cv_summary", O.base(SCORED_TRAIN, _cum_sql("model, fold"), FOLDS_SQL) +
          f" SELECT model, metric, {O.r6('avg(value)')} AS mean, {O.r6('stddev_pop(value)')} AS std FROM folds GROUP BY model, metric")
def q_cv_summary(spark, sf):
    return E.cv_summary(E.fold_scores(_scored(spark, sf, "train")))


@register("cv_box")
def q_cv_box(spark, sf):
    return E.cv_box(E.fold_scores(_scored(spark, sf, "train")))


SQL["cv_box"] = (O.base(SCORED_TRAIN, _cum_sql("model, fold"), FOLDS_SQL,
                        "src AS (SELECT model, value FROM folds WHERE metric = 'roc_auc')",
                        """q AS (SELECT model, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM src GROUP BY model)""") + f"""
 SELECT s.model, count(*) AS n, {O.r6('any_value(q.q1)')} AS q1, {O.r6('any_value(q.median)')} AS median, {O.r6('any_value(q.q3)')} AS q3,
        min(CASE WHEN s.value >= q.q1 - (q.q3 - q.q1) * 1.5 THEN s.value END) AS whisker_lo,
        max(CASE WHEN s.value <= q.q3 + (q.q3 - q.q1) * 1.5 THEN s.value END) AS whisker_hi,
        min(s.value) AS min, max(s.value) AS max
 FROM src s JOIN q ON s.model = q.model GROUP BY s.model""")


@register("test_metrics", O.base(SCORED_TEST, _cum_sql("model"), TEST_METRICS_SQL) + " SELECT * EXCLUDE (specificity) FROM tm")
def q_test_metrics(spark, sf):
    return E.test_metrics(_scored(spark, sf))


@register("leaderboard", O.base(SCORED_TEST, _cum_sql("model"), TEST_METRICS_SQL) + " SELECT " + LABEL_SQL + " AS Model, "
          + ", ".join(f"{O.rnd(c, 4)} AS {c}" for c in
                      ["roc_auc", "avg_precision", "f1", "precision", "recall", "accuracy", "log_loss_val"]) + " FROM tm")
def q_leaderboard(spark, sf):
    return E.leaderboard(E.test_metrics(_scored(spark, sf)))


@register("best_model", O.base(SCORED_TEST, _cum_sql("model"), TEST_METRICS_SQL) +
          " SELECT model AS best_model, roc_auc AS best_auc FROM tm ORDER BY roc_auc DESC, model ASC LIMIT 1")
def q_best_model(spark, sf):
    return E.best_model(E.test_metrics(_scored(spark, sf)))


@register("metric_bars", O.base(SCORED_TEST, _cum_sql("model"), TEST_METRICS_SQL) +
          " SELECT " + LABEL_SQL + " AS Model, 'roc_auc' AS metric, roc_auc AS value FROM tm UNION ALL SELECT "
          + LABEL_SQL + " AS Model, 'f1' AS metric, f1 AS value FROM tm")
def q_metric_bars(spark, sf):
    return E.metric_bars(E.test_metrics(_scored(spark, sf)))


@register("label_lookup", O.base(SCORED_TEST) + " SELECT DISTINCT model, " + LABEL_SQL + " AS label FROM scored")
def q_label_lookup(spark, sf):
    from vigilo.functions.clean import model_label
    return _scored(spark, sf).select("model").distinct().select("model", model_label("model").alias("label"))


# ---------------------------------------------------------------- features (M1–M8)

from vigilo.plans import features as FT  # noqa: E402
from vigilo.plans import models as M  # noqa: E402
from vigilo.plans import workflow as WF  # noqa: E402
from vigilo.functions.clean import r6  # noqa: E402

TRAIN = "split_base WHERE split = 'train'"
NUM_LIST = ", ".join(C.NUM_FEATURES)
MED_SQL = (f"tr_num AS (SELECT {NUM_LIST} FROM {TRAIN}), med AS (SELECT feature, quantile_cont(v, 0.5) AS med FROM (UNPIVOT (SELECT {NUM_LIST} FROM {TRAIN}) "
           f"ON {NUM_LIST} INTO NAME feature VALUE v) GROUP BY feature)")
STD_SQL = (f"std AS (SELECT l.feature, avg(coalesce(l.v, m.med)) AS mean, "
           f"CASE WHEN coalesce(stddev_pop(coalesce(l.v, m.med)), 0) = 0 THEN 1 ELSE stddev_pop(coalesce(l.v, m.med)) END AS std "
           f"FROM (SELECT * FROM tr_num UNPIVOT INCLUDE NULLS (v FOR feature IN ({NUM_LIST}))) l "
           f"JOIN med m ON l.feature = m.feature GROUP BY l.feature)")
CAT_FILLED = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in C.CAT_FEATURES)
CAT_LIST = ", ".join(C.CAT_FEATURES)
KEPT_SQL = (f"kept AS (SELECT feature, category FROM (SELECT feature, category, row_number() OVER "
            f"(PARTITION BY feature ORDER BY category) AS r FROM (SELECT DISTINCT feature, category FROM "
            f"(UNPIVOT (SELECT {CAT_FILLED} FROM {TRAIN}) ON {CAT_LIST} INTO NAME feature VALUE category))) WHERE r > 1)")


def _prep_model(spark, sf):
    return WF.shared_preparation(spark, sf)


@register("impute_median", O.base(MED_SQL) + f" SELECT feature, {O.r6('med')} AS median FROM med")
def q_impute_median(spark, sf):
    pm = _prep_model(spark, sf)
    rows = list(zip(pm.getOrDefault("numCols"), pm.getOrDefault("medians")))
    return spark.createDataFrame(rows, "feature string, median double").select("feature", r6("median").alias("median"))


@register("standardise", O.base(MED_SQL, STD_SQL) + f" SELECT feature, {O.r6('mean')} AS mean, {O.r6('std')} AS std FROM std")
def q_standardise(spark, sf):
    pm = _prep_model(spark, sf)
    rows = list(zip(pm.getOrDefault("numCols"), pm.getOrDefault("means"), pm.getOrDefault("stds")))
    return spark.createDataFrame(rows, "feature string, mean double, std double").select(
        "feature", r6("mean").alias("mean"), r6("std").alias("std"))


@register("one_hot_drop_first", O.base(KEPT_SQL) + " SELECT feature, category, feature || '_' || category AS column_name FROM kept")
def q_one_hot_drop_first(spark, sf):
    pm = _prep_model(spark, sf)
    cats = pm.category_map()
    rows = [(c, v, f"{c}_{v}") for c in pm.getOrDefault("catCols") for v in cats.get(c, [])[1:]]
    return spark.createDataFrame(rows, "feature string, category string, column_name string")


_BIN_D = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.BIN_COLS)


@register("feature_matrix", O.base(MED_SQL, STD_SQL, KEPT_SQL) + f""",
te_num AS (SELECT VAERS_ID, {NUM_LIST} FROM split_base WHERE split = 'test'),
te_bin AS (SELECT VAERS_ID, {_BIN_D} FROM split_base WHERE split = 'test'),
te_rows AS (SELECT VAERS_ID FROM te_num)
 SELECT l.VAERS_ID, l.feature, {O.r6('(coalesce(l.v, m.med) - s.mean) / s.std')} AS value
 FROM (SELECT * FROM te_num UNPIVOT INCLUDE NULLS (v FOR feature IN ({NUM_LIST}))) l
 JOIN med m ON l.feature = m.feature JOIN std s ON l.feature = s.feature
 UNION ALL
 SELECT VAERS_ID, feature, {O.r6('coalesce(v, 0)')} AS value
 FROM (SELECT * FROM te_bin UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (VAERS_ID)))))
 UNION ALL
 SELECT VAERS_ID, feature, CAST(v AS DOUBLE) AS value FROM ({O.flags_long('te_rows')})
 UNION ALL
 SELECT t.VAERS_ID, k.feature || '_' || k.category AS feature, CAST(t.category = k.category AS DOUBLE) AS value
 FROM (UNPIVOT (SELECT VAERS_ID, {CAT_FILLED} FROM split_base WHERE split = 'test') ON {CAT_LIST}
       INTO NAME feature VALUE category) t JOIN kept k ON t.feature = k.feature""")
def q_feature_matrix(spark, sf):
    pm = _prep_model(spark, sf)
    return pm.long(WF.test_rows(spark, sf)).select(C.KEY, "feature", r6("value").alias("value"))


@register("balanced_weights", O.base() + f"""
 SELECT DIED, n / (CAST(2 AS DOUBLE) * n_c) AS weight FROM (
   SELECT DIED, count(*) AS n_c, sum(count(*)) OVER () AS n FROM {TRAIN} GROUP BY DIED)""")
def q_balanced_weights(spark, sf):
    return FT.balanced_weights(WF.train_rows(spark, sf)).select(C.LABEL, "weight").distinct()


@register("unbalance_weights", O.base() + f"""
 SELECT CAST(1 AS TINYINT) AS DIED, count(*) FILTER (WHERE DIED = 0) / CAST(count(*) FILTER (WHERE DIED = 1) AS DOUBLE) AS weight FROM {TRAIN}
 UNION ALL SELECT CAST(0 AS TINYINT) AS DIED, CAST(1 AS DOUBLE) AS weight""")
def q_unbalance_weights(spark, sf):
    return FT.unbalance_weights(WF.train_rows(spark, sf)).select(C.LABEL, "weight").distinct()


# ---------------------------------------------------------------- models (C1–C8, C12, C13; rows-only)

def _fit_query(name):
    def q(spark, sf):
        return E.test_metrics(WF.scored_by(spark, sf, name))
    q.__name__ = f"q_fit_{name}"
    return q


for _key, _name in [("fit_logistic", "logistic"), ("fit_ridge", "ridge"), ("fit_lasso", "lasso"),
                    ("fit_cart", "cart"), ("fit_forest", "random_forest"),
                    ("fit_boosted", "lightgbm"), ("fit_mlp", "mlp")]:
    register(_key)(_fit_query(_name))


@register("score")
def q_score(spark, sf):
    return WF.scored_test(spark, sf, ("logistic", "lightgbm"))


@register("coefficients")
def q_coefficients(spark, sf):
    return M.coefficients(spark, {n: WF.fitted(spark, sf, n) for n in M.LINEAR})


@register("top_coefficients")
def q_top_coefficients(spark, sf):
    return M.top_by_rank(q_coefficients(spark, sf))


@register("zero_coef_share")
def q_zero_coef_share(spark, sf):
    return X.zero_coef_share(q_coefficients(spark, sf))


@register("importances")
def q_importances(spark, sf):
    return M.importances(spark, {n: WF.fitted(spark, sf, n) for n in M.TREES})


@register("top_importances")
def q_top_importances(spark, sf):
    return M.top_by_rank(q_importances(spark, sf))


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    return E.leaderboard(E.test_metrics(WF.scored_test(spark, sf)))


# ---------------------------------------------------------------- attributions

from vigilo.operators import explain as XP  # noqa: E402
from vigilo.plans.formula import (  # noqa: E402
    INTERCEPTS, formula_inputs, formula_inputs_sql, formula_weights, formula_weights_sql)

EX_SQL = (f"ex AS (SELECT *, CAST(rk - 1 AS INTEGER) AS row_id FROM (SELECT *, row_number() OVER (ORDER BY "
          f"md5(CAST(VAERS_ID AS VARCHAR) || ':explain{C.SEED}'), VAERS_ID) AS rk FROM split_base WHERE split = 'test') "
          f"WHERE rk <= {C.EXPLAIN_ROWS})")
ATTR_SQL = [EX_SQL, f"vals AS ({formula_inputs_sql('ex')})", f"w AS ({formula_weights_sql()})",
            "m AS (SELECT feature, avg(value) AS mean FROM vals GROUP BY feature)",
            "attr AS (SELECT v.row_id, v.feature, v.value, w.weight * (v.value - m.mean) AS shap "
            "FROM vals v JOIN m ON v.feature = m.feature JOIN w ON v.feature = w.feature)",
            f"base AS (SELECT CAST({INTERCEPTS['formula_age']} AS DOUBLE) + sum(w.weight * m.mean) AS base "
            "FROM m JOIN w ON m.feature = w.feature)"]


def _linear_attr(spark, sf):
    rows = WF.explain_rows(spark, sf)
    vals = formula_inputs(rows)
    w = formula_weights(spark)
    return XP.linear_attributions(vals, w), XP.linear_base(vals, w, INTERCEPTS["formula_age"])


@register("linear_attributions", O.base(*ATTR_SQL) +
          f" SELECT row_id, feature, {O.r6('value')} AS value, {O.r6('shap')} AS shap FROM attr")
def q_linear_attributions(spark, sf):
    a, _ = _linear_attr(spark, sf)
    return a.select("row_id", "feature", r6("value").alias("value"), r6("shap").alias("shap"))


@register("mean_abs_attribution", O.base(*ATTR_SQL) +
          f" SELECT feature, {O.r6('avg(abs(shap))')} AS mean_abs_shap FROM attr GROUP BY feature "
          f"ORDER BY avg(abs(shap)) DESC, feature LIMIT {C.TOP_FEATURES}")
def q_mean_abs_attribution(spark, sf):
    a, _ = _linear_attr(spark, sf)
    return XP.mean_abs_attribution(a).select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@register("attribution_pairs", O.base(*ATTR_SQL) + f"""
 SELECT p.row_id, {O.r6('p.value')} AS x, {O.r6('p.shap')} AS shap, {O.r6('c.value')} AS color
 FROM attr p JOIN attr c ON p.row_id = c.row_id WHERE p.feature = 'AGE_YRS' AND c.feature = 'HOSPITAL'""")
def q_attribution_pairs(spark, sf):
    a, _ = _linear_attr(spark, sf)
    return XP.attribution_pairs(a, "AGE_YRS", "HOSPITAL").select(
        "row_id", r6("x").alias("x"), r6("shap").alias("shap"), r6("color").alias("color"))


K_WF = C.WATERFALL_ROWS


@register("waterfall", O.base(*ATTR_SQL,
    "r AS (SELECT *, row_number() OVER (ORDER BY abs(shap) DESC, feature) AS rank FROM attr WHERE row_id = 0)",
    f"""bars AS (SELECT row_id, CAST(rank AS INTEGER) AS rank, feature, value, shap FROM r WHERE rank < {K_WF}
             UNION ALL SELECT row_id, {K_WF}, count(*) || ' other features', CAST(NULL AS DOUBLE), sum(shap)
             FROM r WHERE rank >= {K_WF} GROUP BY row_id)""",
    "st AS (SELECT b.*, base.base + sum(shap) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM bars b, base)")
    + f" SELECT row_id, rank, feature, {O.r6('value')} AS value, {O.r6('shap')} AS shap, {O.r6('e - shap')} AS start, {O.r6('e')} AS \"end\" FROM st")
def q_waterfall(spark, sf):
    a, base = _linear_attr(spark, sf)
    return XP.waterfall(a, base, 0)


@register("force_split", O.base(*ATTR_SQL) + f"""
 SELECT row_id, feature, {O.r6('value')} AS value, {O.r6('shap')} AS shap,
        CASE WHEN shap > 0 THEN 'higher' WHEN shap < 0 THEN 'lower' ELSE 'none' END AS direction
 FROM attr WHERE row_id = 0""")
def q_force_split(spark, sf):
    a, _ = _linear_attr(spark, sf)
    return XP.force_split(a, 0)


@register("attribution_long", O.base(*ATTR_SQL,
    f"top AS (SELECT feature FROM attr GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT {C.TOP_FEATURES})")
    + f" SELECT a.feature, a.row_id, {O.r6('a.value')} AS value, {O.r6('a.shap')} AS shap FROM attr a SEMI JOIN top t ON a.feature = t.feature")
def q_attribution_long(spark, sf):
    a, _ = _linear_attr(spark, sf)
    return XP.attribution_long(a).select("feature", "row_id", r6("value").alias("value"), r6("shap").alias("shap"))


def tree_attr(spark, sf, only=None):
    m = WF.fitted(spark, sf, "lightgbm")
    rows = WF.explain_rows(spark, sf)
    rows = m.stages[0].transform(rows if only is None else rows.where(F.col("row_id") == only))
    return XP.tree_attributions(spark, m.stages[-1], rows, M.feature_names(m))


@register("tree_attributions")
def q_tree_attributions(spark, sf):
    a, base = tree_attr(spark, sf)
    return a.withColumn("base", F.lit(base))


@register("attribution_by_raw_feature")
def q_attribution_by_raw_feature(spark, sf):
    a, _ = tree_attr(spark, sf)
    raw = WF.fitted(spark, sf, "lightgbm").stages[0].raw_feature_of()
    raw_map = spark.createDataFrame(list(raw.items()), "feature string, raw_feature string")
    return XP.attribution_by_raw_feature(a, raw_map)


@register("tree_mean_abs_attribution")
def q_tree_mean_abs_attribution(spark, sf):
    a, _ = tree_attr(spark, sf)
    return XP.mean_abs_attribution(a)


@register("tree_waterfall")
def q_tree_waterfall(spark, sf):
    a, base = tree_attr(spark, sf, only=0)
    return XP.waterfall(a, base, 0)


# ---------------------------------------------------------------- what-if, dependence

from vigilo.plans import whatif as WI  # noqa: E402
from vigilo.plans import tuning as TU  # noqa: E402
from vigilo.sources import artifacts as AR  # noqa: E402
from vigilo.sources import csv_scan as CS  # noqa: E402
from vigilo.session import scratch_path  # noqa: E402


def _scenarios(spark, sf):
    """Scenario overrides drawn from the data: every observed (SEX, dose) pair."""
    t = WF.test_rows(spark, sf)
    return (t.select("SEX", "VAX_DOSE_SERIES").distinct()
             .withColumn("scenario", F.concat_ws("|", F.coalesce("SEX", F.lit("?")),
                                                 F.coalesce("VAX_DOSE_SERIES", F.lit("?")))))


@register("what_if")
def q_what_if(spark, sf):
    t = WF.test_rows(spark, sf)
    prof = WI.profile_values(t)
    return WI.what_if(WF.fitted(spark, sf, "lightgbm"), "lightgbm", _scenarios(spark, sf), prof, t.schema)


@register("what_if_attributions")
def q_what_if_attributions(spark, sf):
    t = WF.test_rows(spark, sf)
    m = WF.fitted(spark, sf, "lightgbm")
    rows = WI.apply_profile(_scenarios(spark, sf), WI.profile_values(t), t.schema)
    # scenarios are the observed (SEX, dose) pairs: a handful of rows
    rows = rows.withColumn("row_id", (F.dense_rank().over(Window.orderBy("scenario")) - 1).cast("int"))
    attr, base = XP.tree_attributions(spark, m.stages[-1], m.stages[0].transform(rows), M.feature_names(m))
    return XP.waterfall(attr, base, 0, C.WHATIF_WATERFALL_ROWS)


@register("dependence_curve")
def q_dependence_curve(spark, sf):
    t = WF.test_rows(spark, sf)
    m = WF.fitted(spark, sf, "lightgbm")
    parts = [WI.dependence_curve(m, "lightgbm", t, f) for f in ("AGE_YRS", "SEX", "HOSPITAL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- CV, grid search, history

_CV: dict = {}
CV_MODELS = tuple(m for m in M.ALL_MODELS if m != "mlp")     # as the reference cross-validates


def cv_scored(spark, sf):
    """Out-of-fold scores of the models: five fits each, written once."""
    key = (spark.sparkContext.applicationId, WF.input_signature(spark, sf), "scored")
    if key not in _CV:
        train = WF.train_rows(spark, sf)
        folds = TU.Folds(train)
        try:
            parts = [TU.cross_validate(train, name, folds=folds) for name in CV_MODELS]
        finally:
            folds.close()
        _CV[key] = reduce(DataFrame.unionByName, parts)
    return _CV[key]


@register("cv_model_scores")
def q_cv_model_scores(spark, sf):
    key = (spark.sparkContext.applicationId, WF.input_signature(spark, sf))
    if key not in _CV:                                  # shared with the summary
        folds = E.fold_scores(cv_scored(spark, sf))
        _CV[key] = spark.createDataFrame(folds.collect(), folds.schema)   # models × folds × 5 metric rows
    return _CV[key]


@register("cv_model_summary")
def q_cv_model_summary(spark, sf):
    return E.cv_summary(q_cv_model_scores(spark, sf))


_GRID: dict = {}


def _grid(spark, sf, name):
    """A model's grid search, made when a query first asks for it."""
    key = (spark.sparkContext.applicationId, WF.input_signature(spark, sf), name)
    if key not in _GRID:
        _GRID[key] = TU.grid_search(spark, WF.train_rows(spark, sf), name)
    return _GRID[key]


def _grid_rows(spark, sf):
    parts = [_grid(spark, sf, name)[0] for name in M.TREES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("grid_search")
def q_grid_search(spark, sf):
    return _grid_rows(spark, sf)


@register("grid_refit")
def q_grid_refit(spark, sf):
    scored = None
    for name in M.TREES:
        s = M.score(_grid(spark, sf, name)[1], WF.test_rows(spark, sf), name)
        scored = s if scored is None else scored.unionByName(s)
    return E.test_metrics(scored)


@register("grid_top5")
def q_grid_top5(spark, sf):
    return TU.grid_top5(_grid(spark, sf, "lightgbm")[0])


@register("grid_pivot")
def q_grid_pivot(spark, sf):
    return TU.grid_pivot(_grid(spark, sf, "cart")[0])


@register("grid_best")
def q_grid_best(spark, sf):
    return TU.grid_best(_grid_rows(spark, sf))


def _history(spark, sf):
    return TU.boosting_history(spark, *WF.held_out(spark, sf, "lightgbm"))


@register("training_history")
def q_training_history(spark, sf):
    return _history(spark, sf)


@register("best_epoch")
def q_best_epoch(spark, sf):
    return E.best_epoch(q_mlp_history(spark, sf))


@register("early_stop_epoch")
def q_early_stop_epoch(spark, sf):
    return E.early_stop_epoch(q_mlp_history(spark, sf))


# ---------------------------------------------------------------- sources and sinks

@register("scan_reports", O.base() + " SELECT * FROM reports")
def q_scan_reports(spark, sf):
    """Reports written as CSV to the shared scratch folder and scanned back."""
    path = scratch_path(spark, "reports-csv")
    CS.write_extract(fixtures.raw_reports(spark, sf), path)
    return P.clean_reports(CS.scan_reports(spark, path))


@register("sample_roundtrip", O.base() + WIDE_SAMPLE)
def q_sample_roundtrip(spark, sf):
    """S4 + S6: the sample written as Parquet and read back."""
    path = scratch_path(spark, "sample")
    AR.write_table(materialized_merged(spark, sf), path)
    return _with_flag_list(AR.read_table(spark, path))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """A fitted pipeline saved, loaded, and used to score the test rows."""
    path = scratch_path(spark, "model")
    AR.save_model(WF.fitted(spark, sf, "logistic"), path)
    return M.score(AR.load_model(path), WF.test_rows(spark, sf), "logistic")


@register("results_upsert")
def q_results_upsert(spark, sf):
    """S8 + S9: all models' metrics written, then one model's rows rewritten."""
    path = scratch_path(spark, "metrics")
    first = E.test_metrics(WF.scored_test(spark, sf, ("logistic", "ridge", "cart")))
    AR.upsert_results(first, path)
    AR.upsert_results(E.test_metrics(WF.scored_test(spark, sf, ("ridge",))).withColumn("accuracy", F.lit(-1.0)), path)
    return AR.read_table(spark, path)


@register("artifact_check", O.base() + " SELECT DIED, count(*) AS count, CAST(0 AS BIGINT) AS history_rows "
          "FROM sample_base GROUP BY DIED")
def q_artifact_check(spark, sf):
    """Required artifacts verified; an optional one falls back to empty."""
    path = scratch_path(spark, "artifacts")
    AR.write_table(materialized_merged(spark, sf), f"{path}/sample")
    AR.require_artifacts(spark, [f"{path}/sample"])
    hist = AR.optional_table(spark, f"{path}/history", "model string, epoch int, val_loss double")
    return AR.read_table(spark, f"{path}/sample").groupBy(C.LABEL).count().withColumn(
        "history_rows", F.lit(hist.count()).cast("bigint"))


@register("tree_rules")
def q_tree_rules(spark, sf):
    m = WF.fitted(spark, sf, "cart")
    return AR.tree_rules(spark, m.stages[-1], M.feature_names(m))



# ---------------------------------------------------------------- more scans and the explorer menu

def _catalogue_sql() -> str:
    fixed = ([(c, C.EXPLORER_KINDS["num"]) for c in C.EXPLORER_NUM] + [(c, C.EXPLORER_KINDS["cat"]) for c in C.EXPLORER_CAT]
             + [(c, C.EXPLORER_KINDS["bin"]) for c in C.EXPLORER_BIN])
    vals = ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(fixed))
    n = len(fixed)
    return O.base() + f""" SELECT * FROM (VALUES {vals}) t(position, feature, kind)
 UNION ALL SELECT CAST({n} - 1 + row_number() OVER (ORDER BY name) AS INTEGER), name, '{C.EXPLORER_KINDS["sym"]}'
 FROM (SELECT DISTINCT {O.safe("SYMPTOM")} AS name FROM top_terms)"""


@register("feature_catalogue", _catalogue_sql())
def q_feature_catalogue(spark, sf):
    return X.feature_catalogue(materialized_merged(spark, sf))


@register("scan_symptoms", O.base() + " SELECT VAERS_ID, SYMPTOM FROM sym_long")
def q_scan_symptoms(spark, sf):
    """Symptoms written as CSV, scanned back by name, unpivoted."""
    path = scratch_path(spark, "symptoms-csv")
    CS.write_extract(fixtures.raw_symptoms(spark, sf), path)
    return P.symptom_long(CS.scan_symptoms(spark, path))


@register("scan_vaccines_first", O.base() + " SELECT * FROM vax")
def q_scan_vaccines_first(spark, sf):
    """S3 + D1: vaccines written as CSV in file-position order (range-sorted,
    several files), scanned back with their true file order, first row per
    report kept, manufacturer normalised."""
    path = scratch_path(spark, "vaccines-csv")
    raw = fixtures.raw_vaccines(spark, sf)
    CS.write_extract(raw.orderBy("_file_pos").select(*C.VACCINE_COLUMNS), path)
    scanned = CS.scan_vaccines(spark, path)
    return P.vaccines_first(scanned)


# ---------------------------------------------------------------- second labelled set (NULL labels)

from vigilo.sources.tables import table as _table  # noqa: E402


@register("rate_by_source_docs", O.with_("""t AS (
  SELECT d.source, avg(l.toxic) AS rate, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.source IS NOT NULL GROUP BY d.source HAVING count(*) >= 20)""") +
          f" SELECT source, rate, n, {O.rnd('rate * 100', 2)} AS rate_pct FROM t")
def q_rate_by_source_docs(spark, sf):
    """A4 on documents ⟕ labels: unlabelled rows count in n, not in the rate
    (mean over non-NULL labels, size over all rows)."""
    docs = _table(spark, sf, "documents", "doc_id", "source")
    labels = _table(spark, sf, "labels", "doc_id", "toxic")
    return X.rate_table(docs.join(labels, "doc_id", "left"), "source", C.MIN_SUPPORT["category"],
                        label="toxic")


# ---------------------------------------------------------------- the training job and the network history

@register("export_artifacts")
def q_export_artifacts(spark, sf):
    """S4–S9 end to end: all models fitted, six cross-validated, three tuned,
    evaluated, explained, persisted; lists the written tables with their row
    counts. Fits that the session has made on this split are not made again."""
    from vigilo.plans.training import run_training
    ready = {"models": {name: WF.fitted(spark, sf, name) for name in M.ALL_MODELS}, "grids": {name: _grid(spark, sf, name) for name in M.TREES},
             "cv": q_cv_model_scores(spark, sf)}
    return run_training(spark, sf, scratch_path(spark, "training"), grids=dict.fromkeys(M.TREES), ready=ready)


@register("mlp_history")
def q_mlp_history(spark, sf):
    """C14 for the network: loss, accuracy and AUC of each epoch."""
    return M.training_history(spark, WF.fitted(spark, sf, "mlp"), "mlp")



@register("split_importances")
def q_split_importances(spark, sf):
    """C12 as split counts for the boosted model."""
    return M.split_importances(spark, "lightgbm", WF.fitted(spark, sf, "lightgbm"))


from vigilo import catalog_derived  # noqa: E402, F401  (registers its queries)
from vigilo import catalog_checks  # noqa: E402, F401
