"""DuckDB twins of the Spark plans, used as the correctness oracle.

``WITH`` clauses here rebuild, step for step, the stand-in extracts
(:mod:`vigilo.sources.fixtures`) and the ETL (:mod:`vigilo.plans.sample`)
over the driver's tables, written the plain way (window functions over
whole classes, ``quantile_cont``) so that they check
the distributed Spark forms independently.

Rules: every output column is aliased to the Spark name; doubles computed
by summation are rounded with ``round_even(x*1e6, 0)/1e6`` on both sides;
decimal literals are cast to DOUBLE so the arithmetic matches Spark's.
"""

from __future__ import annotations

from vigilo import config as C

NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in C.NA_TOKENS)
LINE_ORDER = ("l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, "
              "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus")
UNSAFE = "[" + "".join(ch for ch in C.SAFE_NAME_CHARS if ch != "-").replace("'", "''") + "-]"


def na(x: str) -> str:
    return f"(CASE WHEN {x} IN ({NA_LIST}) THEN NULL ELSE {x} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def yes(x: str) -> str:
    return f"CAST(CASE WHEN {strip(x)} = 'Y' THEN 1 ELSE 0 END AS TINYINT)"


def num(x: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def clip(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 365) END)"


def rnd(x: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def r6(x: str) -> str:
    return rnd(x, 6)


def safe(x: str) -> str:
    return f"('{C.SYM_PREFIX}' || regexp_replace({x}, '{UNSAFE}', '_', 'g'))"


def manu(x: str) -> str:
    base = strip(f"upper(coalesce({x}, '{C.MANUFACTURER_MISSING}'))")
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MANUFACTURER_ALIASES.items())
    return f"(CASE {base} {whens} ELSE {base} END)"


def fixture_ctes() -> str:
    """raw_reports, raw_symptoms, raw_vaccines (all text), as in fixtures.py."""
    age = "CAST(c.c_acctbal / 100 AS VARCHAR)"
    return f"""
line_agg AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_r,
         max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS any_a,
         max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS any_f,
         max(l_discount) AS max_disc, max(l_tax) AS max_tax, min(l_quantity) AS min_qty
  FROM lineitem GROUP BY l_orderkey),
raw_reports AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS VAERS_ID,
         CASE WHEN o.o_orderstatus = 'P' AND c.c_mktsegment = 'AUTOMOBILE' THEN 'NaN'
              WHEN c.c_nationkey = 7 THEN {age} || 'x' ELSE {age} END AS AGE_YRS,
         o.o_orderstatus AS SEX, n.n_name AS STATE,
         CAST(c.c_acctbal / 10 AS VARCHAR) AS NUMDAYS,
         CAST(la.qty AS VARCHAR) AS HOSPDAYS,
         CASE WHEN la.any_r = 1 THEN 'Y' ELSE 'N' END AS HOSPITAL,
         CASE WHEN la.max_disc > 0.08 THEN ' Y ' END AS L_THREAT,
         CASE WHEN la.any_a = 1 THEN 'Y' ELSE '' END AS ER_ED_VISIT,
         CASE WHEN la.max_tax >= 0.08 THEN 'Y' ELSE 'N' END AS DISABLE,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Y' WHEN o.o_orderstatus = 'O' THEN 'U' ELSE 'N' END AS RECOVD,
         CASE WHEN la.n_lines >= 7 THEN 'y' WHEN la.n_lines >= 6 THEN 'Y' ELSE 'N' END AS X_STAY,
         CASE WHEN la.min_qty <= 1 THEN 'Y' END AS BIRTH_DEFECT,
         CASE WHEN la.any_f = 1 THEN 'Y' ELSE 'N' END AS OFC_VISIT,
         c.c_mktsegment AS V_ADMINBY,
         strftime(o.o_orderdate, '%Y-%m-%d') AS RECVDATE,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Y' END AS DIED
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN line_agg la ON o.o_orderkey = la.l_orderkey),
lines_part AS (
  SELECT l.*, p.p_name, p.p_brand FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
raw_symptoms AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS VAERS_ID,
         {", ".join(f"CASE WHEN (l_linenumber - 1) % 5 + 1 = {k} THEN CASE WHEN l_linenumber = 3 THEN p_name || ' ' ELSE p_name END END AS SYMPTOM{k}" for k in range(1, 6))}
  FROM lines_part),
raw_vaccines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS VAERS_ID,
         CASE p_brand WHEN 'Brand#1' THEN 'pfizer\\biontech' WHEN 'Brand#2' THEN 'PFIZER-BIONTECH '
                      WHEN 'Brand#3' THEN 'Pfizer' WHEN 'Brand#4' THEN NULL WHEN 'Brand#5' THEN 'N/A'
                      ELSE p_brand END AS VAX_MANU,
         CAST(l_linenumber AS VARCHAR) AS VAX_DOSE_SERIES,
         l_returnflag AS VAX_ROUTE, l_linestatus AS VAX_SITE,
         {LINE_ORDER}
  FROM lines_part)"""


def etl_ctes(top_k: int = C.TOP_TERMS) -> str:
    """reports (typed), sym_long, top_terms, sym_named, vax, merged_base."""
    r = {c: na(c) for c in C.REPORT_COLUMNS}
    d = ("CAST(coalesce(try_strptime(" + r["RECVDATE"] + ", '%Y-%m-%d'), try_strptime("
         + r["RECVDATE"] + ", '%m/%d/%Y')) AS DATE)")
    flags = ",\n         ".join(f"{yes(r[c])} AS {c}" for c in C.BIN_COLS)
    slots = " UNION ALL ".join(f"SELECT VAERS_ID, {s} AS t FROM raw_symptoms" for s in C.SYMPTOM_SLOTS)
    vcols = [c for c in C.VACCINE_COLUMNS if c != C.KEY]
    return f"""
reports AS (
  SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID,
         {num(r["AGE_YRS"])} AS AGE_YRS,
         {r["SEX"]} AS SEX, {r["STATE"]} AS STATE,
         {clip(num(r["NUMDAYS"]))} AS NUMDAYS,
         {clip(num(r["HOSPDAYS"]))} AS HOSPDAYS,
         {flags},
         {r["V_ADMINBY"]} AS V_ADMINBY,
         {yes(r["DIED"])} AS DIED,
         strftime({d}, '%Y-%m') AS RECV_YEAR_MONTH,
         CAST(year({d}) AS INTEGER) AS RECV_YEAR
  FROM raw_reports),
sym_long AS (
  SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID, {strip("t")} AS SYMPTOM
  FROM ({slots}) s
  WHERE {na("t")} IS NOT NULL AND {strip("t")} <> ''),
term_counts AS (SELECT SYMPTOM, count(*) AS n FROM sym_long GROUP BY SYMPTOM),
top_terms AS (SELECT SYMPTOM, n FROM term_counts ORDER BY n DESC, SYMPTOM ASC LIMIT {top_k}),
sym_named AS (
  SELECT DISTINCT l.VAERS_ID, {safe("l.SYMPTOM")} AS name
  FROM sym_long l SEMI JOIN top_terms t ON l.SYMPTOM = t.SYMPTOM),
vax AS (
  SELECT TRY_CAST(VAERS_ID AS BIGINT) AS VAERS_ID, {manu(na("VAX_MANU"))} AS VAX_MANU,
         {", ".join(f"{na(c)} AS {c}" for c in vcols if c != "VAX_MANU")}
  FROM (SELECT *, row_number() OVER (PARTITION BY VAERS_ID ORDER BY {LINE_ORDER}) AS rn
        FROM raw_vaccines) WHERE rn = 1),
merged_base AS (
  SELECT r.*, v.VAX_MANU, v.VAX_DOSE_SERIES, v.VAX_ROUTE, v.VAX_SITE
  FROM reports r LEFT JOIN vax v ON r.VAERS_ID = v.VAERS_ID)"""


def sample_ctes(target: int | None = None, seed: int = C.SEED) -> str:
    """sample_base (no flag columns) and split_base (+ split, fold): of the
    whole merged table, or of R1's sample with a target."""
    share = C.TEST_SHARE
    k = C.CV_FOLDS
    keep = "" if target is None else f"WHERE DIED = 1 OR rk <= greatest(least({target} - (n_all - n_c), n_c), 0)"
    return f"""
ranked_s AS (
  SELECT *, row_number() OVER (PARTITION BY DIED ORDER BY h, VAERS_ID) AS rk,
         count(*) OVER (PARTITION BY DIED) AS n_c, count(*) OVER () AS n_all
  FROM (SELECT *, md5(CAST(VAERS_ID AS VARCHAR) || ':{seed}') AS h FROM merged_base)),
sample_base AS (SELECT * EXCLUDE (h, rk, n_c, n_all) FROM ranked_s {keep}),
ranked_t AS (
  SELECT * EXCLUDE (n_c, n_all),
         CAST(floor(count(*) OVER (PARTITION BY DIED) * CAST({share} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS nt
  FROM ranked_s {keep}),
split_base AS (
  SELECT * EXCLUDE (h, rk, nt),
         CASE WHEN rk <= nt THEN 'test' ELSE 'train' END AS split,
         CASE WHEN rk > nt THEN CAST((rk - nt - 1) % {k} AS INTEGER) END AS fold
  FROM ranked_t)"""


def flag_ctes() -> str:
    """Flags in long form: flag_names (name), and flag_lists (VAERS_ID, flags),
    the sorted names of a report's flags as one text.

    Pivot columns would come from the data, which a view cannot have.
    """
    return """
flag_names AS (SELECT DISTINCT name FROM sym_named),
flag_lists AS (SELECT VAERS_ID, string_agg(name, ',' ORDER BY name) AS flags FROM sym_named GROUP BY VAERS_ID)"""


def flags_long(rows: str) -> str:
    """(VAERS_ID, feature, v) of every flag of the reports in ``rows``."""
    return (f"SELECT r.VAERS_ID, n.name AS feature, CASE WHEN s.VAERS_ID IS NULL THEN 0 ELSE 1 END AS v "
            f"FROM {rows} r CROSS JOIN flag_names n LEFT JOIN sym_named s ON s.VAERS_ID = r.VAERS_ID AND s.name = n.name")


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts if p.strip())


def base(*extra: str, target: int | None = None) -> str:
    """WITH clause through split_base and the flag tables + extras."""
    return with_(fixture_ctes(), etl_ctes(), sample_ctes(target), flag_ctes(), *extra)
