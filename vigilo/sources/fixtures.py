"""Stand-in report extracts built from the driver's tables.

The reference reads three CSV extracts (reports, symptoms, vaccines) whose
fields are all text. These views rebuild the same three shapes, all-text,
from the TPC-H-like tables so that every cleaning rule has something to do:

* reports   one row per order (orders ⟕ customer ⟕ nation ⟕ line aggregates)
* symptoms  five term slots per row, several rows per report
            (lineitem ⋈ part, term = part name, one line per row)
* vaccines  one row per line item; the first one per report in "file order"
            (a total order over the line columns) is the one kept

Each view has a DuckDB twin in :mod:`vigilo.oracle`; the two must agree
column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.sources.tables import table

# Total order that plays the part of the CSV row order of the line-level
# extracts (l_orderkey is the report key and so is not part of it).
LINE_FILE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def _num_text(c: Column) -> Column:
    return c.cast("string")


def line_aggregates(lineitem: DataFrame) -> DataFrame:
    """Per-order facts the clinical flags are derived from (one shuffle)."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("any_r"),
        F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("any_a"),
        F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("any_f"),
        F.max("l_discount").alias("max_disc"),
        F.max("l_tax").alias("max_tax"),
        F.min("l_quantity").alias("min_qty"),
    )


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports extract: 17 text columns, one row per order."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal",
              "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag",
               "l_linestatus", "l_discount", "l_tax")
    la = line_aggregates(li)
    # nation has 25 rows by construction: a broadcast of fixed size.
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left")
          .join(la, o.o_orderkey == la.l_orderkey, "left"))
    age = _num_text(F.col("c_acctbal") / 100)
    yes = F.lit("Y")
    return j.select(
        _num_text(F.col("o_orderkey")).alias("VAERS_ID"),
        # a few malformed ages: the text 'NaN' and numbers with a stray suffix
        F.when((F.col("o_orderstatus") == "P") & (F.col("c_mktsegment") == "AUTOMOBILE"),
               F.lit("NaN"))
         .when(F.col("c_nationkey") == 7, F.concat(age, F.lit("x")))
         .otherwise(age).alias("AGE_YRS"),
        F.col("o_orderstatus").alias("SEX"),
        F.col("n_name").alias("STATE"),
        _num_text(F.col("c_acctbal") / 10).alias("NUMDAYS"),
        _num_text(F.col("qty")).alias("HOSPDAYS"),
        F.when(F.col("any_r") == 1, yes).otherwise(F.lit("N")).alias("HOSPITAL"),
        F.when(F.col("max_disc") > 0.08, F.lit(" Y ")).alias("L_THREAT"),
        F.when(F.col("any_a") == 1, yes).otherwise(F.lit("")).alias("ER_ED_VISIT"),
        F.when(F.col("max_tax") >= 0.08, yes).otherwise(F.lit("N")).alias("DISABLE"),
        F.when(F.col("o_orderstatus") == "F", yes)
         .when(F.col("o_orderstatus") == "O", F.lit("U"))
         .otherwise(F.lit("N")).alias("RECOVD"),
        F.when(F.col("n_lines") >= 7, F.lit("y"))
         .when(F.col("n_lines") >= 6, yes)
         .otherwise(F.lit("N")).alias("X_STAY"),
        F.when(F.col("min_qty") <= 1, yes).alias("BIRTH_DEFECT"),
        F.when(F.col("any_f") == 1, yes).otherwise(F.lit("N")).alias("OFC_VISIT"),
        F.col("c_mktsegment").alias("V_ADMINBY"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("RECVDATE"),
        F.when(F.col("o_orderpriority") == "1-URGENT", yes).alias("DIED"),
    )


def _lines_with_part(spark: SparkSession, sf_dir: str, *line_cols: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", *line_cols)
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey, "left")


def raw_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symptoms extract: VAERS_ID + SYMPTOM1..5, several rows per report.

    Each line item is one row whose term sits in slot ((linenumber − 1) mod 5)
    + 1, the other slots empty; the third line's term carries a trailing
    blank that cleaning must strip. A narrow projection of the scan — no
    per-report ordering, grouping or shuffle, however many lines one report
    has.
    """
    lp = _lines_with_part(spark, sf_dir, "l_partkey", "l_linenumber")
    term = F.when(F.col("l_linenumber") == 3, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name"))
    slot = (F.col("l_linenumber") - 1) % 5 + 1
    return lp.select(_num_text(F.col("l_orderkey")).alias("VAERS_ID"),
                     *[F.when(slot == k, term).alias(f"SYMPTOM{k}") for k in range(1, 6)])


def raw_vaccines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vaccine extract: one text row per line item plus its file position.

    Manufacturer text is made messy on purpose: two spellings of one alias,
    a lower-case name, a null and a missing-value token.
    """
    lp = _lines_with_part(spark, sf_dir, *LINE_FILE_ORDER)
    brand = F.col("p_brand")
    manu = (F.when(brand == "Brand#1", F.lit("pfizer\\biontech"))
             .when(brand == "Brand#2", F.lit("PFIZER-BIONTECH "))
             .when(brand == "Brand#3", F.lit("Pfizer"))
             .when(brand == "Brand#4", F.lit(None).cast("string"))
             .when(brand == "Brand#5", F.lit("N/A"))
             .otherwise(brand))
    return lp.select(
        _num_text(F.col("l_orderkey")).alias("VAERS_ID"),
        manu.alias("VAX_MANU"),
        _num_text(F.col("l_linenumber")).alias("VAX_DOSE_SERIES"),
        F.col("l_returnflag").alias("VAX_ROUTE"),
        F.col("l_linestatus").alias("VAX_SITE"),
        F.struct(*LINE_FILE_ORDER).alias("_file_pos"),
    )
