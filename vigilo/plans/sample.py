"""The ETL job: three text extracts → one typed, flagged, sampled table.

Stages (each lazy; Catalyst sees one plan):

1. clean reports        NA tokens → NULL, flags, numbers, clip, date parts
2. symptom terms        unpivot → top-k → indicator pivot (one shuffle by id)
3. vaccines             NA tokens → NULL, first row per id, manufacturer
4. assemble             reports ⟕ flags ⟕ vaccines; the two right sides are
                        already hash-partitioned by id, so only reports
                        shuffle for the joins
5. split                stratified train/test and folds of the whole table —
                        one seeded permutation (R1's sample is a query of its
                        own; models are fitted on all training rows)

Only two small results reach the driver: the ≤30 top terms (they become
column names) and percentile/offset tables inside the helpers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import (
    clip, date_parts, fill_zero_flag, na_to_null, normalise_manufacturer, to_number, yes_flag)
from vigilo.operators.reshape import (
    collect_top_terms, dedup_first, indicator_pivot, topk_terms, unpivot_terms)
from vigilo.operators.sampling import sample_and_split, stratified_sample
from vigilo.sources import fixtures


def clean_reports(raw: DataFrame) -> DataFrame:
    """P1–P4 on the text reports: one projection, one codegen span."""
    r = raw.select(*[na_to_null(c).alias(c) for c in C.REPORT_COLUMNS])
    typed = r.select(
        F.col(C.KEY).try_cast("bigint").alias(C.KEY),
        to_number("AGE_YRS").alias("AGE_YRS"),
        "SEX", "STATE",
        *[clip(to_number(c)).alias(c) for c in C.CLIPPED],
        *[yes_flag(c).alias(c) for c in C.BIN_COLS],
        "V_ADMINBY", "RECVDATE",
        yes_flag(C.LABEL).alias(C.LABEL),
    )
    return date_parts(typed, "RECVDATE")


def clean_vaccines(raw: DataFrame) -> DataFrame:
    cols = [c for c in C.VACCINE_COLUMNS if c != C.KEY]
    return raw.select(F.col(C.KEY).try_cast("bigint").alias(C.KEY),
                      *[na_to_null(c).alias(c) for c in cols], "_file_pos")


def vaccines_first(raw: DataFrame) -> DataFrame:
    """D1 + P8: first vaccine row per report, manufacturer normalised."""
    first = dedup_first(clean_vaccines(raw), C.KEY, "_file_pos")
    return first.withColumn("VAX_MANU", normalise_manufacturer("VAX_MANU"))


def symptom_long(raw: DataFrame) -> DataFrame:
    long = unpivot_terms(raw)
    return long.withColumn(C.KEY, F.col(C.KEY).try_cast("bigint"))


class Assembled:
    """The merged report table plus the flag columns it carries."""

    def __init__(self, merged: DataFrame, sym_cols: list[str], top_terms: list[str]):
        self.merged = merged
        self.sym_cols = sym_cols
        self.top_terms = top_terms


def assemble(raw_reports: DataFrame, raw_symptoms: DataFrame, raw_vaccines: DataFrame,
             top_k: int = C.TOP_TERMS) -> Assembled:
    """J1 + J2 over three text extracts, scanned from CSV or stand-ins."""
    reports = clean_reports(raw_reports)
    long = symptom_long(raw_symptoms)
    terms = collect_top_terms(topk_terms(long, top_k))
    flags = indicator_pivot(long, terms)
    sym_cols = [c for c in flags.columns if c != C.KEY]
    vax = vaccines_first(raw_vaccines)
    merged = (reports.join(flags, C.KEY, "left")                       # J1
                     .join(vax, C.KEY, "left")                         # J2
                     .withColumns({c: fill_zero_flag(c) for c in sym_cols}))  # P9
    return Assembled(merged, sym_cols, terms)


def assemble_stand_in(spark: SparkSession, sf_dir: str, top_k: int = C.TOP_TERMS) -> Assembled:
    """The same over the stand-in extracts of the driver's tables."""
    return assemble(fixtures.raw_reports(spark, sf_dir), fixtures.raw_symptoms(spark, sf_dir),
                    fixtures.raw_vaccines(spark, sf_dir), top_k)


def build_sample(spark: SparkSession, sf_dir: str, target: int = C.SAMPLE_TARGET) -> DataFrame:
    """R1 over J1/J2: the reference's sample. Views and evaluation do not read
    it; they read the whole merged table."""
    return stratified_sample(assemble_stand_in(spark, sf_dir).merged, target=target)


def build_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged table with ``split`` and ``fold`` columns (R2 + R3, one rank)."""
    return sample_and_split(assemble_stand_in(spark, sf_dir).merged)
