"""CSV scans of the three extracts.

Every field is read as text (no inference, so one odd value cannot change a
column's type), columns are selected **by name** (a positional schema would
misalign on a wider file), and the reader's missing-value tokens become
NULL in one projection. Quoted fields may hold line breaks, as the free-text
columns of real extracts do.

Spark's own reader gives a file with such fields to one task, since a line
break alone does not tell whether a record ends. :func:`records` reads the
file's lines in as many splits as it has: the number of quotes of each split,
odd or even, summed over the splits before it tells whether the split begins
inside a quoted field, and the same running sum inside a split tells which
lines begin a record. Where a split has no line with an odd number of quotes and
begins outside a field, each line is a record, and nothing is moved or sorted.
Lines of one record are joined again, and each record is parsed on its own. Quotes inside fields must be doubled and their field
quoted, as in any CSV that Spark reads with these options. Files known to have
no line breaks in fields can be read line by line with ``multiline=False``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import na_to_null
from vigilo.operators.reshape import with_file_order

OPTIONS = {"quote": '"', "escape": '"'}


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, text): the records of CSV files, the header included.

    A record is known by the split in which it begins and its number there,
    from 1, so (file, block, number) is the order of the file. In a file whose
    first line ends in a carriage return and a line feed, the two are one line
    break, in fields too.
    """
    lines = (spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumns({"line": F.monotonically_increasing_id(), "odd": F.length(F.regexp_replace("value", '[^"]', "")) % 2}))
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    begins = (lines.groupBy("file", "block").agg(                                  # a row for each split
        F.sum("odd").alias("odd"), F.min_by(F.col("value").endswith("\r"), "line").alias("two"), F.min("line").alias("first"))
        .select("file", "block", "odd", "first", F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("open"),
                F.first("two").over(by_block).alias("two")))
    # A split's lines have consecutive numbers, so where all are records they need no window.
    begins = begins.withColumn("plain", (F.col("odd") == 0) & (F.col("open") % 2 == 0)).drop("odd")
    placed = lines.join(F.broadcast(begins), ["file", "block"])
    plain = placed.where("plain").select("file", "block", (F.col("line") - F.col("first") + 1).alias("number"), "two", F.col("value").alias("text"))
    within = Window.partitionBy("file", "block").orderBy("line")
    so_far = F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.where("NOT plain").withColumn("starts", (F.col("open") + so_far) % 2 == 0)
    numbered = starts.withColumns({
        "number": F.sum(F.col("starts").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "alone": F.col("starts") & ((F.col("odd") == 0))})
    # Lines before a split's first record end the last record of a split before it.
    counts = numbered.groupBy("file", "block").agg(F.max("number").alias("n")).unionByName(
        plain.groupBy("file", "block").agg(F.max("number").alias("n")))
    owner = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(before)
    owners = counts.select("file", "block", owner.alias("owner"))
    single = numbered.where("alone").select("file", "block", "number", "two", F.col("value").alias("text"))
    parts = numbered.where("NOT alone").join(owners, ["file", "block"]).select(
        "file", "two", F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("owner.block")).alias("first"),
        F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("owner.n")).alias("number"),
        F.struct("block", "line", "value").alias("part"))
    joined = parts.groupBy("file", "first", "number", "two").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        "file", F.col("first").alias("block"), "number", "two", F.array_join(F.col("parts.value"), "\n").alias("text"))
    one_break = F.replace(F.concat(F.col("text"), F.lit("\n")), F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.col("two"), F.left(one_break, F.length(one_break) - 1)).otherwise(F.col("text"))
    return plain.unionByName(single).unionByName(joined).select("file", "block", "number", text.alias("text"))


def read_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Records of CSV files with a header as text columns named ``columns``, and ``_file_pos``."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    text = records(spark, path).where((F.col("block") > 0) | (F.col("number") > 1)).where("text <> ''")
    fields = F.from_csv("text", F.lit(schema), OPTIONS)
    return text.select(fields.alias("r"), F.struct(F.col("file").alias("f"), F.col("block").alias("b"), F.col("number").alias("r")).alias("_file_pos")
                       ).select("r.*", "_file_pos")


def read_extract(spark: SparkSession, path: str, columns: list[str], multiline: bool = True,
                 file_order: bool = False) -> DataFrame:
    plain = spark.read.option("header", True).option("inferSchema", False).options(**OPTIONS)
    df = plain.option("multiLine", multiline).csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    if multiline:
        df = read_records(spark, path, df.columns)
    elif file_order:                    # D1 needs the row position, taken at the scan
        df = with_file_order(df)
    keep = [na_to_null(c).alias(c) for c in columns]
    return df.select(*keep, *(["_file_pos"] if file_order else []))


def scan_reports(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_extract(spark, path, C.REPORT_COLUMNS, multiline)


def scan_symptoms(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_extract(spark, path, C.SYMPTOM_COLUMNS, multiline)


def scan_vaccines(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_extract(spark, path, C.VACCINE_COLUMNS, multiline, file_order=True)


def write_extract(df: DataFrame, path: str) -> None:
    """Write a text extract as CSV with a header (used to build CSV inputs)."""
    df.write.mode("overwrite").option("header", True).options(**OPTIONS).csv(path)
