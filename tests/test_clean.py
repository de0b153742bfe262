"""Unit fixtures for the cleaning traps (FIXTURES.md §4)."""

import math


from vigilo import config as C
from vigilo.functions import clean
from vigilo.functions.names import safe_name
from vigilo.operators.reshape import flag_columns, indicator_pivot


def col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_yes_flags(spark):
    df = col(spark, ["Y", " Y ", "y", "N", "", None])
    assert [r[0] for r in df.select(clean.yes_flag("x")).collect()] == [1, 1, 0, 0, 0, 0]


def test_clip_keeps_null(spark):
    df = col(spark, ["-3", "0", "364.5", "400", "abc", "NaN", None])
    got = [r[0] for r in df.select(clean.clip(clean.to_number("x"))).collect()]
    assert got == [0.0, 0.0, 364.5, 365.0, None, None, None]


def test_na_tokens(spark):
    df = col(spark, ["N/A", "NA", "NULL", "None", "nan", "", "ok", " NA"])
    got = [r[0] for r in df.select(clean.na_to_null("x")).collect()]
    assert got == [None] * 6 + ["ok", " NA"]           # matched unpadded, like the CSV reader


def test_half_even_rounding_of_doubles(spark):
    df = col(spark, [0.125, 2.675, 1.005], "double")
    got = [r[0] for r in df.select(clean.round_half_even("x", 2)).collect()]
    assert got == [0.12, 2.68, 1.0]                 # numpy: rint(x*100)/100


def test_dates(spark):
    df = col(spark, ["2021-03-05", "03/05/2021", "garbage", None])
    got = [tuple(r) for r in clean.date_parts(df.withColumnRenamed("x", "RECVDATE")).collect()]
    assert got == [("2021-03", 2021), ("2021-03", 2021), (None, None), (None, None)]


def test_manufacturer_aliases(spark):
    df = col(spark, ["pfizer\\biontech", "PFIZER-BIONTECH ", " moderna", None])
    got = [r[0] for r in df.select(clean.normalise_manufacturer("x")).collect()]
    assert got == ["PFIZER", "PFIZER", "MODERNA", "UNKNOWN"]


def test_model_label(spark):
    df = col(spark, ["lasso", "my_new_model"])
    got = [r[0] for r in df.select(clean.model_label("x")).collect()]
    assert got == [C.MODEL_LABELS["lasso"], "My New Model"]


def test_name_collision_merges(spark):
    assert safe_name("A-B") == safe_name("A B") == "SYM_A_B"
    assert list(flag_columns(["A-B", "A B", "C"]).items()) == [("SYM_A_B", ["A B", "A-B"]), ("SYM_C", ["C"])]
    long = spark.createDataFrame([(1, "A-B"), (2, "A B"), (3, "C"), (3, "A B")], "VAERS_ID long, SYMPTOM string")
    rows = {r["VAERS_ID"]: (r["SYM_A_B"], r["SYM_C"]) for r in indicator_pivot(long, ["A-B", "A B", "C"]).collect()}
    assert rows == {1: (1, 0), 2: (1, 0), 3: (1, 1)}


def test_risk_ratio_floor(spark):
    from vigilo.operators.explore import risk_ratio
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "f int, DIED int")
    r = risk_ratio(df, "f").first()
    assert r["no_rate_pct"] == 0.0 and math.isclose(r["ratio"], 50.0 / 0.001)
