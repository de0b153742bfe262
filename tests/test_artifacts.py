"""Result tables: dynamic-overwrite upsert, artifact checks, CSV file order."""

import pytest
from pyspark.sql import functions as F

from vigilo.sources import artifacts as AR
from vigilo.sources.csv_scan import read_extract, write_extract
from vigilo.operators.reshape import dedup_first


def test_upsert_replaces_one_model_only(spark, tmp_path):
    path = str(tmp_path / "metrics")
    first = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "model string, auc double")
    AR.upsert_results(first, path)
    AR.upsert_results(spark.createDataFrame([("b", 0.9)], "model string, auc double"), path)
    got = {r["model"]: r["auc"] for r in AR.read_table(spark, path).collect()}
    assert got == {"a": 0.1, "b": 0.9, "c": 0.3}


def test_required_and_optional_artifacts(spark, tmp_path):
    AR.write_table(spark.range(3), str(tmp_path / "present"))
    AR.require_artifacts(spark, [str(tmp_path / "present")])
    with pytest.raises(FileNotFoundError, match="missing"):
        AR.require_artifacts(spark, [str(tmp_path / "absent")])
    assert AR.optional_table(spark, str(tmp_path / "absent"), "x int").count() == 0


def test_first_row_in_csv_file_order(spark, tmp_path):
    rows = [(str(k), f"v{k}_{i}") for i in range(4) for k in range(50)]   # key k, then i in file order
    df = spark.createDataFrame(rows, "VAERS_ID string, val string").coalesce(1)
    path = str(tmp_path / "csv")
    write_extract(df, path)
    scanned = read_extract(spark, path, ["VAERS_ID", "val"], file_order=True).repartition(7)
    got = {r["VAERS_ID"]: r["val"] for r in dedup_first(scanned, "VAERS_ID", "_file_pos").collect()}
    assert got == {str(k): f"v{k}_0" for k in range(50)}
