"""Driver contract: entry() runs; every query with SQL agrees with DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from vigilo.sources.tables import TABLES

import os
import sys
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import rows_of  # noqa: E402


def test_entry_runs(spark):
    df = entry(spark)
    assert len(df.collect()) > 0
    assert df.columns == ["STATE", "rate", "n", "rate_pct", "pct_of_total"]


def test_every_sql_key_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_oracle_agrees(spark, sf, con, key):
    df = queries()[key](spark, sf)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    con.execute(f"CREATE OR REPLACE VIEW oracle_view AS {oracle_sql()[key]}")  # as the driver does
    cur = con.execute("SELECT * FROM oracle_view")
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert rows_of(cols, rows, exact=True) == rows_of(dcols, drows, exact=True)   # bit for bit


# Columns that are shares, and rows that follow from a query's definition (models × folds × metrics, points of the grids, ...).
SHARES = ["p", "accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "mean_f1", "val_auc", "train_auc", "val_acc", "train_acc"]
ROWS = {"cv_model_scores": 6 * 5 * 5, "cv_model_summary": 6 * 5, "grid_search": 16 + 9 + 18, "grid_refit": 3, "grid_top5": 5, "grid_pivot": 4,
        "training_history": 300, "best_epoch": 1, "early_stop_epoch": 1, "model_leaderboard": 7, "results_upsert": 3,
        **{f"fit_{m}": 1 for m in ("logistic", "ridge", "lasso", "cart", "forest", "boosted", "mlp")}}
RANKED = ["importances", "split_importances", "coefficients", "top_importances", "top_coefficients"]


def test_rows_only_queries_hold_their_shape_without_cross_joins(spark, sf):
    q, o = queries(), oracle_sql()
    for key in sorted(set(q) - set(o)):
        df = q[key](spark, sf)
        rows = df.collect()
        assert len(rows) == ROWS[key] if key in ROWS else rows, key
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
        for c in set(SHARES) & set(df.columns) if key != "results_upsert" else ():      # which writes an accuracy of -1
            assert all(r[c] is None or 0 <= r[c] <= 1 for r in rows), (key, c)
        if key in RANKED:
            for model in {r["model"] for r in rows}:
                mine = sorted((r for r in rows if r["model"] == model), key=lambda r: r["rank"])
                assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)), key
                assert [abs(r["value"]) for r in mine] == sorted((abs(r["value"]) for r in mine), reverse=True), key
        if key == "mlp_history":
            assert sorted(r["epoch"] for r in rows) == list(range(1, len(rows) + 1)) and all(None not in r for r in rows)
        if key == "export_artifacts":
            found = {r["artifact"]: r["rows"] for r in rows}
            orders = spark.read.parquet(f"{sf}/orders.parquet").count()
            assert found["sample"] == orders and found["X_test_original"] == found["y_test"] and found["scores"] == 7 * found["y_test"]
            assert found["metrics"] == found["confusion"] == 7 and found["grid"] == 43 and found["cv_folds"] == 150
            assert found["history"] > 300 and found["X_test"] == found["shap"]
