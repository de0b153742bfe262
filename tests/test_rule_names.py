"""Rules on features whose names differ by case alone."""

from types import SimpleNamespace

from vigilo import catalog_checks as CC
from vigilo.plans.features import FeaturePreparer


def test_rules_on_names_that_differ_by_case(spark, monkeypatch):
    rows = spark.createDataFrame([(k, float(k), c) for k, c in enumerate(["A", "UNKNOWN", "Unknown", "UNKNOWN", None])],
                                 "VAERS_ID long, age double, manu string")
    prep = FeaturePreparer(numCols=["age"], catCols=["manu"]).fit(rows)
    assert prep.feature_names() == ["age", "manu_UNKNOWN", "manu_Unknown"]
    rules = ["manu_UNKNOWN <= 0.5 & manu_Unknown <= 0.5", "manu_UNKNOWN <= 0.5 & manu_Unknown > 0.5", "manu_UNKNOWN > 0.5"]
    monkeypatch.setattr(CC, "q_tree_rules", lambda s, sf: spark.createDataFrame([(r,) for r in rules], "rule string"))
    monkeypatch.setattr(CC.WF, "fitted", lambda s, sf, name: SimpleNamespace(stages=[prep]))
    monkeypatch.setattr(CC.WF, "test_rows", lambda s, sf: rows)
    assert tuple(CC.q_tree_rules_check(spark, "").first()) == (5, 0, 0)
    rules.pop()
    assert tuple(CC.q_tree_rules_check(spark, "").first()) == (5, 2, 0)      # the two of UNKNOWN
