"""A query that reads one model's grid starts no other model's."""

from vigilo import catalog as CAT


def test_a_query_of_one_grid_searches_only_that_model(spark, tmp_path, monkeypatch):
    asked = []
    schema = "model string, params map<string,string>, mean_f1 double, std_f1 double, n_splits int"

    def search(spark, train, name):
        asked.append(name)
        point = {"max_depth": "3", "min_samples_leaf": "5"}
        return spark.createDataFrame([(name, point, 0.5, 0.1, 5)], schema), None, point

    monkeypatch.setattr(CAT, "_GRID", {})
    monkeypatch.setattr(CAT.TU, "grid_search", search)
    monkeypatch.setattr(CAT.WF, "train_rows", lambda spark, sf: None)
    sf = str(tmp_path)
    assert [tuple(r) for r in CAT.QUERIES["grid_pivot"](spark, sf).collect()] == [(3, 0.5)]
    assert asked == ["cart"]
    assert [r["model"] for r in CAT.QUERIES["grid_top5"](spark, sf).collect()] == ["lightgbm"]
    assert asked == ["cart", "lightgbm"]
    assert CAT.QUERIES["grid_search"](spark, sf).count() == 3        # the third; none twice
    assert asked == ["cart", "lightgbm", "random_forest"]
