"""CSV with line breaks in fields, read in several splits: equal to the one-task reader."""

import pytest
from pyspark.sql import functions as F

from vigilo.sources import csv_scan as CS

FILES = {
    "plain": 'a,b,c\n1,x,\n2,,"y"\n',
    "breaks": 'a,b,c\n1,"two\nlines",x\n2,"a ""quoted"" word, and\n\n""more""\n",y\n3,plain,z\n4,"\n","\n\n"\n5,é日本,"ü\n"\n',
    "no end": 'a,b,c\n1,"x\ny",2\n3,4,"5\n6"',
    "carriage returns": 'a,b,c\r\n1,"two\r\nlines",x\r\n2,y,"z"\r\n',
    "blank lines": 'a,b,c\n\n1,2,3\n\n\n4,"\n\n",6\n',
    "long field": 'a,b,c\n1,"' + "line\n" * 60 + '",x\n2,"' + '""\n' * 40 + '",y\n3,4,5\n',
    "wide header": '"a","b ""x""\n1",c\n1,2,3\n',
    "header only": "a,b,c\n",
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one_task(spark, path):
    return spark.read.option("header", True).option("multiLine", True).options(**CS.OPTIONS).csv(path)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 10_000])
def test_cut_anywhere_equals_one_task(spark, tmp_path, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name, text in FILES.items():
            if size == 1 and len(text) > 150:       # each byte a split: short files
                continue
            path = tmp_path / f"{name}.csv"
            path.write_bytes(text.encode())
            whole = one_task(spark, str(path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = CS.read_records(spark, str(path), whole.columns)
            if 1 < size < 40 and name == "long field":
                assert CS.records(spark, str(path)).select("block").distinct().count() >= 2
                assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 1
            assert rows(got.drop("_file_pos")) == rows(whole), name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_file_order_and_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f'{k},"{i}\n{i}"\n' for i in range(30)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        got = CS.read_records(spark, str(tmp_path), ["a", "b"]).repartition(5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 90
    for k in range(3):
        mine = sorted((r["_file_pos"], r["b"]) for r in got if r["a"] == str(k))
        assert [b for _, b in mine] == [f"{i}\n{i}" for i in range(30)]


def test_missing_columns_and_tokens(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('b,a,extra\n"N/A","1\n2",\nx,NULL,y\n')
    got = CS.read_extract(spark, str(path), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in got if r["a"]) == [("1\n2", None)]
    assert [(r["a"], r["b"]) for r in got if not r["a"]] == [(None, "x")]
    with pytest.raises(ValueError, match="missing columns"):
        CS.read_extract(spark, str(path), ["a", "z"])
