"""Splits whose every line is a record are numbered without moving or sorting lines."""

import re

from vigilo.sources import csv_scan as CS


def test_plain_lines_need_no_window(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,x\n2,"y"\n3,z\n')
    (tmp_path / "b.csv").write_text('id,t\n4,"two\nlines"\n5,w\n')
    df = CS.records(spark, str(tmp_path))
    got = sorted((r["file"][-5:], r["number"], r["text"]) for r in df.collect())
    assert got == [("a.csv", 1, "id,t"), ("a.csv", 2, "1,x"), ("a.csv", 3, '2,"y"'), ("a.csv", 4, "3,z"),
                   ("b.csv", 1, "id,t"), ("b.csv", 2, '4,"two\nlines"'), ("b.csv", 3, "5,w")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    branches = re.split(r"\n(?::- |\+- )", plan)                       # of the union
    assert any("windowspecdefinition" in b and not re.search(r"windowspecdefinition\([^)]*line#", b) for b in branches[1:])
