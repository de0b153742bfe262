"""Three CSV extracts, with line breaks in free text, go to trained models."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.plans.sample import assemble
from vigilo.plans.training import run_training_csv
from vigilo.sources import artifacts as AR
from vigilo.sources import csv_scan as CS

N = 400


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def extracts(tmp_path_factory):
    """CSV files with more columns than are read, one of them free text with
    quotes and line breaks; deaths depend on age and hospital stay."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("extracts")
    header = ["SYMPTOM_TEXT", *C.REPORT_COLUMNS, "OTHER"]
    reports, symptoms, vaccines = [], [], []
    for i in range(N):
        row = dict.fromkeys(C.REPORT_COLUMNS, "")
        age, stay = rng.randint(1, 95), rng.random() < 0.4
        died = rng.random() < (0.7 if age > 60 and stay else 0.05)
        row |= {C.KEY: str(i), "AGE_YRS": str(age), "SEX": rng.choice("MFU"), "STATE": rng.choice(["CA", "NY", ""]),
                "HOSPITAL": "Y" if stay else "", C.LABEL: "Y" if died else "", "RECVDATE": "03/04/2021",
                "V_ADMINBY": rng.choice(["PVT", "N/A"])}
        reports.append([f'said "it, hurt"\nand then\r\nleft {i}', *[row[c] for c in C.REPORT_COLUMNS], "x,y"])
        symptoms.append([str(i), *(rng.choice(["Fever", "Chills", "Pain "]) if k < 2 else "" for k in range(5)), "v\n1"])
        for dose in range(rng.randint(1, 3)):
            vaccines.append([str(i), *(str(dose + 1) if c == "VAX_DOSE_SERIES" else "Pfizer" if c == "VAX_MANU" else "IM"
                                       for c in C.VACCINE_COLUMNS if c != C.KEY)])
    write(folder / "reports.csv", header, reports)
    write(folder / "symptoms.csv", [C.KEY, *C.SYMPTOM_SLOTS, "NOTE"], symptoms)
    write(folder / "vaccines.csv", [C.KEY, *(c for c in C.VACCINE_COLUMNS if c != C.KEY)], vaccines)
    return [str(folder / f"{n}.csv") for n in ("reports", "symptoms", "vaccines")]


def test_line_breaks_do_not_split_rows(spark, extracts):
    assert CS.scan_reports(spark, extracts[0]).count() == N
    assert CS.scan_symptoms(spark, extracts[1]).count() == N
    got = assemble(CS.scan_reports(spark, extracts[0]), CS.scan_symptoms(spark, extracts[1]),
                   CS.scan_vaccines(spark, extracts[2]))
    assert got.merged.count() == N and sorted(got.top_terms) == ["Chills", "Fever", "Pain"]
    assert got.merged.where("VAX_DOSE_SERIES <> '1'").count() == 0      # the first row of each report


def test_training_on_csv(spark, extracts, tmp_path):
    out = str(tmp_path / "run")
    got = run_training_csv(spark, *extracts, out, models=("logistic", "cart", "lightgbm"), cv_models=("logistic",),
                           settings={"lightgbm": {"maxIter": 5, "maxDepth": 3}},
                           grids={"cart": {"max_depth": [2, 3], "min_samples_leaf": [5]}})
    rows = {r["artifact"]: r["rows"] for r in got.collect()}
    test = round(0.3 * N)
    assert rows["sample"] == N and abs(rows["y_test"] - test) <= 1 and rows["metrics"] == 3
    assert rows["grid"] == 2 and rows["history"] == 5 and rows["cv_folds"] == 25 and rows["tree_text"] >= 3
    assert {r[0] for r in AR.read_table(spark, f"{out}/importances").select("model").distinct().collect()} == {"cart", "lightgbm"}
    auc = {r["model"]: r["roc_auc"] for r in AR.read_table(spark, f"{out}/metrics").collect()}
    # The label depends on the features here, so a working model is far from chance.
    assert all(v > 0.75 for v in auc.values()), auc
    best = AR.load_model(f"{out}/models/cart")
    assert best.stages[-1].depth <= 3
    assert AR.read_table(spark, f"{out}/split").where(F.col("split") == "train").count() == N - rows["y_test"]
