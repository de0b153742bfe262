"""Exact, reproducible sampling and splitting.

Rows are ordered by md5('<key>:<salt><seed>') — the same bytes in Spark and
in any SQL engine — and cut by exact counts. Where only the first n rows of a
class matter (R1, R4, the bound of a fit), the cut is found in one bucket of the
hash and the rest is a filter: no row is moved. Folds need every row's rank,
from :func:`vigilo.operators.distributed.hash_rank`, which never sorts a whole
class in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.operators.distributed import hash_cuts, hash_rank, md5_hash, up_to_cut


def ranked_rows(df: DataFrame, h, strata, key: str, max_strata: int = 2) -> DataFrame:
    """``df`` with ``_rank``, ``_n`` and ``_n_all``: the rank of each row in
    hash order within its stratum."""
    return hash_rank(df.withColumn("_h", h), "_h", strata, key, max_strata).drop("_h")


def class_counts(train: DataFrame, label: str = C.LABEL) -> dict:
    """Rows of each class. Raises if only one class has rows."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}      # ≤ 3 rows
    if not (counts.get(0) and counts.get(1)):
        raise ValueError(f"a fit needs rows of both classes, got {counts}")
    return counts


def fit_rows(train: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows a model is fitted on: all, unless the caller bounds them."""
    if rows is not None:
        return bounded_rows(train, rows)
    class_counts(train)
    return train


def bounded_rows(train: DataFrame, rows: int, label: str = C.LABEL, key: str = C.KEY,
                 seed: int = C.SEED) -> DataFrame:
    """At most about ``rows`` training rows, the same share of either class.

    A bound that a caller may set on a fit, no query does: each class keeps its
    first ceil(n_class · rows / n) rows in seeded hash order. Fewer rows are
    returned as they are. Raises if only one class has rows.
    """
    n = sum(class_counts(train, label).values())
    if n <= rows:
        return train
    hashed = train.withColumn("_h", md5_hash(key, seed, "fit"))
    cuts = hash_cuts(hashed, "_h", lambda n_class, _: F.ceil(n_class * F.lit(rows / n)), key, [label])
    return hashed.where(up_to_cut(cuts, "_h", key, [label])).drop("_h")


def stratified_sample(df: DataFrame, label: str = C.LABEL, key: str = C.KEY,
                      target: int = C.SAMPLE_TARGET, seed: int = C.SEED) -> DataFrame:
    """Every positive plus exactly n0 = min(target − positives, negatives)
    negatives (clamped at 0), chosen without replacement in seeded hash order.
    """
    hashed = df.withColumn("_h", md5_hash(key, seed))

    def negatives(n, n_all):                            # n_all - n: the positives, on a negative row
        return F.greatest(F.least(F.lit(target) - (n_all - n), n), F.lit(0))

    cuts = hash_cuts(hashed, "_h", negatives, key, [label])
    return hashed.where((F.col(label) == 1) | up_to_cut(cuts, "_h", key, [label])).drop("_h")


def test_count(n: str = "_n", share: float = C.TEST_SHARE):
    """Test rows per class: round-half-up of share · n_class."""
    return F.floor(F.col(n) * F.lit(share) + F.lit(0.5)).cast("long")


def stratified_split(df: DataFrame, label: str = C.LABEL, key: str = C.KEY,
                     share: float = C.TEST_SHARE, k: int = C.CV_FOLDS,
                     seed: int = C.SEED) -> DataFrame:
    """R2 + R3: add ``split`` ('train'/'test') and ``fold`` (0..k-1, train only).

    Per class the first round(share·n) rows in hash order are test rows; the
    remaining rows are dealt round-robin into k folds, so fold sizes per
    class differ by at most one.
    """
    ranked = hash_rank(df.withColumn("_h", md5_hash(key, seed, "split")), "_h", [label], key)
    n_test = test_count("_n", share)
    is_test = F.col("_rank") <= n_test
    return ranked.withColumns({
        "split": F.when(is_test, F.lit("test")).otherwise(F.lit("train")),
        "fold": F.when(~is_test, ((F.col("_rank") - n_test - 1) % k).cast("int")),
    }).drop("_h", "_rank", "_n", "_n_all")


def sample_and_split(df: DataFrame, label: str = C.LABEL, key: str = C.KEY,
                     target: int | None = None, share: float = C.TEST_SHARE,
                     k: int = C.CV_FOLDS, seed: int = C.SEED) -> DataFrame:
    """R1 + R2 + R3 from ONE seeded permutation per class.

    With a ``target`` the sample keeps each class's first n_c' rows in hash
    order (all positives, n0 negatives); without one it is the whole table.
    A kept row's rank is its rank inside the sample, so the first
    round(share·n_c') of them are the test rows and the rest are dealt into k
    folds — one ranking pass instead of two.
    """
    ranked = ranked_rows(df, md5_hash(key, seed), [label], key)
    n0 = F.col("_n")
    if target is not None:
        n0 = F.greatest(F.least(F.lit(target) - (F.col("_n_all") - F.col("_n")), F.col("_n")), F.lit(0))
    kept_n = F.when(F.col(label) == 1, F.col("_n")).otherwise(n0)
    kept = ranked.withColumn("_kn", kept_n).where(F.col("_rank") <= F.col("_kn"))
    n_test = F.floor(F.col("_kn") * F.lit(share) + F.lit(0.5)).cast("long")
    is_test = F.col("_rank") <= n_test
    return kept.withColumns({
        "split": F.when(is_test, F.lit("test")).otherwise(F.lit("train")),
        "fold": F.when(~is_test, ((F.col("_rank") - n_test - 1) % k).cast("int")),
    }).drop("_h", "_rank", "_n", "_n_all", "_kn")


def validation_holdout(train: DataFrame, key: str = C.KEY,
                       share: float = C.VALIDATION_SHARE, seed: int = C.SEED) -> DataFrame:
    """Flag ``is_val`` on the first floor(share·n) training rows, unstratified."""
    hashed = train.withColumn("_h", md5_hash(key, seed, "val"))
    cuts = hash_cuts(hashed, "_h", lambda n, _: F.floor(n * F.lit(share)).cast("long"), key)
    return hashed.withColumn("is_val", up_to_cut(cuts, "_h", key)).drop("_h")


def explain_sample(test: DataFrame, key: str = C.KEY, n: int = C.EXPLAIN_ROWS,
                   seed: int = C.SEED) -> DataFrame:
    """The first n test rows in seeded hash order, with their row number.

    A bounded top-n: every task sends n rows at most, and the window numbers n.
    """
    first = test.withColumn("_h", md5_hash(key, seed, "explain")).orderBy("_h", key).limit(n)
    return first.withColumn("row_id", F.row_number().over(Window.orderBy("_h", key)) - 1).drop("_h")
