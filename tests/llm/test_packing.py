"""Boundaries against all choices, batches against their rules."""

import itertools
import re

import numpy as np
import pytest

from vigilo.llm import packing as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_choices(lengths, counts, buckets):
    best = None
    for n in range(min(buckets, len(lengths))):
        for cut in itertools.combinations(range(len(lengths) - 1), n):
            bounds = [lengths[i] for i in cut] + [lengths[-1]]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 9, len(lengths))
        k = int(rng.integers(1, 5))
        bounds, cost = P.optimal_boundaries(lengths, counts, k)
        assert cost == all_choices(lengths, counts, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1]
        assert cost == sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def check(docs, settings):
    got = P.pack(docs, settings).toPandas()
    words = {}
    for r in docs.select("doc_id", "text").collect():
        n = len(WORD.findall(r.text or ""))
        words[r.doc_id] = words.get(r.doc_id, 0) + n
    per_doc = got.groupby(got.doc_id.fillna(-1)).n_words.sum()
    assert {k: v for k, v in words.items() if v} == {None if k == -1 else k: v for k, v in per_doc.items()}
    assert (got.n_words <= got.bucket_length).all() and (got.n_words <= settings.max_length).all()
    for (bucket, batch), rows in got.groupby(["bucket", "batch"]):
        assert sorted(rows.slot) == list(range(len(rows)))
        assert len(rows) * rows.bucket_length.iloc[0] <= settings.batch_tokens
    for bucket, rows in got.groupby("bucket"):
        room = settings.batch_tokens // rows.bucket_length.iloc[0]
        assert rows.batch.max() == (len(rows) - 1) // room  # all but the last batch are full
    histogram = got.groupby("n_words").size()
    _, cost = P.optimal_boundaries(histogram.index.to_numpy(), histogram.to_numpy(), settings.buckets)
    assert (got.bucket_length - got.n_words).sum() == cost


def test_table(real_docs):
    check(real_docs, P.Settings())
    check(real_docs, P.Settings(max_length=100, buckets=3, batch_tokens=450, block_rows=40))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, P.Settings(max_length=512, batch_tokens=2048, block_rows=30))
    empty = P.pack(no_docs)
    assert empty.count() == 0 and empty.columns == P.pack(odd_docs).columns


def test_pieces_follow_each_other(make_docs):
    rows = P.pack(make_docs(["w " * 25]), P.Settings(max_length=10, batch_tokens=20)).orderBy("piece").collect()
    assert [(r.start_word, r.n_words) for r in rows] == [(0, 10), (10, 10), (20, 5)]


def test_a_batch_must_hold_a_sequence(make_docs):
    with pytest.raises(ValueError):
        P.pack(make_docs(["a"]), P.Settings(max_length=10, batch_tokens=9))


def test_rows_without_id_are_no_large_group(spark, monkeypatch):
    texts = ["a " * (1 + i % 37) for i in range(4000)]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tables = {}
    write = P.written
    monkeypatch.setattr(P, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    check(docs, P.Settings(max_length=64, buckets=3, batch_tokens=256, block_rows=100))
    assert tables["sequences"].where("doc_id IS NULL").count() <= 37  # a third of the rows, a row for each length


def test_copies_are_expanded_in_parts(make_docs):
    docs = make_docs(["w " * 7, "x y z"]).drop("doc_id").selectExpr("CAST(NULL AS bigint) AS doc_id", "text")
    docs = docs.crossJoin(docs.sparkSession.range(45)).drop("id")
    for copies in (1, 4, 45, 1000):
        check(docs, P.Settings(max_length=5, buckets=2, batch_tokens=20, copies=copies))


def test_repartitioning_changes_nothing(odd_docs):
    s = P.Settings(max_length=512, batch_tokens=2048, block_rows=30)
    rows = lambda d: sorted(map(str, P.pack(d, s).collect()))
    assert rows(odd_docs) == rows(odd_docs.repartition(7))
