"""Held-out accuracy and odd rows of the quality and toxicity classifiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.llm import quality_classifier as Q
from vigilo.llm import toxicity as X

LARGE = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def held(folds, at):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == at


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = Q.fit(docs, labels.where(~held(3, 1)))
    got = Q.score(docs, model).join(labels.where(held(3, 1)), "doc_id").toPandas()
    y = got.quality.to_numpy()
    assert auc(got.score.to_numpy(), y) > 0.95
    assert ((got.predicted == 1) == (got.score >= 0.5)).all()
    assert (got.predicted == y).mean() > 0.93


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = X.fit(docs, labels.where(~held(5, 0)))
    got = X.score(docs, model).join(labels.where(held(5, 0)), "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.75
    assert got[got.predicted == 1].toxic.mean() > 0.8


def test_held_out_labels_are_not_used(real_docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = [sorted((r.doc_id, r.score) for r in X.score(real_docs, X.fit(real_docs, x.where(~held(5, 0)))).collect())
           for x in (labels, flipped)]
    assert got[0] == got[1]


def test_counts_are_all_grams(make_docs):
    docs = make_docs(["ab ab c", "ab"]).withColumn("toxic", (F.col("doc_id") == 0).cast("int"))
    got = {r.gram: (r.toxic, r.ordinary) for r in X.gram_counts(docs).collect()}
    grams, _ = X.word_grams(["ab"])
    assert [got[g] for g in grams.tolist()] == [(2, 1)] * 3  # ab, b and the end
    assert sum(t for t, _ in got.values()) == 3 + 3 + 2


def test_each_order_is_a_distribution():
    words = ["loser", "lost", "last", "list", "toast", "über", "a1"]
    grams, _ = X.word_grams(words)
    unique, n = np.unique(grams, return_counts=True)
    model = X.Model(unique, n, np.roll(n, 1))
    everything = np.arange(X.SYMBOLS)
    for context in (0, 12, 12 << 5 | 15, 99):
        p = np.full(X.SYMBOLS, 1 / X.SYMBOLS)
        grams = (context << 5) | everything
        for k, order in reversed(model.shared):
            p = order.probability(grams & ((1 << (5 * k)) - 1), p)
            assert abs(p.sum() - 1) < 1e-9
        for c in model.classes:
            assert abs(c.probability(grams, p).sum() - 1) < 1e-9


def test_context_sums_by_definition():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7])
    tokens = rng.integers(0, 50, lengths.sum())
    places, signs = Q.index_vectors(3)
    index = np.zeros((Q.BUCKETS, Q.DIM))
    for b in range(50):
        np.add.at(index[b], places[b], signs[b])
    want = np.zeros((Q.BUCKETS, Q.DIM))
    at = 0
    for n in lengths:
        for i in range(n):
            for j in range(max(0, i - Q.WINDOW), min(n, i + Q.WINDOW + 1)):
                want[tokens[at + i]] += index[tokens[at + j]]
        at += n
    assert (Q.context_sums(tokens, lengths, places, signs) == want).all()


@pytest.mark.parametrize("operator, column", [(Q, "quality"), (X, "toxic")])
def test_odd_rows_and_labels(operator, column, spark, odd_docs, no_docs):
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(3, 0, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], LABELS)
    none = spark.createDataFrame([], LABELS)
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(12)], LABELS)
    for labels in (some, none, one_class, some.select("doc_id", F.lit(None).cast("int").alias(column))):
        rows = operator.score(odd_docs, operator.fit(odd_docs, labels)).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        twins = {r.score for r in rows if r.doc_id in (7, 8)}
        assert len(twins) == 1
    assert operator.score(no_docs, operator.fit(no_docs, none)).count() == 0


def test_tokens_are_words_and_symbols():
    import re
    plain = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]")
    texts = ["Hello, wörld!! a_b 12.5", "", " \n\t", "###", "x", "日本 x\x00y\x7fz", "a" * 50, "a a a"]
    tokens, lengths = Q.tokens_of(texts)
    want = [plain.findall(t.encode()) for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    bucket = {}
    for t, b in zip((t for w in want for t in w), tokens.tolist()):
        assert bucket.setdefault(t, b) == b
    assert len(set(bucket.values())) > 0.8 * len(bucket)
    assert (Q.tokens_of(["pad pad", "###"])[0][-3:] == Q.tokens_of(["###"])[0]).all()


def test_tokens_do_not_depend_on_the_texts_beside(monkeypatch):
    texts = ["some words, and wörds!", "x" * 30, "日本語テキスト words " * 4, "", "a-b_c " * 9, "z" * 95 + " end"]
    alone = [Q.tokens_of([t])[0].tolist() for t in texts]
    for size in (32, 41, 64, 100):
        monkeypatch.setattr(Q, "SLICE", size)
        short = [i for i, t in enumerate(texts) if max((len(w.encode()) for w in t.split()), default=0) <= size]
        mine = [Q.tokens_of([t])[0].tolist() for t in texts]
        assert [mine[i] for i in short] == [alone[i] for i in short]
        for pad in range(0, 2 * size, 3):
            tokens, lengths = Q.tokens_of(["p" * pad, *texts])
            got = np.split(tokens, np.cumsum(lengths)[:-1])[1:]
            assert [g.tolist() for g in got] == mine


def test_quality_scores_do_not_depend_on_the_cut(real_docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    long = spark.createDataFrame([(10 ** 9, "mot " * 300_000 + "x" * 50, "fr", "s", 0)], real_docs.schema)
    docs = real_docs.unionByName(long)
    model = Q.fit(docs, labels)
    got = [{r.doc_id: r.score for r in Q.score(docs.repartition(n), model).collect()} for n in (1, 7, 50)]
    assert got[0] == got[1] == got[2]
    assert {i: v for i, v in got[0].items() if i != 10 ** 9} == {r.doc_id: r.score for r in Q.score(real_docs, model).collect()}
