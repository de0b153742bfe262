"""Ranked search: equal to a plain version; classes are told apart by their bags."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from vigilo.llm import bag_search as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = "item_id bigint, text string"


def words(text):
    return [w.translate(UPPER) for w in TERM.findall(text or "")]


def by_hand(docs, items, k, b=25):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, tf in bags for t in tf)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, w, tf in bags:
            m = 100 - b + (b * len(w) * n_docs) // n_terms
            score = sum(weight[t] * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if score > 0:
                scored.append((-score, 2 ** 63 if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, s=B.Settings(), docs_ddl="doc_id bigint, text string"):
    got = B.search(spark.createDataFrame(docs, docs_ddl), spark.createDataFrame(items, ITEMS), k, s)
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(60)] + ["Été", "日本", "naïve", "ABC", "abc"]
    p = 1 / np.arange(1, len(vocab) + 1)
    texts = [" ".join(rng.choice(vocab, size=rng.integers(1, 30), p=p / p.sum())) for _ in range(150)]
    docs = [(k, texts[k % 110]) for k in range(400)]                            # copies
    items = [(k, " ".join(rng.choice(vocab, size=6))) for k in range(12)]
    return docs, items


def test_equals_a_plain_version(spark, corpus):
    docs, items = corpus
    assert found(spark, docs, items) == by_hand(docs, items, 20)


def test_many_copies_fill_an_item_by_ascending_id(spark, corpus):
    docs, items = corpus
    hot = docs + [(10_000 + k, items[0][1]) for k in range(300, 0, -1)]
    got = found(spark, hot, items, k=7)
    assert got == by_hand(hot, items, 7)
    assert [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == 0] == [10_000 + k for k in range(1, 8)]


def test_blocks_and_batches_do_not_matter(spark, corpus):
    docs, items = corpus
    small = B.Settings(block_terms=9, block_items=3, batch_classes=7, batch_products=5)
    assert found(spark, docs, items, s=small) == found(spark, docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,;\n"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "b a"), (5, "b" * 100_000), (6, "a\x00b\x7fc"),
            (7, "A-B a_b"), (8, "Ä ä Á"), (9, "x " * 50_000 + "a")]
    items = [(1, "a A a"), (1, "b"), (None, "ä"), (3, None), (4, " ;"), (5, "nowhere"), (6, "b" * 100_000)]
    assert found(spark, docs, items) == by_hand(docs, items, 20)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [], []) == []
    docs = [(1, "a b"), (2, "a")]
    wide = [(*r, 1, "x", 2.0, 3) for r in docs]
    assert found(spark, wide, [(1, "a")], docs_ddl="doc_id bigint, text string, item_id int, bag string, score double, rank int") == \
        by_hand(docs, [(1, "a")], 20)


def test_equal_hashes_do_not_join_classes():
    rows = [np.array([[0, 1], [1, 1]], dtype=np.int32).tobytes(), np.array([[0], [3]], dtype=np.int32).tobytes()]
    row, term, tf = B.unpacked(rows)
    assert (row.tolist(), term.tolist(), tf.tolist()) == ([0, 0, 1], [0, 1, 0], [1, 1, 3])


def test_large_sums_are_exact():
    q = B.Questions([7], {b"a": 0}, np.array([0]), np.array([1]), np.array([0]), np.array([3]))
    bag = np.array([[0], [1]], dtype=np.int32).tobytes()
    w = np.array([2 ** 52 + 1])
    each = (2 ** 52 + 1) * (10 ** 9 // (1000 + 12 * 10 ** 8))
    assert B.scores([bag], np.array([10 ** 8]), w, q, 100)[0, 0] == 3 * each
    q.count[0] = 1
    assert B.scores([bag, bag], np.array([83_000_000, 10 ** 8]), w, q, 1)[:, 0].tolist() == [
        (2 ** 52 + 1) * (10 ** 9 // (1000 + 12 * 83_000_000)), each]
