"""Links and classes against all pairs."""

import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from vigilo.llm import ngram_join as J
from vigilo.llm.graph import components


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def all_pairs(texts):
    """{id: (class, links)} of {id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in sets}


def result(docs, settings=J.Settings()):
    return {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs, settings).collect()}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == all_pairs({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


def near_copies(n, words=80, changes=4, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_a_large_group_keeps_every_link(make_docs, block):
    texts = near_copies(150) + near_copies(30, seed=9) + ["short one"] * 5
    settings = J.Settings(block_rows=block, group_rows=20)
    assert result(make_docs(texts), settings) == all_pairs(dict(enumerate(texts)))


def test_similarity_of_exactly_the_threshold_links(make_docs):
    # 9 shingles of which 8 are shared: 8 / 10; and one fewer.
    a = [f"a{i}" for i in range(13)]
    texts = [" ".join(a), " ".join(a[:12] + ["z"]), " ".join(a[:11] + ["y", "z"])]
    assert result(make_docs(texts)) == all_pairs(dict(enumerate(texts)))
    assert result(make_docs(texts))[0][1] == 1


def test_odd_rows(odd_docs, no_docs):
    rows = J.jaccard_join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    assert (got[0].class_id, got[0].n_links) == (0, 0) and (got[1].class_id, got[2].n_links) == (1, 0)
    assert got[8].class_id == 7 and got[None].class_id is None
    assert J.jaccard_join(no_docs).count() == 0
    kept = J.representatives_only(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and ids.count(7) == 2 and None in ids and 0 in ids and 1 in ids


def test_posterior_bound():
    s = J.Settings()
    t = float(Fraction(s.threshold))
    for n, m in J.least_matches(s).items():
        posterior = lambda k: sum(comb(n + 1, i) * t ** i * (1 - t) ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert posterior(m) >= s.tolerance and (m == 0 or posterior(m - 1) < s.tolerance)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    factors = J.multipliers(512, 1)
    pool = J.mixed(rng.integers(0, 1 << 62, 3000, dtype=np.uint64))
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    got = (J.signature(a, factors) == J.signature(b, factors)).mean()
    assert abs(got - 1 / 3) < 0.08


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(5000, i) for i in range(5001, 5100)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.vertex: r.smallest for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
