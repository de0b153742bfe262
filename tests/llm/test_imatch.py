"""I-Match fingerprints: equal to a plain version; near texts share hashes, others do not."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from vigilo.llm import imatch as I

SPLIT = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def h64(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def terms(text):
    return {h64(w) for w in SPLIT.split(text.lower()) if w}


def by_hand(docs, s):
    """{(doc_id, text): (n_chars, edited sha256, print, edited print, near edited, near next)}"""
    docs = [(i, t or "") for i, t in docs]
    df = Counter(h for _, t in docs for h in terms(t))
    most = max(s.min_df, int(s.max_share * len(docs)))
    signed = lambda h: h - 2 ** 64 if h >= 2 ** 63 else h

    def print_of(text):
        own = {h for h in terms(text) if df[h] <= most}
        m = s.subsets
        while m < len(own):
            m *= 2
        kept = sorted((h for h in own if h % m < s.subsets and df[h] >= s.min_df), key=signed)
        if not kept:
            return 0, [h64(text)]
        cells = [[h for h in kept if h % (m * up) == i] for up in (1, 2) for i in range(s.subsets)]
        return m, [h64(" ".join(str(signed(h)) for h in c)) % 2 ** 32 if c else None for c in cells]

    def like(a, b):
        (m, x), (n, y) = a, b
        k = s.subsets
        if m != n:
            if m and 2 * m == n:
                x, y = x[k:], y[:k]
            elif n and 2 * n == m:
                x, y = x[:k], y[k:]
            else:
                return 0.0
        either = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
        return sum(p == q for p, q in either) / len(either) if either else 0.0

    def show(p):
        return f"{p[0]}:" + ",".join("" if c is None else f"{c:x}" for c in p[1])

    ring = sorted(set(docs), key=lambda d: -d[0])
    out = {}
    for (i, t), (_, after) in zip(ring, ring[1:] + ring[:1]):
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        p, e, n = print_of(t), print_of(edited), print_of(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), show(p), show(e), like(p, e), like(p, n))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                        "near_edited", "near_next").collect()]


@pytest.mark.parametrize("s", [I.Settings(), I.Settings(subsets=4, min_df=1, max_share=0.3)], ids=["default", "small"])
def test_equals_a_plain_version(spark, real_docs, s):
    docs = [(r.doc_id, r.text) for r in real_docs.select("doc_id", "text").collect()]
    plain = by_hand(docs, s)
    got = rows_of(I.fingerprints(real_docs, s))
    assert len(got) == len(docs)
    assert {r[0]: r[1:] for r in got} == plain


def test_edited_texts_are_nearer_than_others(spark):
    got = rows_of(I.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    near, other = np.array([r[5] for r in got]), np.array([r[6] for r in got])
    assert near.mean() > 0.35 and other.mean() < 0.05 and (near > other).mean() > 0.9


def test_equal_texts_have_equal_fingerprints(spark, real_docs):
    by_text = {}
    prints = {r[0]: r[3] for r in rows_of(I.fingerprints(real_docs))}
    for r in real_docs.select("doc_id", "text").collect():
        by_text.setdefault(r.text, set()).add(prints[r.doc_id])
    assert all(len(x) == 1 for x in by_text.values()) and any(True for _ in by_text)


def test_odd_rows(spark, odd_docs):
    got = rows_of(I.fingerprints(odd_docs))
    assert len(got) == odd_docs.count()
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 and r[3] and r[4] for r in got)
    chars = sorted(len(r.text or "") for r in odd_docs.select("text").collect())
    assert sorted(r[1] for r in got) == chars
    assert sum(r[0] is None for r in got) == 1


def test_ring_nulls_and_repeats(spark, make_docs):
    texts = ["abcdef", "uvw xyz", None, "12"]
    got = {r[0]: r for r in rows_of(I.fingerprints(make_docs(texts)))}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [got[k][2] for k in range(4)] == [sha("abcd12"), sha("uvw xab"), sha(""), sha("12")]    # 0 is followed by 3
    assert got[2][3] == got[2][4] and got[2][5] == 1.0
    alone = rows_of(I.fingerprints(make_docs(["one two three"])))
    assert alone[0][2] == sha("one two tone ") and len(alone) == 1 and alone[0][6] == 1.0
    again = make_docs(texts).union(make_docs(texts[:2])).union(make_docs(texts[:1]))
    assert sorted(rows_of(I.fingerprints(again)))[:3] == [sorted(rows_of(I.fingerprints(again)))[0]] * 3


def test_many_repeats_come_back(spark, make_docs, monkeypatch):
    monkeypatch.setattr(I, "COPIES_AT_ONCE", 3)
    docs = make_docs(["same text", "other"]).crossJoin(spark.range(10)).select("doc_id", "text")
    assert len(rows_of(I.fingerprints(docs))) == 20


def test_empty_table(spark, no_docs):
    assert rows_of(I.fingerprints(no_docs)) == []


def test_no_python_in_the_plan(spark, real_docs):
    plan = I.fingerprints(real_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
