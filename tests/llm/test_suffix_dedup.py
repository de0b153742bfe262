"""Removed bytes against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from vigilo.llm import suffix_dedup as D


def plain(rows):
    """{(id, text): (bytes, removed, spans, digest)} of (id, text) rows."""
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49) if i is not None else ():
            s = data[p:p + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 49) if i is not None else ():
            if first[data[p:p + 50]] < i:
                gone[p:p + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out.append((str(i), len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(docs, settings=D.Settings()):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digests(docs, settings).collect())


SMALL = D.Settings(bucket_bytes=30_000, batch_windows=500, block_bytes=50_000)


@pytest.mark.parametrize("settings", [D.Settings(), SMALL])
def test_table(real_docs, settings):
    assert result(real_docs, settings) == plain([(r.doc_id, r.text) for r in real_docs.collect()])


def test_borders(make_docs):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    s = word(120)
    texts = [s, s[:49], s[:50], "x" + s[10:60] + "y", s[30:] + s[:30], word(30) + s[60:111], "ab" * 300, "b" + "ab" * 40,
             s, "é" * 40 + s[:50], "a" * 500, "a" * 49, "a" * 51]
    for order in (texts, texts[::-1]):
        assert result(make_docs(order), SMALL) == plain(list(enumerate(order)))


def test_long_texts_come_in_pieces(make_docs):
    settings = D.Settings(bucket_bytes=30_000, chunk_bytes=1500, piece_bytes=700)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(3000)) for _ in range(3)]
    texts.append(texts[0][500:2600] + texts[1][100:180] + "tail")
    data = [t.encode() for t in texts]
    for which, offset, parts in D.pieces(data, settings):
        for i, at, part in zip(which, offset, parts):
            assert data[i][at:at + len(part)] == part
    assert result(make_docs(texts), settings) == plain(list(enumerate(texts)))


def test_a_passage_that_all_share(make_docs):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef ") for _ in range(90))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(100)) + passage + "".join(rng.choice("mnop ") for _ in range(60))
             for _ in range(300)]
    assert result(make_docs(texts), SMALL) == plain(list(enumerate(texts)))


def test_index_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    index, seen = D.IndexFamily(), {}
    for batch in range(40):
        windows = rng.integers(0, 4000, 100).astype(np.uint64)
        documents = np.full(100, batch, dtype=np.int64)
        documents[50:] += rng.integers(-3, 4, 50)  # batches need not be in order
        everything = dict(seen)
        for w, d in zip(windows.tolist(), documents.tolist()):
            everything[w] = min(d, everything.get(w, d))
        found = index.scan_and_add(windows, documents)
        assert found.tolist() == [everything[w] < d for w, d in zip(windows.tolist(), documents.tolist())]
        seen = everything
        sizes = [len(k) for k, _ in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_odd_rows(odd_docs, no_docs):
    # The long rows repeat themselves only, so they can be left out of the plain table.
    docs = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (5, 6, 10)")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert D.digests(odd_docs).count() == odd_docs.count()
    got = D.deduplicate(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text is None and rows[1].text == "" and rows[8].text == "" and rows[8].n_chars == 0
    assert rows[6].text and len(rows[6].text) == rows[6].n_chars
    assert D.digests(no_docs).count() == 0 and D.deduplicate(no_docs).count() == 0


def test_cut_characters_go_whole(make_docs):
    text = "é" * 60
    got = D.deduplicate(make_docs([text, "x" + text[:30] + "ü" + text])).orderBy("doc_id").collect()
    assert got[0].text == text
    assert "�" not in got[1].text and got[1].n_chars == len(got[1].text)
