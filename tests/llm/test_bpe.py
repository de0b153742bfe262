"""Rank-array BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    from vigilo.llm.bpe import RankArrayBPE
    return RankArrayBPE(PATH)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(library, own):
    random.seed(3)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "'", "1", "٣", "²", "!", "日", "😀", " ", "　", "\x85",
             "<|endoftext|>", "_", "ß", "́", "the", "\x1f", "don't"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 50)))
        got = ids(library, text)
        assert own.encode(text) == got, text
        assert own.decode(got) == library.decode(got, skip_special_tokens=False), text


def test_long_words_use_a_queue_with_equal_results(library, own):
    for text in ("a" * 300, "ab" * 400, "=" * 1000 + "x", "thequickbrown" * 60):
        assert own.encode(text) == ids(library, text)


def test_a_very_long_word_is_not_quadratic(own):
    text = "z" * 200_000
    assert own.decode(own.encode(text)) == text


def test_block_and_single_word_agree(own):
    words = [b" hello", b"", b"x", b" thndwhat", bytes(range(60, 90))]
    assert own.word_ids(words) == [own.word_ids([w])[0] for w in words]


def test_whole_texts_of_the_table(real_docs, library):
    from vigilo.llm.bpe import round_trip_digests
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    for r in round_trip_digests(real_docs, PATH).collect():
        got = ids(library, texts[r.doc_id])
        assert r.n_tokens == len(got)
        assert r.ids_sha256 == hashlib.sha256(np.array(got, dtype="<u4").tobytes()).hexdigest()
        back = library.decode(got, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    from vigilo.llm.bpe import decode, encode, round_trip_digests
    got = round_trip_digests(odd_docs, PATH).collect()
    assert len(got) == odd_docs.count()
    empty = next(r for r in got if r.doc_id == 0)
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert round_trip_digests(no_docs, PATH).count() == 0
    back = {r.doc_id: r.text for r in decode(encode(odd_docs, PATH), PATH).collect()}
    for r in odd_docs.select("doc_id", "text").collect():
        assert back[r.doc_id] == (r.text or "")
