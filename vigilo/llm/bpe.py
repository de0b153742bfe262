"""Byte-level BPE with a contiguous rank array.

A short word is held as two parallel arrays: its parts and the merge rank of
each adjacent pair. The smallest rank is found by scanning, its boundary is
deleted, and the two neighbouring ranks are refreshed, until no pair can
merge. The arrays of a word are a few dozen entries, so scanning beats a
priority queue. Words beyond ``SHORT`` bytes use
a queue instead, with the same result, so one long run of text cannot cost
its length squared.

Null and empty texts give no ids. Special tokens in the text become their own
id, as the ``tokenizers`` library does. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from vigilo.llm.common import arrow_schema, map_columns, text_chunks, to_batch

# Fixed value: the word pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT = 96               # bytes of a word up to which the rank array is scanned
BLOCK = 4_096            # words whose rank arrays are worked on together
CACHE_WORDS = 250_000    # words in a generation of a worker's cache
CHUNK = 4_000_000        # characters encoded together
NONE = 1 << 30           # rank of a pair that does not merge
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file → byte: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder for a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        keys = np.array([a << 20 | b for a, b in self.merges], dtype=np.int64)
        by_key = np.argsort(keys)
        self.pair_keys = keys[by_key]
        self.pair_rank = by_key.astype(np.int32)  # merges are held in rank order
        self.merged = np.array([i for _, i in self.merges.values()], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(PATTERN)
        self.young: dict[str, bytes] = {}  # two generations: words in use survive
        self.old: dict[str, bytes] = {}

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; ``NONE`` where they don't merge or one is missing (< 0)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_rank[at], NONE)

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; the rank arrays of a block of words of like
        length are the rows of one matrix, and every round merges one pair in each."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order) and len(words[order[lo]]) <= SHORT:
            width = max(len(words[order[lo]]) + 4, 8)
            hi = lo
            while hi < len(order) and hi - lo < BLOCK and len(words[order[hi]]) <= min(width, SHORT):
                hi += 1
            for i, ids in zip(order[lo:hi], self._block([words[i] for i in order[lo:hi]])):
                out[i] = ids
            lo = hi
        for i in order[lo:]:
            out[i] = np.array(self._long_word_ids([self.byte_ids[b] for b in words[i]]), dtype="<u4").tobytes()
        return out

    def _block(self, words: list[bytes]) -> list[bytes]:
        lens = np.array([len(w) for w in words])
        n, width = len(words), int(lens.max()) + 1
        cols = np.arange(width)
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[cols[None, :] < lens[:, None]] = np.array(self.byte_ids, dtype=np.int32)[
            np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((n, width), NONE, dtype=np.int32)
        ranks[:, :-1] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        done = np.full((n, width), -1, dtype=np.int32)
        live = np.arange(n)
        while len(live):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(live)), at]
            ended = low == NONE
            if ended.any():
                done[live[ended]] = ids[ended]
                ids, ranks, at, low, live = (x[~ended] for x in (ids, ranks, at, low, live))
                if not len(live):
                    break
            row = np.arange(len(live))
            ids[row, at] = self.merged[low]
            # Delete the boundary: parts after at + 1 and ranks after at move up.
            pull = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, pull, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols[None, :] + (cols[None, :] >= at[:, None]), width - 1), axis=1)
            ranks[:, -1] = NONE
            left = np.maximum(at - 1, 0)
            fresh = self._pair_ranks(ids[row, left], ids[row, left + 1])
            ranks[row, left] = fresh
            ranks[row, at] = np.where(at == 0, fresh, self._pair_ranks(ids[row, at], ids[row, at + 1]))
        kept = done >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = done[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long_word_ids(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of its parts has changed since
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in merges:
                    heapq.heappush(heap, (merges[p][0], left, *p))
        return [x for x in ids if x >= 0]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._stretches(t) for t in texts]
        self._learn({p for ps in parts for p in ps})
        look = self.young.__getitem__
        return [b"".join(map(look, ps)) for ps in parts]

    def _stretches(self, text: str) -> list[str]:
        """Cut ``text`` where a word surely starts. Where single spaces stand
        between other characters that is at each of them."""
        if self.split_special is not None and any(s in text for s in self.special):
            return [x for p in self.split_special.split(text) if p
                    for x in ([p] if p in self.special else self._stretches(p))]
        first, *rest = text.split(" ")
        if (first and first[-1].isspace()) or any(not p or p[0].isspace() or p[-1].isspace() for p in rest):
            return self.words.findall(text)
        return [first, *[" " + p for p in rest]]

    def _learn(self, stretches: set[str]) -> None:
        """Put all ``stretches`` into the young generation of the cache."""
        young, old = self.young, self.old
        if len(young) > CACHE_WORDS:
            self.young, self.old = young, old = {}, young
        missing = {}
        for p in stretches:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                elif p in self.special:
                    young[p] = np.array([self.special[p]], dtype="<u4").tobytes()
                else:
                    missing[p] = self.words.findall(p)
        words = list({w for ws in missing.values() for w in ws})
        known = dict(zip(words, self.word_ids([w.encode() for w in words])))
        for p, ws in missing.items():
            young[p] = b"".join(map(known.__getitem__, ws))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, RankArrayBPE] = {}


def loaded(path: str) -> RankArrayBPE:
    """The tokenizer of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(c):
        packed = loaded(path).encode_packed([x or "" for x in c["text"]])
        return {"doc_id": c["doc_id"], "ids": [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed]}

    return map_columns(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run,
                       f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from the rows of :func:`encode`."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(c):
        t = loaded(path)
        return {"doc_id": c["doc_id"], "text": [t.decode(x or ()) for x in c["ids"]]}

    return map_columns(tokens.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the text
    decoded from them, in one pass, so that the ids need not be moved."""
    schema = arrow_schema(DIGESTS)

    def run(batches):
        t, sha = loaded(path), hashlib.sha256
        for ids, texts in text_chunks(batches, CHUNK):
            packed = t.encode_packed(texts)
            back = (t.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed)
            yield to_batch({"doc_id": ids, "n_tokens": [len(p) // 4 for p in packed],
                            "ids_sha256": [sha(p).hexdigest() for p in packed],
                            "decoded_sha256": [sha(x.encode()).hexdigest() for x in back]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
