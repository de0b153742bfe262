"""Quality classifier: random-indexing word vectors and a small network.

Every token gets a sparse random index vector; its word vector is the sum of
the index vectors in its window (itself included) over the whole corpus.
Tokens share ``BUCKETS`` vectors by hash, which bounds the table whatever the
vocabulary. A document is the mean of its tokens' normalised vectors, with its
length and how often a token is repeated at once. A network with one hidden layer (numpy) scores it, and a temperature
fitted on rows that training did not see calibrates the probability.

Word vectors are counted over all documents; the network learns from at most
``Settings.training_rows`` labelled rows. A null or empty text is the zero
vector, and is scored too. A document with several labels is good if one says
so; null labels are ignored. With one class or none to learn from every score
is the base rate. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import arrow_schema, text_chunks, to_batch
from vigilo.llm.suffix_dedup import Fingerprints

BUCKETS = 1 << 14
DIM = 64
INPUTS = DIM + 2
NONZERO = 2              # entries of an index vector, each +1 or -1
WINDOW = 2
CHUNK = 2_000_000
AT_ONCE = 100_000       # vectors of a text that are gathered at once
SLICE = 1_000_000        # bytes whose tokens are hashed together


@dataclass(frozen=True)
class Settings:
    training_rows: int = 20_000   # labelled rows the network learns from, at most
    hidden: int = 32
    epochs: int = 40
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 7


def byte_kinds() -> np.ndarray:
    """0: between tokens, 1: part of a word (letters, digits, all beyond ASCII), 2: a symbol, a token of its own."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[33:127] = 2
    kinds[[b for b in range(128) if chr(b).isalnum() or chr(b) == "_"]] = 1
    kinds[128:] = 1
    return kinds


KINDS = byte_kinds()
_PRINTS: list[Fingerprints] = []


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens, and the number of tokens of each text.

    Tokens are found and hashed as stretches of the joined bytes, a bounded
    number of bytes at a time. Such a slice ends before a word that it does not
    hold whole, so that a text's tokens do not depend on the texts beside it; a
    word of more than ``SLICE`` bytes counts as pieces of that size.
    """
    if not _PRINTS:
        _PRINTS.append(Fingerprints(SLICE))
    data = [t.encode() + b"\n" for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    buckets, begins = [], []
    following = 0
    while following < len(joined):
        at = following
        kind = KINDS[joined[at:at + SLICE]]
        following = at + len(kind)
        if following < len(joined) and kind[-1] == 1 and KINDS[joined[following]] == 1:
            outside = np.flatnonzero(kind != 1)
            if len(outside):
                kind = kind[:outside[-1] + 1]
                following = at + len(kind)
        part = joined[at:following]
        word = np.concatenate([[False], kind == 1, [False]])
        begin = np.flatnonzero((kind == 2) | (word[1:-1] & ~word[:-2]))
        end = begin + 1
        end[kind[begin] == 1] = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        prefixes = _PRINTS[0].prefixes(part)
        buckets.append((_PRINTS[0].of(prefixes, begin, end) % np.uint64(BUCKETS)).astype(np.int64))
        begins.append(begin + at)
    if not begins:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    place = np.searchsorted(np.concatenate(begins), bounds)
    return np.concatenate(buckets), np.diff(place)


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.stack([rng.integers(0, DIM, BUCKETS) for _ in range(NONZERO)], axis=1)
    return places, rng.choice(np.array([-1, 1]), size=(BUCKETS, NONZERO))


def context_sums(tokens: np.ndarray, lengths: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(BUCKETS, DIM) sums of index vectors in the windows of some texts."""
    total = np.zeros(BUCKETS * DIM)
    text = np.repeat(np.arange(len(lengths)), lengths)
    for k in range(WINDOW + 1):
        a, b = tokens[:len(tokens) - k], tokens[k:]
        if k:
            same = text[:len(text) - k] == text[k:]
            a, b = a[same], b[same]
        for word, near in ((a, b), (b, a))[:1 + (k > 0)]:
            for j in range(NONZERO):
                total += np.bincount(word * DIM + places[near, j], weights=signs[near, j], minlength=len(total))
    return total.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, seed: int) -> np.ndarray:
    """Unit word vectors of all buckets from the whole corpus.

    Each task adds up its own rows and passes on one row a bucket; Spark sums
    those, in the tasks first. The driver gets ``BUCKETS`` rows.
    """
    columns = [f"d{i}" for i in range(DIM)]
    ddl = "bucket int, " + ", ".join(f"{c} bigint" for c in columns)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(seed)
        total = np.zeros((BUCKETS, DIM), dtype=np.int64)
        for _, texts in text_chunks(batches, CHUNK):
            total += context_sums(*tokens_of(texts), places, signs).astype(np.int64)
        used = np.flatnonzero(total.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 2_000)):
            if len(part):
                yield to_batch({"bucket": part, **dict(zip(columns, total[part].T))}, schema)

    sums = (docs.select("doc_id", "text").mapInArrow(run, ddl)
            .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns))).toArrow()
    vectors = np.zeros((BUCKETS, DIM), dtype=np.float32)
    vectors[sums.column("bucket").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in columns])
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean vector, log length and share of tokens like the one before, of each text."""
    tokens, lengths = tokens_of(texts)
    out = np.zeros((len(texts), INPUTS), dtype=np.float64)
    ones = np.ones(AT_ONCE, dtype=vectors.dtype)
    for i, end in enumerate(np.cumsum(lengths).tolist()):
        n = int(lengths[i])
        for at in range(end - n, end, AT_ONCE):
            part = tokens[at:min(at + AT_ONCE, end)]
            out[i, :DIM] += ones[:len(part)] @ vectors.take(part, axis=0) / n
    if len(tokens):
        text = np.repeat(np.arange(len(texts)), lengths)
        again = (tokens[1:] == tokens[:-1]) & (text[1:] == text[:-1])
        out[:, DIM + 1] = np.bincount(text[1:][again], minlength=len(texts)) / np.maximum(lengths, 1)
    out[:, DIM] = np.log1p(lengths)
    return out


class Network:
    """tanh hidden layer, one logit; inputs standardised, output tempered."""

    def __init__(self, inputs: int, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.mean, self.sd, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.p = [rng.normal(0, inputs ** -0.5, (inputs, settings.hidden)), np.zeros(settings.hidden),
                  rng.normal(0, settings.hidden ** -0.5, settings.hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.sd @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, settings: Settings) -> None:
        """Adam on the log loss."""
        rng = np.random.default_rng(settings.seed)
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.mean) / self.sd
        first, second = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        step = 0
        for _ in range(settings.epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), settings.batch):
                rows = order[at:at + settings.batch]
                w1, b1, w2, b2 = self.p
                h = np.tanh(z[rows] @ w1 + b1)
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[rows]) / len(rows)
                dh = np.outer(d, w2) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[rows].T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                    g = g + settings.decay * self.p[i] * (i in (0, 2))
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - settings.rate * (first[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on unseen rows."""
        logits = self.logits(x)

        def loss(t):
            return float(np.mean(np.logaddexp(0, logits / t) - y * logits / t))

        self.temperature = float(min(np.exp(np.linspace(-2, 2, 161)), key=loss))


def learn(x: np.ndarray, y: np.ndarray, settings: Settings) -> Network:
    network = Network(INPUTS, settings)
    aside = np.arange(len(y)) % 5 == 0
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        network.p = [np.zeros_like(p) for p in network.p]
        network.p[3] = np.array([np.log(rate / (1 - rate))])
        return network
    network.train(x[~aside], y[~aside], settings)
    network.calibrate(x[aside], y[aside])
    return network


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple:
    """Word vectors of ``docs`` and a network from the labelled rows given."""
    spark = docs.sparkSession
    # BUCKETS x DIM floats: 4 MB.
    vectors = spark.sparkContext.broadcast(word_vectors(docs, settings.seed))
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.training_rows))
    flags = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    x, y = np.zeros((0, INPUTS)), np.zeros(0)
    if flags:
        ids = F.broadcast(spark.createDataFrame([(i,) for i in flags], "doc_id bigint"))  # training_rows ids at most
        rows = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

        def run(batches):
            for i, texts in text_chunks(batches, CHUNK):
                yield to_batch({"doc_id": i, "x": list(pooled(texts, vectors.value))}, schema)

        schema = arrow_schema("doc_id bigint, x array<double>")
        got = rows.mapInArrow(run, "doc_id bigint, x array<double>").toArrow().sort_by("doc_id")
        if len(got):
            x = np.stack(got.column("x").to_numpy())
            y = np.array([flags[i] for i in got.column("doc_id").to_pylist()], dtype=float)
    mixed = np.random.default_rng(settings.seed).permutation(len(y))
    return vectors, learn(x[mixed], y[mixed], settings)


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    vectors, network = model
    ddl = "doc_id bigint, score double, predicted int"
    schema = arrow_schema(ddl)

    def run(batches):
        for ids, texts in text_chunks(batches, CHUNK):
            p = np.round(network.score(pooled(texts, vectors.value)), 9)
            yield to_batch({"doc_id": ids, "score": p, "predicted": (p >= 0.5).astype(np.int32)}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
