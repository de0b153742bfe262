"""Personal data: patterns, and a skip-chain conditional random field over them.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
The field then labels every token that holds a digit or an ``@`` with one of
these kinds or none. Its unary potentials come from the token and its
neighbours; chain edges join tokens that stand side by side; skip edges join
distant tokens that are the same or similar (the same digits, or the same
letters in another case). Loopy sum-product messages, passed until they settle,
make the labels agree across the document, so a number that is a phone number once is found where
it is repeated without its marks. Runs of tokens that the field is sure of,
outside the patterns' spans, are added as spans of their kind.

All potentials are learned from the patterns' spans in a bounded sample of
the documents (``Settings.sample``); every document is searched whole. A
token is joined to the previous one like it, not to all, so a document's
edges grow with its tokens.

A null text is empty; texts without digits and ``@`` have no spans. Without
any document to learn from only the patterns speak. Repeated rows are
searched alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import arrow_schema, map_columns, ranges, text_chunks, to_batch

# The kinds, in the order in which spans are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits matches from its start or not at all
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CANDIDATE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NOT_KEY = re.compile(r"[^0-9a-z@]+")
FEATURES = 1 << 12   # rows of the weight table; features share them by hash
LABELS = len(KINDS) + 1  # the last is "none"
CHUNK = 4_000_000
FOUND = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
         "base_sha256 string, spans string")


@dataclass(frozen=True)
class Settings:
    sample: int = 1_000          # documents to learn from
    sample_tokens: int = 400     # tokens of each of them
    rounds: int = 12             # a message that still moves after a multiple of these is slowed until it rests
    damping: float = 0.3
    tolerance: float = 1e-7      # change of a message (log scale) that is passed on
    sure: float = 0.95           # least probability of an added token
    similar_digits: int = 5      # least digits that make two tokens similar
    agreement: float = 8.0       # skip edges of each label that agree, assumed before any is seen


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@label.label…``, found from each ``@``
    backwards, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def shape(token: str) -> str:
    """Letters and digits by class, runs shortened to one."""
    out = re.sub(r"[^\W\d_]+", "a", token[:64])
    return re.sub(r"[0-9]+", lambda m: "9" if len(m.group()) < 5 else "99", out)


def feature_rows(token: str, before: str, after: str) -> list[int]:
    """Rows of the weight table for one token among its neighbours."""
    s = shape(token)
    n = sum(c.isdigit() for c in token)
    named = (f"s:{s}", f"n:{min(n, 20)}", f"l:{min(len(token), 30)}", f"b:{shape(before)}|{s}",
             f"a:{s}|{shape(after)}", f"d:{token.count('.')}", "bias")
    return [zlib.crc32(x.encode()) % FEATURES for x in named]


@dataclass
class Graph:
    """Tokens and edges of some documents."""
    document: list
    start: list
    end: list
    rows: list           # feature rows of each token
    chain: list          # (token, token) side by side
    skip: list           # (token, earlier token like it)


def build_graph(texts: list[str], settings: Settings, limit: int | None = None) -> Graph:
    g = Graph([], [], [], [], [], [])
    for d, text in enumerate(texts):
        if not CANDIDATE.search(text):
            continue
        last: dict[str, int] = {}
        before, previous, n = "", None, 0
        tokens = TOKEN.finditer(text)
        current = next(tokens, None)
        while current is not None:
            following = next(tokens, None)
            word = current.group()
            if CANDIDATE.search(word):
                k = len(g.start)
                g.document.append(d)
                g.start.append(current.start())
                g.end.append(current.end())
                g.rows.append(feature_rows(word, before, following.group() if following else ""))
                if previous is not None:
                    g.chain.append((previous, k))
                plain = NOT_KEY.sub("", word.lower())
                digits = "".join(c for c in plain if "0" <= c <= "9")
                for key in {plain, digits if len(digits) >= settings.similar_digits else plain}:
                    if key in last:
                        g.skip.append((last[key], k))
                    last[key] = k
                previous = k
                n += 1
                if n == limit:
                    break
            else:
                previous = None
            before, current = word, following
    return g


def labels_of(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The kind of the pattern span that each token overlaps, or none."""
    out = np.full(len(g.start), LABELS - 1)
    by_document: dict[int, list[int]] = {}
    for i, d in enumerate(g.document):
        by_document.setdefault(d, []).append(i)
    for d, nodes in by_document.items():
        starts = np.array([g.start[i] for i in nodes])
        ends = np.array([g.end[i] for i in nodes])
        for kind, a, b in reversed(spans[d]):  # where kinds overlap, the first listed stays
            lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
            for i in nodes[lo:hi]:
                out[i] = kind
    return out


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def unary_scores(g: Graph, weights: np.ndarray) -> np.ndarray:
    return weights[np.array(g.rows, dtype=np.int64).reshape(len(g.start), -1)].sum(axis=1)


def pair_potential(edges: list, labels: np.ndarray, agreement: float = 0.0) -> np.ndarray:
    """Log ratio of how often two labels meet on an edge to how often they
    would by chance; symmetric, smoothed by a prior count."""
    n = np.full((LABELS, LABELS), 0.5) + agreement * np.eye(LABELS)
    if edges:
        e = np.array(edges)
        np.add.at(n, (labels[e[:, 0]], labels[e[:, 1]]), 1)
    n = n + n.T
    p = n / n.sum()
    return np.clip(np.log(p) - np.log(np.outer(p.sum(axis=1), p.sum(axis=0))), -4, 4)


def learn(samples: list[str], settings: Settings) -> dict | None:
    """Unary weights by softmax regression, pair potentials by counting."""
    g = build_graph(samples, settings, settings.sample_tokens)
    if not g.start:
        return None
    y = labels_of(g, [base_spans(t) for t in samples])
    rows = np.array(g.rows, dtype=np.int64)
    target = np.eye(LABELS)[y]
    weights = np.zeros((FEATURES, LABELS))
    squares = np.full_like(weights, 1e-8)
    for _ in range(150):
        error = np.exp(log_softmax(weights[rows].sum(axis=1))) - target
        gradient = 1e-4 * weights
        np.add.at(gradient, rows.ravel(), np.repeat(error / len(y), rows.shape[1], axis=0))
        squares += gradient ** 2
        weights -= 0.3 * gradient / np.sqrt(squares)
    return {"weights": weights, "chain": pair_potential(g.chain, y), "skip": pair_potential(g.skip, y, settings.agreement)}


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, settings: Settings) -> np.ndarray:
    """Label probabilities of all tokens by damped loopy sum-product.

    ``edges`` (m, 2) with log potentials ``pair`` (m, L, L). Message 2e goes
    from an edge's first token to its second, 2e + 1 back. A round renews the
    messages whose inputs have changed, until none has, so evidence travels as
    far as it bears. In a loop messages may swing for ever: one renewed more
    often than evidence from afar needs takes ever smaller steps.
    """
    unary = log_softmax(unary)
    if not len(edges):
        return np.exp(unary)
    source, sink = edges.ravel(), edges[:, ::-1].ravel()
    psi = np.stack([pair, pair.transpose(0, 2, 1)], axis=1).reshape(-1, LABELS, LABELS)
    message = np.full((len(source), LABELS), -np.log(LABELS))
    renewed = np.zeros(len(source), dtype=np.int64)
    free = 5 * settings.rounds + 12 * np.sqrt(len(unary))
    by_source = np.argsort(source, kind="stable")
    n_out = np.bincount(source, minlength=len(unary))
    first_out = np.cumsum(n_out) - n_out
    belief = unary.copy()
    np.add.at(belief, sink, message)
    active = np.arange(len(source))
    while len(active):
        out = (belief[source[active]] - message[active ^ 1])[:, :, None] + psi[active]
        top = out.max(axis=1, keepdims=True)
        out = log_softmax(np.log(np.exp(out - top).sum(axis=1)) + top[:, 0])
        renewed[active] += 1
        step = (1 - settings.damping) * 0.9 ** np.maximum(0, renewed[active] - free)
        change = step[:, None] * (out - message[active])
        moved = np.abs(change).max(axis=1) > settings.tolerance
        active, change = active[moved], change[moved]
        message[active] += change
        np.add.at(belief, sink[active], change)
        # Next: those on their way, and those that start where one has arrived.
        tokens = np.unique(sink[active])
        active = np.union1d(active, by_source[ranges(first_out[tokens], n_out[tokens])])
    return np.exp(log_softmax(belief))


def added_spans(texts: list[str], base: list[list[tuple]], model: dict | None, settings: Settings) -> list[list[tuple]]:
    """Spans of the field, outside the patterns' spans, per text."""
    out: list[list[tuple]] = [[] for _ in texts]
    if model is None:
        return out
    g = build_graph(texts, settings)
    if not g.start:
        return out
    unary = unary_scores(g, model["weights"])
    known = labels_of(g, base)
    # What a pattern has found is evidence, so it reaches the tokens like it.
    unary[known < LABELS - 1] = np.where(np.eye(LABELS)[known[known < LABELS - 1]] > 0, 0.0, -20.0)
    edges = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
    pair = np.concatenate([np.broadcast_to(model[k], (len(e), LABELS, LABELS))
                           for k, e in (("chain", g.chain), ("skip", g.skip))])
    p = marginals(unary, edges, pair, settings)
    label = p.argmax(axis=1)
    sure = (label < LABELS - 1) & (p.max(axis=1) >= settings.sure) & (known == LABELS - 1)
    joined = set(map(tuple, g.chain))
    i = 0
    while i < len(label):
        if not sure[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(label) and sure[j + 1] and label[j + 1] == label[i] and (j, j + 1) in joined:
            j += 1
        text = texts[g.document[i]]
        start, end = g.start[i], g.end[j]
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        if start < end and all(end <= a or b <= start for _, a, b in base[g.document[i]]):
            out[g.document[i]].append((int(label[i]), start, end))
        i = j + 1
    return out


def sample_texts(docs: DataFrame, settings: Settings) -> list[str]:
    """The bounded sample: the first documents by hash that hold a digit or ``@``."""
    rows = (docs.where(F.col("text").rlike("[0-9@]")).select("doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample))
    ids = [r[0] for r in rows.collect() if r[0] is not None]
    kept = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text") if ids else docs.limit(0).select("doc_id", "text")
    return [t for _, t in sorted((r[0], r[1] or "") for r in kept.collect())]


def fit(docs: DataFrame, settings: Settings = Settings()) -> dict | None:
    return learn(sample_texts(docs, settings), settings)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(texts: list[str], model: dict | None, settings: Settings) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if CANDIDATE.search(t) else [] for t in texts]
    added = added_spans(texts, base, model, settings)
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def personal_data(docs: DataFrame, model: dict | None, settings: Settings = Settings()) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans, per document."""
    schema = arrow_schema(FOUND)

    def run(batches):
        for ids, texts in text_chunks(batches, CHUNK):
            found = find(texts, model, settings)
            out = {f"n_{k}": [sum(s[0] == i for s in b) for b, _ in found] for i, k in enumerate(KINDS)}
            out["doc_id"] = ids
            out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [listed(a) for _, a in found]
            yield to_batch(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redact(docs: DataFrame, model: dict | None, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and
    ``n_chars`` (where there is one) counted anew; a null text stays null."""
    names = docs.columns

    def run(c):
        texts = [t or "" for t in c["text"]]
        out = []
        for whole, text, (_, spans) in zip(c["text"], texts, find(texts, model, settings)):
            if whole is None:
                out.append(None)
                continue
            parts, at = [], 0
            for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                    at = b
                elif b > at:  # the rest of a span that overlaps the last one
                    at = b
            out.append("".join(parts) + text[at:])
        c = dict(c) | {"text": out}
        if "n_chars" in c:
            c["n_chars"] = [None if t is None else len(t) for t in out]
        return c

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_columns(docs.select(names), run, ddl)
