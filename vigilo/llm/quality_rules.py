"""Quality rules: distribution divergence from language references.

Base counts (words, symbols, repeated lines, repeated three-word windows) come
first. A document that passes them is held against each language's reference
by two histograms: character classes, and common words. Its distance to a
language is the Jensen–Shannon distance (base 2, 0 to 1) of each; it is
rejected if no language is near enough. A histogram over too few items is
noise, so each test has a minimum length, below which it says nothing.

References are counts over all documents: the character classes of each
``lang``, its script, and the shares of its most frequent words. A language has
a reference if it has words enough for a stable histogram (``min_words``),
however large the others are. A document's own ``lang`` only counts for the
references; its verdict follows its text alone. The nearest language decides. A
text that holds hardly any common word of any reference (``min_common_share`` of
what is usual) is of a language without one: the word test says nothing of it,
and the class test takes all letters as one class, since languages differ in
theirs. Where the script of most letters has no reference no test speaks.

A null text is empty. Empty and short texts fail the base rule. Without any
reference (no rows, or all languages null) only the base rule decides.
Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import (
    WORD_SEPARATORS, arrow_schema, give_back, map_columns, text_chunks, to_batch, written)

# The characters counted as symbols, and the base limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Classes of bytes; every byte of the UTF-8 text is in exactly one.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "line", "stop", "comma", "mark",
           "bracket", "symbol", "beyond", "control")
LETTERS = ("vowel", "consonant", "upper", "beyond")  # one class for languages without a reference
FLUSH_WORDS = 200_000  # distinct words a task counts before it passes them on
CHUNK = 4_000_000
TOP_PARTS = 32         # a language's words are ranked in so many parts, so that no task has all
RULES = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
         "n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean")


@dataclass(frozen=True)
class Settings:
    """Limits of the divergence tests."""
    common_words: int = 100          # words of a language's reference
    min_words: int = 1_000           # for a language to have a reference: ten for each bin
    max_class_distance: float = 0.28
    max_word_distance: float = 0.45
    min_chars: int = 200             # below, the class test says nothing
    min_common_words: int = 100      # words, below which the word test says nothing
    min_common_share: float = 0.25   # of a reference's share of common words, for its language


def byte_classes() -> np.ndarray:
    """Class number of every byte."""
    out = np.full(256, CLASSES.index("control"), dtype=np.int64)
    out[128:] = CLASSES.index("beyond")
    groups = {"vowel": "aeiou", "consonant": "bcdfghjklmnpqrstvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "digit": "0123456789", "space": " \t", "line": "\r\n", "stop": ".", "comma": ",;:",
              "mark": "!?\"'`", "bracket": "()[]{}-_/\\", "symbol": "#*$%&|<>@^~+="}
    for name, chars in groups.items():
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


def class_counts(data: bytes, classes: np.ndarray) -> np.ndarray:
    per_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    return np.bincount(classes, weights=per_byte, minlength=len(CLASSES))


def script_table() -> np.ndarray:
    """Script number of every pair of first and second byte of a character;
    0 for none, as digits, marks and symbols. Neighbouring blocks of 128
    characters share a script only where they are one by name."""
    out = np.zeros((256, 256), dtype=np.int64)
    letters = [c for c in range(128) if chr(c).isalpha()]
    out[letters] = 1                                           # Latin
    out[0xC3:0xCB] = 1
    out[0xE1, 0xB8:0xBC] = 1
    for n, (first, last) in enumerate(((0xCE, 0xCF), (0xD0, 0xD3), (0xD4, 0xD5), (0xD6, 0xD7), (0xD8, 0xDB),
                                       (0xDC, 0xDF), (0xE3, 0xE9), (0xEA, 0xED)), 2):
        out[first:last + 1] = n                                # Greek, Cyrillic, … Han and kana, Hangul
    for first in (0xE0, 0xE1):
        for second in range(0x80, 0xC0):
            if not out[first, second]:
                out[first, second] = 100 + (first & 1) * 32 + (second - 0x80) // 2
    return out


def script_counts(data: bytes, table: np.ndarray) -> np.ndarray:
    """Characters of each script."""
    per_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    wide = [b for b in (0xE0, 0xE1) if per_byte[b]]
    by_first = table[:, 0].copy()
    out = np.bincount(by_first, weights=per_byte, minlength=164)
    if wide:
        raw = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(np.isin(raw[:-1], wide))
        out += np.bincount(table[raw[at], raw[at + 1]], minlength=164)
    out[0] = 0
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen–Shannon distance (base 2) of one histogram, or of each row of
    ``p``, to each row of ``q``."""
    p = p / p.sum(axis=-1, keepdims=True)
    q = q / q.sum(axis=1, keepdims=True)
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)

    return np.sqrt(np.maximum(0.0, (kl(np.broadcast_to(p, q.shape)) + kl(q)) / 2))


def base_counts(text: str) -> tuple[dict[str, int], np.ndarray, dict[bytes, int]]:
    """The base counts, the words as numbers, and the number of each distinct word."""
    data = text.encode()
    words = data.split()  # bytes split at exactly the six separators
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n_dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(WORD_SEPARATORS):
            n_dup += line in seen
            seen.add(line)
    counts = {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, WORD_SEPARATORS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(ids, len(number)),
    }
    return counts, ids, number


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside a three-word window that occurs at least twice."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = n[which] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= twice
    return int(covered.sum())


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, item, n): every lower-case word, character class and script
    of each language, counted in each task first, then summed."""
    ddl = "lang string, kind string, item string, n bigint"
    schema = arrow_schema(ddl)
    classes, table = byte_classes(), script_table()

    def flush(words, chars, scripts):
        rows = [(lang, "word", w.decode(), n) for (lang, w), n in words.items()]
        rows += [(lang, "class", str(i), int(n)) for lang, c in chars.items() for i, n in enumerate(c)]
        rows += [(lang, "script", str(i), int(n)) for lang, c in scripts.items() for i, n in enumerate(c) if n]
        return to_batch(dict(zip(schema.names, zip(*rows))), schema)

    def run(batches):
        words: Counter = Counter()
        chars: dict = {}
        scripts: dict = {}
        for langs, texts in text_chunks(batches, CHUNK):
            for lang, text in zip(langs, texts):
                words.update((lang, w) for w in text.lower().encode().split())
                data = text.encode()
                chars[lang] = chars.get(lang, 0) + class_counts(data, classes)
                scripts[lang] = scripts.get(lang, 0) + script_counts(data, table)
                if len(words) > FLUSH_WORDS:
                    yield flush(words, chars, scripts)
                    words, chars, scripts = Counter(), {}, {}
        if chars:
            yield flush(words, chars, scripts)
        words.clear()
        give_back()

    known = docs.where("lang IS NOT NULL").select("lang", "text")
    return known.mapInArrow(run, ddl).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, settings: Settings = Settings()) -> dict:
    """The languages' references. What reaches the driver follows the number
    of languages with ``min_words``: ``common_words`` rows for each, and its
    classes and scripts."""
    counts = written(language_counts(docs), "language-counts")
    totals = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("words"))
    langs = {r["lang"]: r["words"] for r in totals.where(F.col("words") >= settings.min_words).collect()}
    if not langs:
        return {}
    own = counts.join(F.broadcast(totals.where(F.col("words") >= settings.min_words).select("lang")), "lang", "left_semi")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("item"), F.lit(TOP_PARTS))).orderBy(F.desc("n"), "item")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top: dict = {}
    for r in (own.where("kind = 'word'").withColumn("rank", F.row_number().over(part))
              .where(F.col("rank") <= settings.common_words).withColumn("rank", F.row_number().over(whole))
              .where(F.col("rank") <= settings.common_words).collect()):
        top.setdefault(r["lang"], []).append((-r["n"], r["item"].encode()))
    bins: dict = {}
    for r in own.where("kind <> 'word'").collect():
        bins.setdefault((r["lang"], r["kind"]), {})[int(r["item"])] = r["n"]
    out = {}
    for lang, words in sorted(langs.items()):
        common = {w: -n / words for n, w in sorted(top[lang])[:settings.common_words]}
        chars, scripts = bins.get((lang, "class"), {}), bins.get((lang, "script"), {})
        out[lang] = {"words": common, "rest": max(0.0, 1 - sum(common.values())),
                     "classes": [chars.get(i, 0) for i in range(len(CLASSES))],
                     "script": max(scripts, key=lambda i: (scripts[i], -i)) if scripts else None}
    return out


class Judge:
    """Distances of a document to the references."""

    def __init__(self, refs: dict, settings: Settings):
        self.settings = settings
        self.classes, self.table = byte_classes(), script_table()
        self.scripts = frozenset(r["script"] for r in refs.values())
        self.class_refs = np.array([r["classes"] for r in refs.values()], dtype=float).reshape(len(refs), len(CLASSES))
        # Sums the letter classes into one, keeps the others.
        self.merge = np.zeros((len(CLASSES), 1 + len(CLASSES) - len(LETTERS)))
        others = [c for c in CLASSES if c not in LETTERS]
        for i, c in enumerate(CLASSES):
            self.merge[i, 0 if c in LETTERS else 1 + others.index(c)] = 1
        self.vocab: dict[bytes, list[tuple[int, int]]] = {}
        width = 1 + max([0, *(len(r["words"]) for r in refs.values())])
        self.word_refs = np.zeros((len(refs), width))
        for k, r in enumerate(refs.values()):
            for i, (w, share) in enumerate(r["words"].items()):
                self.vocab.setdefault(w, []).append((k, i))
                self.word_refs[k, i] = share
            self.word_refs[k, -1] = r["rest"]

    def distances(self, data: bytes, ids: np.ndarray, number: dict[bytes, int]) -> tuple[float | None, float | None]:
        s = self.settings
        if not len(self.class_refs):
            return None, None
        seen = np.zeros_like(self.word_refs)
        n = np.bincount(ids, minlength=len(number))
        for w, k in number.items():
            for lang, i in self.vocab.get(w.decode().lower().encode(), ()):
                seen[lang, i] += n[k]
        common = seen[:, :-1].sum(axis=1)
        seen[:, -1] = len(ids) - common
        known = (common >= s.min_common_share * (1 - self.word_refs[:, -1]) * len(ids)).any()
        by_class = by_word = None
        if len(data) >= s.min_chars:
            counts = class_counts(data, self.classes)
            by_class = (js_distance(counts, self.class_refs) if known
                        else js_distance(counts @ self.merge, self.class_refs @ self.merge))
        if known and len(ids) >= s.min_common_words:
            by_word = js_distance(seen, self.word_refs)
        both = [d for d in (by_class, by_word) if d is not None]
        if not both:
            return None, None
        # The language that is nearest by all tests that speak.
        best = int(np.argmin(sum(both)))
        return tuple(None if d is None else float(d[best]) for d in (by_class, by_word))

    def comparable(self, data: bytes) -> bool:
        """Whether there is a reference of the script that most letters are of."""
        counts = script_counts(data, self.table)
        return not counts.any() or int(counts.argmax()) in self.scripts

    def verdict(self, text: str) -> dict:
        """The base counts, distances and decision of one text."""
        s = self.settings
        counts, ids, number = base_counts(text)
        failed = (counts["n_words"] < MIN_WORDS
                  or 100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
        data = text.encode()
        by_class, by_word = ((None, None) if failed or not self.comparable(data)
                             else self.distances(data, ids, number))
        near = ((by_class is None or by_class <= s.max_class_distance)
                and (by_word is None or by_word <= s.max_word_distance))
        return {**counts, "base_failed": failed, "class_distance": by_class, "word_distance": by_word,
                "kept": not failed and near}


def judge(docs: DataFrame, refs: dict, settings: Settings = Settings()) -> DataFrame:
    """The base counts, distances and verdict of every document."""
    known: list = []

    def run(c):
        if not known:
            known.append(Judge(refs, settings))
        verdicts = [known[0].verdict(text or "") for text in c["text"]]
        return {"doc_id": c["doc_id"], **{k: [v[k] for v in verdicts] for k in verdicts[0]}}

    return map_columns(docs.select("doc_id", "text"), run, RULES)


def kept(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    refs = references(docs, settings)

    def run(batches):
        j = Judge(refs, settings)
        for batch in batches:
            keep = [j.verdict(t or "")["kept"] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, type=pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit the references on ``docs`` and judge every document by them."""
    return judge(docs, references(docs, settings), settings)
