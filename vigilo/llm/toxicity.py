"""Toxicity by class-conditional Kneser–Ney models.

Two character models, of toxic and of ordinary documents, give each word the
log-likelihood ratio of its letters, divided by its length. Their highest
order is counted per class; the lower orders are Kneser–Ney continuation
counts of both classes together, so an expression that is rare in either class
backs off to the same distribution and only what a class really shows tells
them apart. A document's features are the ratios of its strongest words and
the mean ratio over its text; a logistic regression turns them into a
probability. It is fitted on at most ``calibration_rows`` labelled rows, one
in ``calibration_share``, which alone the counts leave out.

Counts cover every other labelled row given, grow with them, and are summed in
the tasks first. Words of Latin letters (marks are dropped) and digits, the
narrow ones, are spelled in ``SYMBOLS`` symbols, so they have at most
``SYMBOLS ** ORDER`` (2^25) grams, the bound of what is sent to the tasks. A
word with any other letter is wide: its characters count as they are, 15 bits
each (two that are a multiple of 32,767 apart share a symbol), and its grams
have no bound. Their counts stay a Spark table; the models over it are
computed there, and the distinct wide words of the texts are joined to them.

A null or empty text, or one without letters, has all features 0. A document
with several labels is toxic if one says so; null labels and documents are
ignored. With one class or none to learn from every score is the base rate.
Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import arrow_schema, text_chunks, to_batch, written

ORDER = 5
SYMBOLS = 32             # 0 ends a word, 1-26 letters, 27 digits; the others are free
WIDE_ORDER = 4
WIDE_BITS = 15           # of a symbol of a wide word
WIDE_SYMBOLS = 1 << WIDE_BITS
WORD = re.compile(r"[^\W_]+")
CHUNK = 4_000_000
CACHE_WORDS = 250_000    # words whose ratios a worker remembers
FLUSH_WORDS = 200_000
STRONGEST = 3            # words whose mean ratio is a feature
#: Length-normalised ratios of the strongest word, of the strongest few, and of
#: all words; of narrow and of wide words, whose ratios differ in scale.
FEATURES = ("strongest", "strong", "mean", "wide_strongest", "wide_strong", "wide_mean")


@dataclass(frozen=True)
class Settings:
    calibration_rows: int = 20_000   # labelled rows that fit the regression, at most
    calibration_share: int = 5       # one in so many labelled rows is kept from the counts
    ridge: float = 1e-2


class Folding(dict):
    """Code points for ``str.translate``: Latin letters by their base letter,
    digits by 0, all else as it is."""

    def __missing__(self, code: int) -> int:
        plain = unicodedata.normalize("NFKD", chr(code))[0].lower()
        name = unicodedata.name(plain, "")
        if plain.isdigit():
            plain = "0"
        elif not plain.isascii() and name.startswith("LATIN SMALL LETTER "):     # as ß or ø, which do not decompose
            plain = name.removeprefix("LATIN SMALL LETTER ")[0].lower()
        got = ord(plain) if plain == "0" or "a" <= plain <= "z" else code
        if len(self) < 100_000:
            self[code] = got
        return got


FOLDING = Folding()
NARROW_SYMBOLS = np.array([27 if b == ord("0") else max(0, b - 96) for b in range(123)], dtype=np.int64)


def is_wide(word: str) -> bool:
    """Whether a word has a character that is neither a Latin letter nor a digit."""
    return not word.isascii() and not word.translate(FOLDING).isascii()


def packed(symbols: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The gram of ``order`` symbols that ends at each symbol of its word."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = symbols.copy()
    for k in range(1, order):
        grams |= np.where(place >= k, np.roll(symbols, k), 0) << (bits * k)
    return grams


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram ending at each symbol of each narrow word (its end included),
    packed in 5 bits a symbol, and the number of grams of each word."""
    spelled = "".join(w.translate(FOLDING) + "\0" for w in words)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    symbols = NARROW_SYMBOLS[np.frombuffer(spelled.encode("ascii"), dtype=np.uint8)]
    return packed(symbols, lengths, ORDER, 5), lengths


def wide_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same of wide words: ``WIDE_ORDER`` symbols of ``WIDE_BITS``."""
    spelled = "".join(w.translate(FOLDING) + "\0" for w in words)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    codes = np.frombuffer(spelled.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return packed(np.where(codes > 0, codes % (WIDE_SYMBOLS - 1) + 1, 0), lengths, WIDE_ORDER, WIDE_BITS), lengths


def gram_counts(rows: DataFrame) -> DataFrame:
    """(wide, gram, toxic, ordinary) of rows (text, toxic): sums over all words."""
    ddl = "wide boolean, gram bigint, toxic bigint, ordinary bigint"
    schema = arrow_schema(ddl)

    def flush(words: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for wide, grams_of in ((False, word_grams), (True, wide_grams)):
            grams, counts = [], []
            for counter in (words[1], words[0]):
                mine = [w for w in counter if is_wide(w) == wide]
                ends, lengths = grams_of(mine)
                grams.append(ends)
                counts.append(np.repeat(np.array([counter[w] for w in mine], dtype=np.int64), lengths))
            unique, at = np.unique(np.concatenate(grams), return_inverse=True)
            cut = len(grams[0])
            yield to_batch({"wide": np.full(len(unique), wide), "gram": unique,
                            "toxic": np.bincount(at[:cut], weights=counts[0], minlength=len(unique)).astype(np.int64),
                            "ordinary": np.bincount(at[cut:], weights=counts[1], minlength=len(unique)).astype(np.int64)},
                           schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {0: Counter(), 1: Counter()}
        for flags, texts in text_chunks(batches, CHUNK):
            for flag, text in zip(flags, texts):
                words[flag].update(WORD.findall(text.lower()))
                if sum(map(len, words.values())) > FLUSH_WORDS:
                    yield from flush(words)
                    words = {0: Counter(), 1: Counter()}
        if any(words.values()):
            yield from flush(words)

    return (rows.select("toxic", "text").mapInArrow(run, ddl)
            .groupBy("wide", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(at, weights=v, minlength=len(unique)) for v in values)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def discount(counts: np.ndarray) -> float:
    return discount_of(int((counts == 1).sum()), int((counts == 2).sum()))


def discount_of(ones: int, twos: int) -> float:
    """Absolute discount by the numbers of grams counted once and twice."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Order:
    """Counts of one order: P(last | context) = share + back * P(lower order)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        d = discount(counts)
        self.grams = grams
        self.contexts, total, kinds = grouped(grams >> 5, counts, np.ones(len(counts)))
        self.back = d * kinds / np.maximum(total, 1e-9)
        at, _ = found(self.contexts, grams >> 5)
        self.share = np.maximum(counts - d, 0) / np.maximum(total[at], 1e-9) if len(grams) else np.zeros(0)

    def probability(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at, here = found(self.contexts, grams >> 5)
        seen, there = found(self.grams, grams)
        if not len(self.grams):
            return lower
        share = np.where(there, self.share[seen], 0.0)
        return np.where(here, share + self.back[at] * lower, lower)


class Model:
    """The two models over one table of gram counts."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        by = np.argsort(grams)
        grams, toxic, ordinary = grams[by], toxic[by].astype(float), ordinary[by].astype(float)
        self.classes = [Order(grams[n > 0], n[n > 0]) for n in (toxic, ordinary)]
        # Continuations: in how many longer grams does a gram end, in either class.
        self.shared = []
        longer = grams
        for k in range(ORDER - 1, 0, -1):
            keys = longer & ((1 << (5 * k)) - 1)
            unique, n = grouped(keys, np.ones(len(keys)))
            self.shared.append((k, Order(unique, n)))
            longer = unique

    def ratios(self, words: list[str]) -> np.ndarray:
        """Length-normalised log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        grams, lengths = word_grams(words)
        p = np.full(len(grams), 1.0 / SYMBOLS)
        for k, order in reversed(self.shared):
            p = order.probability(grams & ((1 << (5 * k)) - 1), p)
        toxic, ordinary = (c.probability(grams, p) for c in self.classes)
        llr = np.log(np.maximum(toxic, 1e-12)) - np.log(np.maximum(ordinary, 1e-12))
        return np.add.reduceat(llr, np.cumsum(lengths) - lengths) / lengths


class WideModel(NamedTuple):
    """The models of wide words as tables: the log-likelihood ratio of every
    counted gram, and for grams not counted that of their context (the lower
    orders are common to both classes and cancel)."""
    grams: DataFrame
    contexts: DataFrame


def context_of(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, WIDE_BITS)


def back_off(d: float, kinds: Column, total: Column) -> Column:
    """The weight of the lower order in a context, 1 where a class lacks it."""
    return F.when(total > 0, d * kinds / total).otherwise(F.lit(1.0))


def wide_model(counts: DataFrame) -> WideModel:
    """:class:`WideModel` of the wide rows of :func:`gram_counts`.

    Grams are distinct rows here, and a context has at most ``WIDE_SYMBOLS`` of
    them, so the windows over contexts are bounded.
    """
    seen = counts.where("wide").select("gram", "toxic", "ordinary")
    # Continuations: in how many longer grams does a gram end, in either class.
    tables: dict[int, DataFrame] = {}
    longer = seen.select("gram")
    for k in range(WIDE_ORDER - 1, 0, -1):
        tables[k] = written(longer.select(F.col("gram").bitwiseAND((1 << (WIDE_BITS * k)) - 1).alias("gram"))
                            .groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"wide-{k}")
        longer = tables[k].select("gram")
    by_context = Window.partitionBy(context_of(F.col("gram")))
    lower = None
    for k in range(1, WIDE_ORDER):
        ones, twos = tables[k].agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        d = discount_of(ones, twos)
        below = F.lit(1.0 / WIDE_SYMBOLS)
        rows = tables[k]
        if lower is not None:
            rows = rows.join(lower, rows["gram"].bitwiseAND((1 << (WIDE_BITS * (k - 1))) - 1) == lower["shorter"])
            below = F.col("p")
        total, kinds = F.sum("n").over(by_context), F.count(F.lit(1)).over(by_context)
        share = F.greatest(F.col("n") - d, F.lit(0.0)) / total
        lower = rows.select(F.col("gram").alias("shorter"), (share + d * kinds / total * below).alias("p"))
    first = seen.agg(*(F.count_if(F.col(c) == n) for c in ("toxic", "ordinary") for n in (1, 2))).first()
    discounts = {"toxic": discount_of(first[0], first[1]), "ordinary": discount_of(first[2], first[3])}

    rows = seen.join(lower, seen["gram"].bitwiseAND((1 << (WIDE_BITS * (WIDE_ORDER - 1))) - 1) == lower["shorter"])
    logs = {}
    for c, d in discounts.items():
        total, kinds = F.sum(c).over(by_context), F.count_if(F.col(c) > 0).over(by_context)
        share = F.when(total > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / total).otherwise(F.lit(0.0))
        logs[c] = F.ln(F.greatest(share + back_off(d, kinds, total) * F.col("p"), F.lit(1e-12)))
    grams = rows.select("gram", (logs["toxic"] - logs["ordinary"]).alias("ratio"))
    backs = {c: F.ln(back_off(d, F.count_if(F.col(c) > 0), F.sum(c))) for c, d in discounts.items()}
    contexts = seen.groupBy(context_of(F.col("gram")).alias("context")).agg(
        (backs["toxic"] - backs["ordinary"]).alias("context_ratio"))
    return WideModel(written(grams, "wide-ratios"), written(contexts, "wide-contexts"))


def wide_ratios(words: DataFrame, wide: WideModel) -> DataFrame:
    """(word, ratio): length-normalised log-likelihood ratio of each of the distinct ``words``."""
    ddl = "word string, size int, gram bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at, end in slices([len(w) + 1 for w in words], CHUNK):
                grams, lengths = wide_grams(words[at:end])
                yield to_batch({"word": np.repeat(np.array(words[at:end], dtype=object), lengths),
                                "size": np.repeat(lengths, lengths), "gram": grams}, schema)

    places = words.select("word").mapInArrow(run, ddl)
    return (places.join(wide.grams, "gram", "left")
            .join(wide.contexts, context_of(places["gram"]) == F.col("context"), "left")
            .groupBy("word").agg((F.sum(F.coalesce("ratio", "context_ratio", F.lit(0.0))) / F.max("size")).alias("ratio")))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` in sum; a larger item comes alone."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


class Scorer:
    """What the words of texts say, with the ratios of a worker's words remembered in
    two generations."""

    def __init__(self, model: Model):
        self.model = model
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def measures(self, texts: list[str]) -> dict[str, list]:
        """Of each text the strongest ratios, the sum and number of all ratios
        of its narrow words, and its wide words with their numbers."""
        words = [WORD.findall(t.lower()) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for w in set().union(*words):
            if w not in young:
                if w in old:
                    young[w] = old[w]
                elif is_wide(w):
                    young[w] = np.nan          # known by its table only
                else:
                    missing.append(w)
        young.update(zip(missing, self.model.ratios(missing).tolist()))
        out: dict[str, list] = {"top": [], "total": [], "n": [], "wide": []}
        look = young.__getitem__
        for ws in words:
            r = np.fromiter(map(look, ws), dtype=float, count=len(ws))
            beyond = np.isnan(r)
            wide: Counter = Counter()
            if beyond.any():
                wide.update(ws[i] for i in np.flatnonzero(beyond).tolist())
                r = r[~beyond]
            top = np.partition(r, -STRONGEST)[-STRONGEST:] if len(r) > STRONGEST else r
            out["top"].append(sorted(top.tolist(), reverse=True))
            out["total"].append(float(r.sum()))
            out["n"].append(len(r))
            out["wide"].append(list(wide.items()))
        return out


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, text, flag): one row per document row with a label."""
    one = (labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max((F.col(column) > 0).cast("int")).alias("flag")))
    rows = docs.select("doc_id", "text")
    # Labels grow with the documents, so neither side is broadcast at any size.
    return rows.join(one.hint("shuffle_hash"), rows["doc_id"] == one["labelled_id"]).select("doc_id", "text", "flag")


def held_aside(share: int):
    """Labelled rows of which those that fit the regression are taken."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(share)) == 0


class Fitted(NamedTuple):
    """What a fit has learned: the narrow counts (a broadcast of at most 2^25
    grams), the tables of the wide model, the regression's weights."""
    narrow: object
    wide: WideModel
    weights: np.ndarray


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method; the weights of the standardised features come back on
    the features' own scale, the intercept last."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(y) * np.diag([1.0] * x.shape[1] + [0.0]) + 1e-9 * np.eye(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Fitted:
    """The models and the regression from the labelled rows given."""
    spark = docs.sparkSession
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & held_aside(settings.calibration_share))
              .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.calibration_rows))
    flags = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    # calibration_rows ids at most
    ids = F.broadcast(spark.createDataFrame([(i,) for i in flags], "doc_id bigint"))
    rows = labelled(docs, labels.select("doc_id", "toxic"), "toxic").withColumnRenamed("flag", "toxic")
    counts = written(gram_counts(rows.join(ids, "doc_id", "left_anti")), "toxic-grams")
    # At most 2^25 rows, as there are no more narrow grams.
    table = counts.where("NOT wide").select("gram", "toxic", "ordinary").toArrow()
    grams, toxic, ordinary = (table.column(c).to_numpy() for c in ("gram", "toxic", "ordinary"))
    shared = spark.sparkContext.broadcast((grams, toxic, ordinary))
    wide = wide_model(counts)
    y, x = np.zeros(0), np.zeros((0, len(FEATURES)))
    if flags:
        got = feature_rows(docs.join(ids, "doc_id", "left_semi"), shared, wide).toArrow()
        y = np.array([flags[i] for i in got.column("doc_id").to_pylist()], dtype=float)
        x = np.column_stack([got.column(c).to_numpy() for c in FEATURES]) if len(y) else x
    counted = toxic.any() or not counts.where("wide AND toxic > 0").isEmpty()
    if len(y) and 0 < y.sum() < len(y) and counted:
        weights = fit_logistic(x, y, settings.ridge)
    else:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.append(np.zeros(len(FEATURES)), np.log(rate / (1 - rate)))
    return Fitted(shared, wide, weights)


_SCORER: list = []


def scorer(table: tuple) -> Scorer:
    """The scorer of this worker process, kept while the model stays the same."""
    if not _SCORER or _SCORER[0] is not table:
        _SCORER[:] = [table, Scorer(Model(*table))]
    return _SCORER[1]


def feature_rows(docs: DataFrame, narrow, wide: WideModel) -> DataFrame:
    """(doc_id, features) of every document.

    The texts are read once; what they say by narrow words, and their wide
    words, are written, and the wide words' ratios joined to them by row.
    """
    ddl = "doc_id bigint, top array<double>, total double, n bigint, wide map<string, bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        s = scorer(narrow.value)
        for ids, texts in text_chunks(batches, CHUNK):
            yield to_batch({"doc_id": ids, **s.measures(texts)}, schema)

    measured = written(docs.select("doc_id", "text").mapInArrow(run, ddl)
                       .withColumn("row", F.monotonically_increasing_id()), "toxic-measures")
    words = measured.select("row", F.explode("wide").alias("word", "times"))
    several = F.array_repeat("ratio", F.least("times", F.lit(STRONGEST)).cast("int"))
    by_row = words.join(wide_ratios(words.select("word").distinct(), wide), "word").groupBy("row").agg(
        strongest_of(F.flatten(F.collect_list(several))).alias("wide_top"),
        F.sum(F.col("ratio") * F.col("times")).alias("wide_total"), F.sum("times").alias("wide_n"))
    both = measured.drop("wide").join(by_row, "row", "left")
    values = []
    for kind in ("", "wide_"):
        top, total, n = (f"{kind}{c}" for c in ("top", "total", "n"))
        mean = F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / F.size(top)
        values += [F.get(top, F.lit(0)), mean, F.col(total) / F.col(n)]
    spoken = [F.col("n") > 0] * 3 + [F.col("wide_n") > 0] * 3
    return both.select("doc_id", *(F.when(some, v).otherwise(F.lit(0.0)).alias(f) for f, some, v in zip(FEATURES, spoken, values)))


def strongest_of(ratios: Column) -> Column:
    return F.slice(F.sort_array(ratios, asc=False), 1, STRONGEST)


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared, wide, weights = model
    *w, intercept = (float(x) for x in weights)
    z = sum((F.col(c) * v for c, v in zip(FEATURES, w)), F.lit(intercept))
    # Nearest to a tenth of a billionth, so that the order of additions cannot show.
    p = F.round(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))), 10)
    return (feature_rows(docs, shared, wide).withColumn("score", p)
            .select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
