"""Ranked lexical search with bag deduplication.

Documents are restricted to the vocabulary of the searching items. What is left
of a document is its bag: a term frequency for each vocabulary term, and the
length part ``m`` of the score. Documents with the same bag and the same ``m``
have the same score for every item, so they form a class that is scored once:
classes are found by a hash of the bag and told apart by the bag itself.

For each item the best classes are chosen by score, then by their smallest
document. The ``k`` best of them hold the item's ``k`` best documents, since
each class that stands before another has a document before all of that
other's. The chosen classes are expanded into their ``k`` smallest documents,
and those are ranked.

A score is a sum of integers, exact in 64 bits. Items come in blocks of a
bounded vocabulary, and each block is held against all documents; a task keeps
``k`` classes an item, and a class of any size sends ``k`` documents from
each task that reads it.

Defined cases: a null text has no term; documents without a term count
nowhere, and those without a term of any item are in no result. Rows are
documents of their own, also when they repeat an id; rows without an id come
after all others of the same score, with a null ``doc_id``. Items without a
term, or with a null text, have no rows; rows that repeat an item's id are items of
their own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo.llm.common import arrow_schema, give_back, ranges, to_batch, written

# Fixed value: bytes of terms (digits, letters, all beyond ASCII); the others separate them.
TERM_BYTES = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Each byte as it counts: A-Z as a-z, separators as a blank.
FOLDED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(TERM_BYTES) else 0x20 for b in range(256))
NO_ID = np.iinfo(np.int64).max
EXACT = 2.0 ** 53


@dataclass(frozen=True)
class Settings:
    b: int = 25                     # share of the length part, in hundredths
    block_terms: int = 200_000      # distinct terms of the items searched at once, about
    block_items: int = 1_000        # items searched at once, about
    batch_classes: int = 2_000      # classes scored at once in a task
    batch_products: int = 4_000_000  # contributions held at once


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def as_bytes(column: pa.Array) -> list:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame, id_col: str) -> DataFrame:
    """(item_id, terms, counts) of each item with a term."""
    ddl = "item_id bigint, terms array<binary>, counts array<bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            found = [(i, c) for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) if (c := Counter(terms_of(t)))]
            yield to_batch({"item_id": [i for i, _ in found], "terms": [list(c) for _, c in found],
                            "counts": [list(c.values()) for _, c in found]}, schema)

    return items.select(F.col(id_col).cast("bigint").alias("item_id"), "text").mapInArrow(run, ddl)


@dataclass
class Questions:
    """Items of a block: their vocabulary, and for each term the items that hold it."""
    ids: list            # of the items, by place; may repeat or be null
    vocabulary: dict     # term -> place
    start: np.ndarray    # of each term's items
    length: np.ndarray
    item: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(rows: list) -> Questions:
        vocabulary = {t: k for k, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        term = np.array([vocabulary[t] for r in rows for t in r.terms], dtype=np.int64)
        item = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        count = np.array([c for r in rows for c in r.counts], dtype=np.int64)
        order = np.lexsort((item, term))
        length = np.bincount(term, minlength=len(vocabulary))
        return Questions([r.item_id for r in rows], vocabulary, np.cumsum(length) - length, length, item[order], count[order])


def bags(docs: DataFrame, questions: Questions) -> DataFrame:
    """(doc_id, n, bag, df, docs, terms): a row for each document with a term of the
    vocabulary, and one for each task with its counts of documents and terms."""
    ddl = "doc_id bigint, n bigint, bag binary, df array<bigint>, docs bigint, terms bigint"
    schema = arrow_schema(ddl)
    held = docs.sparkSession.sparkContext.broadcast(questions.vocabulary)  # bounded by the block

    def run(batches):
        place = held.value.get
        df, n_docs, n_terms = np.zeros(len(held.value), dtype=np.int64), 0, 0
        for batch in batches:
            out = {"doc_id": [], "n": [], "bag": []}
            for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                found = terms_of(t)
                if not found:
                    continue
                n_docs += 1
                n_terms += len(found)
                tf = Counter(map(place, found))
                tf.pop(None, None)
                if tf:
                    bag = np.array(sorted(tf.items()), dtype=np.int64).T
                    df[bag[0]] += 1
                    out["doc_id"].append(i)
                    out["n"].append(len(found))
                    out["bag"].append(bag.astype(np.int32).tobytes())
            none = [None] * len(out["n"])
            yield to_batch({**out, "df": none, "docs": none, "terms": none}, schema)
        yield to_batch({"doc_id": [None], "n": [None], "bag": [None], "df": [df], "docs": [n_docs], "terms": [n_terms]}, schema)
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of all entries of some bags."""
    sizes = np.array([len(x) // 8 for x in rows], dtype=np.int64)
    flat = np.frombuffer(b"".join(rows), dtype=np.int32).astype(np.int64)
    at = ranges(2 * (np.cumsum(sizes) - sizes), sizes)
    row = np.repeat(np.arange(len(rows)), sizes)
    return row, flat[at], flat[at + sizes[row]]


def scores(rows: list[bytes], m: np.ndarray, w: np.ndarray, q: Questions, most_products: int) -> np.ndarray:
    """Scores of classes (rows) for items (columns), exact 64-bit integers."""
    row, term, tf = unpacked(rows)
    each = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    n = len(q.ids)
    out = np.zeros(len(rows) * n, dtype=np.int64)
    products = np.cumsum(q.length[term])
    lo = 0
    while lo < len(row):
        done = products[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(products, done + most_products, "right")))
        length = q.length[term[lo:hi]]
        at = ranges(q.start[term[lo:hi]], length)
        value = np.repeat(each[lo:hi], length) * q.count[at]
        place = np.repeat(row[lo:hi] * n, length) + q.item[at]
        # Doubles add whole numbers exactly up to 2^53; beyond, integers are added one by one.
        if float(value.astype(np.float64).sum()) < EXACT:
            out += np.bincount(place, weights=value, minlength=len(out)).astype(np.int64)
        else:
            np.add.at(out, place, value)
        lo = hi
    return out.reshape(len(rows), n)


def best(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best, by score, then the smallest document."""
    order = np.lexsort((first, -score, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return order[rank < k]


def best_classes(classes: DataFrame, w: np.ndarray, q: Questions, k: int, s: Settings) -> DataFrame:
    """(item, score, first, hash, m, bag): for each item the k best classes of each task."""
    ddl = "item int, score bigint, first bigint, hash bigint, m bigint, bag binary"
    schema = arrow_schema(ddl)
    held = classes.sparkSession.sparkContext.broadcast((w, q))  # bounded by the block

    def run(batches):
        w, q = held.value
        kept = {"item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "first": np.zeros(0, np.int64),
                "hash": np.zeros(0, np.int64), "m": np.zeros(0, np.int64), "bag": np.zeros(0, object)}
        for big in batches:
            for at in range(0, big.num_rows, s.batch_classes):
                batch = big.slice(at, s.batch_classes)
                hash_, m = (batch.column(c).to_numpy() for c in (0, 1))
                bag = np.array([*batch.column(2).to_pylist(), None], dtype=object)[:-1]
                first = batch.column(3).fill_null(NO_ID).to_numpy()
                table = scores(list(bag), m, w, q, s.batch_products)
                floor = np.ones(len(q.ids), dtype=np.int64)
                if len(table) > k:
                    floor = np.maximum(floor, np.partition(table, -k, axis=0)[-k])
                row, item = np.nonzero(table >= floor)
                new = {"item": item, "score": table[row, item], "first": first[row], "hash": hash_[row], "m": m[row], "bag": bag[row]}
                kept = {c: np.concatenate([kept[c], new[c]]) for c in kept}
                keep = best(kept["item"], kept["score"], kept["first"], k)
                kept = {c: x[keep] for c, x in kept.items()}
        for at in range(0, len(kept["item"]), s.batch_classes):
            part = {c: x[at:at + s.batch_classes] for c, x in kept.items()}
            part["first"] = [None if x == NO_ID else x for x in part["first"].tolist()]
            yield to_batch(part, schema)
        give_back()

    return classes.select("hash", "m", "bag", "first").mapInArrow(run, ddl)


def search_block(docs: DataFrame, q: Questions, k: int, s: Settings) -> DataFrame:
    """The result for the items of one block."""
    spark = docs.sparkSession
    read = written(bags(docs, q), "bags")
    counted = read.where("df IS NOT NULL")
    n_docs, n_terms = counted.agg(F.sum("docs"), F.sum("terms")).first()
    ddl = "item_id bigint, rank int, doc_id bigint, score bigint"
    if not n_terms:
        return spark.createDataFrame([], ddl)
    by_term = counted.select(F.posexplode("df").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(q.vocabulary), dtype=np.int64)
    for r in by_term.collect():  # a row for each term of the block
        df[r.term] = r.df
    members = read.where("bag IS NOT NULL").select(
        "doc_id", "bag", (F.expr(f"({s.b} * n * {n_docs}) div {n_terms}") + (100 - s.b)).alias("m"))
    members = members.withColumn("hash", F.xxhash64("bag", "m"))
    same = ("hash", "m", "bag")
    classes = members.groupBy(*same).agg(F.min("doc_id").alias("first"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), *same)
    chosen = written(best_classes(classes, weights(df, n_docs), q, k, s)
                     .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "chosen")
    # At most k hashes for each item of the block; the bags themselves decide afterwards.
    wanted = members.join(F.broadcast(chosen.select("hash").distinct()), "hash", "left_semi")
    smallest = Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id"))
    wanted = wanted.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k).drop("place")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = (chosen.select("item", "score", *same).join(wanted, list(same))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
    names = spark.createDataFrame(list(enumerate(q.ids)), "item int, item_id bigint")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, s: Settings = Settings(), id_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0 only."""
    asked = written(item_terms(items, id_col), "items")
    n_items, total = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    blocks = max(-(-(total or 0) // s.block_terms), -(-n_items // s.block_items))
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, blocks)))
    found = [search_block(docs, Questions.of(rows), k, s) for block in range(blocks)
             if (rows := asked.where(own == block).collect())]  # a block, see Settings
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame(
        [], "item_id bigint, rank int, doc_id bigint, score bigint")
