"""Packing: optimal length buckets, and token-budget batches inside them.

Lengths of all documents make one global histogram. Dynamic programming over
it chooses the bucket boundaries that minimise total padding when every
sequence is padded to its bucket's boundary. Inside a bucket, sequences are
numbered and cut into batches of as many as the token budget holds at the
boundary's length.

A text longer than ``max_length`` words becomes consecutive pieces of that
length and a rest, so no word is lost. Null and empty texts have no words and
no row. Repeated rows are packed once each. Sequences that agree in document,
piece and length (repeated rows, rows without an id) are counted as one with a
weight, so no id makes a large group, and stand next to each other. Numbering
follows a hash of these, within blocks of bounded size whose counts are summed
into offsets, so no task sees a whole bucket and batches stay full across
blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo.llm.common import WORD_SEPARATORS, written


@dataclass(frozen=True)
class Settings:
    max_length: int = 2048        # words of a sequence; also bounds the histogram's rows
    buckets: int = 8
    batch_tokens: int = 16_384    # padded words of a batch
    block_rows: int = 50_000      # different sequences that one task numbers, about
    copies: int = 10_000          # like sequences that one row is expanded into


def word_count(text: Column) -> Column:
    """Words of a text; null and empty give 0. Every separator is one byte
    long, so words end where a separator follows another character."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_SEPARATORS, " " * len(WORD_SEPARATORS))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, the last is the largest length) with the least
    total padding, and that padding. Ties go to the smaller split points.

    ``best[j]`` is the least cost of the first j lengths in k buckets; a bucket
    of lengths i..j-1 costs (sum of counts) * length[j-1] - (sum of words).
    """
    if not len(lengths):
        return [], 0
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    words = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.int64)
    infinite = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, infinite, dtype=np.int64)
    best[0] = 0
    chosen = []
    for _ in range(min(buckets, n)):
        following = np.full(n + 1, infinite, dtype=np.int64)
        cut = np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (words[j] - words[:j])
            cut[j] = int(np.argmin(cost))
            following[j] = cost[cut[j]]
        best = following
        chosen.append(cut)
    bounds, j = [], n
    for cut in reversed(chosen):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    return bounds[::-1], int(best[n])


def sequences(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, piece, start_word, n_words): every word is in one sequence."""
    size = settings.max_length
    counted = docs.select("doc_id", word_count(F.col("text")).alias("total")).where("total > 0")
    pieces = counted.select("doc_id", "total", F.explode(
        F.sequence(F.lit(0), ((F.col("total") - 1) / size).cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * size
    return pieces.select("doc_id", "piece", start.alias("start_word"),
                         F.least(F.lit(size).cast("bigint"), F.col("total") - start).alias("n_words"))


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per sequence: its bucket, batch and place in the batch.

    (doc_id, piece, start_word, n_words, bucket, bucket_length, batch, slot);
    ``batch`` counts from 0 in each bucket, ``slot`` from 0 in each batch.
    """
    if settings.batch_tokens < settings.max_length:
        raise ValueError("a batch must hold the longest sequence")
    key = ("doc_id", "piece", "start_word", "n_words")
    rows = written(sequences(docs, settings).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "sequences")
    # At most max_length rows.
    histogram = sorted(map(tuple, rows.groupBy("n_words").agg(F.sum("copies"), F.count(F.lit(1))).collect()))
    lengths, counts, different = np.array(histogram, dtype=np.int64).reshape(-1, 3).T
    bounds, _ = optimal_boundaries(lengths, counts, settings.buckets)
    if not bounds:
        return rows.select(*key, *(F.lit(None).cast(t).alias(c) for c, t in
                                   (("bucket", "int"), ("bucket_length", "bigint"), ("batch", "bigint"), ("slot", "bigint"))))
    upper = F.array([F.lit(b).cast("bigint") for b in bounds])
    bucket = sum((F.col("n_words") > b).cast("int") for b in bounds)
    blocks = max(1, -(-int(different.sum()) // settings.block_rows))
    rows = rows.withColumn("bucket", bucket).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "n_words"), F.lit(blocks)).cast("int"))
    # buckets x blocks rows: a few for every block_rows sequences.
    sizes = rows.groupBy("bucket", "block").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = (Window.partitionBy("bucket", "block").orderBy(F.xxhash64("piece", "doc_id", "n_words"), "doc_id", "piece", "n_words")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = (rows.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0)))
                .join(offsets, ["bucket", "block"])
                .select(*key, "bucket", "copies", (F.col("offset") + F.col("first")).alias("first")))
    return expanded(numbered, settings.copies).select(
        *key, "bucket", F.element_at(upper, F.col("bucket") + 1).alias("bucket_length"), "place").withColumn(
        "room", F.floor(F.lit(settings.batch_tokens) / F.col("bucket_length"))).select(
        *key, "bucket", "bucket_length", F.floor(F.col("place") / F.col("room")).alias("batch"),
        F.pmod("place", "room").alias("slot"))


def expanded(numbered: DataFrame, most: int) -> DataFrame:
    """A row for each copy, with its ``place``: those with more than ``most``
    copies are first split into rows of at most so many and dealt anew."""
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / most)))
    split = (numbered.where(F.col("copies") > most).withColumn("part", part)
             .withColumn("first", F.col("first") + F.col("part") * most)
             .withColumn("copies", F.least(F.lit(most).cast("bigint"), F.col("copies") - F.col("part") * most))
             .repartition("first", "bucket").drop("part"))
    rows = numbered.where(F.col("copies") <= most).unionByName(split)
    return rows.withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
