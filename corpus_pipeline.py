"""Corpus pipeline: five stages over ``documents``.

Each stage takes the rows its predecessor kept, written as Parquet and read
again; each works on them as on a table of their own. All but the last return
the columns of ``documents``:

1. quality rules: documents the rules reject go;
2. n-gram Jaccard join: of each class of near copies the smallest id stays;
3. suffix-array dedup: bytes that repeat from a smaller document are cut;
4. personal data: spans are replaced by their kind;
5. packing: sequences with their bucket, batch and place.

The quality references, shingle classes and suffix buckets are gathered from
all rows of the stage's input. ``ORACLE_SQL`` is None: no SQL expresses the
message passing of stage 4. Brute-force versions are in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilo.llm import ngram_join, packing, pii, quality_rules, suffix_dedup
from vigilo.llm.common import table, written


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; rows without an id are judged too."""
    return quality_rules.kept(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    return ngram_join.representatives_only(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat from smaller ids."""
    return suffix_dedup.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document in a batch of its length bucket."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_by_quality),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("suffix_array_dedup", cut_repeats),
    ("personal_data", mask_personal_data),
    ("length_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
