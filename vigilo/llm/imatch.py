"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon is the terms whose inverse document frequency lies in a band:
found in at least ``min_df`` documents and in at most ``max_share`` of them.
Terms are maximal runs of letters, marks and digits, in lower case; a term's
64-bit hash stands for it. The lexicon is cut by those hashes into random
subsets, and a text's fingerprint has one hash for each of ``subsets`` of
them: of the sorted distinct terms that the text has in that subset. A text
with more terms uses smaller subsets, so that about one of its terms falls
into each; then a hash is left alone by an edit with the chance that its terms
are. Each text has the hashes of two neighbouring subset sizes, so that texts
of about one length share a size.

Likeness of two fingerprints: of the subsets of the shared sizes in which
either text has a term, the share with equal hashes. Fingerprints without a
shared size are unlike (0).

Everything is DataFrame functions. Only terms in one of a text's subsets are
looked up in the lexicon, a few dozen a text however long it is; terms above
the band, fewer than (mean distinct terms of a document) / ``max_share``, are
dropped before that, so no join key is hotter than the band's upper end.

Defined cases: a null text is empty. A text without a term of the lexicon in
its subsets (empty ones too) has the hash of the whole text as its fingerprint,
like only to itself. Rows that repeat both id and text are one document in the
order of documents and get a row each; rows that repeat an id only are ordered
by a hash of their text. Rows without an id come after all others. A single
document is its own next. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo.llm.common import written

COPIES_AT_ONCE = 10_000


@dataclass(frozen=True)
class Settings:
    subsets: int = 16         # hashes of a text for each of its two subset sizes; a power of two
    min_df: int = 2           # documents that hold a term of the lexicon, at least
    max_share: float = 0.05   # of all documents that hold it, at most


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def level(n: Column, s: Settings) -> Column:
    """Number of subsets that the lexicon is cut into for a text of n terms: a power of two."""
    over = F.floor((n - 1) / s.subsets).cast("bigint")
    doublings = F.when(over > 0, F.length(F.bin(over))).otherwise(0)
    return (F.pow(F.lit(2.0), doublings) * s.subsets).cast("bigint")


def chosen(text: Column, common: Column, s: Settings) -> Column:
    """struct(level, terms): the text's terms that fall into one of its subsets."""
    def pick(all_terms: Column) -> Column:
        return bound(level(F.size(all_terms), s), lambda m: F.struct(
            m.alias("level"), F.filter(all_terms, lambda h: h.bitwiseAND(m - 1) < s.subsets).alias("terms")))

    return bound(F.array_except(terms(text), common), pick)


def lexicon(texts: DataFrame, s: Settings) -> DataFrame:
    """(h, df) of the terms found in ``min_df`` documents or more."""
    return (texts.select(F.explode(terms(F.col("text"))).alias("h"))
            .groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= s.min_df))


def hashes(kept: Column, m: Column, s: Settings) -> Column:
    """Hash of the (sorted) terms in each subset; null where there are none."""
    def cell(i: Column) -> Column:
        own = F.filter(kept, lambda h: h.bitwiseAND(m - 1) == i)
        return bound(F.array_join(F.transform(own, lambda h: h.cast("string")), " "), lambda joined: F.when(
            joined != "", F.xxhash64(joined).bitwiseAND(F.lit(0xFFFFFFFF))))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(s.subsets - 1).cast("bigint")), cell)


def fingerprint(picked: Column, band: Column, whole: Column, s: Settings) -> Column:
    """struct(level, cells): hashes of the subsets at ``level`` and at twice it.

    Without any, level 0 and the hash of the whole text.
    """
    def build(kept: Column) -> Column:
        m = picked["level"]
        return F.when(F.size(kept) > 0, F.struct(
            m.alias("level"), F.concat(hashes(kept, m, s), hashes(kept, m * 2, s)).alias("cells"))).otherwise(
            F.struct(F.lit(0).cast("bigint").alias("level"), F.array(whole).alias("cells")))

    return bound(F.array_sort(F.array_intersect(picked["terms"], band)), build)


def as_text(print_: Column) -> Column:
    """``level:`` and the hashes in hexadecimal, by comma; an empty subset has none."""
    return F.concat(print_["level"].cast("string"), F.lit(":"), F.array_join(
        F.transform(print_["cells"], lambda c: F.coalesce(F.lower(F.hex(c)), F.lit(""))), ","))


def likeness(a: Column, b: Column, s: Settings) -> Column:
    """Share of equal hashes (0 to 1) over the subsets of the shared sizes that either text has terms in."""
    def half(print_: Column, second: bool) -> Column:
        return F.slice(print_["cells"], s.subsets + 1 if second else 1, s.subsets)

    def share(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), None).otherwise(
            F.coalesce((p == q).cast("int"), F.lit(0))))
        count = F.aggregate(same, F.struct(F.lit(0).alias("same"), F.lit(0).alias("n")), lambda acc, v: F.struct(
            (acc["same"] + F.coalesce(v, F.lit(0))).alias("same"), (acc["n"] + v.isNotNull().cast("int")).alias("n")))
        return bound(count, lambda c: F.when(c["n"] > 0, c["same"] / c["n"]).otherwise(F.lit(0.0)))

    return (F.when(a["level"] == b["level"], share(a["cells"], b["cells"]))
            .when((a["level"] > 0) & (a["level"] * 2 == b["level"]), share(half(a, True), half(b, False)))
            .when((b["level"] > 0) & (b["level"] * 2 == a["level"]), share(half(a, False), half(b, True)))
            .otherwise(F.lit(0.0)))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, nameless, text): a document is known by id and a hash of its text."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
                       F.xxhash64(text, none).alias("th"), none.alias("nameless"), text.alias("text"))


def succession(rows: DataFrame) -> DataFrame:
    """(id, th, nameless, copies, n_chars, next_id, next_th) of each document, by descending id, in a ring.

    Ranges of ids are ordered in a task each; the first document of each range,
    one row for each of Spark's shuffle partitions, closes the gaps.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.groupBy("nameless", "id", "th", F.length("text").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("copies"))
    order = ("nameless", F.desc("id"), "th")
    ranged = written(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(*order)
    following = (ranged.repartition(parts, "part").withColumn("next", F.lead(F.struct("id", "th")).over(within))
                 .withColumn("first", F.row_number().over(within) == 1))
    heads = following.where("first").select("part", F.struct("id", "th").alias("head"))
    starts = [(r.part, r.head.id, r.head.th) for r in heads.orderBy("part").collect()]  # a row for each range
    if not starts:
        return following.select("id", "th", "nameless", "copies", "n_chars", F.lit(0).cast("bigint").alias("next_id"),
                                F.lit(0).cast("bigint").alias("next_th"))
    after = rows.sparkSession.createDataFrame(
        [(part, *starts[(i + 1) % len(starts)][1:]) for i, (part, _, _) in enumerate(starts)],
        "part int, over_id bigint, over_th bigint")
    return following.join(F.broadcast(after), "part").select(
        "id", "th", "nameless", "copies", "n_chars", F.coalesce("next.id", "over_id").alias("next_id"),
        F.coalesce("next.th", "over_th").alias("next_th"))


def edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(id, th, text, edited, next_id, next_th, nameless, copies) of each document.

    The last third of ``edited`` is replaced by the first as many code points
    of the next document. The texts are moved once, the beginnings once more.
    """
    again = Window.partitionBy("id", "th").orderBy("nameless")
    texts = (rows.select("id", "th", "text", "nameless").withColumn("copy", F.row_number().over(again)).where("copy = 1")
             .select("id", "th", "text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    asked = order.select(F.col("id").alias("for_id"), F.col("th").alias("for_th"), third.alias("third"), "nameless", "copies",
                         F.col("next_id").alias("id"), F.col("next_th").alias("th"))
    heads = texts.join(asked, ["id", "th"]).select(
        F.col("for_id").alias("id"), F.col("for_th").alias("th"), F.substring("text", F.lit(1), F.col("third")).alias("head"),
        "third", F.col("id").alias("next_id"), F.col("th").alias("next_th"), "nameless", "copies")
    start = F.substring("text", F.lit(1), F.length("text") - F.col("third"))
    return texts.join(heads, ["id", "th"]).select("id", "th", "text", F.concat(start, F.col("head")).alias("edited"),
                                                  "next_id", "next_th", "nameless", "copies")


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    rows = keyed(docs)
    known = written(lexicon(rows, s), "lexicon")
    most = max(s.min_df, int(s.max_share * docs.count()))
    above = [r.h for r in known.where(F.col("df") > most).select("h").collect()]  # bounded, see the module's docstring
    common = F.array(*(F.lit(h) for h in above)) if above else F.array().cast("array<bigint>")
    pairs = edited(rows, succession(rows))
    picked = written(pairs.select(
        "id", "th", "next_id", "next_th", "nameless", "copies", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_hash"),
        F.xxhash64("text").alias("text_hash"), chosen(F.col("text"), common, s).alias("own"),
        chosen(F.col("edited"), common, s).alias("other")), "picked")
    band = (picked.select("id", "th", F.explode(F.array_union("own.terms", "other.terms")).alias("h"))
            .join(known.where(F.col("df") <= most).select("h"), "h").groupBy("id", "th").agg(F.collect_list("h").alias("band")))
    held = F.coalesce("band", F.array().cast("array<bigint>"))
    prints = written(picked.join(band, ["id", "th"], "left").select(
        "id", "th", "next_id", "next_th", "nameless", "copies", "n_chars", "edited_sha256",
        fingerprint(F.col("own"), held, F.col("text_hash"), s).alias("print"),
        fingerprint(F.col("other"), held, F.col("edited_hash"), s).alias("edited_print")), "prints")
    following = prints.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("print").alias("next_print"))
    done = prints.join(following, ["next_id", "next_th"]).select(
        F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), s).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), s).alias("near_next"), "copies")
    # Repeated rows get their rows back, at most COPIES_AT_ONCE in one array.
    at_once = F.lit(COPIES_AT_ONCE).cast("bigint")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / at_once)))
    done = done.withColumn("block", blocks)
    left = F.least(F.col("copies") - F.col("block") * at_once, at_once)
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("copies", "block", "copy")
