"""Reshape operators: unpivot, top-k terms, indicator pivot, first-row dedup."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import na_to_null, strip
from vigilo.functions.names import safe_name


def unpivot_terms(symptoms: DataFrame, key: str = C.KEY, slots=C.SYMPTOM_SLOTS,
                  term: str = "SYMPTOM") -> DataFrame:
    """A1 (+P5): five slots → (key, term); missing, then blank terms dropped."""
    long = symptoms.unpivot([key], list(slots), "slot", "_t")
    t = strip(na_to_null("_t"))
    return (long.where(na_to_null("_t").isNotNull())
                .select(key, t.alias(term))
                .where(F.col(term) != ""))


def topk_terms(long: DataFrame, k: int = C.TOP_TERMS, term: str = "SYMPTOM") -> DataFrame:
    """A2: the k most frequent terms by occurrences (ties: term ascending).

    Partial aggregation collapses a term's rows on the map side, however hot
    the term; the top-k step then sees one row per distinct term.
    """
    counts = long.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(term)).limit(k)


def distinct_terms(long: DataFrame, term: str = "SYMPTOM") -> DataFrame:
    """A2: number of distinct terms (one row)."""
    return long.agg(F.countDistinct(term).alias("n_unique_terms"))


def top_values(df: DataFrame, col: str, k: int = C.TOP_VALUES) -> DataFrame:
    """The k most frequent values of a column (ties: value ascending)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k)


def topk_semi_filter(long: DataFrame, top: DataFrame, term: str = "SYMPTOM") -> DataFrame:
    """Keep rows whose term is in the top list (≤ k rows, broadcast)."""
    return long.join(F.broadcast(top.select(term)), term, "left_semi")


def collect_top_terms(top: DataFrame, term: str = "SYMPTOM") -> list[str]:
    """The ≤ k top terms as a driver list (bounded by the limit)."""
    return [r[0] for r in top.select(term).collect()]


def flag_columns(terms: list[str]) -> "OrderedDict[str, list[str]]":
    """Safe column name → the terms it covers, in term (alphabetical) order.

    Two terms that sanitise to one name share a column (their flags are
    merged with max, i.e. ``greatest``).
    """
    out: "OrderedDict[str, list[str]]" = OrderedDict()
    for t in sorted(terms):
        out.setdefault(safe_name(t), []).append(t)
    return out


def indicator_pivot(long: DataFrame, terms: list[str], key: str = C.KEY,
                    term: str = "SYMPTOM") -> DataFrame:
    """A3: key × term indicator table with one tinyint column per top term.

    Written as one conditional aggregation (a pivot with a fixed value list):
    the long rows are first cut to the top terms, then one hash aggregate per
    key with map-side combine — a single shuffle. Keys without any top term
    are absent; the left join downstream brings them back as zeros.
    """
    cols = flag_columns(terms)
    kept = long.where(F.col(term).isin(list(terms)))
    aggs = [F.coalesce(F.max(F.when(F.col(term).isin(ts), F.lit(1))), F.lit(0))
             .cast("tinyint").alias(name) for name, ts in cols.items()]
    return kept.groupBy(key).agg(*aggs)


def dedup_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key — the first by ``order_col`` (file position).

    ``min_by`` over a struct is a partial aggregate, so a key holding a large
    share of the rows is reduced on the map side before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    return (df.groupBy(key)
              .agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
              .select(key, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def with_file_order(df: DataFrame, out: str = "_file_pos") -> DataFrame:
    """Capture file order right at a file scan: (path, split start, row id)."""
    return df.withColumn(out, F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r")))


def outcome_unpivot(df: DataFrame, value_col: str, outcomes=C.OUTCOME_LABELS) -> DataFrame:
    """One pass producing (Outcome 'Label=v', value) for every outcome flag."""
    present = [(c, lab) for c, lab in outcomes if c in df.columns]
    labelled = df.where(F.col(value_col).isNotNull()).select(
        F.col(value_col),
        *[F.concat(F.lit(f"{lab}="), F.col(c).cast("string")).alias(c) for c, lab in present])
    return (labelled.unpivot([value_col], [c for c, _ in present], "_flag", "Outcome")
                    .where(F.col("Outcome").isNotNull())
                    .select("Outcome", value_col))
