"""Distributed building blocks shared by several operators.

Four patterns recur in the reference's work and none may collapse into a
single task at scale:

* ``prefix_sums``        running totals over an ordered key (ROC/PR curves,
                         exact ranks of values, quantiles)
* ``exact_percentiles``  type-7 (linear) quantiles, exact, per group
* ``hash_rank``          exact 1..n rank of rows in a seeded hash order, per
                         stratum (splits with folds)
* ``hash_cuts``          where the first k rows of that order end, per stratum:
                         exact-size samples are then a plain filter

The first three follow one scheme: cut the ordered key into blocks whose totals
form a *small* table (blocks × groups rows), turn those totals into offsets
with a window over that small table, join the offsets back, and finish with a
window partitioned by (group, block), so no task ever holds more than one
block of one group. Prefix sums count their distinct keys first: blocks hold
about ``BLOCK_ROWS`` of them at every size, and the offsets are broadcast only
if the counted groups times blocks are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.session import scratch_path

# Broadcasting the offsets table is allowed only below this many rows.
MAX_BROADCAST_ROWS = 2_000_000
BLOCK_ROWS = 50_000              # distinct keys of a block of a prefix sum, about
HASH_BUCKETS = 1 << 16           # 16-bit prefix of the md5 hex string


def held(df: DataFrame, name: str = "steps") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once for
    the several small jobs and branches that follow."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join_small(big: DataFrame, small: DataFrame, on: list[str], rows_bound: int) -> DataFrame:
    """Join a table whose row count is bounded by ``rows_bound``.

    Keys match null-safely (a NULL stratum is a stratum, never a lost row);
    as a side effect Catalyst infers no IsNotNull filters that would make the
    two branches over one shared exchange differ.
    """
    renamed = small.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in small.columns])
    if rows_bound <= MAX_BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    cond = [big[c].eqNullSafe(renamed[f"_k_{c}"]) for c in on]
    return big.join(renamed, cond, "inner").drop(*[f"_k_{c}" for c in on])


def block_index(df: DataFrame, order_col: str, n_blocks: int, out: str = "_blk") -> DataFrame:
    """Add a block id that cuts ``order_col`` into ~equal-count ranges.

    Boundaries come from one ``percentile_approx`` (< n_blocks numbers reach
    the driver); the id itself is a JVM-side binary search (Bucketizer).
    Block ids increase with ``order_col``.
    """
    probs = [i / n_blocks for i in range(1, n_blocks)]
    row = df.select(F.percentile_approx(F.col(order_col).cast("double"), probs, max(10_000, 10 * n_blocks))).first()
    bounds = sorted(set(float(b) for b in (row[0] or []) if b is not None)) or [0.0]
    splits = [float("-inf")] + bounds + [float("inf")]
    tmp = f"{out}_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    with_in = df.withColumn(tmp, F.col(order_col).cast("double"))
    return b.transform(with_in).withColumn(out, F.col(out).cast("int")).drop(tmp)


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str],
                partition_cols: list[str] | tuple = (), descending: bool = False,
                n_blocks: int | None = None, suffix: str = "_cum", next_cols: list[str] | tuple = ()) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` per partition.

    ``df`` must hold one row per (partition_cols, order_col) — callers
    aggregate first, which also makes duplicated keys (ties) one step.
    Output adds ``<c><suffix>`` and the partition's total ``<c>_total`` for
    each sum column, and for each of ``next_cols`` the value of the next row,
    ``<c>_next`` (NULL at the end). Totals, and the first values of the block
    that follows, ride on the offsets table, so no further join is needed.
    """
    part = list(partition_cols)
    df = held(df)
    size = df.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(F.struct(*part)) if part else F.lit(1)).alias("groups")).first()
    n_blocks = n_blocks or max(2, -(-size["n"] // BLOCK_ROWS))       # never a constant, which joins would fold
    blk = block_index(df, order_col, n_blocks)
    first_of = F.max_by if descending else F.min_by
    tot = blk.groupBy(*part, "_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols],
                                         *[first_of(c, order_col).alias(f"_f_{c}") for c in next_cols])
    blk_order = F.col("_blk").desc() if descending else F.col("_blk").asc()
    w_seq = Window.partitionBy(*part).orderBy(blk_order)
    w_off = w_seq.rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*part)                                  # over ≤ blocks rows each
    offsets = tot.select(*part, "_blk", *[
        F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in sum_cols], *[
        F.sum(f"_t_{c}").over(w_all).alias(f"{c}_total") for c in sum_cols], *[
        F.lead(f"_f_{c}").over(w_seq).alias(f"_e_{c}") for c in next_cols])
    joined = _join_small(blk, offsets, part + ["_blk"], size["groups"] * (n_blocks + 1))
    val_order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_val = Window.partitionBy(*part, "_blk").orderBy(val_order)
    w_loc = w_val.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({
        **{f"{c}{suffix}": F.col(f"_o_{c}") + F.sum(c).over(w_loc) for c in sum_cols},
        **{f"{c}_next": F.coalesce(F.lead(c).over(w_val), F.col(f"_e_{c}")) for c in next_cols}})
    return out.drop("_blk", *[f"_o_{c}" for c in sum_cols], *[f"_e_{c}" for c in next_cols])


def exact_percentiles(df: DataFrame, value_col: str, probs: list[float],
                      group_cols: list[str] | tuple = (), count_col: str | None = None) -> DataFrame:
    """Exact linear (type-7) percentiles of ``value_col`` per group.

    Returns one row per (group, p): columns ``group_cols``, ``p``, ``q``.
    NULL values are ignored. With ``count_col`` each row stands for so many. Work: one aggregate to distinct values, one
    distributed prefix sum, one small aggregate — no value list is ever
    gathered in one task.
    """
    g = list(group_cols)
    v = F.col(value_col)
    counts = (df.where(v.isNotNull())
                .groupBy(*g, v.cast("double").alias("_v"))
                .agg((F.sum(count_col) if count_col else F.count(F.lit(1))).alias("_c")))
    ps = prefix_sums(counts, "_v", ["_c"], g).withColumnRenamed("_c_total", "_n")
    parr = F.array(*[F.lit(float(p)) for p in probs])
    prev = F.col("_c_cum") - F.col("_c")
    cum = F.col("_c_cum")

    def pick(p: Column) -> Column:
        h = (F.col("_n") - 1) * p
        lo, hi = F.floor(h), F.ceil(h)
        return F.struct(p.alias("p"), (h - lo).alias("frac"),
                        ((prev <= lo) & (lo < cum)).alias("is_lo"),
                        ((prev <= hi) & (hi < cum)).alias("is_hi"))

    hits = ps.select(*g, "_v", F.explode(F.filter(F.transform(parr, pick),
                                                  lambda s: s["is_lo"] | s["is_hi"])).alias("s"))
    agg = hits.groupBy(*g, F.col("s.p").alias("p")).agg(
        F.max(F.when(F.col("s.is_lo"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("s.is_hi"), F.col("_v"))).alias("_hi"),
        F.max(F.col("s.frac")).alias("_f"))
    return agg.select(*g, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("q"))


def md5_hash(key: str | Column, seed: int, salt: str = "") -> Column:
    """Seeded, engine-independent hash: md5 of 'key:salt<seed>' as hex text."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{salt}{seed}")))


def hash_rank(df: DataFrame, hash_col: str, strata: list[str] | tuple = (),
              tiebreak: str | None = None, max_strata: int = 2) -> DataFrame:
    """Exact 1-based rank of each row in (hash, tiebreak) order per stratum.

    Adds ``_rank``, ``_n`` (stratum size) and ``_n_all`` (all rows). Equal to
    ``row_number() OVER (PARTITION BY strata ORDER BY hash, tiebreak)`` but
    computed per (stratum, 16-bit hash prefix) so every window task holds
    ~1/65536 of a stratum. The offsets table has ≤ 65,536 × max_strata rows.
    """
    s = list(strata)
    bucket = hash_bucket(hash_col)
    # The histogram branch needs only (stratum, hash): Catalyst prunes its
    # input to those columns and combines map-side, so it ships ≤ 65,536 rows
    # per stratum and task; the ranking window is the one full shuffle.
    with_b = df.withColumn("_hb", bucket)
    hist = with_b.groupBy(*s, "_hb").agg(F.count(F.lit(1)).alias("_hc"))
    w_off = Window.partitionBy(*s).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(
        *s, "_hb",
        F.coalesce(F.sum("_hc").over(w_off), F.lit(0)).alias("_hoff"),
        F.sum("_hc").over(Window.partitionBy(*s)).alias("_n"),
        F.sum("_hc").over(Window.partitionBy()).alias("_n_all"))
    joined = _join_small(with_b, offsets, s + ["_hb"], HASH_BUCKETS * max_strata)
    order = [F.col(hash_col)] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*s, "_hb").orderBy(*order)
    return joined.withColumn("_rank", F.col("_hoff") + F.row_number().over(w)).drop("_hb", "_hoff")


def hash_bucket(hash_col: str) -> Column:
    """16-bit prefix of a hexadecimal hash, as a number."""
    return F.coalesce(F.conv(F.substring(F.col(hash_col), 1, 4), 16, 10).cast("int"), F.lit(0))


def hash_cuts(df: DataFrame, hash_col: str, kept: Callable[[Column, Column], Column], key: str,
              strata: list[str] | tuple = ()) -> list[tuple]:
    """(stratum values, hash, key) of the last kept row of each stratum, in (hash, key) order.

    ``kept(n, n_all)`` says how many of a stratum's n rows (of n_all rows) are
    kept; strata that keep none are missing. Two narrow jobs: the histogram of
    the hash's 16-bit prefix tells in which bucket the cut lies, and only the
    rows of that bucket, about 1/65,536 of a stratum, are ranked. Strata are
    few (classes); their cuts, one row each, come to the driver. ``key`` is unique.
    """
    s = list(strata)
    rows = df.select(*s, hash_col, key, hash_bucket(hash_col).alias("_hb"))
    hist = rows.groupBy(*s, "_hb").agg(F.count(F.lit(1)).alias("_hc"))
    before = Window.partitionBy(*s).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    counted = hist.select(*s, "_hb", "_hc", F.coalesce(F.sum("_hc").over(before), F.lit(0)).alias("_hoff"),
                          kept(F.sum("_hc").over(Window.partitionBy(*s)), F.sum("_hc").over(Window.partitionBy())).alias("_keep"))
    edges = counted.where((F.col("_hoff") < F.col("_keep")) & (F.col("_keep") <= F.col("_hoff") + F.col("_hc"))).collect()
    if not edges:
        return []
    inside, place = F.lit(False), F.lit(None).cast("long")
    for e in edges:
        here = (F.col("_hb") == e["_hb"]) & _in_stratum(s, [e[c] for c in s])
        inside, place = inside | here, F.when(here, F.lit(e["_keep"] - e["_hoff"]).cast("long")).otherwise(place)
    last = (rows.where(inside).withColumn("_rank", F.row_number().over(Window.partitionBy(*s, "_hb").orderBy(hash_col, key)))
            .where(F.col("_rank") == place))
    return [(tuple(r[c] for c in s), r[hash_col], r[key]) for r in last.collect()]


def _in_stratum(strata: list[str], values: list) -> Column:
    out = F.lit(True)
    for c, v in zip(strata, values):
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out


def up_to_cut(cuts: list[tuple], hash_col: str, key: str, strata: list[str] | tuple = ()) -> Column:
    """Whether a row is among the kept ones of its stratum (see :func:`hash_cuts`)."""
    out = F.lit(False)
    for values, h, k in cuts:
        first = (F.col(hash_col) < h) | ((F.col(hash_col) == h) & (F.col(key) <= F.lit(k)))
        out = out | (_in_stratum(list(strata), list(values)) & first)
    return out


def exact_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value of each column, smallest value on ties, as text.

    One unpivot + one partially-aggregated count + one tiny arg-min: every
    column shares the same shuffle. Returns (feature, mode).
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct((-F.col("_c")).alias("nc"), F.col("value").alias("v"))).alias("mode"))
