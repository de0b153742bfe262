"""Hard negatives by threshold joins over a pruned inverted index.

Vectors become whole numbers, floor(scale * x); a score is the inner product
with an anchor. An anchor's positives are its best other rows of the same
label; for each positive, the window of rows of other labels that score at
most as high and at least ``low`` hundredths of it is filled with its best.

Both are threshold joins of a block of anchors with a block of rows: find all
pairs whose score reaches each anchor's threshold. Dimensions are taken in the
order of their weight. A row's last dimensions are left out of the inverted
index where the norm of that suffix, times the largest such norm of an anchor,
stays below the least threshold; the lists of each dimension are then
beginnings of the rows sorted by indexed length. Partial scores are
accumulated dimension by dimension; a pair is dropped once its partial score
and the product of the remaining norms stay below the anchor's threshold, and
the pairs left are verified by their whole product. A threshold starts where a
sample of the block expects enough rows, and is lowered for the anchors whose
windows are not full, until they are or the window's own end is reached. So
the bounds only save work; the result is exact.

Rows are dealt over blocks by number, not by label, so a label of any share is
spread. A pair of blocks returns at most ``positives`` rows for each anchor, or
``negatives`` for each window.

Defined cases: rows with a null label or vector, or a null or non-finite
component, take no part. Shorter vectors count as filled up with zeros. Rows
without an id can be positives and negatives (last among ties), not anchors.
Rows that repeat an id are candidates of their own; as an anchor only the least
of them (label, then vector) counts, and no row with the anchor's id is among
its positives. A hundred times an inner product must fit 64 bits.
Anchors without another row of their label have no rows; nor has a positive with a negative score, whose window is empty. An
empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo.llm.common import arrow_schema, give_back, written

NO_ID = np.iinfo(np.int64).max
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80              # of a positive's score, in hundredths
    block_rows: int = 8_192    # rows of a task
    block_anchors: int = 512
    step: int = 8              # dimensions accumulated between two prunings
    few: float = 0.05          # share of pairs left below which they are verified one by one
    sample: int = 512          # rows of a block that the first threshold is estimated from


def usable(vectors: DataFrame, label: Column, id_col: str, vector_col: str, s: Settings) -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(label.isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * s.scale)).alias("vector"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros: doubles where they are exact."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def prepared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with heavy dimensions first, as doubles if all products are exact in them."""
    weight = (x.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    q, x = q[:, order], x[:, order]
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0))
    return (q.astype(np.float64), x.astype(np.float64)) if largest * max(1, x.shape[1]) < 2.0 ** 53 else (q, x)


def suffix_norms(x: np.ndarray, step: int) -> np.ndarray:
    """Norm of each row from every ``step``-th dimension on; the last column is 0."""
    width = x.shape[1]
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, width, step), axis=1) if width else np.zeros((len(x), 0))
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([rest, np.zeros((len(x), 1))], axis=1)) * (1 + SLACK)


class Index:
    """Rows of a block, ready for threshold joins with anchors."""

    def __init__(self, rows: np.ndarray, s: Settings):
        self.x, self.s = rows, s
        self.norms = suffix_norms(rows, s.step)

    def join(self, q: np.ndarray, q_norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least ``least[anchor]``."""
        s, chunks = self.s, self.norms.shape[1] - 1
        # Of each row, the first ``lead`` chunks are indexed: without the others it can still not reach any threshold.
        lead = np.minimum((self.norms * q_norms.max(axis=0, initial=0.0) >= least.min()).sum(axis=1), chunks)
        order = np.argsort(-lead, kind="stable")
        reachable = int((lead > 0).sum()) if least.min() > 0 else len(order)
        order = order[:reachable]
        lead = lead[order]
        partial = np.zeros((len(q), len(order)))
        alive = np.ones(partial.shape, dtype=bool)
        for p in range(chunks):
            listed = int((lead > p).sum())
            if not listed:
                break
            span = slice(p * s.step, (p + 1) * s.step)
            partial[:, :listed] += q[:, span] @ self.x[order[:listed], span].T
            seen = np.minimum(lead, p + 1)
            rest = q_norms[:, seen] * self.norms[order, seen]
            alive = partial + rest * (1 + SLACK) + SLACK * np.abs(partial) >= least[:, None]
            if alive.mean() <= s.few:
                break
        i, j = np.nonzero(alive)
        j = order[j]
        score = np.concatenate([(q[a] * self.x[b]).sum(axis=1) for a, b in (
            (i[c:c + 65_536], j[c:c + 65_536]) for c in range(0, len(i), 65_536))] or [np.zeros(0)]).astype(np.int64)
        keep = score >= least[i]
        return i[keep], j[keep], score[keep]

    def spread(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of each anchor's scores, from some rows; they only steer where thresholds start."""
        some = q.astype(np.float64) @ self.x[:self.s.sample].astype(np.float64).T
        return some.mean(axis=1), np.maximum(some.std(axis=1), 1.0)


def place_of(share: float) -> float:
    """How many deviations above the mean that share of rows begins."""
    return NormalDist().inv_cdf(1 - min(0.5, max(share, 1e-12)))


def nearest_of_label(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, s: Settings) -> tuple:
    """(anchor, row, score) of each anchor's best rows, all of one label; not rows with the anchor's own id."""
    q, x = prepared(q, x)
    index, q_norms, k = Index(x, s), suffix_norms(q, s.step), s.positives
    mean, gap = index.spread(q)
    least = mean + gap * place_of(3 * k / len(x))
    bottom = -q_norms[:, 0] * index.norms[:, 0].max() * (1 + SLACK) - 1
    open_, found = np.arange(len(q)), []
    while len(open_):
        least[open_] = np.maximum(least[open_], bottom[open_])
        i, j, score = index.join(q[open_], q_norms[open_], least[open_])
        other = ids[j] != q_ids[open_[i]]
        i, j, score = i[other], j[other], score[other]
        full = (np.bincount(i, minlength=len(open_)) >= k) | (least[open_] <= bottom[open_])
        keep = full[i]
        i, j, score = i[keep], j[keep], score[keep]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((open_[i[keep]], j[keep], score[keep]))
        open_ = open_[~full]
        least[open_] -= gap[open_]
        gap[open_] *= 2
    return tuple(np.concatenate(c) for c in zip(*found))


def fill_windows(q: np.ndarray, q_labels: np.ndarray, windows: list, x: np.ndarray, labels: np.ndarray, ids: np.ndarray,
                 s: Settings) -> tuple:
    """(anchor, window, row, score): each window's best rows of other labels.

    ``windows`` has the positives' scores of each anchor, by place."""
    q, x = prepared(q, x)
    index, q_norms, k = Index(x, s), suffix_norms(q, s.step), s.negatives
    _, gap = index.spread(q)
    gap /= 4
    # Scores below 0 have an empty window: low hundredths of them lie above them.
    ends = np.array([min((s.low * p / 100 for p in w if p >= 0), default=np.inf) for w in windows]) * (1 - SLACK)
    lowest = np.array([min((p for p in w if p >= 0), default=np.inf) for w in windows])
    least = np.maximum(ends, lowest - gap)
    open_, found = np.flatnonzero(ends < np.inf), []
    while len(open_):
        i, j, score = index.join(q[open_], q_norms[open_], least[open_])
        other = labels[j] != q_labels[open_[i]]
        i, j, score = i[other], j[other], score[other]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        edge = np.searchsorted(i, np.arange(len(open_) + 1))
        unfilled = []
        for place, anchor in enumerate(open_):
            own = score[edge[place]:edge[place + 1]]
            at = [(w, np.searchsorted(-own, -p, "left")) for w, p in enumerate(windows[anchor]) if p >= 0]
            took = [(w, a + np.flatnonzero(100 * own[a:a + k] >= s.low * windows[anchor][w])) for w, a in at]
            if least[anchor] > ends[anchor] and any(len(t) < k for _, t in took):
                unfilled.append(anchor)
                continue
            for w, t in took:
                rows = edge[place] + t
                found.append((np.full(len(t), anchor), np.full(len(t), w), j[rows], score[rows]))
        open_ = np.array(unfilled, dtype=np.int64)
        least[open_] = np.maximum(ends[open_], least[open_] - gap[open_])
        gap[open_] *= 2
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found))


POSITIVES = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor_id bigint, window int, negative_id bigint, negative_score bigint"


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids, the missing ones last."""
    return table.column("vec_id").combine_chunks().fill_null(NO_ID).to_numpy()


def named(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def find_positives(width: int, s: Settings):
    schema = arrow_schema(POSITIVES)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            q, x = matrix(anchors.column("vector"), width), matrix(rows.column("vector"), width)
            q_ids, ids = ids_of(anchors), ids_of(rows)
            q_labels, labels = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
            for label in np.intersect1d(q_labels, labels):
                a, b = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
                i, j, score = nearest_of_label(q[a], q_ids[a], x[b], ids[b], s)
                out.append(pa.table({"anchor_id": q_ids[a[i]], "positive_id": named(ids[b[j]]), "positive_score": score}, schema=schema))
            give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def find_negatives(width: int, s: Settings):
    schema = arrow_schema(NEGATIVES)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        q, x = matrix(anchors.column("vector"), width), matrix(rows.column("vector"), width)
        q_ids, ids = ids_of(anchors), ids_of(rows)
        i, w, j, score = fill_windows(q, anchors.column("label").to_numpy(), anchors.column("windows").to_pylist(),
                                      x, rows.column("label").to_numpy(), ids, s)
        give_back()
        return pa.table({"anchor_id": q_ids[i], "window": w.astype(np.int32), "negative_id": named(ids[j]),
                         "negative_score": score}, schema=schema)

    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, s: Settings = Settings(),
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every window's rows."""
    flagged = vectors.withColumn("_anchor", is_anchor).withColumn("_label", label)
    kept = usable(flagged, F.col("_label"), id_col, vector_col, s)
    anchors = usable(flagged.where(F.col("_anchor") & F.col(id_col).isNotNull()), F.col("_label"), id_col, vector_col, s)
    rows = written(kept, "rows")
    asked = written(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least"))
                    .select("vec_id", "least.label", "least.vector"), "anchors")
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    row_blocks = max(1, -(-n_rows // s.block_rows))
    anchor_blocks = max(1, -(-asked.count() // s.block_anchors))
    width = max(width or 0, 1)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Row numbers of a written table are the same however often it is read.
    dealt = rows.select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int").alias("row_block"),
                        every(anchor_blocks).alias("anchor_block"))
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(anchor_blocks)).cast("int")
    keys = ("anchor_block", "row_block")

    def against_all(questions: DataFrame, run, ddl: str) -> DataFrame:
        spread = questions.withColumn("anchor_block", own_block).withColumn("row_block", every(row_blocks))
        return spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, ddl)

    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    positives = written(against_all(asked, find_positives(width, s), POSITIVES)
                        .withColumn("window", F.row_number().over(by_score) - 1).where(F.col("window") < s.positives), "positives")
    windows = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
    asking = asked.join(windows.select(F.col("anchor_id").alias("vec_id"), F.col("w.positive_score").alias("windows")), "vec_id")
    found = against_all(asking, find_negatives(width, s), NEGATIVES)
    in_window = Window.partitionBy("anchor_id", "window").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= s.negatives)
    return ranked.join(positives, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
