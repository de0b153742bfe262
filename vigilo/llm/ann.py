"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors makes a neighbour graph, which is cut into
partitions of equal size: halved along principal directions, then improved by
moving vertices to where their neighbours are, within each partition's room.
A small network learns which partition a vector belongs to. Every vector is
indexed under its most probable partition; a query goes to its several most
probable ones, and what it meets there is ranked by exact cosine. How many
those are is measured: as many as queries kept aside from the sample need to
find ``Settings.recall`` of their true neighbours. Queries that meet fewer than
``k`` candidates there are held against all partitions, in the same blocks.

Partitions follow the number of rows (``Settings.rows_per_partition``) up to as
many as the sample can fill (256 by default; beyond, they grow), and a partition that holds more than a block of rows is dealt over as many tasks
as it has blocks, so neither a frequent vector nor a dense region lands in
one task. Query blocks bound the other side.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id or whose length is not the commonest one. A row is not its own neighbour; rows that
repeat another's id count as that row. Ties go to the smaller id. Fewer
candidates than asked for are all returned, and an empty table returns none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilo.llm.common import arrow_schema, map_columns, written


@dataclass(frozen=True)
class Settings:
    sample: int = 16_384             # vectors the partitions are learned from, at most
    trial_queries: int = 512         # of them, kept aside to choose the number of probes
    recall: float = 0.95             # least share of the trial queries' neighbours to find
    graph_neighbours: int = 10
    rows_per_partition: int = 1_500
    most_partitions: int = 1_024     # the network's outputs
    block_rows: int = 8_192          # rows of a partition that one task holds
    block_queries: int = 1_024
    hidden: int = 128
    epochs: int = 12
    seed: int = 11


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding as doubles, is_query) of the rows that take part."""
    v = F.col(vector_col)
    good = (F.col(id_col).isNotNull() & v.isNotNull()
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest others."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at:at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part (0 .. parts - 1, a power of two) of each vertex; sizes differ by a few percent."""
    part = np.zeros(len(x), dtype=np.int64)
    for _ in range(int(np.log2(parts))):
        halves = np.zeros_like(part)
        for p in range(int(part.max()) + 1):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            halves[own[np.argsort(centred @ direction, kind="stable")[len(own) // 2:]]] = 1
        part = part * 2 + halves
    room = int(np.ceil(1.05 * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(10):
        near = np.zeros((len(x), parts))
        np.add.at(near, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(near, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = near.max(axis=1) - near[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            to = int(near[v].argmax())
            if to != part[v] and size[to] < room:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Network from a unit vector to the log-probability of each partition."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        inputs = x.shape[1]
        self.scale = inputs ** 0.5
        self.p = [rng.normal(0, inputs ** -0.5, (inputs, settings.hidden)), np.zeros(settings.hidden),
                  rng.normal(0, settings.hidden ** -0.5, (settings.hidden, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        z = x * self.scale
        for _ in range(settings.epochs if parts > 1 else 0):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 128):
                rows = order[at:at + 128]
                w1, b1, w2, b2 = self.p
                pre = z[rows] @ w1 + b1
                h = np.maximum(pre, 0)
                d = softmax(h @ w2 + b2)
                d[np.arange(len(rows)), part[rows]] -= 1
                d /= len(rows)
                dh = (d @ w2.T) * (pre > 0)
                step += 1
                for i, g in enumerate((z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 2e-3 * (first[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def probable(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable partitions of each vector, best first."""
        w1, b1, w2, b2 = self.p
        # One row at a time, so that equal vectors get equal results wherever they stand.
        scores = np.einsum("nh,hp->np", np.maximum(np.einsum("nd,dh->nh", unit(x) * self.scale, w1) + b1, 0), w2) + b2
        return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(x: np.ndarray, rows: int, settings: Settings, k: int = 5) -> tuple[Router, int, int]:
    """The router, the number of partitions for a table of ``rows`` rows, and
    the number that a query goes to: as many as the trial queries need."""
    x = unit(x)
    trial = x[:min(settings.trial_queries, len(x) // 4)]
    x = x[len(trial):]
    parts = 1
    while (parts * settings.rows_per_partition < rows and 2 * parts <= settings.most_partitions
           and 2 * parts * 4 * settings.graph_neighbours <= len(x)):
        parts *= 2
    if parts == 1:
        return Router(x, np.zeros(len(x), dtype=np.int64), 1, settings), 1, 1
    part = balanced_parts(x, neighbour_graph(x, settings.graph_neighbours), parts)
    router = Router(x, part, parts, settings)
    own, routes = router.probable(x, 1)[:, 0], router.probable(trial, parts)
    near = np.argpartition(-(trial @ x.T), k, axis=1)[:, :k]
    # Place of each true neighbour's partition in its query's list.
    place = np.argsort(routes, axis=1)[np.arange(len(trial))[:, None], own[near]]
    needed = np.sort(place.ravel())[int(np.ceil(settings.recall * place.size)) - 1] + 1
    return router, parts, int(needed)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def nearest_in_block(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple:
    """(query place, row place, cosine) of each query's k nearest rows.

    A matrix product finds all that can be among them; their cosines are then
    taken pair by pair, so that equal vectors give equal scores.
    """
    qn, rn = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1))
    near = (q / qn[:, None]) @ (r / rn[:, None]).T
    near[qid[:, None] == rid[None, :]] = -np.inf
    ids, of = np.unique(rid, return_inverse=True)
    by_id = near
    if len(ids) < len(rid):  # rows that repeat an id count once, with their best
        order = np.argsort(of, kind="stable")
        by_id = np.maximum.reduceat(near[:, order], np.searchsorted(of[order], np.arange(len(ids))), axis=1)
    at_least = np.partition(by_id, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -2.0)
    i, j = np.nonzero(near >= np.maximum(at_least, -2.0)[:, None] - 1e-9)
    score = np.concatenate([(q[a] * r[b]).sum(axis=1) / (qn[a] * rn[b])
                            for a, b in ((i[c:c + 65_536], j[c:c + 65_536]) for c in range(0, len(i), 65_536))] or [np.zeros(0)])
    order = np.lexsort((-score, rid[j], i))
    i, j, score = i[order], j[order], score[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (rid[j[1:]] != rid[j[:-1]])]) if len(i) else np.zeros(0, dtype=bool)
    i, j, score = i[new], j[new], score[new]
    order = np.lexsort((rid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], score[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, settings: Settings = Settings(),
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors, is_query, id_col, vector_col)
    commonest = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    ddl = "query_id bigint, rank int, vec_id bigint, score double"
    if commonest is None:
        return spark.createDataFrame([], ddl)
    width, n_rows = commonest
    rows = rows.where(F.size("embedding") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toArrow()
    router, parts, probes = learn(matrix(sample.column("embedding")), n_rows, settings, k)
    held = spark.sparkContext.broadcast(router)  # a few hundred kB, from the settings

    def route(c):
        x = np.array(c["embedding"], dtype=np.float64).reshape(len(c["vec_id"]), width)
        return {**c, "parts": list(held.value.probable(x, probes).astype(np.int32))}

    indexed = written(map_columns(
        rows, route,
        "vec_id bigint, embedding array<double>, is_query boolean, parts array<int>"), "partitions")
    # At most most_partitions rows.
    sizes = {p: n for p, n in indexed.groupBy(F.col("parts")[0].alias("part")).count().collect()}
    blocks = F.array(*(F.lit(max(1, -(-sizes.get(p, 0) // settings.block_rows))) for p in range(parts)))
    schema = arrow_schema("query_id bigint, vec_id bigint, score double")

    def search(l: pa.Table, r: pa.Table) -> pa.Table:
        if not len(l) or not len(r):
            return schema.empty_table()
        qid, rid = l.column("vec_id").to_numpy(), r.column("vec_id").to_numpy()
        i, j, score = nearest_in_block(qid, matrix(l.column("embedding")), rid, matrix(r.column("embedding")), k)
        return pa.table({"query_id": qid[i], "vec_id": rid[j], "score": score}, schema=schema)

    def block(of: Column, part: Column, salt: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.element_at(of, part + 1)).cast("int")

    def every(of: Column, part: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), F.element_at(of, part + 1) - 1))

    def found(asked: DataFrame) -> DataFrame:
        """The k best rows that each query (vec_id, embedding, part) meets."""
        asked_sizes = {p: n for p, n in asked.groupBy("part").count().collect()}
        query_blocks = F.array(*(F.lit(max(1, -(-asked_sizes.get(p, 0) // settings.block_queries))) for p in range(parts)))
        own = F.col("parts")[0]
        right = (indexed.select("vec_id", "embedding", own.alias("part"), block(blocks, own, "row").alias("row_block"))
                 .select("*", every(query_blocks, F.col("part")).alias("query_block")))
        left = (asked.select("*", block(query_blocks, F.col("part"), "query").alias("query_block"))
                .select("*", every(blocks, F.col("part")).alias("row_block")))
        keys = ("part", "row_block", "query_block")
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
        best = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    queries = indexed.where("is_query")
    first = found(queries.select("vec_id", "embedding", F.explode("parts").alias("part")))
    if probes == parts:
        return first
    first = written(first, "found")
    full = first.where(F.col("rank") == k).select("query_id")
    short = written(queries.select("vec_id", "embedding").join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.isEmpty():
        return first
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    return first.join(full, "query_id", "left_semi").unionByName(found(short.select("vec_id", "embedding", everywhere)))
