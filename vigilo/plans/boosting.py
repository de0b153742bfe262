"""Leaf-wise gradient boosting on Spark.

Features become small bin numbers once (every distinct value, or quantiles of
a feature with many), and rows are packed into shards of bins, label, weight and
margin. A tree grows best-first: of all its leaves, the one whose split gains
most is split next, until it has ``leaves`` of them. The gain of a leaf comes
from its histogram, the sums of gradient, hessian and rows by (feature, bin),
which the tasks add up over their shards and the driver over the tasks. Where a
task holds a booster's rows, those of a node are dealt to its children once.

The queue is run ahead of the histograms: with the gains known so far it is
played to the end, and the histograms of all leaves that appear on the way are
asked for in one job; then it is played again. When nothing is missing, the
tree is the one that a split at a time would give. So a tree takes about as
many jobs as it is deep. Of two siblings the smaller is counted, the other is
the difference to their parent.

Several boosters (folds, points of a grid) are fitted in step by the same jobs.
A booster's first trees are the booster of fewer rounds, so grids over the
number of rounds need one fit.

The margins are carried from round to round in a cached RDD of packed shards (a
task's work is numpy over a few matrices, and a fit is thousands of short jobs).
Every ``CUT`` rounds they are built anew from the packed rows and all trees so far,
which keeps lineage short without writing a row. Where every group fits one shard
there is nothing to add up between tasks, and each booster is fitted by the same
loop in a task of its own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.session import scratch_path

MOST_BINS = 255
SHARD_ROWS = 1_048_576    # rows of a group that one task may hold: 87 MB of bins at 83 features
SPREAD_ROWS = 32_768      # rows of a shard, about, where a group has more than that, and of a step of a histogram
MOST_TASKS = 64           # tasks of a job; each sends its sums to the driver
CUT = 25
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Spec:
    """A booster to fit on the rows of one group."""
    group: int = 0
    rounds: int = 300
    leaves: int = 31
    depth: int = 0               # of a leaf, at most; 0: any
    rate: float = 0.1
    leaf_rows: int = 20
    leaf_hessian: float = 1e-3


# ---- bins ---------------------------------------------------------------------

def bin_edges(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Upper edges of each feature's bins but the last, by group.

    Up to MOST_BINS distinct values: the middles between them; more: quantiles.
    """
    long = rows.select("group", F.posexplode(vector_to_array("features")).alias("feature", "v"))
    values = long.groupBy("group", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = [k / MOST_BINS for k in range(1, MOST_BINS)]
    sizes = values.groupBy("group", "feature").agg(
        F.count(F.lit(1)).alias("distinct"), F.slice(F.array_sort(F.collect_set(F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))), 1, MOST_BINS).alias("values"))
    wide = sizes.where(F.col("distinct") > MOST_BINS).select("group", "feature")
    quantiles = long.join(F.broadcast(wide), ["group", "feature"]).groupBy("group", "feature").agg(
        F.percentile_approx("v", shares, 10_000).alias("q"))
    cuts = {(r["group"], r["feature"]): np.unique(r["q"]) for r in quantiles.collect()}
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in sizes.collect():                       # a row for each group and feature
        v = np.array(r["values"], dtype=np.float64)
        edges = cuts.get((r["group"], r["feature"]))
        out.setdefault(r["group"], {})[r["feature"]] = (v[:-1] + v[1:]) / 2 if edges is None else edges
    return {g: [features[k] for k in range(len(features))] for g, features in out.items()}


def packed(rows: DataFrame, edges: dict[int, list[np.ndarray]], shards: int, seed: int) -> DataFrame:
    """(group, shard, n, bins, y, w): the rows (group, features, label, weight) of each shard, in hash order.

    Features become bins where the rows are; a byte for each is shuffled, not a double.
    """
    vector = vector_to_array("features")
    ddl = "group int, shard int, n int, bins binary, y binary, w binary"
    schema = pa.schema([("group", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("w", pa.binary())])

    def bin_rows(batches):
        for batch in batches:
            groups = batch.column("group").to_numpy()
            for group in np.unique(groups).tolist():
                own = batch if (groups == group).all() else batch.take(pa.array(np.flatnonzero(groups == group)))
                x = own.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                bins = np.empty(x.shape, dtype=np.uint8)
                for k, e in enumerate(edges[group]):
                    bins[:, k] = np.searchsorted(e, x[:, k], side="left")
                kept = {c: own.column(c) for c in ("group", "label", "weight", "key")}
                yield pa.RecordBatch.from_pydict({**kept, "bins": pa.array([r.tobytes() for r in bins], pa.binary())})

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype=np.uint8).reshape(len(table), -1)[order]
        y, w = (table.column(c).to_numpy()[order].astype(np.float64) for c in ("label", "weight"))
        return pa.table({"group": [table.column("group")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "n": [len(y)],
                         "bins": [bins.tobytes()], "y": [y.tobytes()], "w": [w.tobytes()]}, schema=schema)

    keyed = rows.select(F.col("group").cast("int").alias("group"), vector.alias("vector"), F.col("label").cast("double").alias("label"),
                        F.col("weight").cast("double").alias("weight"), F.xxhash64(F.col("id"), vector, "label", F.lit(seed)).alias("key"))
    binned = keyed.mapInArrow(bin_rows, "group int, label double, weight double, key long, bins binary")
    binned = binned.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    return binned.groupBy("group", "shard").applyInArrow(pack, ddl)


# ---- work inside a task ---------------------------------------------------------

@dataclass
class Shard:
    """Rows of a shard; ``margin`` has a column for each booster of its group,
    ``columns`` are the bins laid out feature by feature."""
    group: int
    number: int
    bins: np.ndarray
    columns: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray

    @staticmethod
    def of(r) -> Shard:
        n = r["n"]
        bins = np.frombuffer(r["bins"], dtype=np.uint8).reshape(n, -1)
        return Shard(r["group"], r["shard"], bins, np.asfortranarray(bins), np.frombuffer(r["y"]), np.frombuffer(r["w"]),
                     np.frombuffer(r["margin"]).reshape(n, -1))


def part(bins: np.ndarray, tree: dict, rows: dict[int, np.ndarray]) -> None:
    """Deal the rows of split nodes to their children, where not done; a parent's number is the smaller."""
    for node in np.flatnonzero(tree["left"] >= 0).tolist():
        left = int(tree["left"][node])
        if left not in rows:
            own = rows[node]
            go = bins[:, tree["feature"][node]][own] <= tree["bin"][node]
            rows[left], rows[int(tree["right"][node])] = own[go], own[~go]


def descend(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf of each row."""
    rows = {0: np.arange(len(bins))}
    part(bins, tree, rows)
    leaf = np.zeros(len(bins), dtype=np.int64)
    for node in np.flatnonzero(tree["left"] < 0).tolist():
        if node in rows:
            leaf[rows[node]] = node
    return leaf


def gradients(shard: Shard, column: int) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-shard.margin[:, column]))
    return shard.w * (p - shard.y), shard.w * p * (1.0 - p)


def histograms(bins: np.ndarray, sizes: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of (g, h, rows) by slot and bin of every feature, features side by side.

    Taken ``SPREAD_ROWS`` at a time, so that memory does not grow with the rows.
    """
    take = np.flatnonzero(slot >= 0)
    out = block_histograms(bins, sizes, slot, slots, g, h, take[:SPREAD_ROWS])
    for at in range(SPREAD_ROWS, len(take), SPREAD_ROWS):
        out += block_histograms(bins, sizes, slot, slots, g, h, take[at:at + SPREAD_ROWS])
    return out


def block_histograms(bins: np.ndarray, sizes: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray,
                     take: np.ndarray) -> np.ndarray:
    """:func:`histograms` of the rows ``take``. Features of two bins, most of them, are one matrix product."""
    bins, slot = bins[take], slot[take]
    parts = np.stack([g[take], h[take], np.ones(len(take))], axis=1)
    spread = np.zeros((len(take), slots, 3))
    spread[np.arange(len(take)), slot] = parts
    total = spread.sum(axis=0)
    start = np.cumsum(sizes) - sizes
    out = np.zeros((slots, int(sizes.sum()), 3))
    two = np.flatnonzero(sizes <= 2)
    upper = (bins[:, two].astype(np.float64).T @ spread.reshape(len(take), slots * 3)).reshape(len(two), slots, 3).transpose(1, 0, 2)
    out[:, start[two]] = total[:, None] - upper
    out[:, start[two[sizes[two] == 2]] + 1] = upper[:, sizes[two] == 2]
    for k in np.flatnonzero(sizes > 2):
        place = slot * int(sizes[k]) + bins[:, k]
        for c in range(3):
            out[:, start[k]:start[k] + sizes[k], c] = np.bincount(
                place, weights=parts[:, c], minlength=slots * int(sizes[k])).reshape(slots, -1)
    return out


def of_nodes(shard: Shard, sizes: np.ndarray, rows: dict[int, np.ndarray], nodes: list[int], gradient: tuple) -> np.ndarray:
    """Histograms of some nodes, from the rows of each."""
    slots = np.full(len(shard.y), -1)
    for k, node in enumerate(nodes):
        slots[rows[node]] = k
    return histograms(shard.bins, sizes, slots, len(nodes), *gradient)


def counted(requests: dict, sizes: dict, columns: list) -> Callable:
    """Function of a task: histograms of the requested nodes of each booster, summed over its shards."""

    def run(shards):
        sums: dict[int, np.ndarray] = {}
        for shard in sorted(shards, key=lambda s: (s.group, s.number)):
            for b, (group, tree, nodes) in requests.items():
                if group != shard.group:
                    continue
                rows = {0: np.arange(len(shard.y))}
                part(shard.columns, tree, rows)
                own = of_nodes(shard, sizes[group], rows, nodes, gradients(shard, columns[b]))
                sums[b] = sums[b] + own if b in sums else own
        yield from sums.items()

    return run


def moved(rounds: list[dict], columns: list) -> Callable:
    """Function of a task: its shards with the finished trees of some rounds added to their margins."""

    def run(shards):
        for s in shards:
            margin = s.margin.copy()
            for finished in rounds:
                for b, (group, tree) in finished.items():
                    if group == s.group:
                        margin[:, columns[b]] += tree["value"][descend(s.columns, tree)]
            yield Shard(s.group, s.number, s.bins, s.columns, s.y, s.w, margin)

    return run


# ---- growing a tree on the driver -------------------------------------------------

@dataclass
class Growing:
    """A tree under growth: its nodes, and what is known of them."""
    spec: Spec
    sizes: np.ndarray                         # bins of each feature
    total: np.ndarray | None = None           # (g, h, rows) of the root
    split: dict = field(default_factory=dict)   # node -> (gain, feature, bin, left sums, right sums), or None
    hist: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)
    parent: dict = field(default_factory=dict)
    sums: dict = field(default_factory=dict)
    depth: dict = field(default_factory=lambda: {0: 0})

    def learn(self, node: int, hist: np.ndarray) -> None:
        """Take a node's histogram and find its best split (ties: first feature, then bin)."""
        if node == 0:
            self.sums[0] = hist[:self.sizes[0]].sum(axis=0)
        self.hist[node] = hist
        start = np.cumsum(self.sizes) - self.sizes
        run = np.cumsum(hist, axis=0)
        before = np.concatenate([np.zeros((1, 3)), run])[np.repeat(start, self.sizes)]
        left, total = run - before, self.sums[node]
        right = total - left
        s = self.spec
        ok = (np.minimum(left[:, 2], right[:, 2]) >= s.leaf_rows - 0.5) & (np.minimum(left[:, 1], right[:, 1]) >= s.leaf_hessian)
        ok[start + self.sizes - 1] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - total[0] ** 2 / total[1]
        gain = np.where(ok, gain, -np.inf)
        best = int(np.argmax(gain))
        self.split[node] = None
        if gain[best] > LEAST_GAIN:
            feature = int(np.searchsorted(start, best, side="right")) - 1
            self.split[node] = (float(gain[best]), feature, best - int(start[feature]), left[best], right[best])

    def open(self, node: int) -> bool:
        """Whether a node could be split at all."""
        s = self.spec
        return (not s.depth or self.depth[node] < s.depth) and self.sums[node][2] >= 2 * s.leaf_rows - 0.5

    def born(self, node: int) -> tuple[int, int]:
        """The children of a node, numbered when they first appear."""
        if node not in self.children:
            pair = len(self.depth), len(self.depth) + 1
            self.children[node] = pair
            for child, sums in zip(pair, self.split[node][3:]):
                self.parent[child], self.depth[child], self.sums[child] = node, self.depth[node] + 1, sums
        return self.children[node]

    def play(self) -> tuple[list[int], list[int]]:
        """(nodes split in order, nodes whose split must be known): the queue with what is known so far."""
        done: list[int] = []
        missing: list[int] = []
        queue = [(-self.split[0][0], 0)] if self.split.get(0) else []
        while queue and len(done) < self.spec.leaves - 1:
            _, node = heapq.heappop(queue)
            done.append(node)
            last = len(done) == self.spec.leaves - 1
            for child in self.born(node):
                if child in self.split:
                    if self.split[child]:
                        heapq.heappush(queue, (-self.split[child][0], child))
                elif self.open(child) and not last:
                    missing.append(child)
        return done, missing

    def wanted(self, missing: list[int]) -> list[int]:
        """Of the missing nodes and their siblings, those to count: the smaller of each two."""
        return sorted({min(self.children[self.parent[k]], key=lambda c: (self.sums[c][2], c)) for k in missing})

    def receive(self, nodes: list[int], hists: np.ndarray) -> None:
        for node, hist in zip(nodes, hists):
            pair = self.children[self.parent[node]]
            other = pair[0] + pair[1] - node
            whole = self.hist[self.parent[node]]
            for k, own in ((node, hist), (other, whole - hist)):
                if k not in self.split and self.open(k):
                    self.learn(k, own)

    def arrays(self, nodes: list[int] | None = None) -> dict:
        """The tree as arrays over node numbers; only ``nodes`` are split (None: all with children)."""
        inner = list(self.children) if nodes is None else nodes
        n = len(self.depth)
        tree = {"feature": np.zeros(n, dtype=np.int64), "bin": np.zeros(n, dtype=np.int64),
                "left": np.full(n, -1, dtype=np.int64), "right": np.full(n, -1, dtype=np.int64)}
        for node in inner:
            _, tree["feature"][node], tree["bin"][node], _, _ = self.split[node]
            tree["left"][node], tree["right"][node] = self.children[node]
        return tree

    def finished(self, done: list[int], edges: list[np.ndarray]) -> dict:
        """The grown tree, its nodes numbered anew: split, value, cover and gain of each."""
        order, k = [0], 0
        inner = set(done)
        while k < len(order):
            order += self.children[order[k]] if order[k] in inner else ()
            k += 1
        place = {node: k for k, node in enumerate(order)}
        n = len(order)
        tree = {**{c: np.full(n, -1, dtype=np.int64) for c in ("left", "right", "feature")}, "bin": np.zeros(n, dtype=np.int64),
                **{c: np.zeros(n) for c in ("thr", "value", "cover", "gain")}}
        for k, node in enumerate(order):
            g, h, rows = self.sums[node]
            tree["value"][k], tree["cover"][k] = (-g / h * self.spec.rate if h > 0 else 0.0), rows
            if node in inner:
                tree["gain"][k], f, b, _, _ = self.split[node]
                tree["feature"][k], tree["bin"][k], tree["thr"][k] = f, b, edges[f][b]
                tree["left"][k], tree["right"][k] = (place[c] for c in self.children[node])
        return tree


class Tasks:
    """Shards that are spread over the tasks of a cached RDD."""

    def __init__(self, packed_rows: DataFrame, start: dict, width: dict, tasks: int, shards: int):
        # By number: dealt by a hash, one task would hold several shards while others had none.
        place = {g: k * shards for k, g in enumerate(sorted(width))}
        number = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("group")] + F.col("shard")
        dealt = packed_rows.withColumn("number", (number % tasks).cast("int")).repartitionById(tasks, "number").rdd
        self.first: RDD = dealt.map(lambda r: begun(r, start, width))
        self.state: RDD = self.first.persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds: list[dict] = []
        self.old: list[RDD] = []

    def move(self, finished: dict, columns: list) -> None:
        """Add the finished trees to the margins, when the shards are read next."""
        self.rounds.append(finished)
        if len(self.rounds) % CUT:
            after = self.state.mapPartitions(moved([finished], columns))
        else:
            after = self.first.mapPartitions(moved(self.rounds, columns))
        self.old.append(self.state)
        self.state = after.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, requests: dict, sizes: dict, columns: list) -> dict[int, np.ndarray]:
        """The tasks' sums, added in the order of the tasks."""
        out: dict[int, np.ndarray] = {}
        for b, own in self.state.mapPartitions(counted(requests, sizes, columns)).collect():
            out[b] = out[b] + own if b in out else own
        while self.old:
            self.old.pop().unpersist()
        return out

    def close(self) -> None:
        self.state.unpersist()


class Held:
    """Shards that one task holds: a bounded number of rows.

    The gradients of a tree and the rows of its nodes are kept while it grows.
    """

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.known: dict[tuple[int, int], tuple] = {}

    def move(self, finished: dict, columns: list) -> None:
        self.shards = list(moved([finished], columns)(self.shards))

    def sums(self, requests: dict, sizes: dict, columns: list) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for place, shard in enumerate(self.shards):
            for b, (group, tree, nodes) in requests.items():
                if group != shard.group:
                    continue
                if nodes == [0]:                                  # a tree begins
                    self.known[place, b] = gradients(shard, columns[b]), {0: np.arange(len(shard.y))}
                gradient, rows = self.known[place, b]
                part(shard.columns, tree, rows)
                own = of_nodes(shard, sizes[group], rows, nodes, gradient)
                out[b] = out[b] + own if b in out else own
        return out


def begun(r, start: dict, width: dict) -> Shard:
    """A packed row with the first margins."""
    margin = np.full((r["n"], width[r["group"]]), start[r["group"]])
    return Shard.of({**(r if isinstance(r, dict) else r.asDict()), "margin": margin.tobytes()})


def boost(shards: Tasks | Held, specs: dict[int, Spec], columns: list, sizes: dict, edges: dict) -> dict[int, list[dict]]:
    """The trees of some boosters, grown in step."""
    trees: dict[int, list[dict]] = {b: [] for b in specs}
    root = {c: np.array([-1 if c in ("left", "right") else 0]) for c in ("left", "right", "feature", "bin")}
    finished: dict = {}
    for turn in range(max(s.rounds for s in specs.values())):
        if finished:
            shards.move(finished, columns)
        growing = {b: Growing(s, sizes[s.group]) for b, s in specs.items() if turn < s.rounds}
        for b, hist in shards.sums({b: (t.spec.group, root, [0]) for b, t in growing.items()}, sizes, columns).items():
            growing[b].learn(0, hist[0])
        finished = {}
        while growing:
            requests = {}
            for b, tree in list(growing.items()):
                done, missing = tree.play()
                if missing:
                    requests[b] = (tree.spec.group, tree.arrays(), tree.wanted(missing))
                    continue
                grown = tree.finished(done, edges[tree.spec.group])
                finished[b] = (tree.spec.group, {c: grown[c] for c in ("left", "right", "feature", "bin", "value")})
                trees[b].append({c: x.copy() for c, x in grown.items() if c != "bin"})
                del growing[b]
            if requests:
                for b, hists in shards.sums(requests, sizes, columns).items():
                    growing[b].receive(requests[b][2], hists)
    return trees


def fit_many(rows: DataFrame, specs: list[Spec], seed: int = 42, shard_rows: int = SHARD_ROWS) -> list[list[dict]]:
    """The trees of each spec, on the rows (group, id, features, label, weight) of its group.

    Groups of at most ``shard_rows`` rows are one shard: each booster then runs
    the same loop in a task of its own. Larger ones are spread over smaller shards.
    A booster's first tree carries the log-odds of the weighted labels.
    """
    spark = rows.sparkSession
    edges = bin_edges(rows)
    classes = {r["group"]: r for r in rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("p")).collect()}
    start = {g: float(np.log(r["p"] / (r["w"] - r["p"]))) for g, r in classes.items()}
    most = max(r["n"] for r in classes.values())
    shards = 1 if most <= shard_rows else -(-most // min(shard_rows, SPREAD_ROWS))
    sizes = {g: np.array([len(e) + 1 for e in features]) for g, features in edges.items()}
    path = scratch_path(spark, "boosting-bins")
    packed(rows, edges, shards, seed).write.parquet(path)
    bins = spark.read.parquet(path)
    if shards == 1:
        trees = apart(bins, specs, sizes, edges, start)
    else:
        columns, width = [], {g: 0 for g in classes}
        for s in specs:                                   # each booster's column among those of its group
            columns.append(width[s.group])
            width[s.group] += 1
        held = Tasks(bins, start, width, min(MOST_TASKS, shards * len(classes)), shards)
        try:
            trees = boost(held, dict(enumerate(specs)), columns, sizes, edges)
        finally:
            held.close()
    for b, s in enumerate(specs):
        trees[b][0]["value"] += start[s.group]
    return [trees[b] for b in range(len(specs))]


def apart(bins: DataFrame, specs: list[Spec], sizes: dict, edges: dict, start: dict) -> dict[int, list[dict]]:
    """Boosters of one-shard groups, each fitted in its own task."""
    table = bins.sparkSession.createDataFrame([(b, s.group) for b, s in enumerate(specs)], "booster int, group int")
    ddl = "booster int, nodes string"
    schema = pa.schema([("booster", pa.int32()), ("nodes", pa.string())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b, group = r["booster"], r["group"]
                grown = boost(Held([begun(r, start, {group: 1})]), {b: specs[b]}, {b: 0}, sizes, edges)[b]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([dumped(grown)])], schema=schema)

    return {r["booster"]: loaded(r["nodes"]) for r in one_each(bins, table, len(specs)).mapInArrow(run, ddl).collect()}


def one_each(bins: DataFrame, table: DataFrame, tasks: int) -> DataFrame:
    """Each booster beside its group's rows, in the partition of its number: dealt by
    a hash, one task would fit several boosters while others had none."""
    return bins.join(F.broadcast(table), "group").repartitionById(tasks, "booster")


TREE_FIELDS = ("left", "right", "feature", "thr", "value", "cover", "gain")


def dumped(trees: list[dict]) -> str:
    return json.dumps([[t[c].tolist() for c in TREE_FIELDS] for t in trees])


def loaded(text: str) -> list[dict]:
    whole = ("left", "right", "feature")
    return [{c: np.array(x, dtype=np.int64 if c in whole else np.float64) for c, x in zip(TREE_FIELDS, t)} for t in json.loads(text)]


# ---- estimator and model ------------------------------------------------------

class _BoosterParams(Params):
    idCol = Param(Params._dummy(), "idCol", "row id", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree, at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a leaf, at most; 0: any", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf, at least", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="id", maxIter=300, numLeaves=31, maxDepth=0, stepSize=0.1, minInstancesPerNode=20, seed=42)


class LeafwiseBooster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):

    @keyword_only
    def __init__(self, idCol="id", maxIter=300, numLeaves=31, maxDepth=0, stepSize=0.1, minInstancesPerNode=20, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def spec(self, group: int = 0) -> Spec:
        get = self.getOrDefault
        return Spec(group, get("maxIter"), get("numLeaves"), get("maxDepth"), get("stepSize"), get("minInstancesPerNode"))

    def _fit(self, rows: DataFrame) -> "LeafwiseModel":
        named = rows.select(F.lit(0).alias("group"), F.col(self.getOrDefault("idCol")).alias("id"), "features", "label", "weight")
        width = rows.select(F.size(vector_to_array("features"))).first()
        if width is None:
            raise ValueError("no training rows")
        return LeafwiseModel.of(fit_many(named, [self.spec()], self.getOrDefault("seed"))[0], width[0])


class LeafwiseModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    nodes = Param(Params._dummy(), "nodes", "JSON: the trees' nodes by field", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, nodes=None, width=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(trees: list[dict], width: int) -> "LeafwiseModel":
        return LeafwiseModel(nodes=dumped(trees), width=width)

    def trees(self) -> list[dict]:
        """Trees as arrays; leaf values are log-odds and include the learning rate."""
        return loaded(self.getOrDefault("nodes"))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gain of all splits."""
        gain = np.zeros(self.getOrDefault("width"))
        for t in self.trees():
            inner = t["left"] >= 0
            np.add.at(gain, t["feature"][inner], t["gain"][inner])
        return DenseVector(gain / gain.sum() if gain.sum() else gain)

    def _transform(self, df: DataFrame) -> DataFrame:
        from vigilo.operators.explain import leaf_values
        trees = self.trees()

        @F.pandas_udf("double")
        def probability(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.asfortranarray(np.vstack(x.to_numpy()))
            return pd.Series(1.0 / (1.0 + np.exp(-sum(leaf_values(rows, t) for t in trees))))

        p = probability(vector_to_array("features"))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")
