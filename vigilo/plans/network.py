"""Feed-forward network trained data-parallel on Spark.

Rows are dealt by a hash of their id into shards and, inside a shard, into
mini-batches in hash order; both are packed once into a table of matrices. A
step takes one mini-batch of every shard: a Spark job computes each batch's
gradient in its task, tasks add up their batches, and the driver adds up the
tasks' sums (a vector of the network's size each) and takes one Adam step on
the mean. So a step sees ``batch_rows`` × shards rows, and by the square-root
rule the learning rate grows with the root of the number of shards. Which
batches meet in a step is drawn anew for every epoch.

Hidden layers are ReLU with dropout, the output is a logistic unit under mean
cross-entropy. After each epoch one job scores training and validation rows
with the current weights. The learning rate is halved when the validation loss
has stood still (``plateau``), training ends when it has not improved for
``patience`` epochs, and the weights of the best epoch are kept.

Batches, their order and the dropout masks follow the ids and the seed, and sums
are taken in a fixed order; so the partitioning of the input does not change the
weights.

The epochs' scores are kept as counts by (epoch, set, score to six places),
packed to about a byte a row and written as a table; loss, accuracy and exact AUC
of every epoch come from it.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.session import scratch_path

SHARDS_OF_TASK = 4         # whose mini-batches one task of a step takes
MOST_TASKS = 32            # tasks of a step; each sends one gradient
SCORE_STEPS = 1_000_000    # scores are counted to six places
COUNT_PARTS = 64           # of a set's packed counts, added up by themselves first
SERIES = ["epoch", "train_loss", "val_loss", "train_acc", "val_acc", "train_auc", "val_auc"]
HISTORY = "epoch int, " + ", ".join(f"{c} double" for c in SERIES[1:])


# ---- the network itself, on one batch ----------------------------------------

def shapes(layers: list[int]) -> list[tuple[int, int]]:
    return list(zip(layers[:-1], layers[1:]))


def unpack(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of each layer, as views of the flat vector."""
    out, at = [], 0
    for n_in, n_out in shapes(layers):
        w = flat[at:at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        out.append((w, flat[at:at + n_out]))
        at += n_out
    return out


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    """Uniform within 1 / sqrt(inputs) of each layer, biases too."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, n_in * n_out + n_out) / math.sqrt(n_in) for n_in, n_out in shapes(layers)])


def logit(flat: np.ndarray, layers: list[int], x: np.ndarray) -> np.ndarray:
    parts = unpack(flat, layers)
    for w, b in parts[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    w, b = parts[-1]
    return (x @ w + b)[:, 0]


def row_losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross-entropy of each row from its logit."""
    return np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0, np.exp(-np.abs(z))) / (1.0 + np.exp(-np.abs(z)))


def loss_and_gradient(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, dropout: float = 0.0,
                      rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """Summed loss of a batch and its gradient; hidden units are dropped by ``rng``."""
    parts, inputs, masks = unpack(flat, layers), [x], []
    for w, b in parts[:-1]:
        a = inputs[-1] @ w + b
        mask = (a > 0).astype(np.float64)
        if dropout and rng is not None:
            mask *= (rng.random(a.shape) >= dropout) / (1.0 - dropout)
        masks.append(mask)
        inputs.append(a * mask)
    w, b = parts[-1]
    z = (inputs[-1] @ w + b)[:, 0]
    back = (sigmoid(z) - y)[:, None]
    grads = []
    for k in range(len(parts) - 1, -1, -1):
        grads.append(np.concatenate([(inputs[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = (back @ parts[k][0].T) * masks[k - 1]
    return float(row_losses(z, y).sum()), np.concatenate(grads[::-1])


class Adam:
    def __init__(self, size: int, rate: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        self.rate, self.beta1, self.beta2, self.eps = rate, beta1, beta2, eps
        self.mean, self.square, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = self.beta1 * self.mean + (1 - self.beta1) * gradient
        self.square = self.beta2 * self.square + (1 - self.beta2) * gradient * gradient
        mean = self.mean / (1 - self.beta1 ** self.steps)
        square = self.square / (1 - self.beta2 ** self.steps)
        return flat - self.rate * mean / (np.sqrt(square) + self.eps)


class Plateau:
    """Factor by which the rate falls after ``patience`` epochs without a loss
    lower than the best by a ten-thousandth."""

    def __init__(self, patience: int, factor: float, least: float = 1e-4):
        self.patience, self.factor, self.least, self.best, self.bad = patience, factor, least, math.inf, 0

    def after(self, loss: float) -> float:
        if loss < self.best * (1 - self.least):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            return self.factor
        return 1.0


# ---- packed batches and the jobs over them ------------------------------------

PACKED = "is_val boolean, shard int, batch int, x binary, y binary"


def matrix(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(batch.column("x")[k].as_buffer(), dtype=np.float32).reshape(-1, width).astype(np.float64)
    return x, np.frombuffer(batch.column("y")[k].as_buffer(), dtype=np.float32).astype(np.float64)


def packed(rows: DataFrame, id_col: str, shards: int, batch_rows: int, seed: int) -> DataFrame:
    """Rows (features, label, is_val) as matrices of at most ``batch_rows`` rows.

    A shard is of a bounded number of rows; repeated ids are told apart by their
    features, so no id fills one.
    """
    vector = vector_to_array("features", "float32")
    key = F.xxhash64(F.col(id_col), vector, "label", F.lit(seed))
    schema = pa.schema([("is_val", pa.bool_()), ("shard", pa.int32()), ("batch", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        y = table.column("label").to_numpy()[order].astype(np.float32)
        flat = table.column("vector").combine_chunks()
        x = flat.flatten().to_numpy().reshape(len(flat), -1)[order]
        spans = [slice(at, at + batch_rows) for at in range(0, len(y), batch_rows)]
        return pa.table({"is_val": [table.column("is_val")[0].as_py()] * len(spans), "shard": [table.column("shard")[0].as_py()] * len(spans),
                         "batch": list(range(len(spans))), "x": [x[s].tobytes() for s in spans], "y": [y[s].tobytes() for s in spans]}, schema=schema)

    keyed = rows.select(vector.alias("vector"), F.col("label").cast("double").alias("label"), "is_val", key.alias("key"))
    keyed = keyed.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    return keyed.groupBy("is_val", "shard").applyInArrow(pack, PACKED)


def step_gradient(batches: RDD, flat: np.ndarray, layers: list[int], drawn: dict[int, int], dropout: float,
                  seeds: tuple[int, ...]) -> tuple[float, int, np.ndarray]:
    """(loss, rows, gradient), summed over the drawn mini-batch of each shard, of rows (shard, batch, x, y)."""

    def run(parts):
        first, loss, n, total = None, 0.0, 0, np.zeros(len(flat))
        for shard, batch, *packed_rows in parts:
            if drawn.get(shard) != batch:
                continue
            x, y = (np.frombuffer(c, dtype=np.float32).astype(np.float64) for c in packed_rows)
            own, gradient = loss_and_gradient(flat, layers, x.reshape(len(y), -1), y, dropout, np.random.default_rng([*seeds, shard]))
            first, loss, n, total = shard if first is None else first, loss + own, n + len(y), total + gradient
        if n:
            yield first, loss, n, total

    sums = sorted(batches.mapPartitions(run).collect(), key=lambda r: r[0])
    return math.fsum(r[1] for r in sums), sum(r[2] for r in sums), reduce(np.add, [r[3] for r in sums])


SCORED = "epoch int, is_val boolean, loss double, correct bigint, n bigint, counts binary"


def score_sums(z: np.ndarray, y: np.ndarray) -> tuple[float, int, int]:
    """(summed loss, correct decisions, rows) of some logits."""
    return float(row_losses(z, y).sum()), int(((z >= 0) == (y == 1)).sum()), len(y)


def score_counts(z: np.ndarray, y: np.ndarray) -> bytes:
    """Packed counts by score, to six places, and label of some logits."""
    score, place = np.unique(np.rint(sigmoid(z) * SCORE_STEPS).astype(np.int64), return_inverse=True)
    positive = np.bincount(place, weights=y, minlength=len(score)).astype(np.int64)
    return squeezed(score, positive, np.bincount(place, minlength=len(score)) - positive)


def squeezed(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> bytes:
    """Counts by ascending score: the steps from score to score and both counts in the narrowest integers, compressed."""
    columns = [np.diff(score, prepend=0), positive, negative]
    kinds = [np.min_scalar_type(int(c.max(initial=0))) for c in columns]
    raw = b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds))
    return bytes(k.itemsize for k in kinds) + len(score).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(packed_counts: bytes) -> list[np.ndarray]:
    """(scores, positives, negatives) of :func:`squeezed`."""
    n, at, out = int.from_bytes(packed_counts[3:11], "little"), 0, []
    raw = pa.decompress(packed_counts[11:], n * sum(packed_counts[:3]), "zstd", asbytes=True)
    for size in packed_counts[:3]:
        out.append(np.frombuffer(raw, f"<u{size}", n, at).astype(np.int64))
        at += n * size
    return [np.cumsum(out[0]), *out[1:]]


def added(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, positives, negatives) of several packed counts together; at most SCORE_STEPS + 1 scores."""
    score, positive, negative = (np.concatenate(c) for c in zip(*map(unsqueezed, parts)))
    score, place = np.unique(score, return_inverse=True)
    return score, *(np.bincount(place, weights=c, minlength=len(score)).astype(np.int64) for c in (positive, negative))


def epoch_scores(batches: DataFrame, flat: np.ndarray, layers: list[int], epoch: int) -> DataFrame:
    """A row for each packed batch with its sums, and one for each set of a task's batches with its counts by score and label."""

    def run(parts):
        schema = pa.schema([("epoch", pa.int32()), ("is_val", pa.bool_()), ("loss", pa.float64()), ("correct", pa.int64()), ("n", pa.int64()),
                            ("counts", pa.binary())])
        for part in parts:
            out, held = [], {False: [], True: []}
            for k, is_val in enumerate(part.column("is_val").to_pylist()):
                x, y = matrix(part, k, layers[0])
                held[is_val].append((logit(flat, layers, x), y))
                out.append((epoch, is_val, *score_sums(*held[is_val][-1]), None))
            out += [(epoch, is_val, 0.0, 0, 0, score_counts(*map(np.concatenate, zip(*kept)))) for is_val, kept in held.items() if kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    return batches.mapInArrow(run, SCORED)


def history_of(scores: DataFrame) -> DataFrame:
    """C14: the six series from the sums and packed counts of all epochs.

    AUC counts, for each score, the negatives below it and half of those beside
    it. A set's counts are added up in parts, then the parts; they stay packed
    between tasks, and a group holds at most COUNT_PARTS × (SCORE_STEPS + 1) of them.
    """
    sums = scores.groupBy("epoch", "is_val").agg((F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("correct") / F.sum("n")).alias("acc"))

    def add(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).select(["epoch", "is_val"]).append_column(
            "counts", pa.array([squeezed(*added(table.column("counts").to_pylist()))], pa.binary()))

    def auc_of(table: pa.Table) -> pa.Table:
        _, p, q = added(table.column("counts").to_pylist())
        pairs, most = float((p * (np.cumsum(q) - q / 2)).sum()), float(p.sum()) * float(q.sum())
        return table.slice(0, 1).select(["epoch", "is_val"]).append_column("auc", pa.array([pairs / most if most else None], pa.float64()))

    parts = (scores.where(F.col("counts").isNotNull()).select("epoch", "is_val", "counts", F.pmod(F.xxhash64("counts"), F.lit(COUNT_PARTS)).alias("part"))
             .groupBy("epoch", "is_val", "part").applyInArrow(add, "epoch int, is_val boolean, counts binary"))
    auc = parts.groupBy("epoch", "is_val").applyInArrow(auc_of, "epoch int, is_val boolean, auc double")
    both = sums.join(auc, ["epoch", "is_val"])

    def of(name: str, is_val: bool):
        return F.max(F.when(F.col("is_val") == is_val, F.col(name))).alias(f"{'val' if is_val else 'train'}_{name}")

    return both.groupBy("epoch").agg(*[of(c, v) for c in ("loss", "acc", "auc") for v in (False, True)])


# ---- estimator and model ------------------------------------------------------

class _NetworkParams(Params):
    idCol = Param(Params._dummy(), "idCol", "row id that batches follow", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "hidden layer sizes", TypeConverters.toListInt)
    dropout = Param(Params._dummy(), "dropout", "share of hidden units dropped in training", TypeConverters.toFloat)
    stepSize = Param(Params._dummy(), "stepSize", "Adam learning rate for one shard", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "epochs, at most", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a better validation loss before the end", TypeConverters.toInt)
    plateau = Param(Params._dummy(), "plateau", "epochs of standstill before the rate is halved", TypeConverters.toInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a shard's mini-batch", TypeConverters.toInt)
    shardRows = Param(Params._dummy(), "shardRows", "rows of a shard, about", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="id", hidden=[128, 128], dropout=0.3, stepSize=1e-3, maxIter=50, patience=10, plateau=3,
                         batchRows=512, shardRows=8_192, seed=42)


class NetworkClassifier(Estimator, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits rows (features, label, is_val, id); rows with ``is_val`` only steer the
    rate and the end. Without any, all epochs run and the last weights stay."""

    @keyword_only
    def __init__(self, idCol="id", hidden=None, dropout=0.3, stepSize=1e-3, maxIter=50, patience=10, plateau=3, batchRows=512,
                 shardRows=8_192, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> "NetworkModel":
        get = self.getOrDefault
        spark, seed = rows.sparkSession, get("seed")
        size = rows.agg(F.count_if(~F.col("is_val")).alias("train"), F.count_if("is_val").alias("val"),
                        F.max(F.size(vector_to_array("features"))).alias("width")).first()
        if not size["train"]:
            raise ValueError("no training rows")
        layers = [size["width"], *get("hidden"), 1]
        shards = -(-size["train"] // get("shardRows"))
        tasks = min(-(-shards // SHARDS_OF_TASK), MOST_TASKS)
        path, scores = scratch_path(spark, "network-batches"), scratch_path(spark, "network-scores")
        packed(rows, get("idCol"), shards, get("batchRows"), seed).write.parquet(path)
        batches = (spark.read.schema(PACKED).parquet(path).repartition(tasks, "shard")
                   .sortWithinPartitions("shard", "is_val", "batch").persist())
        # Hundreds of short jobs: over an RDD there is nothing to plan anew at each step.
        steps = batches.where("NOT is_val").select("shard", "batch", "x", "y").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sizes = {r["shard"]: r["n"] for r in batches.where("NOT is_val").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
            flat = first_weights(layers, seed)
            adam = Adam(len(flat), get("stepSize") * math.sqrt(len(sizes)))
            slower, best, best_loss, waited = Plateau(get("plateau"), 0.5), flat, math.inf, 0
            for epoch in range(1, get("maxIter") + 1):
                order = {s: np.random.default_rng([seed, epoch, s]).permutation(n) for s, n in sorted(sizes.items())}
                for step in range(max(sizes.values())):
                    drawn = {s: int(o[step]) for s, o in order.items() if step < len(o)}
                    _, n, gradient = step_gradient(steps, flat, layers, drawn, get("dropout"), (seed, epoch, step))
                    flat = adam.step(flat, gradient / n)
                epoch_scores(batches, flat, layers, epoch).write.mode("append").parquet(scores)
                if not size["val"]:
                    best = flat
                    continue
                sums = spark.read.parquet(scores).where((F.col("epoch") == epoch) & F.col("is_val")).select("loss", "n").collect()
                loss = math.fsum(r["loss"] for r in sums) / sum(r["n"] for r in sums)
                adam.rate *= slower.after(loss)
                best, best_loss, waited = (flat, loss, 0) if loss < best_loss else (best, best_loss, waited + 1)
                if waited >= get("patience"):
                    break
        finally:
            steps.unpersist()
            batches.unpersist()
        history = [list(r) for r in history_of(spark.read.parquet(scores)).orderBy("epoch").select(*SERIES).collect()]
        return NetworkModel(layers=layers, weights=best.tolist(), history=json.dumps(history))


class NetworkModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    layers = Param(Params._dummy(), "layers", "layer sizes, input and output included", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weights and biases, layer by layer", TypeConverters.toListFloat)
    history = Param(Params._dummy(), "history", "JSON: the six series by epoch", TypeConverters.toString)

    @keyword_only
    def __init__(self, layers=None, weights=None, history=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        flat, layers = np.array(self.getOrDefault("weights")), self.getOrDefault("layers")

        @F.pandas_udf("double")
        def probability(x):
            import pandas as pd
            return pd.Series(sigmoid(logit(flat, layers, np.vstack(x.to_numpy())))) if len(x) else pd.Series([], dtype=float)

        p = probability(vector_to_array("features"))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def history_table(self, spark: SparkSession, name: str) -> DataFrame:
        """(model, epoch, loss, accuracy and AUC of training and validation rows)."""
        rows = [(name, *r) for r in json.loads(self.getOrDefault("history"))]
        return spark.createDataFrame(rows, f"model string, {HISTORY}")
