"""Training by epochs: minibatch gradients from tasks, validation after each epoch, patience,
and the best state in the end.

The model is logistic regression on an array of features, and its state a few vectors as
long as that array; only these are on the driver.  Training rows are dealt to minibatches by
a hash of their keys once, and written so that each step reads its own files alone; each
epoch takes the minibatches in another order.  A step sums the gradient in its tasks, over
Arrow batches.  The state after each epoch is stored, and a stopped training goes on from it.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir
from .evaluation import ranking_metrics
from .imbalance import draw_order


@dataclass
class Settings:
    """``steps`` minibatches an epoch; Adam with decoupled weight decay."""

    epochs: int = 20
    steps: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    patience: int = 3
    min_delta: float = 1e-4
    positive_weight: float = 1.0
    seed: int = 42


@dataclass
class State:
    """Weights (the last is the intercept) and moments after ``epoch`` epochs, the best epoch's
    weights, and the history: (epoch, training loss, validation average precision)."""

    weights: list[float]
    first: list[float]
    second: list[float]
    step: int = 0
    epoch: int = 0
    best: list[float] = field(default_factory=list)
    best_epoch: int = 0
    best_value: float | None = None
    wait: int = 0
    stopped: bool = False
    history: list[list] = field(default_factory=list)


def minibatches(rows: DataFrame, key: str, features: str, steps: int, seed: int) -> DataFrame:
    """Known rows as (x, y, batch), stored by batch."""
    batch = F.conv(F.substring(draw_order(key, seed), 1, 8), 16, 10).cast("long") % steps
    path = f"{scratch_dir(rows.sparkSession)}/{uuid.uuid4().hex}"
    known = rows.where(F.col("binary_label").isNotNull() & F.col(features).isNotNull())
    held = known.select(F.col(features).cast("array<double>").alias("x"), F.col("binary_label").cast("double").alias("y"), batch.alias("batch"))
    held.write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(held.schema).parquet(path)


def gradient(rows: DataFrame, weights: list[float], positive_weight: float) -> tuple[np.ndarray, float, float]:
    """Summed gradient and loss of the weighted cross-entropy, and the sum of the weights."""
    w = np.array(weights)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 2)
        for b in batches:
            if b.num_rows:
                y = b.column("y").to_numpy(zero_copy_only=False)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                z = x @ w[:-1] + w[-1]
                weight = np.where(y > 0, positive_weight, 1.0)
                off = weight * (1 / (1 + np.exp(-z)) - y)
                loss = weight * (np.logaddexp(0, z) - y * z)
                total += np.concatenate((off @ x, [off.sum(), loss.sum(), weight.sum()]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    sums = {r["i"]: r["v"] for r in rows.select("x", "y").mapInArrow(tasks, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    out = np.array([sums.get(i, 0.0) for i in range(len(w) + 2)])
    return out[:-2], float(out[-2]), float(out[-1])


def adam(state: State, grad: np.ndarray, settings: Settings) -> None:
    """One step; the intercept does not decay."""
    w, m, v = (np.array(x) for x in (state.weights, state.first, state.second))
    state.step += 1
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
    keep = np.append(np.full(len(w) - 1, 1 - settings.rate * settings.decay), 1.0)
    w = w * keep - settings.rate * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.999**state.step)) + 1e-8)
    state.weights, state.first, state.second = w.tolist(), m.tolist(), v.tolist()


def score(weights: list[float], features: str) -> Column:
    """The probability of the positive class, as built-in functions."""
    of = F.lit([float(w) for w in weights[:-1]])
    z = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), of, lambda x, w: x * w), F.lit(float(weights[-1])), lambda a, p: a + p)
    return 1 / (1 + F.exp(-z))


def after_epoch(state: State, loss: float, value: float | None, settings: Settings) -> None:
    """Counts the epoch, and stops once ``patience`` epochs in a row have brought no more than
    ``min_delta``.  A value that is unknown is no better than any."""
    state.epoch += 1
    state.history.append([state.epoch, loss, value])
    better = value is not None and (state.best_value is None or value > state.best_value + settings.min_delta)
    if better or not state.best:
        state.best, state.best_epoch, state.best_value, state.wait = list(state.weights), state.epoch, value, 0
    else:
        state.wait += 1
    state.stopped = state.wait >= settings.patience


def store(spark: SparkSession, state: State, path: str) -> None:
    """The state as JSON in a folder of its epoch, which is there in full or not at all."""
    spark.createDataFrame([(json.dumps(asdict(state)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/epoch={state.epoch}")


def stored_state(spark: SparkSession, path: str) -> State | None:
    """The state after the last epoch that was stored whole; None without one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    epochs = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if "=" in s.getPath().getName()]
    whole = [e for e in epochs if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}/_SUCCESS"))]
    return State(**json.loads(spark.read.text(f"{path}/epoch={max(whole)}").first()["value"])) if whole else None


def train(rows: DataFrame, validation: DataFrame, key: str, features: str, settings: Settings, path: str | None = None) -> State:
    """Trains on ``rows`` (key, features, binary_label) until the average precision on
    ``validation`` no longer grows, or for all epochs; ``best`` has the weights to use.  With
    a ``path``, states are stored there, and training goes on from what is."""
    spark = rows.sparkSession
    state = stored_state(spark, path) if path else None
    if state is None:
        n = (rows.select(F.max(F.size(features)).alias("n")).first()["n"] or 0) + 1
        state = State([0.0] * n, [0.0] * n, [0.0] * n)
    held = minibatches(rows, key, features, settings.steps, settings.seed)
    known = validation.where(F.col("binary_label").isNotNull())
    while state.epoch < settings.epochs and not state.stopped:
        order, losses, weights = list(range(settings.steps)), 0.0, 0.0
        random.Random(f"{settings.seed}/{state.epoch}").shuffle(order)
        for b in order:
            grad, loss, weight = gradient(held.where(F.col("batch") == b), state.weights, settings.positive_weight)
            if weight:
                adam(state, grad / weight, settings)
                losses, weights = losses + loss, weights + weight
        scored = known.select(F.col("binary_label").alias("label"), score(state.weights, features).alias("score"))
        after_epoch(state, losses / weights if weights else 0.0, ranking_metrics(scored).first()["average_precision"], settings)
        if path:
            store(spark, state, path)
    return state
