"""Class weights and deterministic sampling.

Draws are by keyed hashes: exact in count, and the same in every run and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw_order(key: str, seed: int | Column) -> Column:
    """A pseudo-random order of keys that any SQL engine can repeat."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("/", seed.cast("string"), F.col(key).cast("string")).cast("binary"))


def class_weights(windows: DataFrame, keys: Sequence[str] = (), mode: str = "ratio", cap: float | None = None) -> DataFrame:
    """Class counts and the weight of the positive class: the ratio of the classes, its
    square root, or 1, up to ``cap``.  Null where a class is missing."""
    if mode not in ("ratio", "sqrt", "none"):
        raise ValueError(f"unknown mode {mode}")
    out = windows.where(F.col("binary_label").isNotNull()).groupBy(*keys).agg(F.count_if(F.col("binary_label") == 0).alias("n_negative"), F.count_if(F.col("binary_label") == 1).alias("n_positive"))
    ratio = F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("n_negative") / F.col("n_positive"))
    weight = {"ratio": ratio, "sqrt": F.sqrt(ratio), "none": F.when(ratio.isNotNull(), F.lit(1.0))}[mode]
    return out.withColumn("class_ratio", ratio).withColumn("positive_weight", weight if cap is None else F.when(weight.isNotNull(), F.least(weight, F.lit(cap))))


def sample_weights(windows: DataFrame) -> DataFrame:
    """Inverse class frequency as a ``weight`` column."""
    counts = windows.groupBy("binary_label").agg(F.count("*").alias("__n"))
    return windows.join(F.broadcast(counts), "binary_label").withColumn("weight", 1 / F.col("__n")).drop("__n")


#: The mean of one Poisson draw, and the most copies it can come to: beyond, the distribution
#: has less left than a draw's 52 bits can tell.
DRAW_MEAN, DRAW_MOST = 16, 80


def resampled(windows: DataFrame, weight: str, total: int, key: str, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement in proportion to ``weight``, about ``total`` in all: each
    row's number of draws, ``copies``, is a Poisson draw from a hash of its key, as no task
    could order one common sequence of draws.  A row with a large mean gets the sum of
    several draws of a part of it each, which has the same distribution."""
    sums = windows.agg(F.sum(weight).alias("__w"))
    mean = F.col(weight) * total / F.col("__w")
    parts = F.greatest(F.lit(1), F.ceil(mean / DRAW_MEAN)).cast("int")

    def uniform(own: Column) -> Column:
        return F.conv(F.substring(draw_order(key, own), 1, 13), 16, 10).cast("double") / float(1 << 52)

    def drawn(j: Column) -> Column:
        u = uniform(F.when(j == 1, F.lit(str(seed))).otherwise(F.concat_ws("/", F.lit(str(seed)), j.cast("string"))))
        m = F.col("__mean") / F.col("__parts")
        step = lambda acc, k: F.struct((acc["p"] * m / k).alias("p"), (acc["c"] + acc["p"] * m / k).alias("c"), F.when(u >= acc["c"], k).otherwise(acc["n"]).alias("n"))
        first = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(DRAW_MOST)), first, step)["n"]

    known = windows.crossJoin(F.broadcast(sums)).withColumns({"__mean": mean, "__parts": parts})
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__parts")), drawn), F.lit(0), lambda a, x: a + x)
    # Most rows of a small mean get none, as their one draw is below the first step: these go
    # before the steps are taken.
    some = known.where((F.col("__parts") > 1) | (uniform(F.lit(str(seed))) >= F.exp(-F.col("__mean"))))
    return some.withColumn("copies", copies).where("copies > 0").drop("__w", "__mean", "__parts")


def negative_sample(windows: DataFrame, subject: str, key: str, ratio: float, minimum: int, seed: int = 42) -> DataFrame:
    """All positives, and negatives to ``ratio`` a positive: the first ``minimum`` of each
    subject in its draw order, topped up by a common draw, trimmed likewise if that is too
    many.  ``strategy`` says why a row is in."""
    known = windows.where(F.col("binary_label").isNotNull())
    positives = known.where("binary_label = 1")
    target = positives.agg(F.ceil(F.count("*") * ratio).cast("bigint").alias("__target"))
    negatives = known.where("binary_label = 0").withColumn("__draw", draw_order(key, seed))
    # A filter on the rank keeps few rows of a subject before they are shuffled.
    rank = F.row_number().over(W.partitionBy(subject).orderBy("__draw", key))
    floor = negatives.withColumn("__r", rank).where(F.col("__r") <= minimum).drop("__r")
    first = floor.withColumn("__floor", F.lit(True)).unionByName(negatives.join(floor.select(key), key, "left_anti").withColumn("__floor", F.lit(False)))
    # The common draw goes by hash, with the per-subject floor ahead.  Only as many rows as
    # a bucket count says are ranked globally: every bucket before the last is taken whole.
    place = F.conv(F.substring("__draw", 1, 3), 16, 10).cast("int") + F.when(F.col("__floor"), 0).otherwise(4096)
    placed = first.withColumn("__bucket", place)
    run = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    upto = placed.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__upto", run)
    inside = placed.join(F.broadcast(upto), "__bucket").crossJoin(F.broadcast(target)).where(F.col("__upto") - F.col("__n") < F.col("__target"))
    within = F.row_number().over(W.partitionBy("__bucket").orderBy("__draw", key)) + F.col("__upto") - F.col("__n")
    chosen = inside.withColumn("__r", within).where(F.col("__r") <= F.col("__target"))
    chosen = chosen.withColumn("strategy", F.when(F.col("__floor"), "subject_minimum").otherwise("global_top_up")).select(*windows.columns, "strategy")
    return positives.withColumn("strategy", F.lit("positive")).select(*windows.columns, "strategy").unionByName(chosen)


def epoch_negatives(windows: DataFrame, recording: str, key: str, epoch: int, ratio: float, block: int = 256, seed: int = 42) -> DataFrame:
    """All positives, and a new draw of whole blocks of neighbouring negatives every epoch:
    a recording's windows are dealt to blocks by index, and blocks enter by a hash of their
    recording, number and epoch, until about ``ratio`` negatives a positive are in."""
    known = windows.where(F.col("binary_label").isNotNull())
    totals = known.agg(F.count_if(F.col("binary_label") == 1).alias("__p"), F.count_if(F.col("binary_label") == 0).alias("__q"))
    share = F.least(F.lit(1.0), F.col("__p") * ratio / F.greatest(F.col("__q"), F.lit(1)))
    name = F.concat_ws("/", F.lit(f"{seed}/{epoch}"), F.col(recording).cast("string"), F.floor(F.col(key) / block).cast("string"))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    joined = known.crossJoin(F.broadcast(totals))
    return joined.where((F.col("binary_label") == 1) | (draw < share)).select(*windows.columns)


def balanced_subset(windows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Half positives if there are so many, negatives for the rest."""
    half = size // 2
    order = draw_order(key, seed)
    few = windows.where("binary_label = 1").orderBy(order, key).limit(half)
    held = few.agg(F.count("*").alias("__n"))
    rest = windows.where("binary_label = 0").withColumn("__o", order).orderBy("__o", key).limit(size)
    rank = F.row_number().over(W.orderBy("__o", key))
    rest = rest.withColumn("__r", rank).crossJoin(F.broadcast(held)).where(F.col("__r") <= size - F.col("__n")).select(*windows.columns)
    return few.unionByName(rest)


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, the same ones in every run."""
    return df.orderBy(draw_order(key, seed), key).limit(size)
