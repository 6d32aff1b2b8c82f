"""Mergeable moments, fold scalers and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import z_score

MINIMUM_STD = 1e-6


def block_moments(blocks: DataFrame, keys: Sequence[str], samples: str = "samples", scale: float = 1.0) -> DataFrame:
    """Partial state of each block: count, mean and the sum of squared deviations.  Fails
    on a sample that isn't finite."""
    v = F.transform(samples, lambda x: x.cast("double") * scale)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = F.size(samples).cast("bigint")
    rows = blocks.where(F.assert_true(fine, F.lit("sample not finite")).isNull()).where(n > 0).select(*keys, n.alias("n"), v.alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = rows.withColumn("mean", mean)
    return rows.withColumn("m2", F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))).drop("v")


def row_moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The same state from one row a sample."""
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")).where("n > 0")


def combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial states: N, the weighted mean, and the sum of the parts' squared
    deviations and of their means'.  The means are shifted by one of them first, which
    keeps the second term stable in a single aggregation."""
    pivot = parts.groupBy(*keys).agg(F.min("mean").alias("__p"))
    shifted = parts.join(pivot, list(keys)).withColumn("__d", F.col("mean") - F.col("__p"))
    out = shifted.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("__p").alias("__p"), F.sum(F.col("n") * F.col("__d")).alias("__s"), F.sum(F.col("n") * F.col("__d") * F.col("__d")).alias("__q"), F.sum("m2").alias("__m2"))
    return out.select(*keys, "n", (F.col("__p") + F.col("__s") / F.col("n")).alias("mean"), (F.col("__m2") + F.greatest(F.lit(0.0), F.col("__q") - F.col("__s") * F.col("__s") / F.col("n"))).alias("m2"))


def with_deviation(moments: DataFrame) -> DataFrame:
    """Population variance and deviation."""
    return moments.withColumn("variance", F.col("m2") / F.col("n")).withColumn("std", F.sqrt("variance"))


def fold_scalers(stats: DataFrame, roles: DataFrame, fold_keys: Sequence[str], channel: str = "channel_name", subject: str = "subject_id", minimum_std: float = MINIMUM_STD) -> DataFrame:
    """All folds' scalers in one job: ``stats`` (subject, channel, n, mean, m2) of the
    training subjects of each fold (``roles``: fold keys, subject, role), merged.  The scale
    is 1 where the deviation is below ``minimum_std``."""
    train = stats.join(roles.where("role = 'train'").drop("role"), subject)
    out = with_deviation(combine(train.select(*fold_keys, channel, "n", "mean", "m2"), [*fold_keys, channel]))
    return out.withColumn("scale", F.when((F.col("std") >= minimum_std) & ~F.isnan("std"), F.col("std")).otherwise(1.0))


def missing_statistics(stats: DataFrame, roles: DataFrame, channels: int, subject: str = "subject_id") -> DataFrame:
    """Training subjects without statistics of all channels."""
    have = stats.groupBy(subject).agg(F.count("*").alias("n"))
    asked = roles.where("role = 'train'").select(subject).distinct()
    return asked.join(have, subject, "left").where(F.coalesce("n", F.lit(0)) < channels)


def apply_scaler(blocks: DataFrame, scalers: DataFrame, on: Sequence[str], unit: float = 1e6, limit: float | None = None) -> DataFrame:
    """``scaled`` samples: (x * unit - mean) / scale by channel."""
    joined = blocks.join(scalers.select(*on, "mean", "scale"), list(on))
    return joined.withColumn("scaled", z_score(F.col("samples"), F.col("mean"), F.col("scale"), unit, limit)).drop("mean", "scale")


def check_scaled(blocks: DataFrame, channel: str = "channel_name") -> DataFrame:
    """Mean and variance of the scaled samples of each channel, from naive sums."""
    sums = blocks.select(channel, F.size("scaled").alias("n"), F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    out = sums.groupBy(channel).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return out.select(channel, "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("variance"))
