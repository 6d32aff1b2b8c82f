"""Relational shapes: reconciling joins, counts over fixed key tables, roll-ups, pivots,
signatures, and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import FEW, null_safe, quantiles
from .ranks import RANGE_ROWS, row_numbers


def outer_with_status(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``status``: matched, left_only or right_only."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), list(on), "outer")
    status = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left_only").otherwise("right_only")
    return joined.withColumn("status", status).drop("__l", "__r")


def self_pairs(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str]) -> DataFrame:
    """Pairs of rows of one (small) duplicate group, the lower index first."""
    left = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (index, *values)])
    right = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (index, *values)])
    return left.join(right, list(keys)).where(F.col(f"{index}_a") < F.col(f"{index}_b"))


def conditional_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Rows, and rows of each value, per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def counts_with_zeros(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Count of each label of a fixed table, 0 where it doesn't occur."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return labels.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def presence_matrix(df: DataFrame, key: str, name: str, names: Sequence[str]) -> DataFrame:
    """One row a key, one 0/1 column a name.  The names are given, so one pass is enough."""
    columns = [F.coalesce(F.max(F.when(F.col(name) == n, 1)), F.lit(0)).alias(n) for n in names]
    return df.groupBy(key).agg(*columns)


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, the smallest of equals, as one row."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("mode_value"))


def deviations_from_mode(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't the mode, with the mode."""
    return df.crossJoin(F.broadcast(mode_value(df, column))).where(F.col(column) != F.col("mode_value"))


def signatures(df: DataFrame, key: str, name: str, index: str) -> DataFrame:
    """Ordered and unordered signatures of each key's list of names."""
    pairs = F.array_sort(F.collect_list(F.struct(index, name)))
    return df.groupBy(key).agg(
        F.array_join(F.transform(pairs, lambda p: p[name]), "|").alias("ordered_signature"),
        F.array_join(F.array_sort(F.collect_set(name)), "|").alias("unordered_signature"),
        F.count("*").alias("n_names"),
    )


def rank_signatures(signed: DataFrame, key: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct unordered signatures by descending use, with ids SIG-001, ...  The ranking
    runs over distinct signatures, after the aggregation, in ranges of about ``rows``."""
    grouped = signed.groupBy("unordered_signature").agg(F.count("*").alias("n_files"), F.min(key).alias("example"), F.min("n_names").alias("min_names"), F.max("n_names").alias("max_names"))
    ranked = row_numbers(grouped, [F.desc("n_files"), F.col("unordered_signature")], "__rank", rows)
    return ranked.withColumn("signature_id", F.format_string("SIG-%03d", "__rank")).drop("__rank")


def describe_by(df: DataFrame, keys: Sequence[str], column: str, few: int = FEW) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum.  Quartiles of
    groups with more than ``few`` rows are found by narrowing."""
    x, quartiles = F.col(column), {"q25": 0.25, "median": 0.5, "q75": 0.75}
    moments = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    found = quantiles(df, keys, {n: (column, p) for n, p in quartiles.items()}, few).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    out = moments.join(found, null_safe(keys, [f"__k_{k}" for k in keys]))
    return out.select(*keys, "n", "mean", "std", "min", *quartiles, "max")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the column's range; the maximum is in the last bin."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
    bucket = F.when(F.col("__hi") > F.col("__lo"), at).otherwise(0).cast("bigint")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row of the highest sequence number of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(sequence)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of equal keys; the rest stays."""
    return existing.join(new, list(keys), "left_anti").unionByName(new)


def replace_partitions(existing: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """Rows of the partitions that ``new`` has are all replaced."""
    return existing.join(new.select(partition).distinct(), partition, "left_anti").unionByName(new)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has: (keys, side); empty if the sets are equal."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def longest_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Length of the longest run of rows with ``flag``, per key."""
    by = W.partitionBy(*keys)
    marked = df.select(*keys, *order, flag.alias("__f")).withColumn("__a", F.row_number().over(by.orderBy(*order)))
    marked = marked.withColumn("__b", F.row_number().over(W.partitionBy(*keys, "__f").orderBy(*order)))
    runs = marked.groupBy(*keys, "__f", (F.col("__a") - F.col("__b")).alias("__g")).agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__f"), F.col("n"))), F.lit(0)).alias("longest_run"))


def early_stopping(history: DataFrame, keys: Sequence[str], epoch: str, metric: str, patience: int, min_delta: float) -> DataFrame:
    """Replays early stopping on a metric to be maximised: best epoch and value, and the
    epoch it stops at.  One run's epochs are one small array."""
    rows = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(metric).cast("double").alias("v")))).alias("__h"))
    first = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("wait"), F.lit(0).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["stop"] > 0
        better = acc["best"].isNull() | (x["v"] > acc["best"] + min_delta)
        wait = F.when(better, 0).otherwise(acc["wait"] + 1)
        return F.struct(
            F.when(over | ~better, acc["best"]).otherwise(x["v"]).alias("best"),
            F.when(over | ~better, acc["best_epoch"]).otherwise(x["e"]).alias("best_epoch"),
            F.when(over, acc["wait"]).otherwise(wait).alias("wait"),
            F.when(over, acc["stop"]).when(wait >= patience, x["e"]).otherwise(0).alias("stop"),
        )

    return rows.withColumn("__r", F.aggregate("__h", first, step)).select(*keys, F.col("__r.best_epoch").alias("best_epoch"), F.col("__r.best").alias("best_value"), F.nullif(F.col("__r.stop"), F.lit(0)).alias("stopped_at"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where they are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def transposed(df: DataFrame, key: str, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row a column of ``columns``, one column a value of ``key``; for small results."""
    long = df.unpivot([key], list(columns), "measure", "value")
    return long.groupBy("measure").pivot(key, list(values)).agg(F.any_value("value"))


def metric_differences(df: DataFrame, keys: Sequence[str], name: str, metrics: Sequence[str], a: str, b: str) -> DataFrame:
    """Metrics of the models ``a`` and ``b`` side by side, and how much ``a`` is above ``b``."""
    of = {(m, x): F.max(F.when(F.col(name) == x, F.col(m))) for m in metrics for x in (a, b)}
    out = df.groupBy(*keys).agg(*[c.alias(f"{m}_{x}") for (m, x), c in of.items()])
    return out.withColumns({f"{m}_difference": F.col(f"{m}_{a}") - F.col(f"{m}_{b}") for m in metrics})


def contiguous(windows: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """All rows of a path in one partition, in order: each signal is then read once, onward."""
    return windows.repartition(path).sortWithinPartitions(path, *order)
