"""Signals as a stream: sliding windows over event time, and running moments by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(stream: DataFrame, time: str, keys: Sequence[str], length: str, stride: str, late: str) -> DataFrame:
    """Counts and sums of ``value`` in sliding windows; rows later than ``late`` are dropped."""
    w = F.window(time, length, stride)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, m2) of all rows so far, after each micro-batch; update mode.  The
    state of a key is three numbers, merged with those of the batch."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            x = f[value].dropna()
            if len(x):
                c, m = len(x), float(x.mean())
                d, total = m - mean, n + c
                mean, m2, n = mean + d * c / total, m2 + float(((x - m) ** 2).sum()) + d * d * n * c / total, total
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    return stream.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, mean double, m2 double", "n bigint, mean double, m2 double", "update", "NoTimeout")
