"""Signal quality: metrics of a chunk's samples, review flags, and roll-ups.

Amplitude metrics exist in two forms: over long rows of samples with built-in aggregates
(``amplitude_stats``), and over arrays inside the block table with one Arrow kernel
(``chunk_quality``), which adds the flatline and spectral metrics.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalars import array_diff
from .quantiles import FEW, quantiles

#: Thresholds of the provisional flags.
THRESHOLDS = {
    "nonfinite_fraction": 0.0,
    "flatline_fraction": 0.01,
    "zero_fraction": 0.01,
    "constant_std_uv": 0.01,
    "peak_to_peak_uv": 5000.0,
    "line_noise_ratio": 0.25,
    "high_frequency_ratio": 0.50,
    "bad_chunk_fraction": 0.10,
}
FLAGS = ("flag_nonfinite", "flag_flatline", "flag_zero_heavy", "flag_near_constant", "flag_extreme_amplitude", "flag_line_noise", "flag_high_frequency")


def amplitude_stats(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Moments, extremes, exact quantiles, and bias-corrected skewness and excess kurtosis."""
    v, n = F.col(x), F.count(x).cast("double")
    g1, g2 = F.skewness(v), F.kurtosis(v)
    skew = F.when((n > 2) & (F.var_pop(v) > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.var_pop(v) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    q = {f"q{p:02d}": F.percentile(v, p / 100) for p in (1, 5, 25, 75, 95, 99)}
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("variance"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("min"), F.max(v).alias("max"),
        skew.alias("skewness"), kurt.alias("kurtosis"), *[c.alias(k) for k, c in q.items()],
    )
    return out.withColumns({"peak_to_peak": F.col("max") - F.col("min"), "iqr": F.col("q75") - F.col("q25"), "robust_range": F.col("q99") - F.col("q01")})


def median_deviation(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The unscaled median absolute deviation."""
    mid = df.groupBy(*keys).agg(F.median(x).alias("__m"))
    return df.join(mid, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(x) - F.col("__m"))).alias("mad"))


def line_length(values: Column) -> Column:
    """Struct of the sum, mean and maximum of the absolute differences of an array."""
    steps = F.transform(array_diff(values), lambda d: F.abs(d))
    total = F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)
    return F.struct(total.alias("line_length"), F.when(F.size(steps) > 0, total / F.size(steps)).alias("mean_abs_difference"), F.array_max(steps).alias("max_abs_difference"))


def flat_runs(values: Column, tolerance: float, minimum: int) -> Column:
    """Struct (longest, total) of the samples in runs of differences within ``tolerance``;
    only runs of at least ``minimum`` samples count for the total."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest"), F.lit(0).alias("total"))

    def step(acc: Column, d: Column) -> Column:
        flat = F.abs(d) <= tolerance
        run = F.when(flat, acc["run"] + 1).otherwise(0)
        # A run of n differences is n + 1 samples: it enters the total when it gets long
        # enough, and grows it by one from then on.
        more = F.when(run + 1 == minimum, minimum).when(run + 1 > minimum, 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["longest"], F.when(run > 0, run + 1).otherwise(0)).alias("longest"), (acc["total"] + more).alias("total"))

    done = F.aggregate(array_diff(values), zero, step)
    return F.struct(done["longest"].alias("longest"), done["total"].alias("total"))


METRICS = "recording_id string, channel_index int, channel_name string, chunk_index bigint, " + ", ".join(f"{n} {t}" for n, t in kernels.METRIC_TYPES.items())


def chunk_quality(chunks: DataFrame, chunk_column: str = "chunk_index", scale: float = 1.0) -> DataFrame:
    """All metrics of every (recording, channel, chunk) row with an array ``samples`` and its
    ``sampling_rate_hz``.  Rows are independent: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [kernels.channel_metrics(s, r, scale) for s, r in zip(b["samples"], b["sampling_rate_hz"])]
            out = pd.DataFrame(rows, columns=list(kernels.METRIC_TYPES)).astype(object)
            out = out.where(out.notna(), None)
            out.insert(0, "chunk_index", b["chunk_index"].to_numpy())
            for i, c in enumerate(("recording_id", "channel_index", "channel_name")):
                out.insert(i, c, b[c].to_numpy())
            yield out

    source = chunks.select("recording_id", "channel_index", "channel_name", F.col(chunk_column).alias("chunk_index"), "sampling_rate_hz", "samples")
    return source.mapInPandas(run, METRICS)


def add_flags(df: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The seven provisional flags (null compares as false), their count, and needs_review."""
    t = {**THRESHOLDS, **(limits or {})}
    tests = {
        "flag_nonfinite": F.col("nonfinite_fraction") > t["nonfinite_fraction"],
        "flag_flatline": F.col("flatline_sample_fraction") >= t["flatline_fraction"],
        "flag_zero_heavy": F.col("zero_fraction") >= t["zero_fraction"],
        "flag_near_constant": F.col("std_uv") <= t["constant_std_uv"],
        "flag_extreme_amplitude": F.col("peak_to_peak_uv") >= t["peak_to_peak_uv"],
        "flag_line_noise": F.col("line_noise_ratio") >= t["line_noise_ratio"],
        "flag_high_frequency": F.col("high_frequency_ratio") >= t["high_frequency_ratio"],
    }
    flagged = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in tests.items()})
    count = sum((F.col(f).cast("int") for f in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))
    return flagged.withColumn("flag_count", count).withColumn("needs_review", F.col("flag_count") > 0)


def roll_up_channels(chunks: DataFrame, keys: Sequence[str] = ("case_id", "recording_id", "channel_name", "channel_index")) -> DataFrame:
    """Chunk rows to one row a channel."""
    labels = [F.count_if(F.col("annotation_label") == v).alias(f"{v}_chunk_count") for v in ("non_ictal", "ictal", "boundary")]
    pairs = [("median", "rms_uv"), ("max", "rms_uv"), ("median", "std_uv"), ("min", "std_uv"), ("median", "peak_to_peak_uv"), ("max", "peak_to_peak_uv"), ("median", "robust_range_uv"), ("max", "flatline_sample_fraction"), ("median", "flatline_sample_fraction"), ("max", "zero_fraction"), ("median", "line_noise_ratio"), ("max", "line_noise_ratio"), ("median", "high_frequency_ratio"), ("max", "high_frequency_ratio")]
    how = {"median": F.median, "max": F.max, "min": F.min}
    out = chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), *labels, *[how[h](c).alias(f"{h}_{c}") for h, c in pairs], F.count_if("needs_review").alias("review_chunk_count"), F.max("flag_count").alias("max_flag_count"))
    return out.withColumn("review_chunk_fraction", F.col("review_chunk_count") / F.col("chunk_count"))


def roll_up_recordings(channels: DataFrame, keys: Sequence[str] = ("case_id", "recording_id"), threshold: float = THRESHOLDS["bad_chunk_fraction"]) -> DataFrame:
    """Channel rows to one row a recording; a recording is reviewed if any channel is."""
    out = channels.withColumn("channel_needs_review", F.col("review_chunk_fraction") >= threshold).groupBy(*keys).agg(
        F.count("*").alias("channel_count"), F.count_if("channel_needs_review").alias("reviewed_channel_count"), F.median("median_rms_uv").alias("median_channel_rms_uv"), F.max("max_rms_uv").alias("max_channel_rms_uv"),
        F.max("max_flatline_sample_fraction").alias("max_flatline_fraction"), F.max("max_line_noise_ratio").alias("max_line_noise_ratio"), F.max("max_high_frequency_ratio").alias("max_high_frequency_ratio"),
    )
    return out.withColumn("reviewed_channel_fraction", F.col("reviewed_channel_count") / F.col("channel_count")).withColumn("recording_needs_review", F.col("reviewed_channel_count") > 0)


def medians_by_label(chunks: DataFrame, metrics: Sequence[str], few: int = FEW) -> DataFrame:
    """Medians of the metrics by annotation label: few labels over all chunks, so that a label
    with more than ``few`` of them is narrowed."""
    return quantiles(chunks, ["annotation_label"], {m: (m, 0.5) for m in metrics}, few)


def review_worklist(chunks: DataFrame) -> DataFrame:
    """Review counts by recording, channel and label, the busiest first."""
    return chunks.where("needs_review").groupBy("recording_id", "channel_name", "annotation_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recording_id", "channel_name")


def spectrum_db(blocks: DataFrame, seconds: float = 4.0, low: float = 0.1, high: float = 100.0) -> DataFrame:
    """The power density of every block in decibels, one row a frequency within [low, high];
    blocks shorter than a segment, or without power at a frequency, have no row there."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, n = np.asarray(r.samples, np.float64), round(seconds * r.sampling_rate_hz)
                if n < 2 or len(x) < n:
                    continue
                f, p = kernels.welch(x, r.sampling_rate_hz, n)
                inside = (f >= low) & (f <= high) & (p > 0)
                yield pd.DataFrame({"recording_id": r.recording_id, "channel_index": r.channel_index, "block_index": r.block_index, "frequency_hz": f[inside], "power_db": 10 * np.log10(p[inside])})

    columns = blocks.select("recording_id", "channel_index", "block_index", "sampling_rate_hz", "samples")
    return columns.mapInPandas(run, "recording_id string, channel_index int, block_index bigint, frequency_hz double, power_db double")


def spectrum_change(before: DataFrame, after: DataFrame, **how: float) -> DataFrame:
    """Mean power in decibels by recording, channel and frequency, before and after a step."""
    keys = ["recording_id", "channel_index", "frequency_hz"]
    a, b = (spectrum_db(x, **how).groupBy(*keys).agg(F.avg("power_db").alias(n)) for x, n in ((before, "before_db"), (after, "after_db")))
    return a.join(b, keys).withColumn("change_db", F.col("after_db") - F.col("before_db"))
