"""Annotations and filtering of signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from . import resample as rs


def seizure_annotations(seizures: DataFrame) -> DataFrame:
    """(recording_id, onset, duration, description), failing on a negative onset or an end
    that isn't beyond it."""
    fine = (F.col("onset_seconds") >= 0) & (F.col("offset_seconds") > F.col("onset_seconds"))
    checked = seizures.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("invalid seizure")).isNull())
    return checked.select("recording_id", F.col("onset_seconds").alias("onset"), (F.col("offset_seconds") - F.col("onset_seconds")).alias("duration"), F.lit("seizure").alias("description"))


def append_annotations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New annotations that aren't there yet, by onset and duration to six decimals and
    description; equal ones within ``new`` are all kept."""
    key = ["recording_id", F.round("onset", 6).alias("__o"), F.round("duration", 6).alias("__d"), "description"]
    have = existing.select(*key).distinct()
    keyed = new.withColumns({"__o": F.round("onset", 6), "__d": F.round("duration", 6)})
    return existing.unionByName(keyed.join(have, ["recording_id", "__o", "__d", "description"], "left_anti").drop("__o", "__d"))


def uncontained_annotations(annotations: DataFrame, recordings: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Annotations that reach beyond their recording."""
    joined = annotations.join(recordings.select("recording_id", "duration_seconds"), "recording_id")
    return joined.where((F.col("onset") < -tolerance) | (F.col("onset") + F.col("duration") > F.col("duration_seconds") + tolerance))


def preprocessed(blocks: DataFrame, low: float = 0.5, high: float = 45.0, notch_hz: float | None = None, reference: str | None = None, rate_change: tuple[int, int] | None = None) -> DataFrame:
    """The steps of preprocessing in their order: band-pass, and, where asked for, a notch, the
    ``average`` reference, and a change of the rate by (up, down)."""
    if reference not in (None, "average"):
        raise ValueError(f"unknown reference {reference}")
    out = band_pass(blocks, low, high)
    out = rs.notch(out, notch_hz) if notch_hz else out
    out = rs.average_reference(out) if reference else out
    return rs.resample(out, *rate_change) if rate_change else out


def band_pass(blocks: DataFrame, low: float = 0.5, high: float = 45.0) -> DataFrame:
    """Zero-phase band-pass of the block table, block by block: each block comes with as
    many samples of its neighbours as half the filter is long, so blocks need no other.

    Fails on a block shorter than half the filter that isn't the last one.
    """
    columns = blocks.columns
    order = W.partitionBy("recording_id", "channel_index").orderBy("block_index")
    # Of the neighbours, only what the filter reaches goes to Python.
    half = half_taps(F.col("sampling_rate_hz"), low, high)
    before, after = F.lag("samples").over(order), F.lead("samples").over(order)
    near = blocks.withColumns({"__before": before, "__after": after})
    long_enough = F.col("__after").isNull() | (F.size("samples") >= half)
    near = near.where(F.assert_true(long_enough, F.lit("block shorter than half the filter")).isNull())
    size = F.size("__before")
    near = near.withColumns({"__before": F.slice("__before", F.greatest(F.lit(1), size - half + 1), half), "__after": F.slice("__after", F.lit(1), half)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rate, x, left, right in zip(b["sampling_rate_hz"], b["samples"], b.pop("__before"), b.pop("__after")):
                left, right = (np.asarray(y, np.float64) if y is not None else np.zeros(0) for y in (left, right))
                full = kernels.fir_filter(np.concatenate((left, np.asarray(x, np.float64), right)), kernels.band_pass_taps(rate, low, high))
                out.append(full[len(left) : len(left) + len(x)].astype(np.float32))
            b["samples"] = out
            yield b[columns]

    return near.mapInPandas(run, blocks.schema)


def half_taps(rate: Column, low: float, high: float) -> Column:
    """Samples on either side that the band-pass of ``kernels.band_pass_taps`` reaches."""
    narrow = F.least(F.lit(min(max(0.25 * low, 2.0), low)), F.lit(max(0.25 * high, 2.0)), rate / 2 - high)
    return F.floor(F.ceil(F.lit(3.3) / narrow * rate) / 2).cast("int")


def preprocessing_rows(before: DataFrame, after: DataFrame, annotations_before: DataFrame, annotations_after: DataFrame, target_channels: int) -> DataFrame:
    """One row a recording: channels, rate, seconds and annotations before and after a step,
    and whether all samples of its output are finite.  A recording without output has nulls."""

    def measured(blocks: DataFrame, name: str) -> DataFrame:
        per = blocks.groupBy("recording_id", "channel_index").agg(F.max("sampling_rate_hz").alias("r"), F.sum(F.size("samples")).alias("n"))
        return per.groupBy("recording_id").agg(F.count("*").alias(f"{name}_channels"), F.max("r").alias(f"{name}_rate"), F.max(F.col("n") / F.col("r")).alias(f"{name}_seconds"))

    def annotated(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("recording_id").agg(F.count("*").alias(f"{name}_annotations"))

    whole = after.groupBy("recording_id").agg(F.bool_and(F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("finite"))
    out = measured(before, "before")
    for part in (measured(after, "after"), whole, annotated(annotations_before, "before"), annotated(annotations_after, "after")):
        out = out.join(part, "recording_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("before_annotations", "after_annotations")}
    return out.withColumns(counts).withColumn("target_channels", F.lit(target_channels))


def window_samples(windows: DataFrame, blocks: DataFrame, block_samples: int) -> DataFrame:
    """Windows with their samples by channel: an equi-join on (recording, block number), a
    window meeting the two or more blocks it touches, and a slice of what they hold."""
    touched = F.sequence(F.floor(F.col("start_sample") / block_samples), F.floor((F.col("stop_sample_exclusive") - 1) / block_samples))
    asked = windows.withColumn("block_index", F.explode(touched))
    held = blocks.select("recording_id", "channel_index", "channel_name", "block_index", F.col("start_sample").alias("__at"), "samples")
    joined = asked.join(held, ["recording_id", "block_index"])
    lists = joined.groupBy(*windows.columns, "channel_index", "channel_name").agg(F.array_sort(F.collect_list(F.struct("block_index", F.col("__at").alias("at"), "samples"))).alias("__b"))
    flat = F.flatten(F.transform("__b", lambda x: x["samples"]))
    cut = F.slice(flat, (F.col("start_sample") - F.col("__b")[0]["at"] + 1).cast("int"), (F.col("stop_sample_exclusive") - F.col("start_sample")).cast("int"))
    out = lists.withColumn("samples", cut).drop("__b")
    full = F.size("samples") == F.col("stop_sample_exclusive") - F.col("start_sample")
    return out.where(F.assert_true(full, F.lit("window beyond its recording")).isNull())
