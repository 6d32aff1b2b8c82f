"""Interval algebra, window generation and labelling.

Intervals are half-open.  Touching intervals merge, overlap by nothing and are at distance
0.  Every overlap or distance of a left join is guarded, because ``greatest`` and ``least``
skip nulls and would make an unmatched row overlap fully.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import kept
from . import sweep as sw

#: Intervals or windows of a recording that one row may hold or meet as pairs.
DENSE = 4_096


def validate_intervals(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``df``, failing on a negative start or an end that isn't beyond the start."""
    fine = (F.col(start) >= 0) & (F.col(end) > F.col(start))
    return df.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("invalid interval")).isNull())


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part; null if there is no second interval."""
    return F.when(s2.isNotNull(), F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)))


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The gap between two intervals, 0 if they overlap or touch; null without a second."""
    return F.when(s2.isNotNull(), F.greatest(F.lit(0), s2 - e1, s1 - e2))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or touching intervals within ``keys``."""
    order = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__opens", opens)
    island = marked.withColumn("__island", F.sum("__opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def fixed_windows(recordings: DataFrame, n: str, length: int, stride: int, drop_incomplete: bool = True) -> DataFrame:
    """One row a window: ``window_index``, ``window_start``, ``window_end``.  Starts are 0,
    stride, ...; an incomplete tail is dropped, or kept shorter."""
    if not 0 < stride <= length:
        raise ValueError("need 0 < stride <= length")
    last = F.col(n) - length if drop_incomplete else F.col(n) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    rows = recordings.select("*", F.posexplode(starts).alias("window_index", "window_start"))
    return rows.withColumn("window_end", F.least(F.col("window_start") + length, F.col(n)))


def tumbling_chunks(recordings: DataFrame, n: str, length: int, minimum: int) -> DataFrame:
    """Chunks side by side; the last is kept if it has at least ``minimum`` samples."""
    return fixed_windows(recordings, n, length, length, drop_incomplete=False).where(F.col("window_end") - F.col("window_start") >= minimum)


def statistics_blocks(recordings: DataFrame, n: str, length: int) -> DataFrame:
    """Blocks side by side, the tail included however short it is."""
    return tumbling_chunks(recordings, n, length, 1)


def interval_status(df: DataFrame, start: str, end: str, length: str, rate: Column) -> Column:
    """The first check that an interval fails, or ``valid``: its recording's metadata, its
    times, and its samples (from the floor of its start to the ceiling of its end)."""
    first, last, total = F.floor(F.col(start) * rate), F.ceil(F.col(end) * rate), F.floor(F.col(length) * rate)
    return (
        F.when(F.col(length).isNull() | rate.isNull(), "missing_metadata")
        .when(~F.coalesce((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.col(length)), F.lit(False)), "invalid_time")
        .when((first < 0) | (last > total) | (last <= first), "invalid_sample")
        .otherwise("valid")
    )


def many(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys that have more than ``most`` rows, stored; None if there are none."""
    found = kept(rows.where(sw.all_set(keys)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys))
    return None if found.isEmpty() else found


def in_two(few: Callable[..., DataFrame], lots: Callable[..., DataFrame], asked: DataFrame, other: DataFrame, keys: Sequence[str], dense: int) -> DataFrame:
    """``few(asked, other)`` for keys with at most ``dense`` rows of ``other``, ``lots`` for the
    rest: the same results, by arrays of a bounded length or by a sweep.  With ``dense`` 0 all
    keys are swept, without being parted."""
    if dense <= 0:
        return lots(asked, other)
    busy = many(other, keys, dense)
    if busy is None:
        return few(asked, other)
    on = list(keys)
    return few(asked.join(busy, on, "left_anti"), other.join(busy, on, "left_anti")).unionByName(lots(asked.join(busy, on, "left_semi"), other.join(busy, on, "left_semi")))


def window_overlaps(windows: DataFrame, intervals: DataFrame, keys: Sequence[str], dense: int = DENSE) -> DataFrame:
    """Windows with ``overlap`` (over merged intervals), ``nearest`` (null without any) and
    ``n_intervals``, one row a window.

    Merged intervals of a recording are gathered to one array, so that the equi-join adds no
    rows and windows aren't shuffled again to be put back together; a recording with more
    than ``dense`` intervals is swept instead.
    """
    return in_two(lambda w, i: listed_overlaps(w, i, keys), lambda w, i: sw.swept_overlaps(w, i, keys), windows, intervals.where(F.col("end") > F.col("start")), keys, dense)


def listed_overlaps(windows: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    merged = merge_intervals(intervals, keys)
    lists = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__all"))
    s, e = F.col("window_start"), F.col("window_end")
    joined = windows.join(lists, list(keys), "left")
    total = F.aggregate("__all", F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(F.lit(0).cast("bigint"), F.least(e, x["end"]) - F.greatest(s, x["start"])))
    nearest = F.array_min(F.transform("__all", lambda x: F.greatest(F.lit(0).cast("bigint"), x["start"] - e, s - x["end"])))
    return joined.select(*windows.columns, F.coalesce(total, F.lit(0)).alias("overlap"), nearest.alias("nearest"), F.coalesce(F.size("__all"), F.lit(0)).alias("n_intervals"))


def label_windows(df: DataFrame, threshold: float, near: int, clean: int) -> DataFrame:
    """Label columns from ``overlap`` and ``nearest``.  Ictal windows are near, too;
    a non-ictal window is clean if no interval is within ``clean``."""
    part = F.col("overlap") / (F.col("window_end") - F.col("window_start"))
    name = F.when(F.col("overlap") <= 0, "non_ictal").when(part >= threshold, "ictal").otherwise("boundary")
    out = df.withColumn("overlap_fraction", part).withColumn("label_name", name)
    label = F.when(F.col("label_name") == "non_ictal", 0).when(F.col("label_name") == "boundary", 1).otherwise(2)
    binary = F.when(F.col("label_name") == "non_ictal", 0).when(F.col("label_name") == "ictal", 1)
    return out.withColumns({
        "label_id": label,
        "binary_label": binary,
        "near_interval": F.coalesce(F.col("nearest") <= near, F.lit(False)),
        "clean_non_ictal": (F.col("label_name") == "non_ictal") & (F.col("nearest").isNull() | (F.col("nearest") >= clean)),
    })


def chunk_annotation(chunks: DataFrame, intervals: DataFrame, keys: Sequence[str], threshold: float = 0.5, dense: int = DENSE) -> DataFrame:
    """``overlap_fraction`` (the most that any single, unmerged interval covers) and
    ``annotation_label`` of each chunk.  A recording with more than ``dense`` intervals is
    swept; its chunks must not overlap."""

    def listed(c: DataFrame, i: DataFrame) -> DataFrame:
        lists = i.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("__all"))
        s, e = F.col("window_start"), F.col("window_end")
        most = F.array_max(F.transform("__all", lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(e, x["end"]) - F.greatest(s, x["start"]))))
        return c.join(lists, list(keys), "left").withColumn("most", most).drop("__all")

    found = in_two(listed, lambda c, i: sw.swept_most(c, i, keys), chunks, intervals.where(F.col("end") > F.col("start")), keys, dense)
    out = found.withColumn("overlap_fraction", F.coalesce(F.col("most") / (F.col("window_end") - F.col("window_start")), F.lit(0.0))).drop("most")
    return out.withColumn("annotation_label", F.when(F.col("overlap_fraction") <= 0, "non_ictal").when(F.col("overlap_fraction") >= threshold, "ictal").otherwise("boundary"))


def interval_coverage(intervals: DataFrame, windows: DataFrame, keys: Sequence[str], interval_id: str, dense: int = DENSE) -> DataFrame:
    """For each interval: windows that overlap it, by label; intervals without a window stay.
    The recording is the equi-key of a theta-join; a recording with more than ``dense``
    windows is swept."""
    return in_two(lambda i, w: joined_coverage(i, w, keys, interval_id), lambda i, w: sw.swept_coverage(i, w, keys, interval_id), intervals, windows, keys, dense)


def joined_coverage(intervals: DataFrame, windows: DataFrame, keys: Sequence[str], interval_id: str) -> DataFrame:
    i, w = intervals.alias("i"), windows.alias("w")
    match = [F.col(f"i.{k}") == F.col(f"w.{k}") for k in keys] + [F.col("w.window_start") < F.col("i.end"), F.col("w.window_end") > F.col("i.start")]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    joined = i.join(w, condition, "left")
    return joined.groupBy(*[F.col(f"i.{k}").alias(k) for k in keys], F.col(f"i.{interval_id}").alias(interval_id)).agg(
        F.count("w.window_start").alias("overlapping_windows"),
        F.count_if(F.col("w.label_name") == "ictal").alias("ictal_windows"),
        F.count_if(F.col("w.label_name") == "boundary").alias("boundary_windows"),
    ).withColumn("has_ictal", F.col("ictal_windows") > 0)


def previous_overlaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows that begin before the row before them ends."""
    before = F.lag(end).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous_end", before).where(F.col(start) < F.col("previous_end"))


def constant_stride(df: DataFrame, keys: Sequence[str], start: str, stride: int) -> DataFrame:
    """Whether the starts of each group are ``stride`` apart."""
    step = F.col(start) - F.lag(start).over(W.partitionBy(*keys).orderBy(start))
    return df.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("__step") == stride), F.lit(True)).alias("constant"))
