"""Sweeps against loops, in ranges of few edges and many."""

import random

import pytest
from pyspark.sql import functions as F

from wavemill.operators import intervals as ivl
from wavemill.operators import sweep

WINDOWS = "r string, window_index bigint, window_start bigint, window_end bigint"
SPANS = "r string, start bigint, end bigint, id bigint"


def example(seed: int):
    rng = random.Random(seed)
    spans = [("a", s, s + rng.randint(1, 60), i) for i, s in enumerate(rng.randint(0, 2000) for _ in range(40))]
    # Nested, equal, touching and far intervals, a recording without windows, no recording.
    spans += [("b", 100, 900, 100), ("b", 200, 300, 101), ("b", 200, 300, 102), ("b", 900, 950, 103), ("b", 5000, 5001, 104), ("x", 1, 2, 105), (None, 0, 10, 106), ("a", 70, 70, 107)]
    windows = [(r, i, i * 50, i * 50 + 100) for r in ("a", "b", "c", None) for i in range(40)] + [("b", 90, 950, 1000), ("b", 91, 4000, 5000), ("a", 92, 0, 2100)]
    return spans, windows


def brute_overlap(spans, window):
    r, _, s, e = window
    own = [(a, b) for k, a, b, _ in spans if k == r and k is not None and b > a]
    covered = {t for a, b in own for t in range(a, b)}
    merged = sum(t - 1 not in covered for t in covered)
    return len(covered & set(range(s, e))), min((max(0, a - e, s - b) for a, b in own), default=None), merged


@pytest.mark.parametrize("rows", [7, 64, 10_000])
def test_overlaps(spark, rows):
    spans, windows = example(1)
    got = sweep.swept_overlaps(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(spans, SPANS).select("r", "start", "end"), ["r"], rows).collect()
    assert sorted(tuple(x[:4]) for x in got if x.r) == sorted(w for w in windows if w[0])
    assert len(got) == len(windows)
    for x in got:
        overlap, nearest, merged = brute_overlap(spans, tuple(x[:4]))
        assert (x.overlap, x.nearest, x.n_intervals) == (overlap, nearest, merged)


@pytest.mark.parametrize("rows", [9, 10_000])
def test_coverage(spark, rows):
    spans, windows = example(2)
    named = [(r, s, e, ("ictal", "boundary", "non_ictal", None)[(i + s // 50) % 4]) for r, i, s, e in windows]
    frame = spark.createDataFrame(named, "r string, window_start bigint, window_end bigint, label_name string")
    intervals = spark.createDataFrame([s for s in spans if s[2] > s[1]], SPANS)
    want = {tuple(x) for x in ivl.joined_coverage(intervals, frame, ["r"], "id").collect()}
    assert {tuple(x) for x in sweep.swept_coverage(intervals, frame, ["r"], "id", rows).collect()} == want
    # Some recordings swept, some joined.
    assert {tuple(x) for x in ivl.interval_coverage(intervals, frame, ["r"], "id", dense=41).collect()} == want


@pytest.mark.parametrize("rows", [5, 10_000])
def test_chunks(spark, rows):
    spans, _ = example(3)
    chunks = [(r, i, i * 130, i * 130 + 130) for r in ("a", "b", "c") for i in range(18)] + [("a", 50, 2500, 2510), ("b", 51, 4990, 5010)]
    intervals = spark.createDataFrame(spans, SPANS).select("r", "start", "end")
    want = {(r, i): max((max(0, min(e, b) - max(s, a)) for k, a, b, _ in spans if k == r and b > a), default=0) for r, i, s, e in chunks}
    frame = spark.createDataFrame(chunks, WINDOWS)
    assert {(x.r, x.window_index): x.most for x in sweep.swept_most(frame, intervals, ["r"], rows).collect()} == want
    for dense in (0, 10, 4096):
        got = ivl.chunk_annotation(frame, intervals, ["r"], dense=dense).collect()
        assert {(x.r, x.window_index): round(x.overlap_fraction * (x.window_end - x.window_start)) for x in got} == want


def test_dense_and_sparse_recordings_agree(spark):
    spans, windows = example(4)
    frame, intervals = spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(spans, SPANS).select("r", "start", "end")
    outcomes = [{tuple(x) for x in ivl.window_overlaps(frame, intervals, ["r"], dense).collect()} for dense in (0, 10, 4096)]
    assert outcomes[0] == outcomes[1] == outcomes[2]


def test_one_long_recording(spark):
    """A recording with hundreds of thousands of edges is dealt to many ranges of equal size."""
    n = 100_000
    windows = spark.range(n).select(F.lit("a").alias("r"), F.col("id").alias("window_index"), (F.col("id") * 10).alias("window_start"), (F.col("id") * 10 + 20).alias("window_end"))
    intervals = spark.range(n).select(F.lit("a").alias("r"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 3 + F.col("id") % 5).alias("end"))
    edges = sweep.ranged(sweep.together(sweep.points_of(windows, "window_start", "window_end", ["r"]), sweep.placed(intervals, ["r"], "start", sweep.START)), ["r"], 20_000)
    sizes = [x["count"] for x in edges.groupBy("__range").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 2 * 20_000
    got = sweep.swept_overlaps(windows, intervals, ["r"], 20_000).agg(F.sum("overlap").alias("o"), F.count("*").alias("n"), F.max("n_intervals").alias("m")).first()
    # Every interval is in two windows, but the first one, and the last window holds one.
    lengths = [i % 5 for i in range(n)]
    assert (got.o, got.n, got.m) == (2 * sum(lengths) - lengths[0], n, sum(x > 0 for x in lengths))


def test_tasks_do_not_grow(spark):
    """What a task holds is bounded by the ranges' size, not by a fixed number of partitions."""
    n, r = 60_000, F.floor(F.col("id") / 10).alias("r")
    windows = spark.range(n).select(r, F.col("id").alias("window_index"), (F.col("id") % 10 * 10).alias("window_start"), (F.col("id") % 10 * 10 + 20).alias("window_end"))
    intervals = spark.range(n).select(r, (F.col("id") % 10 * 10 + 3).alias("start"), (F.col("id") % 10 * 10 + 7).alias("end"), "id")
    swept = sweep.swept_overlaps(windows, intervals.drop("id"), ["r"], 10_000)
    covered = sweep.swept_coverage(intervals, windows.withColumn("label_name", F.lit("ictal")), ["r"], "id", 10_000)
    for out in (swept, covered):
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / (4 * n / 10_000)
