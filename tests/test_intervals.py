import random

from pyspark.sql import functions as F

from wavemill.operators import intervals as ivl


def frame(spark, rows, spec="r string, start bigint, end bigint"):
    return spark.createDataFrame(rows, spec)


def test_merge_joins_touching_intervals(spark):
    got = ivl.merge_intervals(frame(spark, [("a", 10, 20), ("a", 15, 25), ("a", 30, 40), ("b", 0, 5), ("b", 5, 9)]), ["r"]).collect()
    assert sorted(map(tuple, got)) == [("a", 10, 25), ("a", 30, 40), ("b", 0, 9)]


def test_fixed_windows(spark):
    recs = spark.createDataFrame([("a", 2560), ("b", 1200), ("c", 1023), ("d", 0)], "r string, n bigint")
    got = ivl.fixed_windows(recs, "n", 1024, 512).groupBy("r").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 4, "b": 1}
    short = ivl.fixed_windows(recs, "n", 1024, 512, drop_incomplete=False).where("r = 'b'").orderBy("window_start").collect()
    assert [(r.window_start, r.window_end) for r in short] == [(0, 1024), (512, 1200), (1024, 1200)]


def test_labels(spark):
    windows = spark.createDataFrame([("a", 0, 0, 400), ("b", 0, 0, 400), ("c", 0, 0, 400), ("d", 0, 0, 400)], "r string, window_index bigint, window_start bigint, window_end bigint")
    spans = frame(spark, [("a", 300, 1000), ("b", 200, 1000), ("c", 400, 500)])
    got = {r.r: r for r in ivl.label_windows(ivl.window_overlaps(windows, spans, ["r"]), 0.5, 6000, 6000).collect()}
    assert (got["a"].label_name, got["a"].overlap_fraction, got["a"].binary_label) == ("boundary", 0.25, None)
    assert (got["b"].label_name, got["b"].binary_label, got["b"].near_interval) == ("ictal", 1, True)
    assert (got["c"].label_name, got["c"].nearest, got["c"].near_interval, got["c"].clean_non_ictal) == ("non_ictal", 0, True, False)
    assert (got["d"].nearest, got["d"].overlap, got["d"].clean_non_ictal) == (None, 0, True)


def test_overlaps_against_a_loop(spark):
    rng = random.Random(7)
    spans = [(r, s, s + rng.randint(1, 300)) for r in "abc" for s in (rng.randint(0, 2000) for _ in range(8))]
    windows = [(r, i, i * 100, i * 100 + 200) for r in "abcd" for i in range(20)]
    found = ivl.window_overlaps(spark.createDataFrame(windows, "r string, window_index bigint, window_start bigint, window_end bigint"), frame(spark, spans), ["r"])
    for row in found.collect():
        own = [(s, e) for r, s, e in spans if r == row.r]
        covered = {t for s, e in own for t in range(s, e)} & set(range(row.window_start, row.window_end))
        assert row.overlap == len(covered)
        assert row.nearest == min((max(0, s - row.window_end, row.window_start - e) for s, e in own), default=None)


def test_coverage_keeps_intervals_without_windows(spark):
    windows = spark.createDataFrame([("a", 0, 100, "ictal"), ("a", 50, 150, "boundary")], "r string, window_start bigint, window_end bigint, label_name string")
    spans = spark.createDataFrame([("a", 90, 120, 1), ("b", 0, 10, 2)], "r string, start bigint, end bigint, id int")
    got = {r.id: (r.overlapping_windows, r.ictal_windows, r.has_ictal) for r in ivl.interval_coverage(spans, windows, ["r"], "id").collect()}
    assert got == {1: (2, 1, True), 2: (0, 0, False)}


def test_chunks_keep_a_long_enough_tail(spark):
    recs = spark.createDataFrame([("a", 130), ("b", 105)], "r string, n bigint")
    got = ivl.tumbling_chunks(recs, "n", 60, 10).groupBy("r").agg(F.count("*").alias("c")).collect()
    assert {r[0]: r[1] for r in got} == {"a": 3, "b": 2}
