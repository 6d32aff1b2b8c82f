import re

import numpy as np
import pytest

from wavemill.sources import block_table as bt

SCHEMA = "recording_id string, channel_index int, channel_name string, block_index bigint, start_sample bigint, samples array<float>"


def blocks(spark, n=1000, size=128):
    x = {(r, c): np.random.default_rng(c).normal(size=n).astype(np.float32) for r in "ab" for c in range(3)}
    rows = [(r, c, f"ch{c}", i, i * size, [float(v) for v in y[i * size : (i + 1) * size]]) for (r, c), y in x.items() for i in range(-(-n // size))]
    return x, spark.createDataFrame(rows, SCHEMA)


def test_windows_of_a_table(spark, tmp_path):
    x, frame = blocks(spark)
    table = bt.write_block_table(frame, "laid_out", 99, 4, f"file://{tmp_path}/laid_out")
    try:
        starts = [0, 28, 29, 127, 128, 500, 900]
        windows = spark.createDataFrame([(r, f"{r}{s}", s, s + 100) for r in "ab" for s in starts], "recording_id string, window_id string, start_sample bigint, stop_sample_exclusive bigint")
        found = bt.read_windows(windows, table, 128)
        got = {(w.recording_id, w.channel_index, w.start_sample): w.samples for w in found.collect()}
        assert len(got) == 2 * 3 * len(starts)
        assert all(np.array_equal(np.float32(v), x[r, c][s : s + 100]) for (r, c, s), v in got.items())
        # The windows' side is shuffled, or broadcast where it is small; the samples are not.
        for limit in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plan = bt.read_windows(windows, table, 128)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"\bExchange hashpartitioning", plan)) == (1 if limit == "-1" else 0), plan
            assert limit != "-1" or "Bucketed: true" in plan
        with pytest.raises(Exception, match="beyond its recording"):
            bt.read_windows(spark.createDataFrame([("a", "w", 950, 1050)], windows.schema), table, 128).collect()
        assert bt.table_sample(spark, "laid_out", windows, 128, 5).count() == 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE laid_out")
    with pytest.raises(Exception, match="shorter than the halo"):
        bt.with_halo(frame, 129).collect()
