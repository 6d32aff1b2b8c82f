import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import kernels as k
from wavemill.operators import preprocess, quality


def test_sine_power_and_line_noise():
    t = np.arange(256 * 40) / 256
    tone = k.channel_metrics(20 * np.sin(2 * np.pi * 60 * t), 256)
    assert tone["line_noise_ratio"] > 0.9 and tone["high_frequency_ratio"] > 0.9
    slow = k.channel_metrics(20 * np.sin(2 * np.pi * 10 * t), 256)
    assert slow["line_noise_ratio"] < 0.5 and slow["high_frequency_ratio"] < 0.01


def test_white_noise_level():
    x = np.random.default_rng(42).normal(0, 2, 256 * 600)
    f, p = k.welch(x, 256, 1024)
    inside = (f > 5) & (f < 120)
    assert abs(p[inside].mean() / (4 * 2 / 256) - 1) < 0.05


def test_moments_and_counts():
    x = np.array([0.0, 1.0, np.nan, np.inf])
    m = k.channel_metrics(x, 256)
    assert (m["nonfinite_fraction"], m["nan_fraction"], m["finite_count"]) == (0.5, 0.25, 2)
    assert k.channel_metrics(None, 256)["sample_count"] == 0


def test_flatline():
    x = np.concatenate((np.arange(100.0), np.full(300, 7.0), np.arange(100.0)))
    m = k.flatline(x, 256)
    assert m["flatline_sample_fraction"] == 300 / 500 and m["longest_flat_run_seconds"] == 300 / 256


def test_band_pass_removes_line_noise():
    t = np.arange(256 * 20) / 256
    slow, fast = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 60 * t)
    taps = k.band_pass_taps(256, 0.5, 45)
    assert len(taps) == 1691
    mid = slice(1000, -1000)
    assert np.sqrt(np.mean(k.fir_filter(fast, taps)[mid] ** 2)) < 0.2 * np.sqrt(np.mean(fast[mid] ** 2))
    assert np.abs(k.fir_filter(slow, taps) - slow)[mid].max() < 0.05


def blocks(spark, x, size, rate=256.0):
    rows = [("r", 0, "c", i, i * size, rate, x[i * size : (i + 1) * size].tolist()) for i in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "recording_id string, channel_index int, channel_name string, block_index bigint, start_sample bigint, sampling_rate_hz double, samples array<float>")


def test_blocks_filter_like_the_whole(spark):
    x = np.random.default_rng(1).normal(0, 20, 8192)
    got = preprocess.band_pass(blocks(spark, x, 2048)).orderBy("block_index").collect()
    whole = k.fir_filter(x.astype(np.float32).astype(float), k.band_pass_taps(256, 0.5, 45))
    assert np.abs(np.concatenate([r.samples for r in got]) - whole).max() < 1e-3


def test_window_slices(spark):
    x = np.arange(4096.0)
    w = spark.createDataFrame([("w", "r", 512, 1536), ("v", "r", 3000, 4096)], "window_id string, recording_id string, start_sample bigint, stop_sample_exclusive bigint")
    got = {r.window_id: r.samples for r in preprocess.window_samples(w, blocks(spark, x, 1000), 1000).collect()}
    assert got["w"] == list(range(512, 1536)) and got["v"] == list(range(3000, 4096))


def test_quality_and_flags(spark):
    x = np.concatenate((np.zeros(2048), np.random.default_rng(3).normal(0, 20, 2048)))
    rows = quality.add_flags(quality.chunk_quality(blocks(spark, x, 2048), "block_index")).orderBy("chunk_index").collect()
    assert rows[0].flag_near_constant and rows[0].flag_zero_heavy and not rows[1].flag_near_constant


def test_short_blocks_fail(spark):
    x = np.random.default_rng(1).normal(0, 20, 4096)
    with pytest.raises(Exception, match="shorter than half the filter"):
        preprocess.band_pass(blocks(spark, x, 512)).collect()
    half = spark.range(1).select(*[preprocess.half_taps(F.lit(r), a, b).alias(f"x{i}") for i, (r, a, b) in enumerate(((256.0, 0.5, 45.0), (100.0, 5.0, 20.0), (512.0, 1.0, 70.0)))]).first()
    assert list(half) == [(len(k.band_pass_taps(r, a, b)) - 1) // 2 for r, a, b in ((256.0, 0.5, 45.0), (100.0, 5.0, 20.0), (512.0, 1.0, 70.0))]
