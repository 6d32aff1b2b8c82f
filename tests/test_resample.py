"""Block by block equals the whole signal."""

import numpy as np
import pytest

from wavemill.functions import kernels as k
from wavemill.operators import preprocess, resample


def blocks(spark, signals, sizes, rate=256.0):
    rows = []
    for (rec, ch), x in signals.items():
        at = 0
        for i, n in enumerate(sizes):
            part = x[at : at + n] if i < len(sizes) - 1 else x[at:]
            rows.append((rec, ch, i, at, rate, [float(v) for v in part]))
            at += n
    return spark.createDataFrame(rows, "recording_id string, channel_index int, block_index bigint, start_sample bigint, sampling_rate_hz double, samples array<float>").repartition(5)


def whole(df):
    out = {}
    for r in df.orderBy("block_index").collect():
        out.setdefault((r.recording_id, r.channel_index), []).append((r.start_sample, np.array(r.samples)))
    return out


def signals(n=3000):
    rng = np.random.default_rng(5)
    t = np.arange(n) / 256
    base = np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 60 * t)
    return {(r, c): (base + rng.normal(0, 0.2, n)).astype(np.float32) for r in "ab" for c in range(2)}


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (5, 8), (1, 1), (125, 128)])
def test_resample(spark, up, down):
    x = signals()
    taps, n = k.resample_taps(up, down), 3000
    total = -(-n * up // down)
    assert taps.sum() == pytest.approx(up)
    got = whole(resample.resample(blocks(spark, x, [700, 1301, 500, 499]), up, down))
    for key, parts in got.items():
        want = k.resample_part(x[key].astype(float), 0, 0, total, up, down, taps)
        loop = [sum(x[key][j] * taps[m * down - j * up + len(taps) // 2] for j in range(n) if 0 <= m * down - j * up + len(taps) // 2 < len(taps)) for m in (0, 1, total // 2, total - 1)]
        assert np.allclose(want[[0, 1, total // 2, total - 1]], loop)
        assert [s for s, _ in parts] == [-(-s * up // down) for s in (0, 700, 2001, 2501)]
        assert np.allclose(np.concatenate([y for _, y in parts]), want, atol=1e-5)


def test_resample_keeps_a_slow_wave(spark):
    x = {("a", 0): np.sin(2 * np.pi * 10 * np.arange(2560) / 256).astype(np.float32)}
    df = resample.resample(blocks(spark, x, [1280, 1280]), 1, 2)
    y = np.concatenate([p for _, p in whole(df)["a", 0]])
    assert len(y) == 1280 and df.first().sampling_rate_hz == 128.0
    assert np.abs(y[100:-100] - np.sin(2 * np.pi * 10 * np.arange(1280) / 128)[100:-100]).max() < 1e-3


@pytest.mark.parametrize("run", [1, 2, 1000])
def test_notch(spark, run):
    """The state crosses seams: many short blocks are filtered as one signal."""
    x = signals()
    got = whole(resample.notch(blocks(spark, x, [17] * 60 + [300] * 6 + [180]), 60.0, 30.0, run))
    b, a = k.notch_taps(256.0, 60.0, 30.0)
    for key, parts in got.items():
        y, _ = k.biquad(x[key].astype(float)[None], b, a, np.zeros((1, 2)))
        y, _ = k.biquad(y[:, ::-1], b, a, np.zeros((1, 2)))
        assert np.allclose(np.concatenate([p for _, p in parts]), y[0, ::-1], atol=1e-5)
        spectrum = [np.abs(np.fft.rfft(v[500:2548] * np.hanning(2048))) for v in (x[key], np.concatenate([p for _, p in parts]))]
        assert spectrum[1][480] < 0.05 * spectrum[0][480] and spectrum[1][80] == pytest.approx(spectrum[0][80], rel=0.01)
    with pytest.raises(ValueError):
        k.notch_taps(100.0, 60.0, 30.0)


def test_reference_and_steps(spark):
    x = signals()
    got = whole(resample.average_reference(blocks(spark, x, [1000, 2000])))
    for r in "ab":
        mean = (x[r, 0] + x[r, 1]) / 2
        assert all(np.allclose(np.concatenate([p for _, p in got[r, c]]), x[r, c] - mean, atol=1e-5) for c in (0, 1))
    all_steps = whole(preprocess.preprocessed(blocks(spark, x, [1500, 1500]), notch_hz=60.0, reference="average", rate_change=(1, 2)))
    assert all(sum(len(p) for _, p in parts) == 1500 for parts in all_steps.values())
    with pytest.raises(ValueError):
        preprocess.preprocessed(blocks(spark, x, [1500, 1500]), reference="mastoid")
