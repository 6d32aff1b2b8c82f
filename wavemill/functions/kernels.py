"""Numeric kernels on one array of samples: quality metrics, Welch spectra, FIR filters."""

from __future__ import annotations

import numpy as np

#: The analysis bands in Hz, and flatline settings.
ANALYSIS_BAND = (0.5, 100.0)
LINE_HZ, LINE_HALF, REFERENCE_HALF = 60.0, 1.0, 5.0
HIGH_BAND = (40.0, 100.0)
FLAT_UV, FLAT_SECONDS = 0.01, 1.0
SEGMENT_SECONDS = 4.0

METRIC_TYPES = {
    "sample_count": "bigint", "finite_count": "bigint", "nan_count": "bigint", "inf_count": "bigint", "zero_count": "bigint",
    "nonfinite_fraction": "double", "nan_fraction": "double", "zero_fraction": "double",
    "mean_uv": "double", "median_uv": "double", "std_uv": "double", "variance_uv2": "double", "rms_uv": "double", "min_uv": "double", "max_uv": "double", "peak_to_peak_uv": "double",
    "q01_uv": "double", "q05_uv": "double", "q25_uv": "double", "q75_uv": "double", "q95_uv": "double", "q99_uv": "double", "iqr_uv": "double", "robust_range_uv": "double", "mad_uv": "double",
    "skewness": "double", "excess_kurtosis": "double",
    "line_length_uv": "double", "mean_abs_difference_uv": "double", "max_abs_difference_uv": "double",
    "flat_difference_fraction": "double", "longest_flat_run_seconds": "double", "flatline_sample_fraction": "double",
    "total_power": "double", "line_power": "double", "high_frequency_power": "double", "line_noise_ratio": "double", "high_frequency_ratio": "double", "spectral_entropy": "double",
}


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def flatline(x: np.ndarray, rate: float) -> dict[str, float]:
    if len(x) < 2:
        return {}
    flat = np.abs(np.diff(x)) <= FLAT_UV
    first, last = runs(flat)
    sizes = last - first + 1
    minimum = max(2, round(FLAT_SECONDS * rate))
    return {
        "flat_difference_fraction": float(flat.mean()),
        "longest_flat_run_seconds": float(sizes.max(initial=0) / rate),
        "flatline_sample_fraction": float(sizes[sizes >= minimum].sum() / len(x)),
    }


def median_bias(n: int) -> float:
    """Expected median of n periodogram values over their mean."""
    k = np.arange(1, (n - 1) // 2 + 1)
    return float(1 + np.sum(1 / (2 * k + 1) - 1 / (2 * k)))


def welch(x: np.ndarray, rate: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the median-averaged, one-sided power density: Hann segments with
    half overlap, each without its mean."""
    step = nperseg - nperseg // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    spectra = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    spectra /= rate * np.sum(window**2)
    spectra[:, 1 : -1 if nperseg % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nperseg, 1 / rate), np.median(spectra, axis=0) / median_bias(len(parts))


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """Trapezoid integral; NaN for a band of fewer than two bins."""
    inside = (f >= low) & (f <= high)
    return float(np.trapezoid(p[inside], f[inside])) if inside.sum() >= 2 else float("nan")


def spectral(x: np.ndarray, rate: float) -> dict[str, float]:
    nperseg = round(SEGMENT_SECONDS * rate)
    if nperseg < 2 or len(x) < nperseg:
        return {}
    f, p = welch(x, rate, nperseg)
    low, high = ANALYSIS_BAND[0], min(ANALYSIS_BAND[1], rate / 2)
    total, line = band_power(f, p, low, high), band_power(f, p, LINE_HZ - LINE_HALF, LINE_HZ + LINE_HALF)
    reference, fast = band_power(f, p, LINE_HZ - REFERENCE_HALF, LINE_HZ + REFERENCE_HALF), band_power(f, p, HIGH_BAND[0], min(HIGH_BAND[1], high))
    inside = (f >= low) & (f <= high)
    share = p[inside][p[inside] > 0]
    share = share / share.sum() if len(share) else share
    return {
        "total_power": total, "line_power": line, "high_frequency_power": fast,
        "line_noise_ratio": line / reference if reference > 0 else float("nan"),
        "high_frequency_ratio": fast / total if total > 0 else float("nan"),
        "spectral_entropy": float(-np.sum(share * np.log(share)) / np.log(len(share))) if len(share) > 1 else float("nan"),
    }


def channel_metrics(samples: np.ndarray | None, rate: float, scale: float = 1.0) -> dict[str, float]:
    """All metrics; those that can't be had are absent."""
    raw = np.asarray(samples if samples is not None else [], dtype=np.float64) * scale
    x = raw[np.isfinite(raw)]
    n, nan = len(raw), int(np.isnan(raw).sum())
    out: dict[str, float] = {"sample_count": n, "finite_count": len(x), "nan_count": nan, "inf_count": n - len(x) - nan, "zero_count": int((x == 0).sum())}
    if n:
        out |= {"nonfinite_fraction": 1 - len(x) / n, "nan_fraction": nan / n}
    if not len(x):
        return out
    q = np.quantile(x, [0.01, 0.05, 0.25, 0.75, 0.95, 0.99])
    mid, mean, std = float(np.median(x)), float(x.mean()), float(x.std())
    out |= {
        "zero_fraction": out["zero_count"] / len(x),
        "mean_uv": mean, "median_uv": mid, "std_uv": std, "variance_uv2": std**2, "rms_uv": float(np.sqrt(np.mean(x**2))), "min_uv": float(x.min()), "max_uv": float(x.max()), "peak_to_peak_uv": float(np.ptp(x)),
        **{f"q{p}_uv": float(v) for p, v in zip(("01", "05", "25", "75", "95", "99"), q)},
        "iqr_uv": float(q[3] - q[2]), "robust_range_uv": float(q[5] - q[0]), "mad_uv": float(np.median(np.abs(x - mid))),
    }
    m = float(len(x))
    if std > 0 and m > 3:
        z = (x - mean) / std
        g1, g2 = float(np.mean(z**3)), float(np.mean(z**4)) - 3
        out |= {"skewness": g1 * np.sqrt(m * (m - 1)) / (m - 2), "excess_kurtosis": (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * g2 + 6)}
    if len(x) > 1:
        d = np.abs(np.diff(x))
        out |= {"line_length_uv": float(d.sum()), "mean_abs_difference_uv": float(d.mean()), "max_abs_difference_uv": float(d.max())}
    return out | flatline(x, rate) | spectral(x, rate)


def band_pass_taps(rate: float, low: float, high: float) -> np.ndarray:
    """A Hamming-windowed linear-phase band-pass; its length follows the narrower transition."""
    t_low = min(max(0.25 * low, 2.0), low)
    t_high = min(max(0.25 * high, 2.0), rate / 2 - high)
    n = int(np.ceil(3.3 / min(t_low, t_high) * rate))
    n += 1 - n % 2
    k = np.arange(n) - (n - 1) / 2

    def low_pass(cut: float) -> np.ndarray:
        return 2 * cut / rate * np.sinc(2 * cut / rate * k)

    taps = (low_pass(high + t_high / 2) - low_pass(low - t_low / 2)) * np.hamming(n)
    centre = np.sqrt(low * high)
    return taps / np.abs(np.sum(taps * np.exp(-2j * np.pi * centre / rate * k)))


def fir_filter(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: symmetric taps, the ends mirrored (odd reflection)."""
    half = (len(taps) - 1) // 2
    if not len(x):
        return x
    pad = min(half, len(x) - 1)
    left, right = 2 * x[0] - x[pad:0:-1], 2 * x[-1] - x[-2 : -pad - 2 : -1]
    full = np.concatenate((np.full(half - pad, left[0] if pad else x[0]), left, x, right, np.full(half - pad, right[-1] if pad else x[-1])))
    size = 1 << int(np.ceil(np.log2(len(full) + len(taps) - 1)))
    out = np.fft.irfft(np.fft.rfft(full, size) * np.fft.rfft(taps, size), size)
    return out[len(taps) - 1 : len(taps) - 1 + len(x)]


def resample_taps(up: int, down: int) -> np.ndarray:
    """The low-pass of a rate change by ``up`` / ``down``, at ``up`` times the rate: a sinc under
    a Hamming window, ten periods of the slower rate to either side, with a sum of ``up``."""
    slow = max(up, down)
    k = np.arange(-10 * slow, 10 * slow + 1)
    taps = np.sinc(k / slow) * (0.54 + 0.46 * np.cos(np.pi * k / (10 * slow)))
    return taps * (up / taps.sum())


def resample_part(x: np.ndarray, first: int, begin: int, end: int, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Outputs ``begin`` to ``end`` (exclusive) of a rate change, where ``x`` has the samples
    from number ``first`` on; samples that it lacks are zeros."""
    half = len(taps) // 2
    m = np.arange(begin, end)[:, None]
    n = -((half - m * down) // up) + np.arange(2 * half // up + 1)
    at = m * down - n * up + half
    fine = (at >= 0) & (at < len(taps)) & (n >= first) & (n < first + len(x))
    return np.sum(np.where(fine, x[np.clip(n - first, 0, max(0, len(x) - 1))] * taps[np.clip(at, 0, len(taps) - 1)], 0.0), axis=1) if len(x) else np.zeros(end - begin)


def notch_taps(rate: float, hz: float, quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a second-order notch whose width is ``hz`` / ``quality``."""
    if not 0 < hz < rate / 2:
        raise ValueError("the notch must be below half the rate")
    w = 2 * np.pi * hz / rate
    gain = 1 / (1 + np.tan(w / quality / 2))
    return gain * np.array([1.0, -2 * np.cos(w), 1.0]), np.array([1.0, -2 * gain * np.cos(w), 2 * gain - 1])


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ``x`` through a second-order filter from its state in ``z`` (two numbers), and
    the states at the end; the rows go side by side."""
    y, first, second = np.empty_like(x), z[:, 0].copy(), z[:, 1].copy()
    for i in range(x.shape[1]):
        now = b[0] * x[:, i] + first
        first = b[1] * x[:, i] - a[1] * now + second
        second = b[2] * x[:, i] - a[2] * now
        y[:, i] = now
    return y, np.stack((first, second), axis=1)


def biquad_map(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What one step does to the state of ``biquad``, besides what the sample adds."""
    return np.array([[-a[1], 1.0], [-a[2], 0.0]])
