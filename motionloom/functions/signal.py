"""Kernels over one recording's ordered samples (NumPy arrays in, numbers or arrays out), from textbook definitions."""

from __future__ import annotations

import math

import numpy as np

# windows and filters


def hann(m: int, symmetric: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / max(m - 1 if symmetric else m, 1))


def butterworth(order: int, wn: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth coefficients (b, a) by the bilinear transform; ``wn`` is a share of half the sampling rate."""
    warped = math.tan(math.pi * wn / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    poles = warped * poles if kind == "low" else warped / poles
    z = (1 + poles) / (1 - poles)
    a = np.real(np.poly(z))
    b = np.poly(np.full(order, -1.0 if kind == "low" else 1.0))
    at = 1.0 if kind == "low" else -1.0
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


def lfilter(b, a, x) -> np.ndarray:
    """Causal recursive filter with zero initial state (transposed direct form)."""
    b, a, x = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0], np.asarray(x, float)
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    if n == 1 or not a[1:].any():
        return np.convolve(x, b)[: len(x)]
    state, out = [0.0] * n, np.empty(len(x))
    bs, as_ = b.tolist(), a.tolist()
    for k, v in enumerate(x.tolist()):
        y = bs[0] * v + state[0]
        for j in range(1, n):
            state[j - 1] = bs[j] * v + state[j] - as_[j] * y
        out[k] = y
    return out


def high_pass(x, fs=100.0, cutoff=2.0, order=2) -> np.ndarray:
    return lfilter(*butterworth(order, 2 * cutoff / fs, "high"), x)


def low_pass(x, fs=100.0, cutoff=10.0, order=4) -> np.ndarray:
    return lfilter(*butterworth(order, 2 * cutoff / fs, "low"), x)


def resample_mean(t, x, step) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each bin of ``step`` seconds from the first sample on, empty bins filled linearly."""
    t, x = np.asarray(t, float), np.asarray(x, float)
    at = np.floor((t - t[0]) / step + 1e-9).astype(int)
    n = np.bincount(at)
    full = np.flatnonzero(n)
    mean = np.bincount(at, x)[full] / n[full]
    return np.arange(len(n)) * step, np.interp(np.arange(len(n)), full, mean)


# spectra


def central(x, window=256) -> np.ndarray:
    x = np.asarray(x, float)
    start = max(len(x) // 2 - window // 2, 0)
    return x[start : start + window]


def windowed_fft(x, window=256) -> np.ndarray:
    part = central(x, window)
    return np.fft.fft(part * hann(len(part)))


def amplitude_fft(x, fs=100.0, low=2.0, high=10.0, window=256) -> tuple[float, float]:
    """(sum of magnitudes, frequency of the largest) inside the open band."""
    ts = np.abs(windowed_fft(x, window)) / max(min(window, len(x)), 1)
    n = len(ts)
    f = np.arange(n // 2) * fs / n
    m = (f > low) & (f < high)
    part = ts[: n // 2][m]
    return (float(part.sum()), float(f[m][part.argmax()])) if len(part) else (0.0, float("nan"))


def welch(x, fs=1.0, nperseg=256) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float)
    n = min(nperseg, len(x))
    w, hop = hann(n, False), max(n - n // 2, 1)
    starts = range(0, len(x) - n + 1, hop)
    p = np.mean([np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * w)) ** 2 for s in starts], axis=0) / (fs * max((w * w).sum(), 1e-300))
    p[1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def amplitude_welch(x, fs=100.0, low=2.0, high=10.0, window=256) -> tuple[float, float]:
    f, p = welch(x, fs, window)
    m = (f > low) & (f < high)
    return (float(p[m].sum()), float(f[p.argmax()])) if len(p) else (0.0, float("nan"))


def fft_centroid(x) -> float:
    m = np.abs(np.fft.rfft(x))
    return float((np.arange(len(m)) * m).sum() / m.sum()) if m.sum() else float("nan")


# dependence


def acf_unbiased(x) -> np.ndarray:
    x = np.asarray(x, float)
    n, d = len(x), x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(d, size)) ** 2, size)[:n]
    v = x.var() * np.arange(n, 0, -1)
    return r / np.where(v == 0, np.nan, v)


def raw_acf(x, unbias=2, normalize=2) -> np.ndarray:
    x = np.asarray(x, float)
    c = np.correlate(x, x, "full")[len(x) - 1 :]
    if unbias == 1:
        c = c / np.arange(len(x), 0, -1)
    elif unbias == 2:
        c = c / np.linspace(c[0] / c[-1] if c[-1] else 1.0, 1, len(x))
    if normalize == 1:
        return c / abs(c[0])
    return c / np.abs(c).max() if normalize == 2 else c


def levinson(r, order) -> tuple[np.ndarray, float, list[float]]:
    """(prediction polynomial, error, reflection coefficients) of autocovariances ``r``."""
    a, e, k = np.array([1.0]), float(r[0]), []
    for m in range(1, order + 1):
        g = -float(np.dot(a, r[m : m - len(a) : -1] if m - len(a) >= 0 else r[m::-1][: len(a)])) / e if e else 0.0
        a = np.append(a, 0.0)
        a = a + g * a[::-1]
        e *= 1 - g * g
        k.append(g)
    return a, e, k


def pacf(x, lag) -> float:
    """Partial autocorrelation by Levinson-Durbin on autocovariances over n - k."""
    x = np.asarray(x, float)
    d, n = x - x.mean(), len(x)
    if lag == 0:
        return 1.0
    if lag >= n:
        return float("nan")
    return -levinson(np.array([d[: n - k] @ d[k:] / (n - k) for k in range(lag + 1)]), lag)[2][-1]


def approximate_entropy(x, m=2, r=0.3) -> float:
    """Difference of template match logarithms; templates are compared block by block, so memory is O(n)."""
    x = np.asarray(x, float)
    if len(x) <= m + 1:
        return 0.0
    tolerance = r * x.std()

    def phi(k):
        t = np.lib.stride_tricks.sliding_window_view(x, k)
        n, total = len(t), 0.0
        for i in range(0, n, 256):
            d = np.zeros((min(256, n - i), n))
            for j in range(k):
                np.maximum(d, np.abs(t[i : i + 256, j][:, None] - t[:, j][None, :]), out=d)
            total += np.log((d <= tolerance).sum(1) / n).sum()
        return total / n

    return float(abs(phi(m) - phi(m + 1)))


# peaks and segments


def peakdet(x, delta) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
    """Alternating maxima and minima: a maximum counts once the signal has fallen by ``delta``, and so on."""
    tops, dips, seek_top = [], [], True
    high, low, at_high, at_low = -math.inf, math.inf, -1, -1
    for i, v in enumerate(x):
        if v > high:
            high, at_high = v, i
        if v < low:
            low, at_low = v, i
        if seek_top and v < high - delta:
            tops.append((at_high, float(high)))
            low, at_low, seek_top = v, i, False
        elif not seek_top and v > low + delta:
            dips.append((at_low, float(low)))
            high, at_high, seek_top = v, i, True
    return tops, dips


def find_peaks(x) -> np.ndarray:
    """Strict local maxima; a plateau counts at its middle, left of centre where even; edges never."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0]))
    ends, v = np.append(edge[1:], len(x)) - 1, x[edge]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (edge[top] + ends[top]) // 2


def prominences(x, peaks) -> np.ndarray:
    x, out = np.asarray(x, float), []
    for p in peaks:
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        a = left[-1] + 1 if len(left) else 0
        b = p + 1 + right[0] if len(right) else len(x)
        out.append(x[p] - max(x[a : p + 1].min(), x[p:b].min()))
    return np.array(out)


def pos_to_neg(x) -> np.ndarray:
    x = np.asarray(x)
    return np.flatnonzero((x[:-1] > 0) & (x[1:] <= 0))


def interpeak(x, fs) -> int:
    """Samples a period: second-largest signed value of the packed real transform, read at the two-sided frequencies."""
    x = np.asarray(x, float)
    n, f = len(x), np.fft.rfft(x)
    packed = np.empty(n)
    packed[0] = f[0].real
    packed[1::2] = f.real[1 : 1 + len(packed[1::2])]
    packed[2::2] = f.imag[1 : 1 + len(packed[2::2])]
    at = np.argsort(packed)[-2]
    freq = abs(np.fft.fftfreq(n, 1 / fs)[at])
    return int(np.rint(fs / freq)) if freq else n


def smoothing(x, width=3) -> np.ndarray:
    """In place from the left: where a window's borders agree, its middle takes their value."""
    x = np.array(x, float)
    for i in range(len(x) - width + 1):
        if x[i] == x[i + width - 1]:
            x[i + 1 : i + width - 1] = x[i]
    return x


def segments(x, k) -> np.ndarray:
    """Label of the optimal k-segment fit with least squared error, dynamic programming over prefix sums."""
    x = np.asarray(x, float)
    n = len(x)
    k = min(k, n)
    s, q = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1)
    best, cut = cost(0, np.arange(n + 1)), []
    for m in range(1, k):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(m + 1, n + 1):
            i = np.arange(m, j)
            c = best[i] + cost(i, j)
            at[j] = i[c.argmin()]
            new[j] = c.min()
        best = new
        cut.append(at)
    out, j = np.zeros(n, int), n
    for m in range(k - 1, 0, -1):
        i = cut[m - 1][j]
        out[i:j], j = m, i
    return out




def daubechies(n: int) -> np.ndarray:
    """Decomposition low-pass filter with n vanishing moments, by spectral factorisation."""
    p = [math.comb(n - 1 + k, k) for k in range(n)]
    roots = []
    for y in np.roots(p[::-1]):
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.abs(z).argmin()])
    h = np.real(np.poly(np.concatenate([np.full(n, -1.0), roots])))
    return (h * math.sqrt(2) / h.sum())[::-1]


def dwt(x, low) -> tuple[np.ndarray, np.ndarray]:
    """One level with symmetric extension: (approximation, detail) of length floor((n + L - 1) / 2)."""
    x, size = np.asarray(x, float), len(low)
    high = low[::-1] * np.where(np.arange(size) % 2, 1.0, -1.0)
    e = np.pad(x, size - 1, "symmetric")
    return np.convolve(e, low, "valid")[1::2], np.convolve(e, high, "valid")[1::2]


def wavedec(x, low, level) -> list[np.ndarray]:
    """[approximation, coarsest detail, ..., finest detail]."""
    out, a = [], np.asarray(x, float)
    for _ in range(level):
        a, d = dwt(a, low)
        out.insert(0, d)
    return [a, *out]


def integrate(x, fs) -> float:
    return float((np.sum(x[1:]) / fs + np.sum(x[:-1])) / (2 * fs))


# gait


def freeze_of_gait(x, fs=100.0, window=256, step=50, loco=(0.5, 3), freeze=(3, 8)) -> tuple[list[int], list[float], list[float]]:
    """(end positions, freeze index, total power) of sliding windows: power of the freezing band over the walking band."""
    x, res = np.asarray(x, float), fs / window
    lo, mid, hi = int(loco[0] / res) - 1, int(loco[1] / res), int(freeze[1] / res)
    times, index, total = [], [], []
    for end in range(window + 1, len(x), step):
        y = x[end - window : end]
        p = np.abs(np.fft.fft(y - y.mean())) ** 2 / window
        walk, stop = integrate(p[max(lo, 0) : mid], fs), integrate(p[mid - 1 : hi], fs)
        times.append(end)
        index.append(float(np.float32(stop / walk)) if walk else float("nan"))
        total.append(float(np.float32(stop + walk)))
    return times, index, total


def frequency_of_peaks(x, start=100, end=100, delta=0.5) -> float:
    tops, _ = peakdet(np.asarray(x, float)[start : len(x) - end], delta)
    steps = np.diff([v for _, v in tops])
    return abs(1 / steps.mean()) if len(steps) and steps.mean() else float("nan")


def speed_of_gait(x, level=6, moments=3) -> float:
    r2 = math.sqrt(2)
    coeffs = wavedec(x, daubechies(moments), level)
    weights = [1 / (5 * r2), 1 / (4 * r2), 1 / (3 * r2), 1 / (2 * r2), 1 / r2, 1 / r2]
    e = [(c * c).sum() / len(x) for c in coeffs[:0:-1]]
    return 0.5 * math.sqrt(sum(v * w / (k + 1) for k, (v, w) in enumerate(zip(e, weights, strict=False))))


def step_regularity(x, delta=0.5) -> tuple[float, float, float]:
    """(step, stride, symmetry): second and third maximum of the unbiased autocorrelation, and their difference."""
    tops, _ = peakdet(acf_unbiased(x), delta)
    if len(tops) < 3:
        return (float("nan"),) * 3
    return tops[1][1], tops[2][1], tops[1][1] - tops[2][1]


def heel_strikes(x, fs=100.0, delta=0.5) -> tuple[list[float], list[int]]:
    """(times from the first strike, positions): largest filtered value between falls through zero, refined on the signal."""
    d = np.asarray(x, float) - np.mean(x)
    f = low_pass(d, fs, 5.0)
    falls = pos_to_neg(f)
    least = abs(delta * f.max())
    period, out = interpeak(d, fs), []
    for a, b in zip(falls[:-1], falls[1:], strict=True):
        p = a + int(f[a:b].argmax())
        if f[p] > least:
            lo, hi = max(p - period // 2, 0), min(p + period // 2 + 1, len(d))
            out.append(lo + int(d[lo:hi].argmax()))
    return [(p - out[0]) / fs for p in out], out


def walk_direction(xyz: np.ndarray, fs=100.0, fraction=1 / 8) -> np.ndarray:
    """Unit vector against the mean deceleration before heel strikes on the summed signal."""
    total = np.abs(xyz.sum(1))
    _, strikes = heel_strikes(total, fs)
    n = max(int(np.rint(interpeak(total - total.mean(), fs) * fraction)), 1)
    parts = [xyz[max(p - n, 0) : p].mean(0) for p in strikes if p > 0]
    v = -np.mean(parts, axis=0) if parts else np.full(3, np.nan)
    return v / np.linalg.norm(v)


def regularity_symmetry(x, fs=100.0, step=None, stride=None) -> tuple[float, float, float]:
    d = np.asarray(x, float)
    if step is None or stride is None:
        times, _ = heel_strikes(d, fs)
        d = d - d.mean()
        step = np.mean(np.diff(times)) if len(times) > 1 else float("nan")
        stride = np.mean(np.diff(times[::2])) if len(times) > 2 else float("nan")
    if not (step > 0 and stride > 0):
        return (float("nan"),) * 3
    c = raw_acf(d, 1, 2)
    a, b = (c[min(int(np.rint(1 / v)), len(c) - 1)] for v in (step, stride))
    return float(a), float(b), float(abs(b - a))


def gait(x, fs=100.0, distance=None) -> dict[str, float]:
    """Summary of a walk; ``avg_step_length`` is steps over distance as recorded values have it, the true ratio is beside it."""
    times, strikes = heel_strikes(x, fs)
    d = np.asarray(x, float) - np.mean(x)
    duration, n = len(d) / fs, len(strikes)
    steps, strides = np.diff(times), np.diff(times[::2])
    a, b, s = regularity_symmetry(d, fs, steps.mean() if len(steps) else float("nan"), strides.mean() if len(strides) else float("nan"))
    known = distance or float("nan")
    return {
        "number_of_steps": float(n), "cadence": n / duration, "velocity": known / duration, "avg_step_length": n / known, "step_length": known / n if n else float("nan"),
        "avg_step_time": float(steps.mean()) if len(steps) else float("nan"), "sd_step_time": float(steps.std()) if len(steps) else float("nan"),
        "avg_stride_time": float(strides.mean()) if len(strides) else float("nan"), "sd_stride_time": float(strides.std()) if len(strides) else float("nan"),
        "step_regularity": a, "stride_regularity": b, "symmetry": s,
    }


# feature sets


def tremor_features(t, x, fs=100.0, window=256) -> dict[str, float]:
    """34 features of a magnitude series: 8 of its resampled, filtered spectra, 26 of the series as it is. Undefined ones are NaN."""
    x = np.asarray(x, float)
    n, nan = len(x), float("nan")
    if not n:
        return {}
    _, even = resample_mean(t, x, 1 / fs)
    high, slow = high_pass(even, fs), high_pass(even - even.mean(), fs)
    out = {}
    for pre, y, low, top in (("", high, 2.0, 10.0), ("bradykinesia_", slow, 0.0, 4.0)):
        out[f"{pre}amplitude_by_fft"], out[f"{pre}frequency_by_fft"] = amplitude_fft(y, fs, low, top, window)
        out[f"{pre}amplitude_by_welch"], out[f"{pre}frequency_by_welch"] = amplitude_welch(y, fs, low, top, window)
    d, var = x - x.mean(), x.var()
    _, counts = np.unique(x, return_counts=True)
    low, high_q = np.quantile(x, [0.0, 0.2])
    inside = (x >= low) & (x <= high_q)
    both = inside[1:] & inside[:-1]
    around = [np.concatenate([np.full(k, np.inf), x[:-k]]) if k > 0 else np.concatenate([x[-k:], np.full(-k, np.inf)]) for k in (*range(1, 6), *range(-5, 0)) if n > abs(k)]
    power, line = welch(x)[1], np.fft.rfft(x)
    trend = {(size, f): linear_trend(x, size, f) for size, f in ((5, "min"), (10, "var"), (10, "min"))}
    at = lambda values, k: float(values[k]) if k < len(values) else nan
    rest = {
        "approximate_entropy": approximate_entropy(x),
        **{f"autocorrelation_lag_{k}": float(d[: n - k] @ d[k:] / ((n - k) * var)) if n > k and var > 0 else nan for k in (8, 9)},
        **{f"partial_autocorrelation_lag_{k}": pacf(x, k) if var > 0 else nan for k in (3, 5, 6)},
        "minimum": float(x.min()), "mean": float(x.mean()), "ratio_value_number_to_time_series_length": len(counts) / n,
        "change_quantiles": float(np.abs(np.diff(x)[both]).mean()) if both.any() else 0.0,
        "number_peaks": float(np.all([x > a for a in around], axis=0).sum()) if n > 10 else 0.0,
        "agg_linear_trend_min_chunk_len_5_attr_intercept": trend[5, "min"][0], "agg_linear_trend_var_chunk_len_10_attr_rvalue": trend[10, "var"][1], "agg_linear_trend_min_chunk_len_10_attr_intercept": trend[10, "min"][0],
        **{f"spkt_welch_density_coeff_{k}": at(power, k) for k in (2, 5, 8)},
        "percentage_of_reoccurring_datapoints_to_all_datapoints": float(counts[counts > 1].sum()) / n, "abs_energy": float(x @ x), "fft_aggregated_centroid": fft_centroid(x),
        **{f"fft_coefficient_abs_coeff_{k}": at(np.abs(line), k) for k in (44, 63, 0)}, **{f"fft_coefficient_real_coeff_{k}": at(line.real, k) for k in (0, 23)},
        "sum_values": float(x.sum()),
    }
    return out | {f"magnitude_{k}": v for k, v in rest.items()}


def linear_trend(x, size, of) -> tuple[float, float]:
    """(intercept, correlation) of chunk minima or sample variances against the chunk's number."""
    chunks = [x[i : i + size] for i in range(0, len(x), size)]
    y = np.array([c.min() if of == "min" else c.var(ddof=1) for c in chunks if of == "min" or len(c) > 1])
    k = np.arange(len(y), dtype=float)
    if len(y) < 2:
        return float("nan"), float("nan")
    spread = ((k - k.mean()) ** 2).sum()
    slope = ((k - k.mean()) * (y - y.mean())).sum() / spread
    other = ((y - y.mean()) ** 2).sum()
    return float(y.mean() - slope * k.mean()), float(slope * math.sqrt(spread / other)) if other > 0 else float("nan")


def gait_summary(x, fs=100.0, distance=None) -> dict:
    """The sixteen fields of a walk. ``avg_step_length`` and ``avg_stride_length`` are numbers over distance, as recorded values have it.

    Strides are told apart by side (every other strike); their statistics are the mean of the two sides'.
    """
    times, _ = heel_strikes(x, fs)
    nan, sides = float("nan"), [times[0::2], times[1::2]]
    steps, strides = np.diff(times).tolist(), [np.diff(s).tolist() for s in sides]
    mean, sd = lambda v: float(np.mean(v)) if len(v) else nan, lambda v: float(np.std(v)) if len(v) else nan
    duration, per_side = len(x) / fs, float(np.mean([len(s) for s in sides]))
    step, stride = mean(steps), float(np.mean([mean(s) for s in strides]))
    a, b, symmetry = regularity_symmetry(x, fs, step, stride)
    return {
        "number_of_steps": len(times), "cadence": len(times) / duration if duration else None, "velocity": distance / duration if distance else None,
        "avg_step_length": len(times) / distance if distance else None, "avg_stride_length": per_side / distance if distance else None,
        "step_durations": steps, "avg_step_duration": step, "sd_step_durations": sd(steps), "strides": sides, "stride_durations": strides,
        "avg_number_of_strides": per_side, "avg_stride_duration": stride, "sd_stride_durations": float(np.mean([sd(s) for s in strides])),
        "step_regularity": a, "stride_regularity": b, "symmetry": symmetry,
    }


def two_means(x) -> np.ndarray:
    """Labels 0 (lower) and 1 of the best cut of sorted values into two groups, by squared error."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return np.zeros(len(x), int)
    order = np.argsort(x, kind="stable")
    out = np.zeros(len(x), int)
    out[order] = segments(x[order], 2)
    return out


def walks_and_turns(x, smooth=3) -> tuple[list[list[int]], list[list[int]]]:
    """(walks, turns): peak positions in runs of one cluster of prominence; walks are the cluster with the largest sample."""
    x = np.asarray(x, float)
    p = find_peaks(x)
    if not len(p):
        return [], []
    label = smoothing(two_means(prominences(x, p)), smooth).astype(int)
    edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
    groups: tuple[list, list] = ([], [])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        groups[label[a]].append(p[a:b].tolist())
    top = [max((x[i] for run in g for i in run), default=-math.inf) for g in groups]
    return (groups[0], groups[1]) if top[0] > top[1] else (groups[1], groups[0])
