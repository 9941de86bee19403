"""Kernels over one voice recording, from textbook definitions. Recorded values for these exist nowhere, so tests hold
them against closed forms and slow direct versions only."""

from __future__ import annotations

import math

import numpy as np

from motionloom.functions.signal import daubechies, hann, levinson, lfilter, wavedec

TINY = 1e-6


def normalise(x) -> np.ndarray:
    x = np.asarray(x, float)
    x = x - x.mean()
    return x / (np.abs(x).max() + TINY)


def tkeo(x) -> np.ndarray:
    """Teager-Kaiser energy: x_i^2 - x_{i-1} x_{i+1}, the ends squared."""
    x = np.asarray(x, float)
    y = x * x
    y[1:-1] -= x[:-2] * x[2:]
    return y


def frames(x, size, hop) -> np.ndarray:
    """Full frames; a signal shorter than one is padded with zeros to one."""
    x = np.asarray(x, float)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hz_to_mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def mel_to_hz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def mel_filters(n_fft, fs, n) -> np.ndarray:
    """Triangles on the mel scale, rows with sum 2."""
    edge = mel_to_hz(np.linspace(0, hz_to_mel(fs / 2), n + 2)) * n_fft / fs
    k = np.arange(n_fft // 2 + 1)
    up = (k - edge[:-2, None]) / np.maximum(np.diff(edge)[:-1, None], TINY)
    down = (edge[2:, None] - k) / np.maximum(np.diff(edge)[1:, None], TINY)
    w = np.maximum(0, np.minimum(up, down))
    return 2 * w / np.maximum(w.sum(1, keepdims=True), TINY)


def dct_ortho(x, n) -> np.ndarray:
    size = x.shape[-1]
    basis = np.cos(np.pi / size * (np.arange(size) + 0.5)[None, :] * np.arange(n)[:, None]) * math.sqrt(2 / size)
    basis[0] /= math.sqrt(2)
    return x @ basis.T


def deltas(c, width=9) -> np.ndarray:
    """Regression slope over ``width`` rows, edges repeated."""
    h = width // 2
    p = np.pad(c, ((h, h), (0, 0)), "edge")
    return sum(k * p[h + k : h + k + len(c)] for k in range(-h, h + 1)) / sum(k * k for k in range(-h, h + 1))


def mel_cepstra(x, fs, n=12) -> np.ndarray:
    """Rows of c0..cn and log energy, then their deltas and second deltas."""
    size = 1 << math.floor(math.log2(0.03 * fs))
    f = frames(x, size, size // 2) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1)))
    p = np.abs(np.fft.rfft(f)) ** 2
    m = np.log(np.maximum(p @ mel_filters(size, fs, int(3 * math.log(fs))).T, 1e-12))
    c = np.hstack([dct_ortho(m, n + 1), np.log(np.maximum(p.sum(1, keepdims=True), 1e-12))])
    d = deltas(c)
    return np.hstack([c, d, deltas(d)])


def pitch(x, fs, low=50, high=500) -> np.ndarray:
    """Pitch of 40 ms frames every 10 ms: autocorrelation over the window's own, first peak in range, refined by a parabola."""
    size, hop = int(0.04 * fs), int(0.01 * fs)
    w = np.exp(-0.5 * (2.5 * (np.arange(size) - (size - 1) / 2) / ((size - 1) / 2)) ** 2)
    lags = slice(math.ceil(fs / high), min(int(fs / low), size // 2))
    wr = np.fft.irfft(np.abs(np.fft.rfft(w, 2 * size)) ** 2)[:size]
    out = []
    for f in frames(x, size, hop):
        r = np.fft.irfft(np.abs(np.fft.rfft((f - f.mean()) * w, 2 * size)) ** 2)[:size] / wr
        if r[0] <= 1e-12:
            out.append(np.nan)
            continue
        own = r[lags]
        tops = np.flatnonzero((own[1:-1] > own[:-2]) & (own[1:-1] >= own[2:]) & (own[1:-1] >= 0.9 * own.max())) + 1
        k = lags.start + int(tops[0] if len(tops) else own.argmax())  # the shortest of the high peaks: no multiple periods
        a, b, c = r[k - 1], r[k], r[min(k + 1, size - 1)]
        d = a - 2 * b + c
        out.append(fs / (k + (0.5 * (a - c) / d if d else 0.0)))
    return np.array(out)


def harmonics_to_noise(x, fs, low=50, high=500) -> dict[str, float]:
    size, hop = int(0.08 * fs), int(0.01 * fs)
    w = hann(size)
    hnr, nhr = [], []
    for f in frames(x, size, hop):
        r = np.fft.irfft(np.abs(np.fft.rfft((f - f.mean()) * w, 2 * size)) ** 2)[:size]
        if r[0] <= 0:
            continue
        v = r[math.ceil(fs / high) : int(fs / low)].max() / r[0]
        if 0 < v < 1:
            hnr.append(10 * math.log10(v / (1 - v + TINY)))
            nhr.append((1 - v) / (v + TINY))
    mean = lambda v: float(np.mean(v)) if v else float("nan")
    sd = lambda v: float(np.std(v)) if v else float("nan")
    return {"HNR_mean": mean(hnr), "HNR_std": sd(hnr), "NHR_mean": mean(nhr), "NHR_std": sd(nhr)}


def perturbation(x, k, order=5) -> tuple[float, float, float]:
    """Three perturbation quotients over windows of ``k``: mean absolute deviation from the centre, deviation of the mean from the centre, and autoregressive residual."""
    x = np.asarray(x, float)
    n, h, mean = len(x), k // 2, np.mean(x)
    if n < k + order or not mean:
        return (float("nan"),) * 3
    w = np.lib.stride_tricks.sliding_window_view(x, k)
    c = x[h : n - h]
    first = np.abs(w - c[:, None]).mean(1).sum()
    second = np.abs(np.abs(w).mean(1) - c).sum()
    d = x - mean
    a, _, _ = levinson(np.array([d[: n - j] @ d[j:] / n for j in range(order + 1)]), order)
    third = np.abs(lfilter(a, [1.0], d))[h : n - h].sum()
    return tuple(float(v / (n - k + 1) / mean) for v in (first, second, third))


def jitter_shimmer(x, prefix="") -> dict[str, float]:
    """22 perturbation measures of a track. The TKEO percentile labels hold the values that recorded tables have under them
    (prc75 the median, prc95 the third quartile); the true ones follow under corrected names."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 3:
        return {}
    d, mean, e = np.diff(x), x.mean(), tkeo(x)
    p = np.percentile(e, [5, 25, 50, 75, 95])
    out = {"abs_dif": np.abs(d).mean(), "dif_percent": 100 * np.abs(d).mean() / mean}
    for k in (3, 5, 11):
        out |= {f"PQ{k}_{name}": v for name, v in zip(("classical_Schoentgen", "classical_Baken", "generalised_Schoentgen"), perturbation(x, k), strict=True)}
    r = np.abs(x[1:] / np.where(x[:-1] == 0, np.nan, x[:-1]))
    a, b = np.percentile(x, [5, 95])
    out |= {
        "abs0th_perturb": np.abs(x - mean).mean(), "DB": np.nanmean(20 * np.abs(np.log10(np.where(r > 0, r, np.nan)))), "CV": (d * d).mean() / mean**2,
        "TKEO_mean": np.abs(e).mean(), "TKEO_std": e.std(), "TKEO_prc5": p[0], "TKEO_prc25": p[1], "TKEO_prc75": p[2], "TKEO_prc95": p[3],
        "FM": (x.max() - x.min()) / (x.max() + x.min()), "range_5_95_perc": p[3] - p[0],
        "TKEO_true_prc75": p[3], "TKEO_true_prc95": p[4], "true_range_5_95": b - a,
    }
    return {prefix + k: float(v) for k, v in out.items()}


def detrended_fluctuation(x, scales=range(50, 191, 20)) -> float:
    """Slope of the mean segment root-mean-square against scale on logarithmic axes."""
    y, got = np.cumsum(np.asarray(x, float)), []
    for s in scales:
        n = len(y) // s
        if n < 1:
            continue
        seg, t = y[: n * s].reshape(n, s), np.arange(s) - (s - 1) / 2
        rest = seg - seg.mean(1, keepdims=True) - (seg @ t / (t @ t))[:, None] * t
        got.append((math.log10(s), math.log10(max(np.sqrt((rest**2).mean(1)).mean(), 1e-300))))
    return float(np.polyfit(*zip(*got, strict=True), 1)[0]) if len(got) > 1 else float("nan")


def entropy(counts, base) -> float:
    p = np.asarray(counts, float)
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum() / math.log(base)) if base > 1 else 0.0


def pitch_period_entropy(f0, reference=120.0, order=10, skip=25, bins=99) -> float:
    f0 = np.asarray(f0, float)
    f0 = f0[np.isfinite(f0) & (f0 > 0)]
    if len(f0) <= skip + order:
        return float("nan")
    s = np.log(f0 / reference)
    s = s - s.mean()
    a, _, _ = levinson(np.array([s[: len(s) - k] @ s[k:] / len(s) for k in range(order + 1)]), order)
    n, _ = np.histogram(lfilter(a, [1.0], s)[skip:], bins)
    return entropy(n, max(int((n > 0).sum()), 2))


def recurrence_period_entropy(x, d=4, tau=50, eps=0.2, tmax=1000, standardise=True) -> float:
    """Entropy of first return times into a ball, of a delay embedding; pairs are compared lag by lag, memory O(n)."""
    x = np.asarray(x, float)
    if standardise:
        x = (x - x.mean()) / (x.std() or 1)
    n = len(x) - (d - 1) * tau
    if n < 2:
        return float("nan")
    e = np.stack([x[k * tau : k * tau + n] for k in range(d)], 1).astype(np.float32)
    open_, first = np.ones(n, bool), np.zeros(n, int)
    for lag in range(1, min(tmax, n - 1) + 1):
        near = (np.square(e[lag:] - e[:-lag]).sum(1) <= eps * eps) & open_[: n - lag]
        first[: n - lag][near] = lag
        open_[: n - lag][near] = False
        if not open_.any():
            break
    h = np.bincount(first[first > 0], minlength=tmax + 1)[1:]
    return entropy(h, tmax) if h.sum() else float("nan")


def glottis_quotients(close, open_, fs) -> dict[str, float]:
    """Share of the 5-95 % range of open phases, and deviations of open and closed phases; phases outside [fs/500, fs/50] are ignored."""
    c, o = np.asarray(close, float), np.asarray(open_, float)
    n = min(len(c), len(o))
    opened, closed = np.abs(o[1:n] - c[: n - 1]), np.abs(o[: n - 1] - c[: n - 1])
    inside = lambda v: np.where((v >= fs / 500) & (v <= fs / 50), v, np.nan)
    opened, closed = inside(opened), inside(closed)
    spread = lambda v: np.subtract(*np.nanpercentile(v, [95, 5])) if np.isfinite(v).any() else np.nan
    a, b = spread(opened), spread(closed)
    sd = lambda v: float(np.nanstd(v, ddof=1)) if np.isfinite(v).sum() > 1 else float("nan")
    return {"GQ_prc5_95": float(a / (a + b)) if a + b else float("nan"), "GQ_std_cycle_open": sd(opened), "GQ_std_cycle_closed": sd(closed)}


def burg(x, order) -> np.ndarray:
    """Prediction polynomial by Burg's method."""
    f = b = np.asarray(x, float)
    a = np.array([1.0])
    for _ in range(order):
        f, b = f[1:], b[:-1]
        den = f @ f + b @ b
        k = -2 * (b @ f) / den if den else 0.0
        a = np.append(a, 0) + k * np.append(a, 0)[::-1]
        f, b = f + k * b, b + k * f
    return a


def band_filter(taps, low, high, fs) -> np.ndarray:
    """Hamming-windowed band-pass with unit gain at the middle of the band."""
    n = np.arange(taps) - (taps - 1) / 2
    h = (2 * high / fs * np.sinc(2 * high / fs * n) - 2 * low / fs * np.sinc(2 * low / fs * n)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    return h / max(abs((h * np.cos(np.pi * (low + high) / fs * n)).sum()), 1e-12)


def envelope(x) -> np.ndarray:
    n = len(x)
    f = np.fft.fft(x)
    w = np.zeros(n)
    w[0] = 1
    w[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        w[n // 2] = 1
    return np.abs(np.fft.ifft(f * w))


def noise_excitation(x, fs=10_000, order=13, width=1000, shift=500) -> dict[str, float]:
    """Glottal-to-noise excitation: largest correlations of band envelopes of the whitened 30 ms frames, and energy ratios."""
    size = int(0.03 * fs)
    bands = [band_filter(101, max(lo, 1), lo + width, fs) for lo in range(0, 3001, shift)]
    best, low_high = [], []
    for f in frames(x, size, size // 2):
        if not f.any():
            continue
        r = lfilter(burg(f, order), [1.0], f)
        env = [envelope(np.convolve(r, h, "same")) for h in bands]
        env = [(v - v.mean()) / (v.std() + 1e-12) for v in env]
        best.append(max(np.correlate(env[i], env[j], "full").max() / size for i in range(len(env)) for j in range(i)))
        e = [np.square(np.convolve(f, h, "same")).sum() for h in bands]
        low_high.append(sum(e[:2]) / max(sum(e[-2:]), 1e-18))
    if not best:
        return {"GNE_mean": float("nan"), "GNE_std": float("nan"), "GNE_SNR": float("nan")}
    return {"GNE_mean": float(np.mean(best)), "GNE_std": float(np.std(best)), "GNE_SNR": float(np.mean(low_high))}


def vocal_fold_excitation(x, fs, close) -> dict[str, float]:
    """Excitation ratios of glottal cycles of over 50 samples in 500 Hz bands."""
    ratio, energy = [], []
    bands = [band_filter(51, max(lo, 1), lo + 500, fs) for lo in range(0, min(4000, int(fs / 2) - 500), 500)]
    for a, b in zip(close[:-1], close[1:], strict=True):
        part = np.asarray(x[int(a) : int(b)], float)
        if len(part) <= 50:
            continue
        e = np.array([np.mean(np.convolve(part, h, "same") ** 2) for h in bands])
        t = np.array([np.mean(np.abs(tkeo(np.convolve(part, h, "same")))) for h in bands])
        energy.append(e[5:].sum() / max(e[:5].sum(), 1e-18))
        ratio.append(t[5:].sum() / max(t[:5].sum(), 1e-18))
    if not ratio:
        return {"VFER_mean": float("nan"), "VFER_std": float("nan"), "VFER_SEO": float("nan")}
    return {"VFER_mean": float(np.mean(ratio)), "VFER_std": float(np.std(ratio)), "VFER_SEO": float(np.mean(energy))}


def spline(x, y, at) -> np.ndarray:
    """Natural cubic spline through (x, y)."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    c, d, r = np.zeros(n), np.ones(n), np.zeros(n)
    low, up = h[:-1], h[1:]
    d[1:-1], r[1:-1] = 2 * (low + up), 6 * np.diff(s)
    lower, upper = np.append(low, 0.0), np.append(0.0, up)
    for i in range(1, n):  # tridiagonal elimination
        m = lower[i - 1] / d[i - 1]
        d[i] -= m * upper[i - 1]
        r[i] -= m * r[i - 1]
    c[-1] = r[-1] / d[-1]
    for i in range(n - 2, -1, -1):
        c[i] = (r[i] - upper[i] * c[i + 1]) / d[i]
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * c[k] + (b**3 - b) * c[k + 1]) * h[k] ** 2 / 6


def intrinsic_modes(x, most=14, stable=4, sifts=50) -> np.ndarray:
    """Empirical mode decomposition; a mode is done when its numbers of extrema stay the same ``stable`` times. Rows add up to x."""
    x, out = np.asarray(x, float), []
    rest, t = x.copy(), np.arange(len(x))
    for _ in range(min(max(int(math.log2(len(x))), 1), most) - 1):
        mode, same, before = rest.copy(), 0, None
        for _ in range(sifts):
            up = np.flatnonzero((mode[1:-1] > mode[:-2]) & (mode[1:-1] >= mode[2:])) + 1
            down = np.flatnonzero((mode[1:-1] < mode[:-2]) & (mode[1:-1] <= mode[2:])) + 1
            if len(up) + len(down) < 3:
                break
            ends = lambda k: np.concatenate([[0], k, [len(mode) - 1]])
            mode = mode - (spline(ends(up), mode[ends(up)], t) + spline(ends(down), mode[ends(down)], t)) / 2
            now = (len(up), len(down))
            same, before = (same + 1 if now == before else 0), now
            if same >= stable:
                break
        out.append(mode)
        rest = rest - mode
        if len(np.flatnonzero(np.diff(np.sign(np.diff(rest))))) < 2:
            break
    return np.array([*out, rest])


def mode_ratios(x) -> dict[str, float]:
    """Energy, Teager energy and entropy of later modes over the first ones, plain and on logarithms."""
    m = intrinsic_modes(x)
    log = np.log(np.where(m > 0, m, 1.0))
    e = lambda v: np.square(v).mean(1)
    t = lambda v: np.array([np.mean(np.abs(tkeo(r))) for r in v])
    h = lambda v: np.array([entropy(np.histogram(r, 50)[0], 50) for r in v])
    ratio = lambda v, a, b: float(v[a].sum() / v[b].sum()) if v[b].sum() else float("nan")
    late, first, two, third, second = slice(3, None), slice(0, 3), slice(0, 2), slice(3, None), slice(2, None)
    return {
        "IMF_SNR_SEO": ratio(e(m), late, first), "IMF_SNR_TKEO": ratio(t(m), late, first), "IMF_SNR_entropy": ratio(h(m), late, first),
        "IMF_NSR_SEO": ratio(e(log), two, third), "IMF_NSR_TKEO": ratio(t(log), two, second), "IMF_NSR_entropy": ratio(h(log), two, second),
    }


def wavelet_features(f0, moments=8, most=10) -> dict[str, float]:
    """Energies, entropies and Teager energies of wavelet levels, of the track and of its logarithm."""
    f0, out, low = np.asarray(f0, float), {}, daubechies(moments)
    f0 = f0[np.isfinite(f0)]
    if len(f0) < 2 * moments:
        return out
    level = max(min(most, int(math.log2(len(f0) / (2 * moments - 1)))), 1)
    for name, x in (("", f0), ("log_", np.log(np.abs(f0) + TINY))):
        c = wavedec(x, low, level)
        total = sum((v * v).sum() for v in c) or 1.0
        out[f"{name}Ea"] = float(100 * (c[0] ** 2).sum() / total)
        for k, d in enumerate(c[:0:-1], 1):
            p = d * d
            h = float(-(p * np.log(p + 1e-300)).sum())
            out |= {f"{name}Ed_{k}": float(100 * p.sum() / total), f"{name}det_entropy_shannon_{k}": h, f"{name}det_entropy_log_{k}": -h, f"{name}det_TKEO_mean_{k}": float(np.mean(tkeo(d))), f"{name}det_TKEO_std_{k}": float(np.std(tkeo(d)))}
    return out


def glottal_instants(x, fs) -> tuple[np.ndarray, np.ndarray]:
    """Closure and opening instants: linear-prediction residual, negative crossings of the energy-weighted group delay, then
    a dynamic programme that keeps the candidates with the best waveform, pitch and energy costs."""
    x = lfilter([1.0, -math.exp(-2 * math.pi * 50 / fs)], [1.0], np.asarray(x, float))
    size, hop, order = int(0.025 * fs), int(0.0125 * fs), int(fs / 1000) + 2
    w, res = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1)), np.zeros(len(x))
    for s in range(0, max(len(x) - size, 1), hop):
        f = x[s : s + size]
        f = f * w[: len(f)]
        a, _, _ = levinson(np.array([f[: len(f) - k] @ f[k:] if k < len(f) else 0.0 for k in range(order + 1)]) + np.append(1e-9, np.zeros(order)), order)
        end = len(x) if s + size + hop > len(x) else s + hop
        res[s:end] = lfilter(a, [1.0], x[max(s - order, 0) : end])[-(end - s) :]
    n = max(int(0.002 * fs) | 1, 3)
    e, t = res * res, np.arange(n) - n // 2
    den = np.convolve(e, np.ones(n), "same")
    delay = np.convolve(e, -t.astype(float), "same") / np.maximum(den, 1e-18)
    delay = np.convolve(delay, hann(max(n // 2, 3)) / max(hann(max(n // 2, 3)).sum(), TINY), "same")
    cand = np.flatnonzero((delay[:-1] >= 0) & (delay[1:] < 0) | (delay[:-1] <= 0) & (delay[1:] > 0) & (den[:-1] > den.mean()))
    if len(cand) < 2:
        return cand.astype(float), cand.astype(float)
    strength = den[cand] / den.max()
    shortest, longest = fs / 500, fs / 50
    cost, back = 1 - strength, np.full(len(cand), -1)
    best = cost.copy()
    for j in range(len(cand)):
        i = np.arange(np.searchsorted(cand, cand[j] - longest), np.searchsorted(cand, cand[j] - shortest, "right"))
        if len(i):
            c = best[i] + 0.5 * np.abs(np.log((cand[j] - cand[i]) * 120 / fs)) - 1.2
            k = int(c.argmin())
            if c[k] < 0:
                best[j], back[j] = cost[j] + c[k], i[k]
    k, path = int(best.argmin()), []
    while k >= 0:
        path.append(cand[k])
        k = back[k]
    close = np.array(path[::-1], float)
    return close, openings(close)


def openings(close, ratio=0.3) -> np.ndarray:
    """Opening instants: a share of the cycle after each closure, held to the median cycle of seven."""
    close = np.asarray(close, float)
    if len(close) < 2:
        return close
    gap = np.append(np.diff(close), close[-1] - close[-2])
    p = np.pad(gap, 3)
    med = np.median(np.lib.stride_tricks.sliding_window_view(p, 7), axis=1)
    return close + np.minimum(ratio * gap, ratio * med.max())


def voice_measures(x, fs) -> dict[str, float]:
    """All measures of one recording, by name; how many there are depends on the length of the pitch track."""
    x = normalise(x)
    f0 = pitch(x, fs)
    close, open_ = glottal_instants(x, fs)
    edges = close.astype(int)
    a0 = [np.abs(x[a:b]).max() for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    c = mel_cepstra(x, fs)
    names = [f"mfcc_{k}" for k in range(c.shape[1])]
    return {
        **jitter_shimmer(f0, "Jitter->F0_"), **jitter_shimmer(a0, "Shimmer->A0_"), **harmonics_to_noise(x, fs), **glottis_quotients(close, open_, fs),
        **noise_excitation(x, fs), **vocal_fold_excitation(x, fs, close), **mode_ratios(x),
        **{f"mean_{n}": float(v) for n, v in zip(names, c.mean(0), strict=True)}, **{f"std_{n}": float(v) for n, v in zip(names, c.std(0), strict=True)},
        **wavelet_features(f0), "PPE": pitch_period_entropy(f0), "DFA": 1 / (1 + math.exp(-detrended_fluctuation(x))), "RPDE": recurrence_period_entropy(x),
        "voiced_ratio": float(np.isfinite(f0).mean()),
    }


def pitch_summary(x, fs, prefix="") -> dict[str, float]:
    """Pitch statistics; ``quan25`` and ``quan75`` hold the maximum as recorded values do, true quartiles are beside them."""
    f = pitch(normalise(x), fs)
    f = f[np.isfinite(f)]
    if not len(f):
        return {}
    close, _ = glottal_instants(normalise(x), fs)
    q = np.percentile(f, [25, 50, 75])
    got = {"f0_mean": f.mean(), "SD": f.std(), "MD": q[1], "min": f.min(), "max": f.max(), "quan25": f.max(), "quan75": f.max(), "true_quan25": q[0], "true_quan75": q[2], "n_pulses": len(close), "n_periods": max(len(close) - 1, 0), "median": q[1]}
    return {prefix + k: float(v) for k, v in got.items()}
