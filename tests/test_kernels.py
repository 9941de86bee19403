import math

import numpy as np
import pytest

from motionloom.functions import signal as s
from motionloom.functions import voice as v

R = np.random.default_rng(3)


def test_butterworth_and_filter():
    b, a = s.butterworth(2, 0.04, "high")
    assert np.allclose(a, [1, -1.82269493, 0.83718165]) and np.allclose(b, [0.91496914, -1.82993829, 0.91496914])
    b, a = s.butterworth(4, 0.2)
    at = lambda w: abs(np.polyval(b, np.exp(1j * w)) / np.polyval(a, np.exp(1j * w)))
    assert at(0) == pytest.approx(1) and at(0.2 * math.pi) == pytest.approx(math.sqrt(0.5))
    x = R.normal(size=50)
    y = s.lfilter(b, a, x)
    want = []
    for n in range(50):
        want.append(sum(b[k] * x[n - k] for k in range(5) if n >= k) - sum(a[k] * want[n - k] for k in range(1, 5) if n >= k))
    assert np.allclose(y, want)


def test_spectra():
    t = np.arange(1000) / 100
    assert s.amplitude_fft(np.sin(2 * np.pi * 5 * t))[1] == pytest.approx(5, abs=0.4)
    assert s.amplitude_welch(np.sin(2 * np.pi * 5 * t))[1] == pytest.approx(5, abs=0.4)
    x = R.normal(size=4096)
    f, p = s.welch(x, 100.0)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=0.1)


def test_dependence():
    x = R.normal(size=80)
    d = x - x.mean()
    assert np.allclose(s.acf_unbiased(x)[:10], [(d[: 80 - k] @ d[k:]) / (80 - k) / x.var() for k in range(10)])
    y = s.lfilter([1.0], [1, -0.7], R.normal(size=4000))
    assert s.pacf(y, 1) == pytest.approx(0.7, abs=0.05) and abs(s.pacf(y, 3)) < 0.06

    def phi(z, m, r):
        w = [z[i : i + m] for i in range(len(z) - m + 1)]
        return np.mean([math.log(np.mean([max(abs(a - b) for a, b in zip(p, q, strict=True)) <= r for q in w])) for p in w])

    assert s.approximate_entropy(x) == pytest.approx(abs(phi(x, 2, 0.3 * x.std()) - phi(x, 3, 0.3 * x.std())))


def test_peaks_and_segments():
    assert s.peakdet([0, 2, 0, 3, 0, 1, 0.8], 1)[0] == [(1, 2.0), (3, 3.0)]
    assert s.find_peaks([0, 1, 1, 0, 2, 0, 3]).tolist() == [1, 4]
    assert s.prominences([0, 3, 1, 2, 0], [1, 3]).tolist() == [3, 1]
    assert s.pos_to_neg([1, -1, 2, 0, 3]).tolist() == [0, 2]
    assert s.smoothing([1, 5, 1, 4]).tolist() == [1, 1, 1, 4]
    x = np.concatenate([np.zeros(5), np.full(4, 9.0), np.full(6, 3.0)])
    assert s.segments(x, 3).tolist() == [0] * 5 + [1] * 4 + [2] * 6


def test_wavelets():
    want = [0.035226291882100656, -0.08544127388224149, -0.13501102001039084, 0.4598775021193313, 0.8068915093133388, 0.3326705529509569]
    assert np.allclose(s.daubechies(3), want, atol=1e-9)
    a, d = s.dwt(np.ones(20), s.daubechies(3))
    assert len(a) == 12 and np.allclose(a, math.sqrt(2)) and np.allclose(d, 0, atol=1e-9)


def test_walk():
    t = np.arange(3000) / 100
    x = np.sin(2 * np.pi * 1.5 * t) + 0.05 * R.normal(size=3000)
    times, strikes = s.heel_strikes(x)
    assert np.median(np.diff(times)) == pytest.approx(1 / 1.5, rel=0.1)
    assert s.gait(x, distance=40.0)["cadence"] == pytest.approx(1.5, rel=0.1)
    assert len(s.freeze_of_gait(x)[0]) == len(range(257, 3000, 50)) and s.speed_of_gait(x) > 0
    assert np.linalg.norm(s.walk_direction(np.stack([x, x, x], 1))) == pytest.approx(1)


def test_voice_parts():
    fs = 8000
    t = np.arange(fs) / fs
    tone = sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 8))
    assert np.nanmedian(v.pitch(tone, fs)) == pytest.approx(120, rel=0.03)
    assert v.harmonics_to_noise(tone, fs)["HNR_mean"] > v.harmonics_to_noise(tone + R.normal(size=fs), fs)["HNR_mean"]
    assert np.allclose(v.mel_to_hz(v.hz_to_mel([100, 4000])), [100, 4000])
    assert np.allclose(v.mel_filters(256, fs, 20).sum(1), 2)
    assert np.allclose(v.intrinsic_modes(tone[:500]).sum(0), tone[:500])
    assert v.detrended_fluctuation(R.normal(size=20000)) == pytest.approx(0.5, abs=0.1)
    assert np.allclose(v.tkeo([1, 2, 3, 4]), [1, 1, 1, 16])
    a = v.burg(s.lfilter([1.0], [1, -0.9], R.normal(size=5000)), 1)
    assert a[1] == pytest.approx(-0.9, abs=0.03)
    x = np.linspace(0, 3, 9)
    assert np.allclose(v.spline(x, 2 * x + 1, np.array([0.1, 2.9])), [1.2, 6.8])
    assert 0 < v.recurrence_period_entropy(tone[:4000]) < 1
    got = v.voice_measures(tone, fs)
    assert len(got) > 150 and got["voiced_ratio"] == 1


def test_perturbation_labels():
    x = 100 + R.normal(size=60)
    m = v.jitter_shimmer(x)
    p = np.percentile(v.tkeo(x), [50, 75, 95])
    assert (m["TKEO_prc75"], m["TKEO_prc95"], m["TKEO_true_prc95"]) == pytest.approx(tuple(p))


def test_voice_measures_take_the_whole_signal(monkeypatch):
    """Modes and return times read all samples, also past the first 16,384; short recordings have results of their own."""
    x, got = np.random.default_rng(5).normal(size=17_000), {}
    for name in ("mode_ratios", "recurrence_period_entropy"):
        monkeypatch.setattr(v, name, lambda y, name=name: got.setdefault(name, len(y)) and ({} if name == "mode_ratios" else 0.0))
    v.voice_measures(x, 8000)
    assert got == {"mode_ratios": 17_000, "recurrence_period_entropy": 17_000}
    monkeypatch.undo()
    for n in (1, 2, 3, 9, 100, 600):
        m = v.voice_measures(x[:n], 8000)
        assert np.isfinite([m[k] for k in m if k.startswith(("mean_", "std_"))]).all()
    assert np.isfinite([m[k] for k in ("RPDE", "DFA", "HNR_mean", "GNE_mean", "IMF_SNR_SEO")]).all()
