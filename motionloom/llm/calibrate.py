"""Monotone calibration on a histogram: pool adjacent violators over bins, so the driver's work is bounded."""

from __future__ import annotations

import numpy as np


#: Share of the line through the pools' means in a curve; the rest are the pools' steps.
TILT = 0.05


def isotonic(positive: np.ndarray, total: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """Non-decreasing probability of each bin; every pool is smoothed towards the overall rate by ``prior`` rows.

    Bins without rows take the value between their neighbours'. The steps are tilted a little towards the line through
    the pools' mean bins, so that different bins keep different scores. Without any rows all bins are 0.5.
    """
    if not total.sum():
        return np.full(len(total), 0.5)
    rate, blocks = positive.sum() / total.sum(), []
    for k in np.flatnonzero(total):
        blocks.append([positive[k], total[k], k * total[k], [k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    value = np.maximum.accumulate([(p + prior * rate) / (n + prior) for p, n, _, _ in blocks])
    every = np.arange(len(total))
    steps = np.interp(every, np.concatenate([ks for *_, ks in blocks]), np.repeat(value, [len(ks) for *_, ks in blocks]))
    line = np.interp(every, [c / n for _, n, c, _ in blocks], value)
    return (1 - TILT) * steps + TILT * line
