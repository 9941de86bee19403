"""Word shingles of whole texts as 64-bit hashes, computed in whole-array steps."""

from __future__ import annotations

import numpy as np

from motionloom.llm.common import LOWER, UPPER

_R = np.random.default_rng(20240607)
_CODE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _u, _l in zip(UPPER.encode(), LOWER.encode(), strict=True):
    _CODE[_u] = _CODE[_l]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_WORD = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (shift-multiply rounds)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15F39CC060) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_power[0]) < n:
        m = max(n, 2 * len(_power[0]), 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _power[k] = np.multiply.accumulate(steps)
    return _power[0][:n], _power[1][:n]


def prefix_hash(b: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """Polynomial hashes of all prefixes of a byte array; (p[j] - p[i]) times the inverse power i is that of bytes i to j."""
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(code[b] * powers(len(b))[0], out=p[1:])
    return p


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order; A-Z are lower-cased, only ASCII white space separates."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    p = prefix_hash(b)
    return mix((p[ends] - p[starts]) * powers(len(b) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | None, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words are one run; no words, no shingle."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h += mix(w[j : len(w) - n + 1 + j] * _WORD[j % 64], j)
    return np.unique(mix(h))
