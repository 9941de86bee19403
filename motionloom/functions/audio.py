"""Decoding of 16-bit PCM sound."""

from __future__ import annotations

import io
import wave

import numpy as np


def decode(content: bytes, rate: int) -> tuple[int, list[float]]:
    """(sampling rate, mono samples between -1 and 1) of a WAV file or of raw little-endian 16-bit samples."""
    channels = 1
    if content[:4] == b"RIFF":
        with wave.open(io.BytesIO(content)) as w:
            rate, channels, content = w.getframerate(), w.getnchannels(), w.readframes(w.getnframes())
    x = np.frombuffer(content[: len(content) // 2 * 2], "<i2").astype(np.float32) / 32768
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1).tolist()
