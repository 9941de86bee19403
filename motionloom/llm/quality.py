"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The features are cosines at fixed random frequencies, whose inner products approximate a Gaussian kernel over
standardised statistics. Each partition sums its normal equations; the sums are added up in a tree of tasks. The
calibration curve is fitted on scores that no row had a part in: rows fall into CROSS parts by their id, and each
part is scored by weights of the others. Nothing but the text is an input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.calibrate import isotonic
from motionloom.llm.common import id_crc_mod, materialise, tree_sum

MARKS = "|!%#*&$.,"
N_STATS = 10 + len(MARKS)
N_FEATURES = 256
RIDGE = 1e-4
BINS = 1000
#: Parts of the training rows; each is calibrated by weights that were fitted without it.
CROSS = 4
UPPER_B, LOWER_B, DIGIT_B = slice(65, 91), slice(97, 123), slice(48, 58)


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text in UTF-8; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split(b"\n")
    nw = max(len(words), 1)
    some = h[h > 0]
    return [
        math.log1p(n) / 10,
        float(h[UPPER_B].sum()),
        float(h[LOWER_B].sum()),
        float(h[DIGIT_B].sum()),
        float(h[9:14].sum() + h[32]),
        float(h[128:].sum()),
        float(-(some * np.log(some)).sum()),
        n / nw / 10,
        len(set(words)) / nw,
        len(set(lines)) / len(lines),
        *(float(h[ord(c)]) for c in MARKS),
    ]


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, stats array<double>`` of every row, written once; all later passes read this small table."""
    schema = T.StructType([docs.schema[id_col], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], names=schema.names)

    return materialise(docs.select(id_col, text_col).mapInArrow(run, schema), "stats")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class QualityModel:
    """Standardisation, frequencies, ridge weights and calibration; a few hundred numbers, whatever the corpus."""

    def __init__(self, seed: int = 17):
        r = np.random.default_rng(seed)
        self.freq = r.normal(size=(N_STATS, N_FEATURES)) / math.sqrt(N_STATS) * 1.5
        self.phase = r.uniform(0, 2 * math.pi, N_FEATURES)
        self.mean, self.sd = np.zeros(N_STATS), np.ones(N_STATS)
        self.weights = np.zeros(N_FEATURES + 1)
        self.curve = np.full(BINS, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.freq + self.phase) * math.sqrt(2 / N_FEATURES), np.ones((len(z), 1))])

    def bins(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.clip(np.rint((self.features(stats) @ (self.weights if weights is None else weights) + 0.5) / 2 * (BINS - 1)), 0, BINS - 1).astype(int)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.curve[self.bins(stats)]


def fit(labelled: DataFrame, seed: int = 17) -> QualityModel:
    """Fit on all rows of ``stats, y (0 or 1), part (below CROSS)``: moments, normal equations and calibration counts, each a summed pass."""
    m = QualityModel(seed)
    columns = lambda b: (_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False))

    def moments(b):
        x, _, _ = columns(b)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = tree_sum(labelled, 1 + 2 * N_STATS, moments)
    n = max(s[0], 1.0)
    m.mean = s[1 : 1 + N_STATS] / n
    sd = np.sqrt(np.maximum(s[1 + N_STATS :] / n - m.mean**2, 0))
    m.sd = np.where(sd > 1e-9, sd, 1.0)
    k = N_FEATURES + 1

    def normal(b):
        x, y, part = columns(b)
        out = np.zeros((CROSS, k * k + k + 1))
        for p in range(CROSS):
            f = m.features(x[part == p])
            out[p] = np.concatenate([(f.T @ f).ravel(), f.T @ y[part == p], [len(f)]])
        return out.ravel()

    parts = tree_sum(labelled, CROSS * (k * k + k + 1), normal).reshape(CROSS, -1)

    def solved(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[: k * k].reshape(k, k) + RIDGE * max(s[-1], 1.0) * np.eye(k), s[k * k : -1])

    m.weights = solved(parts.sum(0))
    others = [solved(parts.sum(0) - own) for own in parts]

    def counts(b):
        x, y, part = columns(b)
        at = np.zeros(len(x), int)
        for p in range(CROSS):
            at[part == p] = m.bins(x[part == p], others[p])
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    s = tree_sum(labelled, 2 * BINS, counts)
    m.curve = isotonic(s[:BINS], s[BINS:])
    return m


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Score every row: ``id_col, held_out boolean, score double, predicted int``.

    Learns from labelled rows whose crc32(id as text) mod ``folds`` is not ``fold``; those of that remainder are
    ``held_out``. Of labels that an id has twice the larger counts. Texts of any length are read whole. Null text counts as empty and is scored like one; a null id is never labelled; repeated rows are
    scored as often as they stand; without any usable label every score is 0.5; an empty table gives no rows.
    """
    stats = statistics_table(docs, id_col, text_col)
    usable = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    train = stats.where(id_crc_mod(id_col, folds) != fold).join(usable, F.col(id_col) == F.col("__id")).select("stats", "y", F.pmod(F.xxhash64(id_col), F.lit(CROSS)).cast("int").alias("part"))
    model = fit(train, seed)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return stats.select(id_col, (id_crc_mod(id_col, folds) == fold).alias("held_out"), "stats").mapInArrow(run, schema)
