"""Toxic passages as maximum-scoring segments of token log-odds.

A word's score is the log-odds, under a Dirichlet prior, of its most telling unit, a prefix or the whole word, between
toxic and clean labelled documents; a unit's occurrences in a document weigh one and their logarithm, as text
repeated without end is little new evidence. Words without a significant unit share one small negative score. A linear scan finds
every maximal-scoring segment of a text. The scale of segment scores in clean text follows an extreme-value law
(score times lambda, minus the logarithm of K times the length); the evidence of a document is the sum over its
segments of what exceeds that, and an isotonic curve over evidence gives the probability of the label. The constants of
the law and the curve are fitted on segments that no row had a part in: rows fall into CROSS parts by their text,
and each part is scored by the units of the others.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.calibrate import isotonic
from motionloom.llm.common import freed, id_crc_mod, materialise

PREFIXES = (4, 5, 6, 7, 8)
#: Prior weight as a share of all counted words, least log-odds and least z of a telling unit, least decline a word.
PRIOR_SHARE, LEAST_ODDS, LEAST_Z, DECLINE = 0.02, 2.0, 3.0, 0.1
#: Parts of the training rows; each is calibrated by scores that were fitted without it.
CROSS = 4
CACHE_WORDS = 400_000
#: The model is fitted on so many labelled rows at most (about; those with the least hash of their id), so that their
#: labels can be sent to every task and no text is shuffled.
MAX_LABELLED = 100_000
EVIDENCE_BINS = 256 + 32 * 40
EDGE = ".,;:!?\"'()[]|%#*&$-"


def units(word: str) -> list[str]:
    """What a word is counted by: prefixes, and the whole word with a mark that no prefix has."""
    w = word.strip(EDGE)
    return [*(w[:n] for n in PREFIXES if len(w) >= n), w + "\n"] if w else []


def words(text: str) -> list[str]:
    return text.lower().split()


def maximal_segments(scored: list[tuple[int, float]], decline: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score): ``scored`` are the words with a positive score in
    order of position, all others score ``-decline``. One pass; each segment joins or is joined at most once."""
    out: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, at = 0.0, 0
    for i, s in scored:
        total -= decline * (i - at)
        at = i + 1
        first, low, total = i, total, total + s
        high = total
        k = len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= low:
                k -= 1
            if k < 0 or out[k][3] >= high:
                out.append((first, i, low, high))
                break
            first, low = out[k][0], out[k][2]
            del out[k:]
            k = len(out) - 1
    return [(a, b, high - low) for a, b, low, high in out]


class ToxicModel:
    """Scores of the significant units of a bounded sample, the extreme-value constants and the calibration curve."""

    def __init__(self, scores: dict[str, float], decline: float = DECLINE):
        self.scores, self.decline = scores, decline
        self.lam, self.k = 1.0, 0.1
        self.curve = np.full(EVIDENCE_BINS, 0.0)
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def _learn(self, new) -> None:
        if len(self._words) > CACHE_WORDS:
            self._words = {}
        get = self.scores.get
        for w in new:
            self._words[w] = max((get(u, 0.0) for u in units(w)), default=0.0)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, maximal segments) of a whole text."""
        ws = words(text)
        known = self._words
        new = [w for w in set(ws) if w not in known]
        if new:
            if len(known) > CACHE_WORDS:
                new = set(ws)
            self._learn(new)
            known = self._words
        scored = [(i, s) for i, s in enumerate(map(known.__getitem__, ws)) if s > 0]
        return len(ws), maximal_segments(scored, self.decline)

    def significant(self, text: str) -> list[tuple[int, int, float]]:
        """Segments that clean text of this length would hardly show: (first word, last word, normalised score)."""
        n, found = self.segments(text)
        floor = math.log(self.k * max(n, 1))
        return [(a, b, self.lam * s - floor) for a, b, s in found if self.lam * s > floor]

    def evidence(self, text: str) -> float:
        return sum(s for _, _, s in self.significant(text))

    def score(self, evidence: float) -> float:
        return float(self.curve[bin_of(evidence)])


def bin_of(evidence: float) -> int:
    """Quarters up to 64, then ever wider: a bin for each doubling's thirty-second part, so that none is the last."""
    if evidence < 64:
        return int(evidence * 4)
    return min(256 + int(32 * math.log2(evidence / 64)), EVIDENCE_BINS - 1)


def _part(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % CROSS


def _count_units(labelled: DataFrame) -> DataFrame:
    """``unit, part, toxic, clean``: weights of each unit in toxic and in clean rows of each part; partitions add up first.

    A unit that a row holds n times weighs 1 + ln(n) in it. The unit "" weighs what all words of the row do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [(defaultdict(float), defaultdict(float)) for _ in range(CROSS)]  # of part, of label

        def flush():
            rows = [(u, p, t[u] if u in t else 0.0, c[u] if u in c else 0.0) for p, (c, t) in enumerate(weights) for u in c.keys() | t.keys()]
            for own in weights:
                own[0].clear()
                own[1].clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["unit", "part", "toxic", "clean"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, total, to = Counter(), 0.0, weights[_part(text or "")][y]
                for w, n in Counter(words(text or "")).items():
                    total += 1 + math.log(n)
                    for u in units(w):
                        own[u] += n
                to[""] += total
                for u, n in own.items():
                    to[u] += 1 + math.log(n)
                if sum(len(x) for pair in weights for x in pair) > CACHE_WORDS:
                    yield flush()
        yield flush()

    return labelled.mapInArrow(freed(run), "unit string, part int, toxic double, clean double").groupBy("unit", "part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> tuple[float, float]:
    """(log-odds, z) of a unit between toxic and clean text, both with a share of the prior in proportion to its use."""
    prior = PRIOR_SHARE * (all_toxic + all_clean)
    share = (toxic + clean) * (prior / (all_toxic + all_clean))
    t, c = toxic + share, clean + share
    odds = math.log(t / (all_toxic + prior)) - math.log(c / (all_clean + prior))
    return odds, odds / math.sqrt(1 / t + 1 / c)


def _scores(counts: DataFrame, without: int | None) -> dict[str, float]:
    """Log-odds of all significant units, of the rows outside part ``without``; their number is bounded by the sample of rows."""
    own = counts if without is None else counts.where(F.col("part") != without)
    own = own.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = own.where("unit = ''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return {}
    t_all, c_all = total["toxic"], total["clean"]
    prior = PRIOR_SHARE * (t_all + c_all)
    share = (F.col("toxic") + F.col("clean")) * (prior / (t_all + c_all))
    t, c = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(t / (t_all + prior)) - F.log(c / (c_all + prior))
    z = odds / F.sqrt(1 / t + 1 / c)
    told = own.where("unit <> '' and toxic > 0").select("unit", odds.alias("odds")).where((odds >= LEAST_ODDS) & (z >= LEAST_Z)).toArrow()
    return dict(zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True))


def fit(labelled: DataFrame) -> ToxicModel:
    """Fit on all rows of ``text, y`` (y 1: toxic). Without toxic or clean rows every score is the overall rate."""
    counts = materialise(_count_units(labelled), "units")
    model = ToxicModel(_scores(counts, None))
    others = [ToxicModel(_scores(counts, p)) for p in range(CROSS)]
    model.lam, model.k = _extreme_value(labelled, others)
    for m in others:
        m.lam, m.k = model.lam, model.k

    def bins(batches):
        n = np.zeros((2, EVIDENCE_BINS))
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y, bin_of(others[_part(text or "")].evidence(text or ""))] += 1
        y, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(k), pa.array(n[y, k])], names=["y", "k", "n"])

    tally = np.zeros((2, EVIDENCE_BINS))
    for r in labelled.mapInArrow(freed(bins), "y long, k long, n double").groupBy("y", "k").agg(F.sum("n").alias("n")).collect():
        tally[r["y"], r["k"]] = r["n"]
    if tally.sum():
        model.curve = isotonic(tally[1], tally.sum(0))
    return model


def _extreme_value(labelled: DataFrame, others: list[ToxicModel]) -> tuple[float, float]:
    """lambda and K from clean rows, by the model without each row's part: lambda solves E[exp(lambda s)] = 1 over word scores
    (a histogram); K makes the expected number of segments above score x, K n exp(-lambda x), agree with their number at the least."""

    def run(batches):
        score_n: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if y:
                    continue
                n, found = others[_part(text or "")].segments(text or "")
                score_n[(0, 0)] += n
                for _, _, s in found:
                    score_n[(1, round(s * 10))] += 1
        keys = list(score_n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([score_n[k] for k in keys], pa.int64())], names=["kind", "s", "n"])

    got = labelled.mapInArrow(freed(run), "kind long, s long, n long").groupBy("kind", "s").agg(F.sum("n").alias("n")).collect()
    return extreme_value(sum(r["n"] for r in got if r["kind"] == 0), [(r["s"] / 10, r["n"]) for r in got if r["kind"] == 1], DECLINE)


def extreme_value(n_words: int, seen: list[tuple[float, int]], decline: float) -> tuple[float, float]:
    """(lambda, K) of ``seen``, (score, number) of positive segments among ``n_words`` words whose others score ``-decline``."""
    if not n_words or not seen:
        return 1.0, 0.1
    positive = sum(n for _, n in seen)
    mean = lambda lam: sum(n * math.exp(min(lam * s, 500)) for s, n in seen) / n_words + max(0.0, 1 - positive / n_words) * math.exp(-lam * decline) - 1
    low, high = 1e-3, 5.0
    if mean(low) >= 0:
        return 1.0, 0.1
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    least = min(s for s, _ in seen)
    return low, min(max(positive / n_words * math.exp(low * least), 1e-4), 1.0)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on the labelled rows whose crc32(id as text) mod ``folds`` is not ``fold`` (all of them if fold is None)."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if fold is not None:
        usable = usable.where(id_crc_mod(id_col, folds) != fold)
    n = usable.count()
    if n > MAX_LABELLED:
        usable = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * MAX_LABELLED / n))
    chosen = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    return fit(docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("text"), "y"))


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: ``id_col, held_out boolean, score double, predicted int, passages``.

    ``passages`` are the significant segments (first and last word, normalised score). Null text counts as empty and
    has no passage; a null id is never labelled; repeated rows are scored as often as they stand; without labels
    every score is 0; texts of any length are read whole; an empty table gives no rows.
    """
    model = train(docs, labels, label_col, folds, fold, id_col, text_col)
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.significant(t or "") for t in b.column(2).to_pylist()]
            score = np.array([model.score(sum(s for _, _, s in x)) for x in found], dtype=float)
            rows = [[{"first": f, "last": l, "score": s} for f, l, s in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(rows, kind)], names=schema.names)

    return docs.select(F.col(id_col), (id_crc_mod(id_col, folds) == fold).alias("held_out") if fold is not None else F.lit(False).alias("held_out"), F.col(text_col)).mapInArrow(freed(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, with all their columns; no shuffle of texts.

    Learns and scores as :func:`score_documents` does; null and empty texts stay.
    """
    model = train(docs, labels, label_col, folds, fold, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(model.evidence(t or "")) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)
