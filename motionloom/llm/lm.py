"""Language-model scores: a log-bilinear neural model over word classes, trained with noise-contrastive estimation in numpy.

Words are 64-bit hashes. The most frequent words are classes of their own, all others share a class by their first two
bytes and their last. Every word's probability is that of its class after the POSITIONS classes before it, times its
share of the class; a class keeps half a count for words it has never seen, so probabilities sum to one. The model
adds the vectors of the classes before, each through the square matrix of its position, and scores a class by the
product of that context with its target vector, plus a bias.

Training sees every token of the training rows. It starts from a fit to a bounded number of rows on the driver; from
there each task goes once through its own tokens, in batches with NOISE_DRAWS classes drawn from the unigram as noise,
and the tasks' parameters are averaged by their tokens, in a tree. Scoring multiplies batches of contexts with all target
vectors, which gives exactly normalised log-probabilities.

Counts of words cover all training rows and stay distributed. What workers get is bounded: the frequent words
(FREQUENT at most) and the parameters. Other words are looked up by a join.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import LOWER, UPPER, freed, id_crc_mod, materialise, tree_sum
from motionloom.llm.shingles import _SPACE, mix, powers, prefix_hash

WORDS, GROUPS = 256, 128
CLASSES = WORDS + GROUPS + 1
END_CLASS = CLASSES - 1
FREQUENT = 1 << 17
#: Classes before a word that are its context; length of a vector; noise words a token, and drawn for a batch of BATCH tokens.
POSITIONS, DIM, NOISE, NOISE_DRAWS, BATCH = 6, 16, 16, 32, 2048
#: Tokens whose scores against all classes are held at once; small enough for a processor's cache. Tokens scored in one call.
SCORED, JOINED = 512, 1 << 15
#: Scores below this need no shift before their exponentials in single precision, nor do sums of these overflow.
PLAIN = 75.0
#: Rows and passes of the first fit on the driver; rates of the first fit and of the tasks, each falling to a tenth.
WARM_ROWS, WARM_PASSES, WARM_RATE, RATE = 4000, 4, 0.03, 0.005
CHUNK = 4_000_000
END_HASH = np.uint64(0x5EED0E0D)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[list(UPPER.encode())] = list(LOWER.encode())


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, group) of each word and, last, of the end."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.array([END_HASH]), np.array([END_CLASS])
    space = np.ones(len(b) + 2, bool)
    np.take(_SPACE, b, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    p = prefix_hash(b)
    h = mix((p[ends] - p[starts]) * powers(len(b) + 1)[1][starts] + (ends - starts).astype(np.uint64))
    one, two, last = (FOLD[b[k]].astype(np.int64) for k in (starts, np.minimum(starts + 1, ends - 1), ends - 1))
    group = WORDS + (one * 7 + two * 31 + last * 101) % GROUPS
    return np.append(h, END_HASH), np.append(group, END_CLASS)


def _word_counts(train: DataFrame) -> DataFrame:
    """``h, g, c``: hash, group and count of each token of ``text``; tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, gs, size = [], [], 0

        def flush():
            h = np.concatenate(hs)
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            g = np.concatenate(gs)[order[at]].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g), pa.array(np.diff(at, append=len(h)))], names=["h", "g", "c"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h, g = tokens(t or b"")
                hs.append(h)
                gs.append(g)
                size += len(h)
                if size > CHUNK:
                    yield flush()
                    hs, gs, size = [], [], 0
        if hs:
            yield flush()

    return train.mapInArrow(run, "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c"))


class Bilinear:
    """Parameters of the class model: vectors before (r) and after (t), a matrix for each position (m), biases (b)."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        n, g = len(unigram), np.random.default_rng(seed)
        self.unigram = unigram
        self.p = {"r": g.normal(0, 0.1, (n, DIM)), "m": np.stack([np.eye(DIM) / (j + 1) for j in range(POSITIONS)]), "t": g.normal(0, 0.1, (n, DIM)), "b": np.log(unigram)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def size(self) -> int:
        return sum(x.size for x in self.p.values())

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()]).astype(float)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def gradients(self, before: np.ndarray, c: np.ndarray, noise: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean noise-contrastive loss of tokens ``c`` after ``before`` (a column for each position), against drawn classes ``noise``."""
        p, n = self.p, len(self.unigram)
        h = self.mixed(p["r"] @ p["m"], before)
        level = (np.log(NOISE * self.unigram)).astype(np.float32)
        target = p["t"].take(c, axis=0)
        own = (h * target).sum(1) + p["b"][c] - level[c]
        drawn = h @ p["t"][noise].T + (p["b"] - level)[noise]
        g = -1 / (1 + np.exp(np.clip(own, -30, 30)))
        gn = (NOISE / len(noise)) / (1 + np.exp(np.clip(-drawn, -30, 30)))
        g, gn = g / len(c), gn / len(c)
        dh = g[:, None] * target + gn @ p["t"][noise]
        t = _scatter([c], g[:, None] * h, n)[0]
        np.add.at(t, noise, gn.T @ h)
        b = np.bincount(c, g, n) + np.bincount(noise, np.ones(len(c), np.float32) @ gn, n)
        each = _scatter(before.T, dh, n)
        return {"r": sum(each[j] @ p["m"][j].T for j in range(POSITIONS)), "m": p["r"].T @ each, "t": t, "b": b}

    @staticmethod
    def mixed(moved: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Sum over positions of the moved vectors of the classes there."""
        h = moved[0].take(before[:, 0], axis=0)
        for j in range(1, POSITIONS):
            h += moved[j].take(before[:, j], axis=0)
        return h

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate, seed: int) -> None:
        """One step of Adam for each batch; ``rate(k)`` is the rate of step k (from 1)."""
        g = np.random.default_rng(seed)
        edge = np.cumsum(self.unigram) / self.unigram.sum()
        one, two = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step, (before, c) in enumerate(batches, 1):
            noise = np.minimum(np.searchsorted(edge, g.random(NOISE_DRAWS)), len(edge) - 1)
            for k, x in self.gradients(before, c, noise).items():
                one[k] = 0.9 * one[k] + 0.1 * x
                two[k] = 0.99 * two[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate(step) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def log_probabilities(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of each class of a whole sequence after those before it, normalised over all classes."""
        return self.scorer()(contexts(c), c)

    def scorer(self):
        """A function of contexts and classes that gives the classes' log10 probabilities, for many calls."""
        n, moved = len(self.unigram), self.p["r"] @ self.p["m"]
        targets = np.concatenate([self.p["t"].T, self.p["b"][None]])  # the bias is one more dimension, where contexts have a one
        reach, tilt, ones = float(np.sqrt((self.p["t"] ** 2).sum(1).max())), float(np.abs(self.p["b"]).max()), np.ones(n, np.float32)
        h, scores = np.ones((SCORED, DIM + 1), np.float32), np.empty((SCORED, n), np.float32)

        def run(before: np.ndarray, c: np.ndarray) -> np.ndarray:
            out = np.empty(len(c))
            for i in range(0, len(c), SCORED):
                own = c[i : i + SCORED]
                m = len(own)
                h[:m, :DIM] = self.mixed(moved, before[i : i + SCORED])
                s = np.matmul(h[:m], targets, out=scores[:m])
                picked = s[np.arange(m), own].astype(float)
                if math.sqrt(float((h[:m, :DIM] ** 2).sum(1).max())) * reach + tilt > PLAIN:
                    top = s.max(1)
                    s -= top[:, None]
                    picked -= top
                np.exp(s, out=s)
                out[i : i + SCORED] = picked - np.log((s @ ones).astype(float))
            return out / math.log(10)

        return run


@lru_cache(maxsize=4)
def _space(n: int, d: int, rows: int) -> tuple[np.ndarray, ...]:
    """Numbers of the places of an array (n, d), and room for those of ``rows`` rows and their values, kept since fresh memory costs more than the sums."""
    return np.arange(n * d).reshape(n, d), np.empty((rows, d), np.int64), np.empty((rows, d))


def _scatter(ats, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of ``ats`` the sums of rows by number, as an array (len(ats), n, d)."""
    d = rows.shape[1]
    places, at, values = _space(n, d, len(rows))
    values[:] = rows
    out = np.empty((len(ats), n, d), np.float32)
    for k, x in enumerate(ats):
        np.take(places, x, axis=0, out=at, mode="clip")
        out[k] = np.bincount(at.ravel(), values.ravel(), n * d).reshape(n, d)
    return out


def contexts(c: np.ndarray) -> np.ndarray:
    """The classes before each token, nearest first; before the start stands the end's."""
    padded = np.concatenate([np.full(POSITIONS, END_CLASS), c])
    return np.stack([padded[POSITIONS - j : POSITIONS - j + len(c)] for j in range(1, POSITIONS + 1)]).T


def joined_contexts(c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The contexts of sequences of ``sizes`` tokens that stand one behind the other in ``c``."""
    padded = np.full(len(c) + POSITIONS * len(sizes), END_CLASS)
    at = np.arange(len(c)) + POSITIONS * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = c
    return np.stack([padded[at - j] for j in range(1, POSITIONS + 1)]).T


def batched(sequences: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, classes) of BATCH tokens at a time, and the rest."""
    xs, cs, held = [], [], 0
    for c in sequences:
        xs.append(contexts(c))
        cs.append(c)
        held += len(c)
        if held >= BATCH:
            x, y = np.concatenate(xs), np.concatenate(cs)
            whole = held - held % BATCH
            for i in range(0, whole, BATCH):
                yield x[i : i + BATCH], y[i : i + BATCH]
            xs, cs, held = [x[whole:]], [y[whole:]], held - whole
    if held:
        yield np.concatenate(xs), np.concatenate(cs)


class Model:
    """Frequent words (sorted hashes, counts, classes), the masses of classes and the class model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, mass: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        ranked = np.lexsort((hashes, -counts))
        ranked = ranked[hashes[ranked] != END_HASH][:WORDS]
        own = np.full(len(hashes), -1)
        own[ranked] = np.arange(len(ranked))
        self.own = np.append(own[order], -1)  # the last is for words that aren't found
        self.found = np.append(self.counts, -1)
        self.bits = max(1, min(20, (2 * len(hashes)).bit_length()))
        self.starts = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.n, self.v = n, v
        self.mass = mass  # of each class: what its words' counts, each plus a half, and the half of the unseen come to
        unigram = mass.copy()
        unigram[np.arange(len(ranked))] = counts[ranked] + 0.5
        unigram[END_CLASS] = counts[hashes == END_HASH].sum() + 0.5
        self.classes = Bilinear(unigram / unigram.sum())

    def look_up(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of tokens; count -1 where the word isn't among the frequent ones."""
        at = self.places(h)
        own = self.own.take(at)
        return np.where(own >= 0, own, group), self.found.take(at)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where in the sorted hashes each of ``h`` stands, or their number: from the first one with the same leading bits on."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        at = self.starts.take((h >> np.uint64(64 - self.bits)).view(np.int64)).astype(np.int64)
        there = self.hashes.take(at, mode="clip")
        out = np.where((there == h) & (at < n), at, n)
        left = np.flatnonzero((there < h) & (at < n))
        while len(left):
            at[left] += 1
            left = left[at[left] < n]
            there = self.hashes[at[left]]
            hit = left[there == h[left]]
            out[hit] = at[hit]
            left = left[there < h[left]]
        return out


def _falling(rate: float, steps: int):
    return lambda k: rate * max(0.1, 1 - 0.9 * k / max(steps, 1))


def _learn(train: DataFrame, model: Model) -> None:
    """Fit the class model: first on about WARM_ROWS rows, by a hash of the row, then on all rows, task by task, and the mean."""
    rows = int(model.counts[model.hashes == END_HASH].sum())  # every row has one end
    few = F.pmod(F.xxhash64(*train.columns), F.lit(1 << 30)) < int((1 << 30) * min(1.0, WARM_ROWS / max(rows, 1)))
    start = [model.look_up(*tokens((r[0] or "").encode()))[0] for r in train.where(few).select("text").collect()]
    if not start:
        return
    steps = WARM_PASSES * -(-sum(map(len, start)) // BATCH)
    g = np.random.default_rng(5)
    order = [k for _ in range(WARM_PASSES) for k in g.permutation(len(start))]
    model.classes.learn(batched(start[k] for k in order), _falling(WARM_RATE, steps), 1)
    size = model.classes.size()

    def own(batches):
        mine, total = copy.deepcopy(model.classes), 0

        def sequences():
            nonlocal total
            for b in batches:
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    c, _ = model.look_up(*tokens(t or b""))
                    total += len(c)
                    yield c

        mine.learn(batched(sequences()), _falling(RATE, 400), 2 + TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array([(np.append(mine.flat(), 1.0) * total).tobytes()], pa.binary())], names=["s"])

    read = train.select("text").mapInArrow(freed(own), "s binary")
    total = tree_sum(read, size + 1, lambda b: np.sum([np.frombuffer(x) for x in b.column(0).to_pylist()], axis=0))
    if total[-1]:
        model.classes.load(total[:-1] / total[-1])


def _frequent(counts: DataFrame) -> DataFrame:
    """The end, and all words from such a count on that there are at most FREQUENT of them; counts that differ by less than a tenth go together.

    A histogram finds that count, so no task sends its own most frequent words to the driver.
    """
    level = F.floor(F.log2("c") * 8)
    held, least = 0, math.inf
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["level"]
    end = F.col("h") == int(np.array([END_HASH]).view(np.int64)[0])
    return counts.where(end if least == math.inf else end | (level >= least))


def train_model(train: DataFrame, counts: DataFrame) -> Model:
    """Fit on the rows of ``text`` (and, to tell rows apart, ``id``); ``counts`` is their written table of word counts.

    The driver gets FREQUENT rows of three numbers, and the texts of about WARM_ROWS rows.
    """
    top = _frequent(counts).select("h", "g", "c").toArrow()
    h, group, c = (top.column(k).to_numpy() for k in range(3))
    h, c = h.view(np.uint64).copy(), c.astype(np.int64)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranked = [k for k in np.lexsort((h, -c)) if h[k] != END_HASH][:WORDS]
    mass = np.full(CLASSES, 0.5)
    for r in counts.groupBy("g").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["g"]] += r["m"]
    for k in ranked:
        mass[group[k]] -= c[k] + 0.5
    model = Model(h, c, int(n), int(v), mass)
    _learn(train, model)
    return model


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: ``id_col, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double``.

    Learns from the rows whose crc32(id as text) mod ``folds`` is not ``fold``. Tokens: words (A-Z lower-cased, ASCII
    white space separates), then one end. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the
    model's log10 probability of the text. Null text counts as empty: one token, the end. A null id counts as empty
    text for the fold; repeated rows are counted and scored as often as they stand; texts of any length are read whole; an
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = base.where(id_crc_mod("id", folds) != fold)
    counts = materialise(_word_counts(train.select("text")), "words")
    model = train_model(train, counts)
    share = np.log10(model.mass)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId() << 33, 0
        scorer = model.classes.scorer()

        def summed(texts):
            """n_tokens, n_known, logs, word and the number of words to look up of each of ``texts``, and these words and how often."""
            read = [tokens(t or b"") for t in texts]
            sizes = np.array([len(h) for h, _ in read])
            start = np.cumsum(sizes) - sizes  # every text has its end, so none is empty
            h = np.concatenate([h for h, _ in read])
            c, n = model.look_up(h, np.concatenate([g for _, g in read]))
            known, inside = n >= 0, (c >= WORDS) & (c != END_CLASS)
            own = np.where(known, np.log10(np.maximum(n, 0) + 0.5), 0.0)
            word = scorer(joined_contexts(c, sizes), c)
            word += np.where(inside, own - share[c], 0.0)
            who = np.repeat(np.arange(len(sizes)), sizes)[~known]
            rest, many, each = [], [], np.bincount(who, minlength=len(sizes))
            for x in np.split(h[~known], np.cumsum(each)[:-1]):
                x, m = np.unique(x, return_counts=True)
                rest.append(x)
                many.append(m)
            return (sizes, np.add.reduceat(known, start, dtype=np.int64), np.add.reduceat(own, start), np.add.reduceat(word, start), np.array([len(x) for x in rest]), np.concatenate(rest).view(np.int64), np.concatenate(many))

        def pieces(texts):
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t or b"")
                if size > 8 * JOINED:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        for b in batches:
            if b.num_rows:
                sizes, known, logs, word, each, rest, many = (np.concatenate(x) for x in zip(*map(summed, pieces(b.column(1).cast(pa.binary()).to_pylist())), strict=True))
                ends = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
                rows = part + k + np.arange(b.num_rows)
                k += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0), pa.array(sizes), pa.array(known), pa.array(logs), pa.array(word), pa.ListArray.from_arrays(ends, pa.array(rest)), pa.ListArray.from_arrays(ends, pa.array(many))], names=["row", "id", "n_tokens", "n_known", "logs", "word", "rest", "many"])

    scored = materialise(base.mapInArrow(freed(run), f"row long, id {id_type}, n_tokens long, n_known long, logs double, word double, rest array<long>, many array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "many")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.many").alias("m"))
    seen = rare.join(counts.select("h", "c"), "h", "left").select("row", "m", F.coalesce("c", F.lit(0)).alias("c"))
    more = seen.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"))
    total = math.log10(model.n + 0.5 * (model.v + 1))
    extra, known = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return scored.drop("rest", "many").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        (id_crc_mod("id", folds) == fold).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * total).alias("base_score"),
        (F.col("word") + extra).alias("score"),
    )
