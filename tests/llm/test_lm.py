import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from motionloom.llm import lm
from motionloom.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]


def brute(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


@pytest.mark.parametrize("frequent", [1 << 17, 5])
def test_counts_and_base_scores(spark, rng, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(k, " ".join(rng.choice("the The cat dog é sat on mat a1 b2").strip() + str(rng.randrange(3)) * rng.randrange(2) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(got) == brute(rows)


def test_scores_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = lm.score_documents(odd_docs)
    assert rows_of(got) == brute(rows)
    assert all(r["score"] < 0 for r in got.collect())
    assert lm.score_documents(no_docs).count() == 0


def some_model(rng, n=7):
    u = np.array([rng.random() + 0.1 for _ in range(n)])
    b = lm.Bilinear(u / u.sum(), seed=3)
    g = np.random.default_rng(1)
    b.p = {k: (x + g.normal(0, 0.5, x.shape)).astype(np.float32) for k, x in b.p.items()}
    return b


def test_class_probabilities_are_normalised_products(rng, monkeypatch):
    monkeypatch.setattr(lm, "SCORED", 5)
    monkeypatch.setattr(lm, "END_CLASS", 6)
    b = some_model(rng)
    c = np.array([rng.randrange(7) for _ in range(23)])
    before = [6] * lm.POSITIONS + c.tolist()
    for i, x in enumerate(b.log_probabilities(c)):
        h = sum(b.p["r"][before[i + lm.POSITIONS - 1 - j]].astype(float) @ b.p["m"][j] for j in range(lm.POSITIONS))
        s = b.p["t"].astype(float) @ h + b.p["b"]
        assert x == pytest.approx((s[c[i]] - np.log(np.exp(s).sum())) / math.log(10), abs=1e-4)
    every = [10 ** b.log_probabilities(np.append(c[:9], k))[-1] for k in range(7)]
    assert sum(every) == pytest.approx(1, abs=1e-5)


def test_gradients_are_those_of_the_noise_contrastive_loss(rng):
    b = some_model(rng)
    g = np.random.default_rng(2)
    before, c, noise = g.integers(0, 7, (11, lm.POSITIONS)), g.integers(0, 7, 11), g.integers(0, 7, 4)

    def loss(p):
        h = sum(p["r"][before[:, j]] @ p["m"][j] for j in range(lm.POSITIONS))
        level = np.log(lm.NOISE * b.unigram)
        d = (h * p["t"][c]).sum(1) + p["b"][c] - level[c]
        n = h @ p["t"][noise].T + (p["b"] - level)[noise]
        return (np.log1p(np.exp(-d)) + lm.NOISE / len(noise) * np.log1p(np.exp(n)).sum(1)).mean()

    exact = {k: x.astype(float) for k, x in b.p.items()}
    for k, x in b.gradients(before, c, noise).items():
        for at in [tuple(g.integers(0, n) for n in x.shape) for _ in range(12)]:
            up, down = ({q: y.copy() for q, y in exact.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert x[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4), k


def test_batches_hold_every_token_once(rng, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 7)
    sequences = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 20))]) for _ in range(30)]
    got = list(lm.batched(iter(sequences)))
    assert np.concatenate([c for _, c in got]).tolist() == np.concatenate(sequences).tolist()
    assert np.concatenate([x for x, _ in got]).tolist() == np.concatenate([lm.contexts(c) for c in sequences]).tolist()
    assert all(len(c) == 7 for _, c in got[:-1])


def test_a_word_s_share_of_its_class_sums_to_one(spark):
    rows = [(k, f"w{k % 7} x{k % 3} zeta") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    counts = lm._word_counts(docs)
    m = lm.train_model(docs, counts)
    own = {int(r["h"]): r for r in counts.collect()}
    mass = np.full(lm.CLASSES, 0.5)
    for h, r in own.items():
        c, _ = m.look_up(np.array([h]).view(np.uint64), np.array([r["g"]]))
        if c[0] >= lm.WORDS:
            mass[c[0]] += r["c"] + 0.5
    assert np.allclose(mass[: lm.END_CLASS], m.mass[: lm.END_CLASS])


def test_the_model_beats_the_unigram_where_order_tells(spark, rng):
    langs = [["aa", "ab", "ac", "ad"], ["ba", "bb", "bc", "bd"], ["ca", "cb", "cc", "cd"]]
    rows = [(k, " ".join(rng.choice(langs[k % 3]) for _ in range(40))) for k in range(400)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


def test_every_row_takes_part_in_training(spark, rng):
    """Words in pairs that stand in other rows than those of the first fit are learned too."""
    rows = [(" ".join(rng.choice(["aa bb", "cc dd", "ee ff"]) for _ in range(30)),) for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string").repartition(2)
    counts = lm._word_counts(docs)

    def mean(warm):
        lm.WARM_ROWS, kept = warm, lm.WARM_ROWS
        try:
            m = lm.train_model(docs, counts)
        finally:
            lm.WARM_ROWS = kept
        return np.mean([m.classes.log_probabilities(m.look_up(*lm.tokens(t.encode()))[0]).mean() for (t,) in rows[:20]])

    first = lm.Bilinear(lm.train_model(docs.limit(0), counts).classes.unigram)
    assert mean(5) > np.mean([first.log_probabilities(lm.train_model(docs.limit(0), counts).look_up(*lm.tokens(rows[0][0].encode()))[0]).mean()])


def test_scores_of_many_sequences_at_once_are_those_of_each(rng, monkeypatch):
    monkeypatch.setattr(lm, "END_CLASS", 6)
    monkeypatch.setattr(lm, "SCORED", 5)
    b = some_model(rng)
    sequences = [np.array([rng.randrange(7) for _ in range(rng.randint(1, 20))]) for _ in range(30)]
    sizes, joined = np.array([len(c) for c in sequences]), np.concatenate(sequences)
    assert lm.joined_contexts(joined, sizes).tolist() == np.concatenate([lm.contexts(c) for c in sequences]).tolist()
    got = b.scorer()(lm.joined_contexts(joined, sizes), joined)
    assert got == pytest.approx(np.concatenate([b.log_probabilities(c) for c in sequences]), abs=1e-5)


def test_scores_far_apart_keep_their_probabilities(rng, monkeypatch):
    """A sequence's scores may lie further apart than single precision's exponentials reach."""
    monkeypatch.setattr(lm, "END_CLASS", 6)
    b = some_model(rng)
    b.p = {k: x * 6 for k, x in b.p.items()}
    c = np.array([rng.randrange(7) for _ in range(60)])
    before = [6] * lm.POSITIONS + c.tolist()
    low = 0
    for i, x in enumerate(b.log_probabilities(c)):
        h = sum(b.p["r"][before[i + lm.POSITIONS - 1 - j]].astype(float) @ b.p["m"][j] for j in range(lm.POSITIONS))
        s = b.p["t"].astype(float) @ h + b.p["b"]
        low = max(low, abs(s).max())
        assert x == pytest.approx((s[c[i]] - s.max() - np.log(np.exp(s - s.max()).sum())) / math.log(10), rel=1e-4, abs=1e-3)
    assert low > 200


@pytest.mark.parametrize("many", [0, 1, 3, 5000])
def test_words_are_found_where_they_stand(many):
    g = np.random.default_rng(3)
    h = np.unique(np.append(g.integers(0, 2**63, many, dtype=np.uint64) * np.uint64(2), [lm.END_HASH] * bool(many))).astype(np.uint64)
    m = lm.Model(h, np.arange(len(h)) + 1, len(h), len(h), np.ones(lm.CLASSES))
    asked = np.concatenate([h, h + np.uint64(1), g.integers(0, 2**63, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    place = {int(x): k for k, x in enumerate(h)}
    assert m.places(asked).tolist() == [place.get(int(x), len(h)) for x in asked]
    own, count = m.look_up(asked, np.full(len(asked), 300))
    assert count.tolist() == [place.get(int(x), -2) + 1 for x in asked]
    assert all((o == 300) == (k < 0 or x == lm.END_HASH or m.own[place[int(x)]] < 0) for o, k, x in zip(own, count, asked, strict=True))
