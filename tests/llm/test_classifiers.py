import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm import quality, toxicity
from motionloom.llm.calibrate import TILT, isotonic
from motionloom.llm.common import tree_sum


def held(i, mod, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == rest


def corpus(rng, n, bad_words=("nastyish", "horridly")):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        y = int(k % 4 == 0)
        if y:
            for _ in range(rng.randint(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad_words))
        if y or rng.random() < 0.05:
            w += ["#"] * rng.randint(5, 30)
        docs.append((k, " ".join(w)))
        if k % 5:
            labels.append((k, 1 - y, y))
    return docs, labels


# calibration and sums


def test_isotonic_steps_are_the_best_monotone_fit(rng):
    for _ in range(50):
        n = np.array([rng.choice([0, 1, 3, 9]) for _ in range(12)], float)
        p = np.array([rng.randint(0, int(x)) for x in n], float)
        if not n.sum():
            continue
        got = isotonic(p, n, prior=1e-12)
        assert (np.diff(got) >= -1e-12).all()
        full = np.flatnonzero(n)
        # min-max formula of the monotone regression
        want = [max(min(p[full[a : b + 1]].sum() / n[full[a : b + 1]].sum() for b in range(k, len(full))) for a in range(k + 1)) for k in range(len(full))]
        steps = np.interp(np.arange(12), full, want)
        assert np.abs(got - steps).max() <= TILT + 1e-9


@pytest.mark.parametrize("fan", [2, 64])
def test_sums_of_many_partitions(spark, monkeypatch, fan):
    import pyarrow.compute as pc

    from motionloom.llm import common

    monkeypatch.setattr(common, "FAN_IN", fan)
    df = spark.range(1000).repartition(17)
    got = tree_sum(df, 2, lambda b: np.array([pc.sum(b.column(0)).as_py(), b.num_rows], float))
    assert got.tolist() == [499500, 1000]
    assert tree_sum(df.limit(0), 2, lambda b: np.ones(2)).tolist() == [0, 0]


# quality


def test_quality_scores_equal_a_direct_fit(spark, rng):
    docs, labels = corpus(rng, 240)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    y = {i: q for i, q, _ in labels}
    part = {r[0]: r[1] for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.CROSS))).collect()}
    got = {r["doc_id"]: r for r in quality.score_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = {i: np.array(quality.statistics(t.encode())) for i, t in docs}
    train = [i for i, _ in docs if i in y and not held(i, 5, 0)]
    m = quality.QualityModel()
    a = np.array([x[i] for i in train])
    m.mean, m.sd = a.mean(0), np.where(a.std(0) > 1e-9, a.std(0), 1.0)

    def solved(ids):
        f, t = m.features(np.array([x[i] for i in ids])), np.array([y[i] for i in ids], float)
        return np.linalg.solve(f.T @ f + quality.RIDGE * len(ids) * np.eye(f.shape[1]), f.T @ t)

    positive, total = np.zeros(quality.BINS), np.zeros(quality.BINS)
    for p in range(quality.CROSS):
        w = solved([i for i in train if part[i] != p])
        for i in train:
            if part[i] == p:
                k = m.bins(x[i][None], w)[0]
                positive[k] += y[i]
                total[k] += 1
    m.weights, m.curve = solved(train), isotonic(positive, total)
    for i, _ in docs:
        assert got[i]["held_out"] == held(i, 5, 0)
        assert got[i]["score"] == pytest.approx(m.score(x[i][None])[0], abs=0.02)  # a score at the edge of a bin may fall to either
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    wrong = [i for i in got if got[i]["held_out"] and got[i]["predicted"] != (i % 4 != 0)]
    assert len(wrong) <= 0.1 * sum(r["held_out"] for r in got.values())


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (3, 0), (None, 1), (9, None), (7, 1), (7, 0)], "doc_id long, quality int")
    got = quality.score_documents(odd_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 9)}) == 1  # null and empty texts are the same
    assert quality.score_documents(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(odd_docs, labels.limit(0)).collect()} == {0.5}


# toxicity


def brute_segments(values):
    """Maximal-scoring segments by their definition: the best segment (shortest first), then those left and right of it."""
    if not len(values):
        return []
    best = None
    for a in range(len(values)):
        total = 0.0
        for b in range(a, len(values)):
            total += values[b]
            if total > 0 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and b - a < best[2] - best[1]):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    left, right = brute_segments(values[:a]), brute_segments(values[b + 1 :])
    return left + [(a, b, total)] + [(x + b + 1, y + b + 1, s) for x, y, s in right]


def test_segments_are_the_maximal_ones(rng):
    for _ in range(300):
        n, decline = rng.randint(0, 25), rng.choice([0.1, 0.7, 1.3])
        scored = [(i, rng.choice([0.31, 0.9, 1.7, 2.3]) * (1 + rng.random() / 10)) for i in range(n) if rng.random() < 0.4]
        values = [dict(scored).get(i, -decline) for i in range(n)]
        got = toxicity.maximal_segments(scored, decline)
        want = brute_segments(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_extreme_value_constants():
    seen, n = [(2.0, 30), (3.5, 8), (6.0, 2)], 5000
    lam, k = toxicity.extreme_value(n, seen, 0.1)
    mean = sum(c * math.exp(lam * s) for s, c in seen) / n + (1 - 40 / n) * math.exp(-lam * 0.1)
    assert mean == pytest.approx(1, abs=1e-6) and k == pytest.approx(min(40 / n * math.exp(2 * lam), 1))
    assert toxicity.extreme_value(0, [], 0.1) == (1.0, 0.1)


def slow_scores(rows):
    weight = [Counter(), Counter()]
    for text, y in rows:
        own = Counter(u for w in text.lower().split() for u in toxicity.units(w))
        weight[y].update({u: 1 + math.log(n) for u, n in own.items()})
        weight[y][""] += sum(1 + math.log(n) for n in Counter(text.lower().split()).values())
    if not weight[1][""] or not weight[0][""]:
        return {}
    out = {}
    for u in weight[1]:
        odds, z = toxicity.log_odds(weight[1][u], weight[0][u], weight[1][""], weight[0][""])
        if u and odds >= toxicity.LEAST_ODDS and z >= toxicity.LEAST_Z:
            out[u] = odds
    return out


def test_toxicity_scores_equal_a_slow_version(spark, rng):
    docs, labels = corpus(rng, 200)
    y = {i: t for i, _, t in labels}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    train = [(t, y[i]) for i, t in docs if i in y and not held(i, 4, 2)]

    def segments(text, scores):
        ws = text.lower().split()
        values = [max((scores.get(u, 0.0) for u in toxicity.units(w)), default=0.0) for w in ws]
        return len(ws), brute_segments([v if v > 0 else -toxicity.DECLINE for v in values])

    others = [slow_scores([r for r in train if toxicity._part(r[0]) != p]) for p in range(toxicity.CROSS)]
    words, seen = 0, Counter()
    for t, label in train:
        if not label:
            n, found = segments(t, others[toxicity._part(t)])
            words += n
            seen.update(round(s * 10) / 10 for _, _, s in found)
    lam, k = toxicity.extreme_value(words, sorted(seen.items()), toxicity.DECLINE)

    def evidence(text, scores):
        n, found = segments(text, scores)
        floor = math.log(k * max(n, 1))
        return sum(lam * s - floor for _, _, s in found if lam * s > floor)

    tally = np.zeros((2, toxicity.EVIDENCE_BINS))
    for t, label in train:
        tally[label, toxicity.bin_of(evidence(t, others[toxicity._part(t)]))] += 1
    curve, scores = isotonic(tally[1], tally.sum(0)), slow_scores(train)
    assert "nastyish\n" in scores and "nastyi" in scores
    for i, t in docs:
        e = evidence(t, scores)
        assert got[i]["score"] in [pytest.approx(curve[toxicity.bin_of(max(e + x, 0))], abs=1e-6) for x in (0, 1e-9, -1e-9)]
        assert got[i]["held_out"] == held(i, 4, 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    wrong = [i for i in got if got[i]["held_out"] and got[i]["predicted"] != (i % 4 == 0)]
    assert len(wrong) <= 2


def test_a_long_toxic_word_differs_from_a_clean_one_with_the_same_start(spark, rng):
    """Both words share their first eight letters; only the whole word tells them apart."""
    docs, labels = [], []
    for k in range(160):
        w = [rng.choice("abcdefgh") * 3 for _ in range(20)] + (["internationalfoul"] if k % 4 == 0 else ["internationalfair"]) * 2
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (3, 0), (None, 1), (9, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(no_docs, labels).count() == 0
    none = toxicity.score_documents(odd_docs, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    kept = toxicity.drop_toxic(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == 10
