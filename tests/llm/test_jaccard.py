import numpy as np

from motionloom.llm import jaccard
from motionloom.llm.common import LOWER, UPPER, connected_components
from motionloom.llm.shingles import shingle_set

FOLD = str.maketrans(UPPER, LOWER)


def shingles(text, k=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted([(str(i), len(s), None if i is None else find(i)) for i, s in sets], key=str)


def near_copies(rng, n):
    rows, bases = [], [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([3, 8, 30, 120]))] for _ in range(8)]
    passage = [rng.choice("0123456789") for _ in range(60)]
    for k in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [str(rng.random()) for _ in range(30)]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice("XYZ") + str(rng.randrange(50))
        if rng.random() < 0.3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        rows.append((k, " ".join(w)))
    return rows


def run(spark, rows, **more):
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **more).collect()
    return sorted([(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got], key=str)


def test_similar_sets_share_a_signature(rng):
    for _ in range(400):
        n = rng.choice([1, 2, 5, 20, 100, 400])
        s = np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)
        t = s.copy()
        for _ in range(rng.randint(0, max(1, n // 8))):
            t[rng.randrange(n)] = rng.getrandbits(63)
        t = np.concatenate([t, np.array([rng.getrandbits(63) for _ in range(rng.randint(0, n // 10))], np.uint64)])
        both, every = len(np.intersect1d(s, t)), len(np.union1d(s, t))
        if 100 * both >= 85 * every:
            assert np.intersect1d(jaccard.signatures(np.unique(s), 85), jaccard.signatures(np.unique(t), 85)).size


def test_components_equal_brute_force(spark, rng, monkeypatch):
    rows = near_copies(rng, 220)
    assert run(spark, rows) == brute(rows)
    for name, few in (("WALK_DOCS", 7), ("WALK_ELEMENTS", 300), ("WALK_EDGES", 5), ("CHUNK_DOCS", 20), ("MEET_ENTRIES", 30)):
        monkeypatch.setattr(jaccard, name, few)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, percent=60, words=2) == [(i, n, c) for (i, n, _), (_, _, c) in zip(brute2(rows), brute2(rows), strict=True)]


def brute2(rows):
    global shingles
    own, four = shingles, lambda t, k=2: own(t, k)
    shingles = four
    try:
        return brute(rows, 60)
    finally:
        shingles = own


def some_sets(rng, n):
    base = [rng.getrandbits(63) for _ in range(60)]
    return [np.unique(np.array([x if rng.random() < 0.93 else rng.getrandbits(63) for x in base], np.uint64)) for _ in range(n)]


def test_marks_differ_in_no_more_bits_than_sets_in_elements(rng):
    sets = some_sets(rng, 30) + [np.unique(np.array([rng.getrandbits(63) for _ in range(rng.randint(1, 3000))], np.uint64)) for _ in range(20)]
    for s in sets:
        for t in sets:
            words = min(len(jaccard.mark(s)), len(jaccard.mark(t)))
            bits = int(np.bitwise_count(jaccard.folded(jaccard.mark(s), words) ^ jaccard.folded(jaccard.mark(t), words)).sum())
            assert bits <= len(np.setxor1d(s, t))


def test_walks_span_what_links_connect(rng):
    sets = some_sets(rng, 120)
    edges = jaccard.walk(np.array([len(s) for s in sets]), [jaccard.mark(s) for s in sets], 80, sets)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert {tuple(sorted(e)) for e in edges} <= set(links) and len(links) > len(edges)
    assert sorted(jaccard._forest(edges)) == sorted(jaccard._forest(links)) and len(edges) == len(jaccard._forest(links))


def test_components_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted([(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(odd_docs).collect()], key=str)
    assert got == brute(rows)
    assert jaccard.similar_components(no_docs).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "t").collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_set_sizes(rng):
    for _ in range(300):
        t = "".join(rng.choice("aAb \t\nß\x1c\x85") for _ in range(rng.randint(0, 40)))
        assert len(shingle_set(t.encode())) == len(shingles(t))


def test_members_beyond_the_bound_stay_in_their_groups():
    """Signature s1 has L1, L2 and x1, s2 has L1, L2 and x2; both look alike once x1 and x2 are passed through."""
    s1, s2 = (np.full(3, s, np.uint64) for s in (11, 12))
    sigs, ids = np.concatenate([s1[:2], s2[:2]]), np.array([1, 5, 1, 5])
    own = lambda s: int(jaccard._own_group(np.array([s], np.uint64)).view(np.int64)[0])
    groups = lambda partial: set(zip(*(x.tolist() for x in jaccard._group_rows(sigs, ids, partial)), strict=True))
    assert len(groups(np.zeros(0, np.uint64))) == 2
    assert groups(np.array([12], np.uint64)) >= {(own(12), 1), (own(12), 5)}
    assert groups(None) == {(own(11), 1), (own(11), 5), (own(12), 1), (own(12), 5)}


def test_pairs_do_not_depend_on_the_memory_bound(spark, rng, monkeypatch):
    """Every pair of documents that shares a signature shares one in the written groups, whatever a task holds."""
    rows = near_copies(rng, 220)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)

    def pairs():
        groups = {}
        for r in jaccard.candidates(docs, 85, 4, 8).where(f"kind = {jaccard.STAR}").select("g", "id").collect():
            groups.setdefault(r["g"], set()).add(r["id"])
        return {(i, j) for g in groups.values() for i in g for j in g if i < j}

    want = pairs()
    for bound in (0, 40, 400):
        monkeypatch.setattr(jaccard, "MEET_ENTRIES", bound)
        assert pairs() == want


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    w = [f"w{k}" for k in range(60)]
    a, b = " ".join(w), " ".join(x + "z" for x in w)
    rows = [(3, b), (5, a), (5, b), (8, a + " end"), (9, "other"), (9, None), (12, ""), ("x", a)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")).collect()}
    assert got == {3: 3, 5: 3, 8: 3, 9: 9, 12: 12, None: None}
