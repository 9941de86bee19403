import hashlib

import pytest

from motionloom.llm import fingerprints as fp


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    import xxhash

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh3_128_digest((r[1] or "").encode())))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((str(i), len(t), sha(e), float(fp.canonical(t) == fp.canonical(e)), float(fp.canonical(t) == fp.canonical(n))))
    return sorted(out)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect())


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_neighbours_over_ranges(spark, rng, ranges):
    rows = [(k * 3, "".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(fp.fingerprint_documents(docs, ranges=ranges)) == brute(rows)


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = fp.fingerprint_documents(odd_docs, ranges=3)
    assert rows_of(got) == brute(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[5] == by[3] == by[7] and by[5] != by[12] and by[9] == by[1]
    assert fp.fingerprint_documents(no_docs).count() == 0


def test_one_row_follows_itself(spark):
    r = fp.fingerprint_documents(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert (r["edited_sha256"], r["near_next"]) == (sha("abab"), 1.0)


def test_shared_hashes_are_told_apart(spark):
    rows = [(k, f"text {k % 6}") for k in range(30)]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), hashed=lambda c: fp.digest(c)[:1][:0] + b"\x01", ranges=3).collect()
    assert len({r["fingerprint"] for r in got}) == 6
    assert all(len({r["fingerprint"] for r in got if r["doc_id"] % 6 == k}) == 1 for k in range(6))


def test_canonical_form():
    assert fp.canonical(" Ａb\tC ﬁ  STRASSE ß ") == fp.canonical("ab c FI strasse ss")
