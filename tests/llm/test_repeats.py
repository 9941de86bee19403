import hashlib

import pytest

from motionloom.llm import repeats


def brute(rows, length):
    """(id, n_bytes, n_removed, n_spans, kept_sha256); rows with a null id untouched."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                if w in seen:
                    gone[s : s + length] = b"\1" * length
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), len(b) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_suffix_array_is_sorted(rng):
    for _ in range(600):
        s = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(40))]
        assert repeats.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(rng, n):
    bases = ["".join(rng.choice("abc ") for _ in range(rng.randint(5, 120))) for _ in range(12)]
    rows = []
    for k in range(n):
        t = "".join(rng.choice([rng.choice(bases), rng.choice(bases)[:30], "xyz" * rng.randrange(20), "é", str(rng.random())]) for _ in range(rng.randint(0, 6)))
        rows.append((k * 2, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "k"), [(20, 8), (10, 10), (7, 2), (97, 30)])
def test_spans_equal_brute_force(spark, rng, length, k, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    rows = corpus(rng, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(repeats.repeated_spans(docs, length, k)) == brute(rows, length)


def test_the_suffix_array_gives_the_same_spans(rng):
    rows = sorted(corpus(rng, 40))
    got = repeats.repeats_by_suffix_array([t.encode() for _, t in rows], 20)
    want = brute(rows, 20)
    assert sorted((str(i), len(t.encode()), sum(b - a for a, b in s), len(s)) for (i, t), s in zip(rows, got, strict=True)) == [w[:4] for w in want]


def test_spans_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(repeats.repeated_spans(odd_docs)) == brute(rows, 100)
    assert rows_of(repeats.repeated_spans(odd_docs, 20, 8)) == brute(rows, 20)
    assert repeats.repeated_spans(no_docs).count() == 0


def test_bytes_are_compared(rng):
    import numpy as np

    text = np.frombuffer(b"abcdefgh--abcdefgx--abcdefgh", np.uint8)
    assert repeats.same_bytes(text, np.array([20, 21, 22]), np.array([0, 1, 2]), 6)
    assert not repeats.same_bytes(text, np.array([10, 11, 12]), np.array([0, 1, 2]), 6)
    assert not repeats.same_bytes(text, np.array([9, 20]), np.array([0, 0]), 6)
    at = np.arange(len(text) - 5)
    want = [text[i : i + 6].tobytes() in {text[j : j + 6].tobytes() for j in range(i)} for i in at]
    assert repeats._seen_before(text, at, np.zeros(len(at), int), 6).tolist() == want


def test_repeats_go_and_rows_stay(spark, rng):
    from pyspark.sql import functions as F

    rows = [(i, t, "s" + str(k)) for k, (i, t) in enumerate(corpus(rng, 60))]
    rows += [(None, rows[0][1], "none"), (rows[3][0], rows[5][1], "again"), (rows[3][0], rows[3][1], "twice"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("x")).withColumn("kept", F.lit(1)).repartition(3)
    got = repeats.drop_repeats(docs, 20, 8)
    assert got.columns == docs.columns
    left = got.collect()
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in left) == sorted((str(i), str(s)) for i, _, s in rows)
    assert all(r["row"] == "x" and r["kept"] == 1 for r in left)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), digest(r["text"])) for r in left) == sorted((w[0], w[4]) for w in brute([r[:2] for r in rows], 20))
    assert {r["doc_id"] for r in left if r["text"] is None} == {7}
    assert repeats.drop_repeats(docs.limit(0)).count() == 0


def test_blocks_are_few_however_many_the_buckets(spark, rng):
    """The buckets of a task are dealt out together: no block for each two buckets."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(corpus(rng, 400), "doc_id long, text string").repartition(2)
    plain = docs.select(F.col("doc_id").alias("row"), "text")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        found = repeats._find(plain, 20, 8, 256)
        assert found.count() <= 256 * 2
        assert repeats._compared(found, repeats._texts(plain, 256), 20, 256).count() <= 256
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_buckets_follow_the_input_alone(spark, rng):
    docs = spark.createDataFrame(corpus(rng, 20), "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500")
        assert repeats._buckets(docs, "text") == 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("limit", [0, 200, 1 << 20])
def test_held_rows_come_out_once(rng, limit):
    import numpy as np

    held, sent, got = repeats.Held(limit), [], []
    batches = []
    for _ in range(20):
        x = np.array([[rng.randrange(5), rng.randrange(-9, 99), rng.randrange(99)] for _ in range(rng.randrange(9))], np.int64).reshape(-1, 3)
        kind = rng.choice([repeats.SPAN, repeats.ASK])
        sent += [(kind, *r) for r in x.tolist()]
        batches += held.add(kind, *x.T)
    batches += held.rest()
    for b in batches:
        for kind, bucket, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got += [(kind, bucket, *r) for r in repeats._unblob(blob, 2).T.tolist()]
    assert sorted(got) == sorted(sent)
    assert not held.of
    if limit == 1 << 20:
        assert sum(b.num_rows for b in batches) <= 2 * 5
