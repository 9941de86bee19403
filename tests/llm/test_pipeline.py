import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from motionloom.llm import toxicity
from tests.llm.test_jaccard import brute as components
from tests.llm.test_repeats import brute as repeats_brute
from tests.llm.test_runs import brute as lines_brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    r, d = random.Random(5), str(tmp_path_factory.mktemp("corpus"))
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    docs, labels = [], []
    for k in range(240):
        w = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = k % 5 == 0
        if bad:
            w += ["nastyword", "horridword"] * 2
        if k % 7 == 0:
            w.insert(len(w) // 2, passage)
        if k % 6 == 0 and docs and not bad:
            w = docs[-1][1].split(" ")
            w[len(w) // 2] = "changed"
        text = " ".join(w)
        docs.append((k, text if k % 4 else text + "\nthis line stands in very many of the documents here\nend", "en", "s", len(text)))
        labels.append((k, 1, int(any(x in text for x in ("nastyword", "horridword")))))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, docs[3][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, {i for i, _, t in labels if t}


def test_stages_in_turn(spark, corpus):
    d, rows, toxic = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    (_, tox), (_, lines), (_, near), (_, spans), (_, pack) = corpus_pipeline.STAGES
    kept = tox(spark, docs, d)
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - toxic
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    after = lines(spark, kept, d)
    assert after.columns == columns
    got = sorted([(str(r["doc_id"]), r["text"]) for r in after.collect()], key=str)
    assert got == [x[:2] for x in lines_brute(before, 40)]
    one = near(spark, after, d)
    assert one.columns == columns
    before = [(r["doc_id"], r["text"]) for r in after.collect()]
    want = {i for i, _, c in components_of(before) if str(c) == i}
    assert {str(r["doc_id"]) for r in one.collect()} == want
    left = spans(spark, one, d)
    assert left.columns == columns
    before = [(r["doc_id"], r["text"]) for r in one.collect()]
    digests = {w[0]: w[4] for w in repeats_brute(before, 100)}
    assert {str(r["doc_id"]): hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in left.collect()} == digests
    assert pack(spark, left, d).select("doc_id").distinct().count() == left.count()


def components_of(rows):
    import tests.llm.test_jaccard as j

    one = j.shingles
    try:
        j.shingles = lambda t: one(t, 5)
        return components(rows, 80)
    finally:
        j.shingles = one


def test_run_gives_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 100


def test_scores_on_held_out_rows(spark, corpus):
    d, _, toxic = corpus
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).where("held_out").collect()}
    assert {i for i, p in got.items() if p} == {i for i in got if i in toxic}


@pytest.fixture(scope="module")
def label_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(5, 1, 0), (None, 0, 1), (9, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_on_odd_rows(spark, odd_docs, no_docs, label_dir):
    """Null ids and texts, repeated rows, very long texts and clashing columns; every stage keeps rows and columns as it says."""
    left = {"toxicity": 10, "line_dedup": 10, "jaccard_join": 7, "suffix_dedup": 10}
    docs = odd_docs
    for c in ("lines_total", "lines_removed", "component_id", "n_bytes", "row", "kept", "passages", "doc", "of"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, label_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) == left[name], name
        assert all(r[c] == "clash" for r in rows for c in docs.columns[5:]), name
        assert [r["text"] for r in rows if r["doc_id"] is None] == ["no id here"], name
        assert [r["text"] for r in rows if r["doc_id"] == 9] == [None], name
        assert stage(spark, no_docs, label_dir).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, label_dir)
    assert packed.where("piece = 0").count() == 10
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, label_dir).count() == 0
