"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.llm import jaccard, packing, repeats, runs, toxicity
from motionloom.llm.common import materialise, table

CAPACITY = 2048


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where it has one, of its texts as they are now (null text: as it was)."""
    return docs.select(*[F.coalesce(F.length("text").cast("long"), F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; every document stays, those with a null id or text too."""
    return _counted(runs.dedup_lines(docs, report=False))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect (five words, 0.8 or more) the one with the smallest id stays.

    Rows that repeat an id stay or go together, but of rows that repeat id and text one stays. Rows with a null id, and
    null or empty texts, stay.
    """
    found = materialise(jaccard.similar_components(docs, percent=80, words=5), "near")
    left = docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier go; every row stays, those with a null or repeated id too."""
    return _counted(repeats.drop_repeats(docs, length=100))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_dedup", repeat_stage),
    ("packing", packing_stage),
]

#: The toxicity model and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
