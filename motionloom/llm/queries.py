"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motionloom.llm import fingerprints, grace, jaccard, lm, packing, pieces, quality, repeats, runs, toxicity
from motionloom.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir), PIECE_MODEL)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir), folds=5, fold=1)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir), table(spark, sf_dir, "labels"), folds=5, fold=0, threshold=0.3)


def op4_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_groups(table(spark, sf_dir))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.dedup_lines(table(spark, sf_dir)).select("doc_id", "text", "lines_total", "lines_removed")


OP6_SQL = """
WITH l AS (
  SELECT doc_id, pos AS ln, ls, len(ls) AS total, CAST(length(ls[pos]) + 1 AS BIGINT) AS c
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), p AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY ln) AS BIGINT) AS upto FROM l),
w AS (
  SELECT x.doc_id, x.ls, x.ln AS low, y.ln AS high FROM p x ASOF JOIN p y ON x.doc_id = y.doc_id AND x.upto - x.c + 40 <= y.upto
  UNION
  SELECT y.doc_id, y.ls, x.ln AS low, y.ln AS high FROM p y ASOF JOIN p x ON x.doc_id = y.doc_id AND y.upto - 40 >= x.upto - x.c
), r AS (SELECT doc_id, low, high, row_number() OVER (PARTITION BY array_to_string(ls[low:high], chr(10)), high - low ORDER BY doc_id, low) AS n FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS ln FROM r WHERE n > 1),
k AS (
  SELECT l.doc_id, string_agg(ls[l.ln], chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL) AS left_over, max(total) AS lines_total, count(g.ln) AS lines_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id
)
SELECT k.doc_id, CASE WHEN lines_removed = 0 THEN text ELSE coalesce(left_over, '') END AS text, lines_total, lines_removed
FROM k JOIN documents d ON k.doc_id = d.doc_id
"""


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir), percent=85, words=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir), table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir), length=100).drop("spans")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir), WORD_MODEL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pieces": op1_pieces, "op2_lm": op2_lm, "op3_quality": op3_quality, "op4_grace": op4_grace, "op5_fingerprints": op5_fingerprints, "op6_lines": op6_lines, "op7_jaccard": op7_jaccard, "op8_toxicity": op8_toxicity, "op9_repeats": op9_repeats, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    return {"op4_grace": OP4_SQL, "op6_lines": OP6_SQL}
