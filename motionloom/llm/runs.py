"""Line deduplication by winnowing, with DataFrame functions only.

A window starts at a line and takes whole lines until it has ``min_chars`` characters, line feeds counted, so it is
never longer than that many lines. Its fingerprint is the least hash among its lines, the leftmost of equals. Window
and choice depend on the lines alone, so equal windows select the same line at the same place: selected lines are
meeting points that no repeat of ``min_chars`` characters can miss. Lines that are selected at one position only
are out before anything is compared.

Positions of a fingerprint aren't joined as pairs, as a common line would square. A match is extended from a
window to the right by every line whose own shortest window backwards starts at the same line, and to the left by
the windows that start before. The stretches that result, two a line at most, are joined to their first
occurrence. What repeated stretches cover is the union of all maximal repeated runs of at least ``min_chars``
characters, whichever earlier places they repeat: a line in such a run lies in a shortest stretch of it that still has
``min_chars`` characters, and that is a window from its first line or back from its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import materialise

MIN_CHARS = 40


def _lines(chars: Column, least: int) -> Column:
    """How many of the first elements of ``chars`` it takes to reach ``least``, null if all together don't."""
    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m"))
    one = lambda acc, x: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["m"] + 1).alias("m")))
    return F.aggregate(chars, none, one, lambda acc: F.when(acc["sum"] >= least, acc["m"]))


def stretches(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row, at`` (first line, from 0), ``m`` (lines), ``anchor``, ``place`` (its line), ``key`` (128 bits) of ``row, lines``."""
    first = rows.select(
        "row",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("more"),
        F.transform("lines", lambda x: F.least(F.length(x) + 1, F.lit(min_chars))).alias("chars"),
    )

    def forward(c, i):
        return F.when(c >= min_chars, F.lit(1)).otherwise(_lines(F.slice("chars", i + 1, F.lit(min_chars)), min_chars))

    def backward(c, i):
        low = F.greatest(i - min_chars + 1, F.lit(0))
        return F.when(c >= min_chars, F.lit(1)).otherwise(_lines(F.reverse(F.slice("chars", low + 1, i - low + 1)), min_chars))

    sized = first.select("row", "hashes", "more", F.transform("chars", forward).alias("fore"), F.transform("chars", backward).alias("back"))
    # A stretch back from line i that is also the window of its first line is there already.
    ends = F.filter(F.transform("back", lambda m, i: F.struct((i - m + 1).alias("at"), m.alias("m"))), lambda w: w["m"].isNotNull() & (w["m"] != F.get("fore", w["at"])))
    starts = F.filter(F.transform("fore", lambda m, i: F.struct(i.alias("at"), m.alias("m"))), lambda w: w["m"].isNotNull())
    every = sized.withColumn("w", F.explode(F.concat(starts, ends)))
    own = F.slice("hashes", F.col("w.at") + 1, F.get("fore", F.col("w.at")))
    key = F.struct(F.xxhash64(F.lit(1), F.slice("hashes", F.col("w.at") + 1, F.col("w.m"))).alias("x"), F.xxhash64(F.lit(2), F.slice("more", F.col("w.at") + 1, F.col("w.m"))).alias("y"))
    least = every.select("row", "w.at", "w.m", own.alias("own"), F.array_min(own).alias("anchor"), key.alias("key"))
    return least.select("row", "at", "m", "anchor", (F.col("at") + F.array_position("own", F.col("anchor")) - 1).cast("int").alias("place"), "key")


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row`` (struct that orders rows) and ``gone``: numbers of its lines that a later repeated run covers."""
    w = materialise(stretches(rows, min_chars), "stretches")
    # written before it is joined: the join's own exchange can then be split where one line has very many positions
    picked = materialise(w.groupBy("row", "anchor", "place").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("one").alias("n")).where("n > 1").select("anchor"), "anchors")
    met = w.join(picked, "anchor", "left_semi").select("row", "at", "m", "key")
    first = materialise(met.groupBy("key").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = met.join(first, "key").where(F.struct("row", "at") > F.col("first"))
    return later.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("m") - 1)))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, report: bool = True) -> DataFrame:
    """``docs`` with the lines of repeated runs gone from ``text_col``; ``report``: with ``lines_total``, ``lines_removed`` behind its columns.

    A run is consecutive lines with at least ``min_chars`` characters together, each line's line feed counted; one
    that stands earlier, in the same text or another, is a repeat, and overlaps count. The first occurrence stays:
    smallest id, nulls first, then an arbitrary but fixed order of repeated rows, then the earliest line. Rows without a
    removed line keep their text as it is, null included; a text that loses all its lines becomes empty. Lines are
    separated by line feeds only; texts of any length and number of lines are read whole. Columns of any name pass
    through (an own column called like one of the two new ones is replaced). An empty table gives an empty one.
    """
    held = materialise(docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tie")).alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc")), "lines")
    text = F.col("doc").getField(text_col)
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    gone = repeated_lines(held.select("row", lines.alias("lines")), min_chars)
    joined = held.join(gone, "row", "left").withColumn("lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    new = F.when(F.col("gone").isNull(), text).otherwise(left)
    added = [F.size("lines").cast("long").alias("lines_total"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed")] if report else []
    others = [c for c in docs.columns if not report or c not in ("lines_total", "lines_removed")]
    return joined.select(*[new.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in others], *added)
