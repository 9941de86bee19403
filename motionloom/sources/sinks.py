"""Writers of feature matrices and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, fmt: str = "csv", plain_names: bool = False) -> None:
    """csv (with a header), json, parquet, or "table" (``path`` is then its name). ``plain_names``: hyphens become underscores in names and ids."""
    if plain_names:
        df = df.withColumnsRenamed({c: c.replace("-", "_") for c in df.columns})
        if "id" in df.columns:
            df = df.withColumn("id", F.regexp_replace("id", "-", "_"))
    if fmt == "table":
        df.write.mode("overwrite").saveAsTable(path)
    else:
        df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scores of every row in order of ``id``, one file with a header ``id,<codes>`` (as many rows as sessions)."""
    scores.orderBy("id").coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)
