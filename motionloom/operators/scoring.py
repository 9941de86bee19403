"""Assembly of feature matrices and scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODES = ["OT-RH", "OT-LH", "TT-RH", "TT-LH", "PS-RH", "PS-LH", "LA-RL", "LA-LL", "PTOTH-RH", "PTOTH-LH", "KTOH-RH", "KTOH-LH", "RTA-RH", "RTA-LH", "RTA-RL", "RTA-LL"]


def feature_matrix(long: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """One row a session; ``names`` spares the job that would look for the pivot's values. Missing features are 0."""
    return long.groupBy(key).pivot("feature", names).agg(F.first("value")).na.fill(0.0)


def append_sessions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Sessions of ``b`` that ``a`` hasn't got, united by column name, missing values 0."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True).na.fill(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def whitened(points: DataFrame, column: str = "p") -> DataFrame:
    """Each dimension over its population standard deviation (1 where that is 0)."""
    sd = points.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r.s).alias("sd"))
    return points.crossJoin(F.broadcast(sd)).withColumn(column, F.zip_with(column, "sd", lambda x, s: x / F.when(s == 0, 1.0).otherwise(s)))


def centroid_order(centroids: list[list[float]]) -> list[list[float]]:
    return sorted(centroids, key=lambda c: sum((x + 100.0) ** 2 for x in c))


def train_clusters(points: DataFrame, k: int = 4, seed: int = 1, column: str = "p") -> list[list[float]]:
    """Centroids of whitened points in order of their distance from (-100, ...)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = whitened(points, column).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return centroid_order([list(map(float, c)) for c in KMeans(k=k, seed=seed).fit(data).clusterCenters()])


def nearest_centroid(points: DataFrame, centroids: list[list[float]], column: str = "p") -> DataFrame:
    """``score``: number of the nearest of a handful of centroids, ties to the lowest; no join, no shuffle."""
    near = F.array_min(F.array(*[F.struct(distance(F.col(column), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)]))
    return points.withColumn("score", near["k"])


#: Rows of either side in one block of distances.
BLOCK_ROWS = 4096


def nearest_neighbours(queries: DataFrame, training: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance-weighted vote of the k nearest training rows; exact matches take all weight, ties go to the lowest ``tid`` and label.

    ``queries`` has ``id, p``; ``training`` has ``tid, q, label``. Both sides are cut into blocks of about ``block_rows``
    rows; a task holds one block of each, and only its k nearest a query leave it. Nothing is broadcast, no pair is a row.
    """
    cuts = [max(1, -(-side.count() // block_rows)) for side in (queries, training)]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", F.col("p").cast("array<double>").alias("p"), F.pmod(F.xxhash64("id"), F.lit(cuts[0])).cast("int").alias("qb")).withColumn("tb", spread(cuts[1]))
    right = training.select("tid", F.col("q").cast("array<double>").alias("q"), "label", F.pmod(F.xxhash64("tid"), F.lit(cuts[1])).cast("int").alias("tb")).withColumn("qb", spread(cuts[0]))
    of, tid, label = (dict(df.dtypes)[c] for df, c in ((queries, "id"), (training, "tid"), (training, "label")))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            b = b.sort_values("tid", ignore_index=True)
            t = np.stack(b["q"].to_numpy())
            for i, p in zip(a["id"], a["p"], strict=True):
                d = np.sqrt(((t - np.asarray(p)) ** 2).sum(axis=1))
                rows += [(i, d[j], b["tid"][j], b["label"][j]) for j in np.argsort(d, kind="stable")[:k]]
        return pd.DataFrame(rows, columns=["id", "d", "tid", "label"])

    near = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInPandas(nearest, f"id {of}, d double, tid {tid}, label {label}")
    if cuts[1] > 1:
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("d", "tid"))).where(F.col("n") <= k)
    exact = near.groupBy("id").agg(F.collect_list(F.struct("d", "label")).alias("r"))
    votes = exact.select("id", (F.array_min(F.transform("r", lambda x: x["d"])) == 0).alias("exact"), F.explode("r").alias("x"))
    weight = F.when(F.col("exact"), F.when(F.col("x.d") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.when(F.col("x.d") == 0, 1.0).otherwise(F.col("x.d")))
    summed = votes.groupBy("id", F.col("x.label").alias("label")).agg(F.sum(weight).alias("w"))
    return summed.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("predicted"))


def top_observations(importances: DataFrame, top: int = 3) -> DataFrame:
    """Sums of ``feature, importance`` over the observation codes that a feature's name holds; the largest few."""
    of = F.explode(F.filter(F.array(*map(F.lit, CODES)), lambda c: F.contains(F.col("feature"), c)))
    return importances.select(of.alias("observation"), "importance").groupBy("observation").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "observation").limit(top)


def importances(matrix: DataFrame, label: str, names: list[str], trees: int = 100, seed: int = 123) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=names, outputCol="features").transform(matrix).select("features", F.col(label).cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(data)
    return matrix.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def read_matrix(spark, path: str, key: str = "id") -> DataFrame:
    """A feature matrix from a CSV file with a header; missing numbers are the column's mean, rows in order of ``key``."""
    m = spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = [c for c, t in m.dtypes if c != key and t != "string"]
    means = m.agg(*[F.avg(f"`{c}`").alias(c) for c in names])
    filled = m.alias("m").crossJoin(F.broadcast(means.select(*[F.col(f"`{c}`").alias(f"mean {c}") for c in names])))  # one row
    return filled.select(*[F.coalesce(F.col(f"m.`{c}`"), F.col(f"`mean {c}`")).alias(c) if c in names else F.col(f"m.`{c}`") for c in m.columns]).orderBy(key)


def of_observation(matrix: DataFrame, code: str) -> list[str]:
    return [c for c in matrix.columns if code in c]


def train_observations(matrix: DataFrame, codes: list[str] = CODES, k: int = 4, seed: int = 1, skip_id=None, key: str = "id") -> dict[str, dict]:
    """For each observation code that has columns: their names, population deviations and ordered centroids of whitened rows."""
    rows = matrix if skip_id is None else matrix.where(F.col(key) != skip_id)
    out = {}
    for code in codes:
        if names := of_observation(matrix, code):
            points = rows.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("p"))
            sd = rows.agg(*[F.stddev_pop(f"`{c}`").alias(str(i)) for i, c in enumerate(names)]).first()
            out[code] = {"columns": names, "sd": [1.0 if not v else float(v) for v in sd], "centroids": train_clusters(points, k, seed)}
    return out


def score_observations(matrix: DataFrame, models: dict[str, dict], key: str = "id") -> DataFrame:
    """``key`` and an int score (number of the nearest centroid) for each trained code; one projection, no join."""
    scores = []
    for code, m in models.items():
        p = F.array(*[F.col(f"`{c}`").cast("double") / s for c, s in zip(m["columns"], m["sd"], strict=True)])
        near = F.array_min(F.array(*[F.struct(distance(p, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(m["centroids"])]))
        scores.append(near["k"].cast("int").alias(code))
    return matrix.select(key, *scores)


def predict_labels(matrix: DataFrame, training: DataFrame, labels: DataFrame, codes: list[str] = CODES, k: int = 3, skip_id=None, key: str = "id") -> DataFrame:
    """``key`` and a predicted label for each code, by the nearest whitened training rows; queries aren't whitened, as recorded values have it.

    ``labels`` has ``key`` and a column for each code; null labels take no part.
    """
    rows = training if skip_id is None else training.where(F.col(key) != skip_id)
    out = matrix.select(key)
    for code in codes:
        names = of_observation(training, code)
        if not names or code not in labels.columns:
            continue
        point = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
        known = whitened(rows.select(F.col(key), point.alias("q")), "q").select(key, "q").join(labels.select(key, F.col(f"`{code}`").cast("int").alias("label")), key).where("label is not null")
        found = nearest_neighbours(matrix.select(F.col(key).alias("id"), point.alias("p")), known.select(F.col(key).alias("tid"), "q", "label"), k)
        out = out.join(found.select(F.col("id").alias(key), F.col("predicted").alias(code)), key, "left")
    return out
