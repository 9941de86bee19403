"""Session folders to feature rows: files are listed, read by their format, reduced to features and pivoted, all as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.operators import motion, scoring, tapping
from motionloom.sources import readers

#: Kinds of the recordings of a smartphone test, as they stand in file names.
KINDS = {"accel": "motion", "gyro": "motion", "tap": "tap", "react": "react", "audio": "audio"}


def session_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".csv",)) -> DataFrame:
    """``path, directory, name`` of the files in the folders below ``root``; folders that start with an underscore don't count."""
    glob = "*{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*{suffixes[0]}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    got = files.select("path", F.element_at(parts, -2).alias("directory"), F.element_at(parts, -1).alias("name"))
    return got.where(~F.col("directory").startswith("_"))


def opdc_names(files: DataFrame) -> DataFrame:
    """``session`` and ``kind`` and ``measure`` of names cut at hyphens and underscores: the sixth-last and the last three parts; the kind; all up to it."""
    parts = F.split("name", "[-_]")
    session = F.concat(*[x for k in (-6, -3, -2, -1) for x in (F.try_element_at(parts, F.lit(k)), F.lit("-"))])
    kind = F.element_at(F.filter(parts, lambda p: p.isin(*KINDS)), 1)
    measure = F.array_join(F.slice(parts, 2, F.array_position(parts, kind).cast("int") - 1), "-")
    return files.where(F.exists(parts, lambda p: p.isin(*KINDS))).select("*", session.alias("session"), kind.alias("kind"), F.concat(measure, F.lit("-")).alias("measure"))


def _named(features: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """Long rows ``id, feature, value`` of rows ``key`` (a path), ``feature, value``; ``name`` may use the file's columns."""
    return features.join(files.withColumnRenamed("path", "key"), "key").select(F.col("session").alias("id"), "directory", F.concat(name, "feature").alias("feature"), "value")


def _matrix(spark: SparkSession, long: DataFrame) -> DataFrame:
    """One row a session, missing features 0. Of folders that hold the same session the first by name counts."""
    first = F.min("directory").over(Window.partitionBy("id"))
    own = long.withColumn("first", first).where("directory = first").groupBy("id", "feature").agg(F.max("value").alias("value"))
    names = sorted(r["feature"] for r in own.select("feature").distinct().collect())  # a few hundred, whatever the number of sessions
    return scoring.feature_matrix(own, names)


def assemble(spark: SparkSession, root: str) -> DataFrame:
    """``id`` and features of every session folder: tremor recordings (files that start with T) and taps (FT)."""
    files = readers.name_parts(session_files(spark, root)).where("session <> ''")
    shake = readers.cloudupdrs(spark, f"{root}/*/T*.csv") if _any(files, "^T") else None
    tap = readers.ft_cloudupdrs(spark, f"{root}/*/FT*.csv") if _any(files, "^FT") else None
    parts = []
    if shake is not None:
        parts.append(_named(motion.tremor_features(shake.withColumnRenamed("path", "key"), value="mag_sum_acc"), files, F.col("code")))
    if tap is not None:
        parts.append(_named(tapping.tap_features(tap.withColumnRenamed("path", "key")), files, F.concat("code", F.lit("-"))))
    return _united(spark, parts)


def assemble_opdc(spark: SparkSession, root: str) -> DataFrame:
    """``id`` and features of every session folder of smartphone tests: motion (accelerometer, gyroscope), taps, reaction and voice.

    Of files that repeat a measurement in a folder the last by name counts; nothing is deleted.
    """
    files = opdc_names(session_files(spark, root, (".csv", ".raw"))).withColumn("session", F.col("directory"))
    files = readers.latest(files, "directory", "measure", "name")
    parts, paths = [], lambda k: [r["path"] for r in files.where(F.col("kind") == k).select("path").collect()]
    for kind in ("accel", "gyro"):
        if own := paths(kind):
            parts.append(_named(motion.tremor_features(readers.opdc(spark, own).withColumnRenamed("path", "key"), value="mag_sum_acc"), files, F.col("measure")))
    if own := paths("tap"):
        parts.append(_named(tapping.tap_features(readers.ft_opdc(spark, own).withColumnRenamed("path", "key"), targets=False), files, F.col("measure")))
    if own := paths("react"):
        wide = tapping.reaction_times(readers.opdc_react(spark, own).withColumnRenamed("path", "key"))
        names = [c for c in wide.columns if c != "key"]
        parts.append(_named(wide.select("key", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names]))), files, F.col("measure")))
    if own := paths("audio"):
        parts.append(_named(_voice(spark, own), files, F.col("measure")))
    return _united(spark, parts)


def _voice(spark: SparkSession, paths: list[str]) -> DataFrame:
    from motionloom.functions import voice

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, fs, x in zip(b["path"], b["fs"], b["samples"], strict=True):
                got = voice.voice_measures(x.astype(float), int(fs))
                yield pd.DataFrame({"key": path, "feature": list(got), "value": [float(v) for v in got.values()]})

    return readers.read_audio(spark, paths).mapInPandas(run, "key string, feature string, value double")


def _any(files: DataFrame, pattern: str) -> bool:
    return not files.where(F.col("name").rlike(pattern)).isEmpty()


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "id string")
    long = parts[0]
    for p in parts[1:]:
        long = long.union(p)
    return _matrix(spark, long)
