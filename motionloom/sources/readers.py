"""Readers of thirteen recording formats into long tables: one row a sample, in file order (``path, seq, ...``).

Files are read as whole texts and split into lines with their numbers, so order never depends on the scan; values
that aren't numbers become null, and lines whose width differs from the file's first line are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = "-?\\d+\\.?\\d*"


def lines(spark: SparkSession, path: str, sep: str, skip_last: bool = False, comment: str | None = None) -> DataFrame:
    """``path, seq, f array<string>`` of well-formed lines. ``skip_last``: the last line goes, whatever it is."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    rows = text.select("path", F.posexplode(F.split(F.regexp_replace("value", "\\s+$", ""), "\r?\n")).alias("seq", "line")).where("trim(line) <> ''")
    if comment:
        rows = rows.where(~F.col("line").startswith(comment))
    w = Window.partitionBy("path")
    if skip_last:
        rows = rows.withColumn("last", F.max("seq").over(w)).where("seq < last").drop("last")
    rows = rows.withColumn("f", F.transform(F.split("line", sep), lambda x: F.trim(x)))
    return rows.withColumn("width", F.min_by(F.size("f"), "seq").over(w)).where(F.size("f") == F.col("width")).select("path", F.col("seq").cast("long").alias("seq"), "f")


def num(i: int) -> Column:
    return F.expr(f"try_cast(get(f, {i}) as double)")


def _since_first(c: str = "t") -> Column:
    return F.col(c) - F.first(c).over(Window.partitionBy("path").orderBy("seq"))


def motion(rows: DataFrame, t: Column, x: Column, y: Column, z: Column, per_second: float) -> DataFrame:
    """Canonical motion rows: seconds since the first sample, axes and magnitude; raw time in nanoseconds is kept."""
    got = rows.select("path", "seq", t.alias("t"), x.alias("x"), y.alias("y"), z.alias("z"))
    return got.select("path", "seq", (F.col("t") * (1e9 / per_second)).cast("long").alias("t_ns"), (_since_first() / per_second).alias("td"), "x", "y", "z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("mag_sum_acc"))


def cloudupdrs(spark, path):
    return motion(lines(spark, path, ","), num(0), num(1), num(2), num(3), 1e9)


def opdc(spark, path):
    return motion(lines(spark, path, ","), num(0), num(1), num(2), num(3), 1.0)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{schema}>>").alias("r"))
    return text.select("path", F.posexplode("r").alias("seq", "r")).select("path", F.col("seq").cast("long").alias("seq"), "r.*")


def mpower(spark, path):
    return motion(_json(spark, path, "timestamp double, x double, y double, z double"), F.col("timestamp"), F.col("x"), F.col("y"), F.col("z"), 1.0)


def _named(spark, path, sep, comment=None) -> DataFrame:
    """Lines behind a header: ``path, seq, m map<string,string>``."""
    rows = lines(spark, path, sep, comment=comment)
    w = Window.partitionBy("path")
    head = rows.withColumn("head", F.min_by("f", "seq").over(w)).withColumn("first", F.min("seq").over(w)).where("seq > first")
    return head.select("path", "seq", F.map_from_arrays("head", "f").alias("m"))


def _field(name: str) -> Column:
    return F.expr(f"try_cast(m['{name}'] as double)")


def segmented(spark, path):
    rows = _named(spark, path, ",").withColumn("ts", F.expr("try_cast(map_values(m)[0] as timestamp)"))
    return rows.select("path", "seq", "ts", *[_field(c).alias(c) for c in ("td", "x", "y", "z", "mag_sum_acc")], F.expr("m['segmentation']").alias("segmentation"))


FREEZE = ["ankle_f", "ankle_v", "ankle_l", "leg_f", "leg_v", "leg_l", "x", "y", "z"]


def freeze(spark, path):
    """Times stay in milliseconds, as in the annotated walks themselves."""
    rows = lines(spark, path, " +").select("path", "seq", num(0).alias("td"), *[num(k + 1).alias(c) for k, c in enumerate(FREEZE)], num(10).cast("int").alias("anno"))
    return rows.withColumn("mag_sum_acc", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))


def huga(spark, path):
    """No clock: samples are 17 ms apart, whole milliseconds of a rate of 58.82 Hz."""
    rows = _named(spark, path, "\t", "#")
    got = rows.select("path", "seq", *[_field(f"acc_lt_{a}").alias(a) for a in "xyz"]).withColumn("t", F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1)
    return motion(got, F.col("t") * int(1000 / 58.82), F.col("x"), F.col("y"), F.col("z"), 1000.0)


def physics(spark, path):
    return motion(_named(spark, path, ","), _field("time"), _field("x"), _field("y"), _field("z"), 1.0)


def accapp(spark, path):
    return motion(lines(spark, path, "\t"), num(1), num(2), num(3), num(4), 1000.0)


def _taps(rows: DataFrame, t: Column, action: Column, x: Column, y: Column, tx: Column, ty: Column, per_second: float) -> DataFrame:
    got = rows.select("path", "seq", t.alias("t"), action.alias("action_type"), x.alias("x"), y.alias("y"), tx.alias("x_target"), ty.alias("y_target"))
    return got.select("path", "seq", (_since_first() / per_second).alias("td"), "action_type", "x", "y", "x_target", "y_target")


def ft_cloudupdrs(spark, path):
    """The last line goes: it is the count of taps in most files, and a malformed one counts as the last."""
    return _taps(lines(spark, path, ",", skip_last=True), num(0), num(2), num(3), num(4), num(7), num(8), 1000.0)


def ft_opdc(spark, path):
    none = F.lit(None).cast("double")
    return _taps(lines(spark, path, ",", skip_last=True), num(0), F.lit(1.0), num(1), num(2), none, none, 1.0)


def ft_mpower(spark, path, left, right):
    """``left`` and ``right``: button rectangles (x, y, width, height) whose centres are the targets."""
    rows = _json(spark, path, "TapTimeStamp double, TapCoordinate string, TappedButtonId string")
    at = F.transform(F.regexp_extract_all("TapCoordinate", F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
    is_left = F.col("TappedButtonId") == "TappedButtonLeft"
    centre = lambda r, k: F.lit(float(r[k] + r[k + 2] / 2))
    return _taps(rows, F.col("TapTimeStamp"), F.lit(1.0), F.get(at, 0), F.get(at, 1), F.when(is_left, centre(left, 0)).otherwise(centre(right, 0)), F.when(is_left, centre(left, 1)).otherwise(centre(right, 1)), 1.0)


def opdc_react(spark, path):
    rows = lines(spark, path, ",", skip_last=True).select("path", "seq", num(0).alias("t"), num(1).alias("x"), num(2).alias("y"), (num(3) != 0).alias("b_vis"), (num(4) == 1).alias("b_pres"))
    return rows.select("path", "seq", _since_first().alias("td"), "x", "y", "b_vis", "b_pres").na.fill(0.0)


READERS: dict[str, Callable] = {
    "cloudupdrs": cloudupdrs, "hopkinsdp": cloudupdrs, "opdc": opdc, "mpower": mpower, "segmented": segmented, "freeze": freeze, "huga": huga, "physics": physics,
    "accapp": accapp, "ft_cloudupdrs": ft_cloudupdrs, "ft_opdc": ft_opdc, "ft_mpower": ft_mpower, "opdc_react": opdc_react,
}


def read_recording(spark: SparkSession, path: str, fmt: str = "cloudupdrs", strict: bool = False, **options) -> DataFrame:
    """Rows of all recordings under ``path``; a name that isn't known is read like the default format, or with ``strict`` refused."""
    if strict and fmt not in READERS:
        raise ValueError(f"no format {fmt!r}; known: {', '.join(READERS)}")
    return READERS.get(fmt, cloudupdrs)(spark, path, **options)


def read_audio(spark: SparkSession, path: str | list[str], rate: int = 44_100) -> DataFrame:
    """``path, fs, samples array<float>``: WAV files by their header, other files as raw 16-bit mono at ``rate``. One file at a time is decoded."""

    def run(batches):
        import pyarrow as pa

        from motionloom.functions.audio import decode

        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                fs, samples = decode(content.as_py(), rate)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([fs], pa.int32()), pa.array([samples], pa.list_(pa.float32()))], names=["path", "fs", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, fs int, samples array<float>")


RANGES = {
    "motion": {"td": (-1, 1000), "x": (-100, 100), "y": (-100, 100), "z": (-100, 100), "mag_sum_acc": (-100, 100)},
    "tap": {"td": (-1, 10_000), "action_type": (0, 1), "x": (-10_000, 10_000), "y": (-10_000, 10_000), "x_target": (-10_000, 10_000), "y_target": (-10_000, 10_000)},
    "tap_plain": {"td": (-1, 10_000), "action_type": (0, 1), "x": (-10_000, 10_000), "y": (-10_000, 10_000)},
}


def validated(rows: DataFrame, kind: str, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows of recordings all of whose values lie in range, keys of the others). A null is out of range."""
    ok = F.lit(True)
    for c, (low, high) in RANGES[kind].items():
        ok = ok & F.coalesce(F.col(c).between(low, high), F.lit(False))
    bad = rows.groupBy(key).agg(F.bool_and(ok).alias("ok")).where("not ok").select(key)
    return rows.join(bad, key, "left_anti"), bad


def sampling_rate(rows: DataFrame, key: str = "path") -> DataFrame:
    """Mean number of samples a second within the first minute."""
    per = rows.where("td < 60").groupBy(key, F.floor("td").alias("s")).count()
    return per.groupBy(key).agg(F.avg("count").alias("sampling_rate"))


def name_parts(paths: DataFrame, column: str = "path") -> DataFrame:
    """``session`` (number before the extension) and ``code`` (initials of the words behind the type, a hyphen kept)."""
    name = F.element_at(F.split(column, "/"), -1)
    words = F.split(F.regexp_replace(F.regexp_replace(name, "_?\\d*\\.csv$", ""), "^[A-Z]+_-_", ""), "_")
    initials = F.array_join(F.transform(F.filter(words, lambda w: F.length(w) > 0), lambda w: F.left(w, F.lit(1))), "")
    return paths.withColumn("session", F.regexp_extract(name, "_(\\d+)\\.csv", 1)).withColumn("code", initials)


def latest(paths: DataFrame, directory: str, prefix: str, name: str) -> DataFrame:
    """The last file by name of each prefix in each directory; nothing is deleted."""
    w = Window.partitionBy(directory, prefix).orderBy(F.desc(name))
    return paths.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
