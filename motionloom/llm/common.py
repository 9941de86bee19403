"""Shared helpers: table access, the shared work folder, byte-level word rules and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing and word rule of the text operators: only A-Z change, only ASCII white space separates.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WORD_RULE = "[^\\x20\\x09-\\x0D]+"
#: The planner gives sources of unknown size a figure beyond this.
UNKNOWN_BYTES = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset in a local session a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    made = tempfile.mkdtemp(prefix="motionloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motionloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder is then left to the cluster's own cleaning
        return


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of what ``docs`` is read from: file sizes as the planner knows them, or where it doesn't, those of its texts."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    if total < UNKNOWN_BYTES:
        return total
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).head()[0] or 0)


def freed(run):
    """``run``, a function over a task's batches, that gives its memory back to the system when it ends: workers live on for other stages."""

    @wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
            ctypes.CDLL(None).malloc_trim(0)

    return task


#: Partial sums that one task adds up, and how often: FAN_IN ** LEVELS partitions leave one sum each.
FAN_IN, LEVELS = 64, 3


def tree_sum(df: DataFrame, size: int, one) -> np.ndarray:
    """Sum over all batches of ``one(batch)``, an array of ``size``: by partition, then FAN_IN partial sums a task, level by level.

    However many partitions there are, no task adds more than FAN_IN sums, and the driver gets one for each
    FAN_IN ** LEVELS partitions.
    """

    def part(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += one(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["k", "s"])

    def more(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(x))
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zstandard.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["k", "s"])

    sums = df.mapInArrow(part, "k long, s binary")
    for _ in range(LEVELS):
        sums = sums.select(F.floor(F.col("k") / FAN_IN).alias("k"), "s").repartition("k").mapInArrow(more, "k long, s binary")
    return np.sum([np.zeros(size), *(np.frombuffer(zstandard.decompress(r["s"])) for r in sums.collect())], axis=0)


def id_crc_mod(id_col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def _stars(e: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is a ``u`` itself."""
    up = e.groupBy("u").agg(F.count("*").alias("n"))
    return up.where("n > 1").isEmpty() and up.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, label: str, src: str = "a", dst: str = "b") -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (two long columns): ``node``, ``component``.

    Alternates the large-star and small-star steps, each two grouped minima with map-side combining and a
    join that Spark may split where a node is hot; lineage is cut by a written table each round. Ends when the
    links are stars (every node has one link down, to a node that has none), so no link is lost however long chains are.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialise(e, label)
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        ms = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(ms, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(ms.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, label)
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
