"""Operators over ordered series: rows ``key, seq (from 0), v`` and, where time matters, ``td`` in seconds.

Everything here is DataFrame functions; each operator needs the rows of a key together once, so a chain of them
shares one exchange on ``key``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def in_order():
    return Window.partitionBy("key").orderBy("seq")


def whole():
    return Window.partitionBy("key")


def relative_time(rows: DataFrame, micros: str) -> DataFrame:
    return rows.withColumn("td", (F.col(micros) - F.first(micros).over(in_order())) / 1e6)


def centred(rows: DataFrame, column: str = "v", out: str = "dc_v") -> DataFrame:
    return rows.withColumn(out, F.col(column) - F.avg(column).over(whole()))


def zero_before_positive(rows: DataFrame) -> DataFrame:
    """Centre, then zero everything before the first positive value."""
    c = centred(rows)
    first = F.min(F.when(F.col("dc_v") > 0, F.col("seq"))).over(whole())
    return c.withColumn("dc_v", F.when(F.col("seq") < F.coalesce(first, F.lit(1 << 62)), 0.0).otherwise(F.col("dc_v")))


def cut(rows: DataFrame, start: int = 0, stop: int = -1) -> DataFrame:
    """Positional slice [start, stop), negative stops from the end; positions start at 0 again."""
    n = F.count("*").over(whole())
    end = n + stop if stop < 0 else F.lit(stop)
    return rows.withColumn("end", end).where((F.col("seq") >= start) & (F.col("seq") < F.col("end"))).withColumn("seq", F.col("seq") - start).drop("end")


def difference(rows: DataFrame) -> DataFrame:
    return rows.select("key", "seq", (F.col("v") - F.lag("v").over(in_order())).alias("d")).where("d is not null")


def cumulative(rows: DataFrame) -> DataFrame:
    return rows.select("key", "seq", F.sum("v").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def teager(rows: DataFrame) -> DataFrame:
    sides = F.lag("v").over(in_order()) * F.lead("v").over(in_order())
    return rows.select("key", "seq", (F.col("v") * F.col("v") - F.coalesce(sides, F.lit(0.0))).alias("tkeo"))


def falls_through_zero(rows: DataFrame) -> DataFrame:
    return rows.withColumn("next", F.lead("v").over(in_order())).where("v > 0 and next <= 0").select("key", "seq")


def count_peaks(rows: DataFrame, n: int = 5) -> DataFrame:
    """Values over all of ``n`` neighbours on each side; edges don't count."""
    left, right = in_order().rowsBetween(-n, -1), in_order().rowsBetween(1, n)
    got = rows.withColumn("l", F.max("v").over(left)).withColumn("r", F.max("v").over(right)).withColumn("n", F.count("*").over(whole()))
    hit = (F.col("v") > F.col("l")) & (F.col("v") > F.col("r")) & (F.col("seq") >= n) & (F.col("seq") < F.col("n") - n)
    return got.groupBy("key").agg(F.count_if(hit).alias("peaks"))


def local_peaks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("l", F.lag("v").over(in_order())).withColumn("r", F.lead("v").over(in_order())).where("v > l and v > r").select("key", "seq", "v")


def runs(rows: DataFrame, label: str, shortest: int = 1, keep: list | None = None, closed: bool = False) -> DataFrame:
    """Stretches of one label that are longer than ``shortest``: ``key, label, first, last``.

    ``keep``: only of these labels. ``closed``: only stretches that another label ends, as recorded sections have it, where
    the last one of a recording stays open and goes; without it the last one counts like any other.
    """
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(in_order())) & (F.lag("seq").over(in_order()).isNotNull()), 0).otherwise(1)
    ranked = rows.withColumn("change", change).withColumn("run", F.sum("change").over(in_order()))
    if closed:
        ranked = ranked.withColumn("end", F.max("seq").over(whole()))
    got = ranked.groupBy("key", "run").agg(F.first(label).alias("label"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"), *([F.max("end").alias("end")] if closed else [])).where(F.col("n") > shortest)
    if closed:
        got = got.where("last < end")
    return (got if keep is None else got.where(F.col("label").isin(keep))).select("key", "label", "first", "last")


def bins(rows: DataFrame, step: float) -> DataFrame:
    """Mean of each bin of ``step`` seconds from the first sample on: ``key, bin, v``."""
    return rows.groupBy("key", F.floor(F.col("td") / step).alias("bin")).agg(F.avg("v").alias("v"))


def resample(rows: DataFrame, step: float) -> DataFrame:
    """Bins of ``step`` seconds, empty ones filled linearly between their neighbours."""
    b = bins(rows, step)
    grid = b.groupBy("key").agg(F.max("bin").alias("last")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    return interpolate(grid.join(b, ["key", "bin"], "left"), "bin")


def interpolate(rows: DataFrame, at: str) -> DataFrame:
    """Linear interpolation of null ``v`` at positions ``at``: an as-of look back, and one in descending order for the look ahead.

    Both windows run from the start of their order to the current row, so a recording costs its length.
    """
    known = F.when(F.col("v").isNotNull(), F.struct(F.col(at).cast("double").alias("x"), F.col("v").alias("y")))
    so_far = lambda order: Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("p", F.last(known, True).over(so_far(F.asc(at)))).withColumn("q", F.last(known, True).over(so_far(F.desc(at))))
    line = F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (F.col(at) - F.col("p.x")) / (F.col("q.x") - F.col("p.x"))
    return got.select("key", at, F.coalesce("v", line).alias("v"))


def frames(rows: DataFrame, size: int, hop: int) -> DataFrame:
    """Full sliding frames as arrays: ``key, frame, values``."""
    arrays = ordered(rows)
    last = F.size("values") - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return arrays.select("key", F.posexplode(F.transform(at, lambda i: F.slice("values", i + 1, size))).alias("frame", "values"))


def ordered(rows: DataFrame, value: str = "v") -> DataFrame:
    """One array a key, in order: ``key, values``."""
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("x")))), lambda r: r.x).alias("values"))


def spectrum_line(rows: DataFrame, k: int) -> DataFrame:
    """Real part, imaginary part and magnitude of one Fourier coefficient, as two sums."""
    n = rows.withColumn("n", F.count("*").over(whole()))
    angle = 2 * math.pi * k * F.col("seq") / F.col("n")
    got = n.groupBy("key").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), (-F.sum(F.col("v") * F.sin(angle))).alias("im"))
    return got.withColumn("magnitude", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))


def autocorrelation(rows: DataFrame, lag: int) -> DataFrame:
    led = rows.withColumn("mu", F.avg("v").over(whole())).withColumn("other", F.lead("v", lag).over(in_order()))
    got = led.groupBy("key").agg(F.sum((F.col("v") - F.col("mu")) * (F.col("other") - F.col("mu"))).alias("s"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    return got.where(f"n > {lag} and var > 0").select("key", (F.col("s") / ((F.col("n") - lag) * F.col("var"))).alias("autocorrelation"))


def linear_trend(rows: DataFrame, size: int, aggregate: Callable[[Column], Column]) -> DataFrame:
    """Intercept, slope and correlation of chunk aggregates against the chunk's number; a short last chunk counts."""
    chunks = rows.groupBy("key", F.floor(F.col("seq") / size).alias("chunk")).agg(aggregate(F.col("v")).alias("a")).where("a is not null")
    return chunks.groupBy("key").agg(F.regr_intercept("a", "chunk").alias("intercept"), F.regr_slope("a", "chunk").alias("slope"), F.corr("chunk", "a").alias("rvalue"))


def change_in_corridor(rows: DataFrame, low: float = 0.0, high: float = 0.2) -> DataFrame:
    """Mean absolute change of neighbours that both lie between two quantiles; 0 if there are none."""
    q = rows.groupBy("key").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"))
    led = rows.withColumn("next", F.lead("v").over(in_order())).join(q, "key")
    inside = lambda c: (F.col(c) >= F.col("q")[0]) & (F.col(c) <= F.col("q")[1])
    return led.groupBy("key").agg(F.coalesce(F.avg(F.when(inside("v") & inside("next"), F.abs(F.col("next") - F.col("v")))), F.lit(0.0)).alias("change"))


def moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("v").alias("minimum"), F.avg("v").alias("mean"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum_values"), F.sum(F.col("v") * F.col("v")).alias("abs_energy"))


def recurring(rows: DataFrame) -> DataFrame:
    """Distinct values over all, points and distinct values that occur again: three ratios."""
    per = rows.groupBy("key", "v").agg(F.count("*").alias("n"))
    again = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return per.groupBy("key").agg((F.count("*") / F.sum("n")).alias("distinct_ratio"), (F.sum(again) / F.sum("n")).alias("recurring_points"), (F.count_if(F.col("n") > 1) / F.count("*")).alias("recurring_values"))


def nearest_label(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """Stamp intervals ``label, start, end, priority`` on samples ``seq``; of several the last one given wins."""
    hit = samples.join(intervals, (F.col("seq") >= F.col("start")) & (F.col("seq") <= F.col("end")), "left")
    return hit.groupBy("key", "seq").agg(F.max_by("label", "priority").alias("label"))


def by_kernel(rows: DataFrame, kernel: Callable, schema: str, value: str | list[str] = "v") -> DataFrame:
    """Apply ``kernel(values, ...) -> dict`` to each key's ordered arrays, one for each name in ``value``: ``key`` and the columns of ``schema``.

    The exchange and the ordering are Spark's; Python sees one Arrow batch of recordings at a time.
    """
    values = [value] if isinstance(value, str) else list(value)
    held = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(values)]))).alias("r"))
    arrays = held.select("key", *[F.col("r").getField(f"x{k}").alias(f"x{k}") for k in range(len(values))])
    types = parsed(schema)
    key = dict(arrays.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            got = [kernel(*(np.asarray(v, float) for v in each)) for each in zip(*(b[f"x{k}"] for k in range(len(values))), strict=True)]
            yield pd.DataFrame({"key": b["key"], **{n: [g.get(n) for g in got] for n in types}})

    return arrays.mapInPandas(run, f"key {key}, {schema}")


def parsed(schema: str) -> list[str]:
    """Column names of a schema string."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def filtered(rows: DataFrame, columns: list[str], kernel: Callable, keep: list[str] | None = None) -> DataFrame:
    """``kernel`` over each of ``columns`` of every recording: ``key, seq``, those columns filtered, and ``keep`` as they are."""
    keep = keep or []
    if missing := [c for c in keep if c not in rows.columns]:
        raise ValueError(f"no such columns: {missing}")
    done = by_kernel(rows, lambda *xs: {c: kernel(x).tolist() for c, x in zip(columns, xs, strict=True)}, ", ".join(f"`{c}` array<double>" for c in columns), columns)
    flat = done.select("key", F.posexplode(F.arrays_zip(*columns)).alias("at", "r")).select("key", F.col("at").cast("long").alias("at"), *[F.col("r")[c].alias(c) for c in columns])
    order = rows.select("key", "seq", *keep).withColumn("at", (F.row_number().over(in_order()) - 1).cast("long"))
    return order.join(flat, ["key", "at"]).select("key", "seq", *columns, *keep)


def resample_columns(rows: DataFrame, columns: list[str], step: float) -> DataFrame:
    """:func:`resample` of several columns on one grid: ``key, bin`` and the columns."""
    b = rows.groupBy("key", F.floor(F.col("td") / step).alias("bin")).agg(*[F.avg(c).alias(c) for c in columns])
    grid = b.groupBy("key").agg(F.max("bin").alias("last")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    got = grid.join(b, ["key", "bin"], "left")
    so_far = lambda order: Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("bin").cast("double").alias("x"), F.col(c).alias("y")))
        got = got.withColumn("p", F.last(known, True).over(so_far(F.asc("bin")))).withColumn("q", F.last(known, True).over(so_far(F.desc("bin"))))
        line = F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (F.col("bin") - F.col("p.x")) / (F.col("q.x") - F.col("p.x"))
        got = got.withColumn(c, F.coalesce(c, line))
        out.append(c)
    return got.select("key", "bin", *out)
