"""Feature sets of whole motion recordings, each one pass over a recording's ordered samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.functions import signal
from motionloom.operators.series import by_kernel


def tremor_features(rows: DataFrame, prefix: str = "", value: str = "v", time: str = "td") -> DataFrame:
    """Long rows ``key, feature, value`` of the 34 tremor features of recordings ``key, seq, time, value``."""
    got = by_kernel(rows, lambda t, x: {"m": {k: float(v) for k, v in signal.tremor_features(t, x).items()}}, "m map<string,double>", [time, value])
    return got.select("key", F.explode("m").alias("feature", "value")).withColumn("feature", F.concat(F.lit(prefix), "feature"))


GAIT = """number_of_steps int, cadence double, velocity double, avg_step_length double, avg_stride_length double, step_durations array<double>, avg_step_duration double,
sd_step_durations double, strides array<array<double>>, stride_durations array<array<double>>, avg_number_of_strides double, avg_stride_duration double,
sd_stride_durations double, step_regularity double, stride_regularity double, symmetry double""".replace("\n", " ")


def gait_summary(rows: DataFrame, rate: float = 100.0, distance: float | None = None, value: str = "v") -> DataFrame:
    """The sixteen fields of each walk; lengths and velocity are null without a ``distance``."""
    return by_kernel(rows, lambda x: signal.gait_summary(x, rate, distance), GAIT, value)


def regularity_by_axis(rows: DataFrame, axes: list[str], delta: float = 0.5) -> DataFrame:
    """``key, step, stride, symmetry``: an array each, one value an axis."""

    def kernel(*xs):
        each = [signal.step_regularity(x, delta) for x in xs]
        return {n: [float(e[k]) for e in each] for k, n in enumerate(("step", "stride", "symmetry"))}

    return by_kernel(rows, kernel, "step array<double>, stride array<double>, symmetry array<double>", axes)


def clustered_peaks(rows: DataFrame, cluster: Callable | None = None, value: str = "v") -> DataFrame:
    """``key, seq, prominence, cluster`` of every peak. ``cluster`` takes an array of prominences and gives their labels
    (an object's ``fit_predict`` on a column vector fits as ``lambda p: model.fit_predict(p.reshape(-1, 1))``); two means without one."""
    label = cluster or signal.two_means

    def kernel(x):
        p = signal.find_peaks(x)
        prominence = signal.prominences(x, p)
        return {"r": [{"seq": int(i), "prominence": float(v), "cluster": int(c)} for i, v, c in zip(p, prominence, label(prominence) if len(p) else [], strict=True)]}

    return by_kernel(rows, kernel, "r array<struct<seq: bigint, prominence: double, cluster: int>>", value).select("key", F.inline("r"))


def walks_and_turns(rows: DataFrame, smooth: int = 3, value: str = "v") -> DataFrame:
    """``key, kind ("walk" or "turn"), part, peaks``: runs of peaks of one cluster, numbered in each kind."""

    def kernel(x):
        return {"r": [{"kind": kind, "part": k, "peaks": run} for kind, runs in zip(("walk", "turn"), signal.walks_and_turns(x, smooth), strict=True) for k, run in enumerate(runs)]}

    return by_kernel(rows, kernel, "r array<struct<kind: string, part: int, peaks: array<bigint>>>", value).select("key", F.inline("r"))
