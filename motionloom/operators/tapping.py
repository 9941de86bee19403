"""Finger-tapping and reaction metrics, one row a recording. Rows have ``key, seq (from 0), td, action_type, x, y, x_target, y_target``.

Metrics over steps use pairs of neighbouring rows of one kind without the last pair, as recorded values have it; of
those only steps with an odd number (from 0) count where a mean over alternating taps is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(taps: DataFrame, action: float) -> DataFrame:
    w = Window.partitionBy("key").orderBy("seq")
    own = taps.where(F.col("action_type") == action)
    return own.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("key")))


def uncounted(taps: DataFrame) -> DataFrame:
    """``taps`` without the last row of each recording."""
    return taps.withColumn("end", F.max("seq").over(Window.partitionBy("key"))).where("seq < end").drop("end")


def _steps(rows: DataFrame, value: Column, crop: bool = False) -> DataFrame:
    """``value`` may use lead columns ``td1, x1, y1``; the last pair of each recording is left out, cropped the last two."""
    w = Window.partitionBy("key").orderBy("seq")
    led = rows.select("*", *[F.lead(c).over(w).alias(f"{c}1") for c in ("td", "x", "y")])
    return led.where(f"i < n - {3 if crop else 2}").select("key", "i", value.alias("v"))


def durations(taps: DataFrame, crop: bool = False) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return taps.withColumn("back", F.row_number().over(w)).where(F.col("back") == (2 if crop else 1)).select("key", F.ceil("td").alias("duration"), F.col("td").alias("td_end"))


def frequency(taps: DataFrame, crop: bool = False) -> DataFrame:
    """Raised taps a second; cropping takes one from the rate, as recorded values have it."""
    got = taps.groupBy("key").agg((F.count_if(F.col("action_type") == 1) / F.max_by("td", "seq")).alias("v"))
    return got.select("key", (F.col("v") - (1 if crop else 0)).alias("frequency"))


def moving_frequency(taps: DataFrame, window: int = 6) -> DataFrame:
    """Relative changes of the tap rate over sliding windows of ``window`` seconds, the last pair left out."""
    last = taps.groupBy("key").agg(F.max_by("td", "seq").alias("last"))
    grid = last.where(F.col("last").cast("long") - window - 1 > 0).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long") - window - 2)).alias("i"))
    hits = taps.where("action_type = 1").select("key", F.explode(F.sequence(F.greatest(F.floor("td") - window, F.lit(0)).cast("long"), F.floor("td").cast("long"))).alias("i"), "td").where(f"i <= td and td < i + {window}")
    f = grid.join(hits.groupBy("key", "i").count(), ["key", "i"], "left").select("key", "i", (F.coalesce("count", F.lit(0)) / window).alias("f"))
    w = Window.partitionBy("key").orderBy("i")
    led = f.select("key", "i", "f", F.lead("f").over(w).alias("f1"), F.lead("f", 2).over(w).alias("f2")).where("f2 is not null")
    return led.select("key", "i", F.when(F.col("f") != 0, (F.col("f1") - F.col("f")) / F.col("f")).alias("moving_frequency"))


def continuous_frequency(taps: DataFrame) -> DataFrame:
    d = F.col("td1") - F.col("td")
    return _steps(_ranked(taps, 1.0), F.when(d != 0, 1 / d)).select("key", "i", F.col("v").alias("continuous_frequency"))


def mean_moving_time(taps: DataFrame, crop: bool = False) -> DataFrame:
    """Milliseconds, over odd steps."""
    got = _steps(_ranked(taps, 1.0), F.col("td1") - F.col("td"), crop)
    return got.where("i % 2 = 1").groupBy("key").agg((F.avg("v") * 1000).alias("mean_moving_time"))


def incoordination(taps: DataFrame, legacy: bool = False, crop: bool = False) -> DataFrame:
    """Population variance (milliseconds scale) of odd steps from a raise to the next touch, paired by ordinal; cropped without the
    last touch's. ``legacy``: all pairs."""
    down = _ranked(taps, 0.0).select("key", (F.col("i") - 1).alias("i"), F.col("td").alias("d"), F.col("n").alias("nd"))
    up = _ranked(taps, 1.0).select("key", "i", F.col("td").alias("u"), F.col("n").alias("nu"))
    got = down.where("i < nd - 2" if crop else "true").where("i >= 0").join(up.where("i < nu - 1"), ["key", "i"]).select("key", "i", (F.col("d") - F.col("u")).alias("v"))
    return (got if legacy else got.where("i % 2 = 1")).groupBy("key").agg((F.var_pop("v") * 1000).alias("incoordination_score"))


def alternate_distance(taps: DataFrame, legacy: bool = False, crop: bool = False) -> DataFrame:
    """Mean distance of odd steps between touches. ``legacy``: between all rows."""
    rows = taps.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("key"))) if legacy else _ranked(taps, 0.0)
    got = _steps(rows, F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2), crop)
    return got.where("i % 2 = 1").groupBy("key").agg(F.avg("v").alias("mean_alnt_target_distance"))


def kinesia(taps: DataFrame, crop: bool = False) -> DataFrame:
    return taps.groupBy("key").agg((F.count_if(F.col("action_type") == 1) - (1 if crop else 0)).alias("kinesia_scores"))


def akinesia(taps: DataFrame, crop: bool = False) -> DataFrame:
    """Absolute mean of touch minus raise, paired by ordinal up to the shorter list; cropped without the recording's last row."""
    taps = uncounted(taps) if crop else taps
    down = _ranked(taps, 0.0).select("key", "i", F.col("td").alias("d"))
    up = _ranked(taps, 1.0).select("key", "i", F.col("td").alias("u"))
    return down.join(up, ["key", "i"]).groupBy("key").agg(F.abs(F.avg(F.col("d") - F.col("u"))).alias("akinesia_times"))


def dysmetria(taps: DataFrame, crop: bool = False) -> DataFrame:
    """Mean distance of touches from their target; cropped without the recording's last row."""
    taps = uncounted(taps) if crop else taps
    return taps.where("action_type = 0").groupBy("key").agg(F.avg(F.sqrt((F.col("x") - F.col("x_target")) ** 2 + (F.col("y") - F.col("y_target")) ** 2)).alias("dysmetria_score"))


def tap_features(taps: DataFrame, prefix: str = "", targets: bool = True, crop: bool = False) -> DataFrame:
    """Long rows ``key, feature, value``: seven features, six without targets; ``crop`` as each feature has it.

    One ordering ranks touches and raises alike, one aggregation gives all features; only pairs by ordinal meet again,
    as sums over ranks inside it.
    """
    w = Window.partitionBy("key", "action_type").orderBy("seq")
    of = Window.partitionBy("key", "action_type")
    led = taps.select("key", "seq", "td", "action_type", "x", "y", *(["x_target", "y_target"] if targets else []), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(of).alias("n"), *[F.lead(c).over(w).alias(f"{c}1") for c in ("td", "x", "y")])
    down, up = F.col("action_type") == 0, F.col("action_type") == 1
    odd_step = (F.col("i") < F.col("n") - (3 if crop else 2)) & (F.col("i") % 2 == 1)
    far = lambda a, b, c, e: F.sqrt((F.col(a) - F.col(b)) ** 2 + (F.col(c) - F.col(e)) ** 2)
    touches, raises = F.collect_list(F.when(down, F.struct("i", "td", "seq"))), F.collect_list(F.when(up, F.struct("i", "td", "seq")))
    missed = F.when(down, far("x", "x_target", "y", "y_target")) if targets else F.lit(None).cast("double")
    got = led.groupBy("key").agg(
        F.count_if(up).alias("ups"), F.max_by("td", "seq").alias("last"),
        F.avg(F.when(up & odd_step, F.col("td1") - F.col("td"))).alias("moving"),
        F.avg(F.when(down & odd_step, far("x1", "x", "y1", "y"))).alias("alternate"),
        F.array_sort(touches).alias("d"), F.array_sort(raises).alias("u"),
        F.sum(missed).alias("missed"), F.count(missed).alias("hits"), F.max_by(F.struct(missed.alias("x")), "seq").alias("end"), F.max("seq").alias("stop"),
    )
    counted = lambda c: F.filter(c, lambda r: r["seq"] < F.col("stop")) if crop else F.col(c)
    both = F.least(F.size(counted("d")), F.size(counted("u")))
    paired = F.transform(F.sequence(F.lit(0), both - 1), lambda i: F.get("d", i)["td"] - F.get("u", i)["td"])
    # raise i and the touch after it, whose ordinal is one more; the last raise has none that counts
    few = F.least(F.size("d") - (2 if crop else 1), F.size("u") - 1)
    after = F.transform(F.filter(F.sequence(F.lit(0), few - 1), lambda i: i % 2 == 1), lambda i: F.get("d", i + 1)["td"] - F.get("u", i)["td"])
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    with_gaps = got.select("*", F.when(both > 0, paired).alias("pairs"), F.when(few > 1, after).alias("gaps"))
    centred = F.transform("gaps", lambda x: (x - mean(F.col("gaps"))) * (x - mean(F.col("gaps"))))
    last = F.when(F.col("end.x").isNotNull(), 1).otherwise(0)
    off = F.when(F.col("hits") > last, (F.col("missed") - F.coalesce("end.x", F.lit(0.0))) / (F.col("hits") - last)) if crop else F.when(F.col("hits") > 0, F.col("missed") / F.col("hits"))
    features = {
        "frequency": F.col("ups") / F.col("last") - (1 if crop else 0), "mean_moving_time": F.col("moving") * 1000,
        "incoordination_score": F.when(F.size("gaps") > 0, mean(centred) * 1000), "mean_alnt_target_distance": F.col("alternate"),
        "kinesia_scores": F.col("ups") - (1 if crop else 0), "akinesia_times": F.abs(mean(F.col("pairs"))), **({"dysmetria_score": off} if targets else {}),
    }
    return with_gaps.select("key", F.explode(F.array(*[F.struct(F.lit(prefix + n).alias("feature"), c.cast("double").alias("value")) for n, c in features.items()])).alias("r")).select("key", "r.*")


def reaction_times(rows: DataFrame, fixed: bool = False) -> DataFrame:
    """Mean press, release and total times of recordings ``key, seq, td, b_vis, b_pres``.

    A button that shows starts an entry, a press ends the waiting, a release ends the press. As recorded values have it
    the release entry repeats the press interval; ``fixed`` takes the true one.
    """
    ordered = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "td", "b_vis", "b_pres"))).alias("r"))
    start = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in (("state", 0), ("shown", 0), ("pressed", 0), ("press", 0), ("release", 0), ("entries", 0))])

    def step(a, r):
        shows, presses, lifts = (a.state == 0) & r.b_vis & ~r.b_pres, (a.state == 1) & r.b_pres, (a.state == 2) & ~r.b_pres
        down = a.pressed - a.shown
        up = (r.td - a.pressed) if fixed else down
        return F.struct(
            F.when(shows, 1.0).when(presses, 2.0).when(lifts, 0.0).otherwise(a.state).alias("state"), F.when(shows, r.td).otherwise(a.shown).alias("shown"), F.when(presses, r.td).otherwise(a.pressed).alias("pressed"),
            F.when(presses, a.press + (r.td - a.shown)).otherwise(a.press).alias("press"), F.when(lifts, a.release + up).otherwise(a.release).alias("release"), F.when(presses | lifts, a.entries + 1).otherwise(a.entries).alias("entries"),
        )

    got = ordered.select("key", F.aggregate("r", start, step).alias("a")).where("a.entries > 0")
    press, release = F.col("a.press") / F.col("a.entries"), F.col("a.release") / F.col("a.entries")
    return got.select("key", press.alias("mean_press_button_time"), release.alias("mean_release_button_time"), (press + release).alias("mean_total_reaction_time"))
