"""Registered queries: every operator over stand-in recordings from the standing tables, with its SQL.

Stand-ins: E, each user's events as an irregular series (ties of time broken by event id); T, the same as taps
(a click is a raise); V, each embedding as 64 uniform samples; X, each supplier's line items as a three-axis recording.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.functions import signal
from motionloom.operators import motion, scoring, series, tapping
from motionloom.plans import oracles, registry
from motionloom.plans.registry import query

E_CTE = """e AS (
  SELECT user_id AS key, row_number() OVER w - 1 AS seq, epoch_us(ts) AS us, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS td, value AS v,
    CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS action, event_type, (event_id % 100)::DOUBLE AS y
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
V_CTE = "v AS (SELECT vec_id AS key, unnest(range(0, len(embedding))) AS seq, unnest(embedding)::DOUBLE AS v FROM embeddings)"
X_CTE = """x AS (SELECT l_suppkey AS key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)"""


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """E: ``key, seq, us, td, v, action, event_type, y``."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select("key", (F.row_number().over(w) - 1).cast("long").alias("seq"), us.alias("us"), F.col("value").alias("v"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("action"), "event_type", (F.col("event_id") % 100).cast("double").alias("y"))
    return series.relative_time(rows, "us")


def taps(spark: SparkSession, d: str) -> DataFrame:
    return recordings(spark, d).select("key", "seq", "td", F.col("action").alias("action_type"), F.col("v").alias("x"), "y", F.lit(50.0).alias("x_target"), F.lit(50.0).alias("y_target"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    got = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("seq", "v"))
    return got.select("key", F.col("seq").cast("long").alias("seq"), F.col("v").cast("double").alias("v"))


def axes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return li.select("key", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def by_sample(df: DataFrame, column: str, at: str = "seq") -> DataFrame:
    """One row for each element of an array column: ``key``, its place as ``at`` and the element under the column's name."""
    return df.select("key", F.posexplode(column).alias("place", "value")).select("key", F.col("place").cast("long").alias(at), F.col("value").alias(column))


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# projections and filters


@query(f"WITH {X_CTE} SELECT key, seq, {r('sqrt(x * x + y * y + z * z)', 'magnitude')} FROM x")
def p01_magnitude(spark, d):
    return rounded(axes(spark, d).select("key", "seq", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("magnitude")))


@query(f"WITH {E_CTE} SELECT key, seq, {r('td', 'td')} FROM e")
def p02_relative_time(spark, d):
    return rounded(recordings(spark, d).select("key", "seq", "td"))


@query(f"WITH {E_CTE} SELECT key, bool_and(td BETWEEN -1 AND 2000000 AND v BETWEEN 0 AND 90) AS valid FROM e GROUP BY key")
def p03_range_validation(spark, d):
    return recordings(spark, d).groupBy("key").agg(F.bool_and(F.col("td").between(-1, 2000000) & F.col("v").between(0, 90)).alias("valid"))


@query(f"WITH {E_CTE} SELECT key, seq, v FROM e WHERE action = 1")
def p04_action_filter(spark, d):
    return recordings(spark, d).where("action = 1").select("key", "seq", "v")


@query(f"WITH {E_CTE}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM e) SELECT key, seq - 2 AS seq, v FROM n WHERE seq >= 2 AND seq < n - 3")
def p05_cut(spark, d):
    return series.cut(recordings(spark, d).select("key", "seq", "v"), 2, -3)


@query(f"WITH {E_CTE} SELECT key, seq, {r('v - avg(v) OVER (PARTITION BY key)', 'dc_v', 9)} FROM e")
def p06_dc_remove(spark, d):
    return rounded(series.centred(recordings(spark, d)).select("key", "seq", "dc_v"), 9)


@query(f"""WITH {V_CTE}, c AS (SELECT key, seq, v - avg(v) OVER (PARTITION BY key) AS c FROM v), f AS (SELECT *, min(CASE WHEN c > 0 THEN seq END) OVER (PARTITION BY key) AS first FROM c)
SELECT key, seq, {r('CASE WHEN seq < first THEN 0.0 ELSE c END', 'dc_v')} FROM f""")
def p07_centre_and_zero(spark, d):
    return rounded(series.zero_before_positive(vectors(spark, d)).select("key", "seq", "dc_v"))


@query("SELECT event_type, count(*) AS n FROM events WHERE contains(event_type, 'c') GROUP BY event_type")
def p08_name_contains(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where(F.contains("event_type", F.lit("c"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey <> 7 GROUP BY o_custkey")
def p09_skip_id(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_custkey <> 7").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {X_CTE} SELECT key, min(seq) AS first FROM x WHERE x <> 0 AND y <> 0 AND z <> 0 GROUP BY key")
def p10_first_full_row(spark, d):
    rows = axes(spark, d).withColumn("a", F.array("x", "y", "z"))
    return rows.where(~F.exists("a", lambda v: v == 0) & (F.size("a") > 0)).groupBy("key").agg(F.min("seq").alias("first"))


@query(f"WITH {E_CTE} SELECT key, {r('avg(coalesce(CASE WHEN v > 60 THEN NULL ELSE v END, 0))', 'filled')} FROM e GROUP BY key")
def p11_fill_missing(spark, d):
    rows = recordings(spark, d).select("key", F.when(F.col("v") > 60, None).otherwise(F.col("v")).alias("v")).na.fill(0.0)
    return rounded(rows.groupBy("key").agg(F.avg("v").alias("filled")))


@query("SELECT c_custkey, " + r("coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, avg(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END) OVER ())", "balance", 4) + " FROM customer")
def p12_mean_imputation(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    return rounded(c.crossJoin(F.broadcast(c.agg(F.avg("b").alias("m")))).select("c_custkey", F.coalesce("b", "m").alias("balance")), 4)


@query(f"WITH {V_CTE}, f AS (SELECT *, seq * 100.0 / 64 AS f FROM v) SELECT key, count(*) AS n, {r('sum(abs(v))', 'total')} FROM f WHERE f > 2 AND f < 10 GROUP BY key")
def p14_band_mask(spark, d):
    f = vectors(spark, d).withColumn("f", F.col("seq") * 100.0 / 64)
    return rounded(f.where("f > 2 and f < 10").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.abs("v")).alias("total")))


@query(f"WITH {E_CTE} SELECT key, seq, CASE WHEN v BETWEEN 10 AND 60 THEN v END AS v FROM e")
def p15_outlier_mask(spark, d):
    return recordings(spark, d).select("key", "seq", F.when(F.col("v").between(10, 60), F.col("v")).alias("v"))


# tap metrics

T_CTE = E_CTE + """, d0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM e WHERE action = 0),
u0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM e WHERE action = 1)"""


@query(f"WITH {E_CTE} SELECT key, {r('count(*) FILTER (WHERE action = 1) / max_by(td, seq)', 'frequency', 9)} FROM e GROUP BY key")
def g01_tap_frequency(spark, d):
    return rounded(tapping.frequency(taps(spark, d)), 9)


@query(f"""WITH {T_CTE}, s AS (SELECT key, i, n, lead(td) OVER (PARTITION BY key ORDER BY seq) - td AS v FROM u0)
SELECT key, i, CASE WHEN v <> 0 THEN {r('1 / v', 'continuous_frequency', 9).replace(' AS continuous_frequency', '')} END AS continuous_frequency FROM s WHERE i < n - 2""")
def g03_continuous_frequency(spark, d):
    return rounded(tapping.continuous_frequency(taps(spark, d)), 9)


@query(f"""WITH {T_CTE}, s AS (SELECT key, i, n, lead(td) OVER (PARTITION BY key ORDER BY seq) - td AS v FROM u0)
SELECT key, {r('avg(v) * 1000', 'mean_moving_time', 1)} FROM s WHERE i < n - 2 AND i % 2 = 1 GROUP BY key""")
def g04_mean_moving_time(spark, d):
    return rounded(tapping.mean_moving_time(taps(spark, d)), 1)


@query(f"""WITH {T_CTE} SELECT d0.key, {r('var_pop(d0.td - u0.td) / 1e6', 'score', 3)} FROM d0 JOIN u0 ON d0.key = u0.key AND d0.i - 1 = u0.i AND u0.i < u0.n - 1 WHERE u0.i % 2 = 1 GROUP BY d0.key""")
def g05_incoordination(spark, d):
    got = tapping.incoordination(taps(spark, d))
    return rounded(got.select("key", (F.col("incoordination_score") / 1e9).alias("score")), 3)


@query(f"""WITH {T_CTE}, s AS (SELECT key, i, n, sqrt(pow(lead(v) OVER w - v, 2) + pow(lead(y) OVER w - y, 2)) AS q FROM d0 WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, {r('avg(q)', 'mean_alnt_target_distance')} FROM s WHERE i < n - 2 AND i % 2 = 1 GROUP BY key""")
def g06_alternate_distance(spark, d):
    return rounded(tapping.alternate_distance(taps(spark, d)))


@query(f"WITH {E_CTE} SELECT key, count(*) FILTER (WHERE action = 1) AS kinesia_scores FROM e GROUP BY key")
def g07_kinesia(spark, d):
    return tapping.kinesia(taps(spark, d))


@query(f"WITH {T_CTE} SELECT d0.key, {r('abs(avg(d0.td - u0.td))', 'akinesia_times', 4)} FROM d0 JOIN u0 ON d0.key = u0.key AND d0.i = u0.i GROUP BY d0.key")
def g08_akinesia(spark, d):
    return rounded(tapping.akinesia(taps(spark, d)), 4)


@query(f"WITH {E_CTE} SELECT key, {r('avg(sqrt(pow(v - 50, 2) + pow(y - 50, 2)))', 'dysmetria_score')} FROM e WHERE action = 0 GROUP BY key")
def g09_dysmetria(spark, d):
    return rounded(tapping.dysmetria(taps(spark, d)))


@query(f"""WITH {E_CTE}, c AS (SELECT *, seq // 5 AS second FROM e), g AS (SELECT key, max(second) AS last FROM c GROUP BY key),
w AS (SELECT key, unnest(range(0, last - 7)) AS i FROM g WHERE last - 7 > 0),
f AS (SELECT w.key, w.i, count(c.key) / 6.0 AS f FROM w LEFT JOIN c ON c.key = w.key AND c.action = 1 AND w.i <= c.seq / 5.0 AND c.seq / 5.0 < w.i + 6 GROUP BY w.key, w.i),
l AS (SELECT *, lead(f) OVER o AS f1, lead(f, 2) OVER o AS f2 FROM f WINDOW o AS (PARTITION BY key ORDER BY i))
SELECT key, i, CASE WHEN f <> 0 THEN round((f1 - f) / f, 6) + 0.0 END AS moving_frequency FROM l WHERE f2 IS NOT NULL""")
def g02_moving_frequency(spark, d):
    return rounded(tapping.moving_frequency(taps(spark, d).withColumn("td", F.col("seq") / 5.0)))


TAP_FEATURES = {"frequency": 9, "mean_moving_time": 1, "incoordination_score": 3, "mean_alnt_target_distance": 6, "kinesia_scores": 0, "akinesia_times": 4, "dysmetria_score": 6}
F_CTE = T_CTE + """, mv AS (SELECT key, avg(v) * 1000 AS mean_moving_time FROM (SELECT key, i, n, lead(td) OVER (PARTITION BY key ORDER BY seq) - td AS v FROM u0) WHERE i < n - 2 AND i % 2 = 1 GROUP BY key),
ic AS (SELECT d0.key, var_pop(d0.td - u0.td) / 1e6 AS incoordination_score FROM d0 JOIN u0 ON d0.key = u0.key AND d0.i - 1 = u0.i AND u0.i < u0.n - 1 WHERE u0.i % 2 = 1 GROUP BY d0.key),
ad AS (SELECT key, avg(q) AS mean_alnt_target_distance FROM (SELECT key, i, n, sqrt(pow(lead(v) OVER w - v, 2) + pow(lead(y) OVER w - y, 2)) AS q FROM d0 WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE i < n - 2 AND i % 2 = 1 GROUP BY key),
ak AS (SELECT d0.key, abs(avg(d0.td - u0.td)) AS akinesia_times FROM d0 JOIN u0 ON d0.key = u0.key AND d0.i = u0.i GROUP BY d0.key),
fr AS (SELECT key, count(*) FILTER (WHERE action = 1) / max_by(td, seq) AS frequency, count(*) FILTER (WHERE action = 1) AS kinesia_scores, avg(sqrt(pow(v - 50, 2) + pow(y - 50, 2))) FILTER (WHERE action = 0) AS dysmetria_score,
  min(v) AS minimum, avg(v) AS mean, sum(v * v) AS abs_energy FROM e GROUP BY key),
tf AS (SELECT fr.*, mean_moving_time, incoordination_score, mean_alnt_target_distance, akinesia_times FROM fr LEFT JOIN mv ON fr.key = mv.key LEFT JOIN ic ON fr.key = ic.key LEFT JOIN ad ON fr.key = ad.key LEFT JOIN ak ON fr.key = ak.key)"""


def tap_matrix(long: DataFrame) -> DataFrame:
    """One row a key; scores in squared milliseconds by the thousand million, as they are too long for doubles to agree on."""
    wide = long.groupBy("key").pivot("feature", list(TAP_FEATURES)).agg(F.first("value")).withColumn("incoordination_score", F.col("incoordination_score") / 1e9)
    return wide.select("key", *[(F.round(c, n) + 0.0).alias(c) for c, n in TAP_FEATURES.items()])


@query(f"WITH {F_CTE} SELECT key, {', '.join(r(c + '::DOUBLE', c, n) for c, n in TAP_FEATURES.items())} FROM tf")
def g10_tap_features(spark, d):
    return tap_matrix(tapping.tap_features(taps(spark, d)))


@query(f"""WITH RECURSIVE {E_CTE}, rr AS MATERIALIZED (SELECT key, seq, td, event_type IN ('view', 'click') AS vis, event_type = 'click' AS pres FROM e),
f AS (SELECT key, -1::BIGINT AS seq, 0 AS state, 0.0::DOUBLE AS shown, 0.0::DOUBLE AS pressed, 0.0::DOUBLE AS press, 0.0::DOUBLE AS release, 0 AS entries FROM (SELECT DISTINCT key FROM rr)
  UNION ALL SELECT f.key, rr.seq, CASE WHEN state = 0 AND vis AND NOT pres THEN 1 WHEN state = 1 AND pres THEN 2 WHEN state = 2 AND NOT pres THEN 0 ELSE state END, CASE WHEN state = 0 AND vis AND NOT pres THEN td ELSE shown END, CASE WHEN state = 1 AND pres THEN td ELSE pressed END,
    CASE WHEN state = 1 AND pres THEN press + (td - shown) ELSE press END, CASE WHEN state = 2 AND NOT pres THEN release + (pressed - shown) ELSE release END, CASE WHEN state = 1 AND pres OR state = 2 AND NOT pres THEN entries + 1 ELSE entries END
  FROM f JOIN rr ON rr.key = f.key AND rr.seq = f.seq + 1),
z AS (SELECT key, max_by(press, seq) AS press, max_by(release, seq) AS release, max_by(entries, seq) AS entries FROM f GROUP BY key)
SELECT key, {r('press / entries', 'mean_press_button_time', 3)}, {r('release / entries', 'mean_release_button_time', 3)}, {r('press / entries + release / entries', 'mean_total_reaction_time', 3)} FROM z WHERE entries > 0""")
def g11_reaction_times(spark, d):
    rows = recordings(spark, d).select("key", "seq", "td", F.col("event_type").isin("view", "click").alias("b_vis"), (F.col("event_type") == "click").alias("b_pres"))
    return rounded(tapping.reaction_times(rows), 3)


# features of series


@query(f"WITH {E_CTE} SELECT key, {r('min(v)', 'minimum', 4)}, {r('avg(v)', 'mean', 4)}, {r('coalesce(sum(v), 0)', 'sum_values', 3)}, {r('sum(v * v)', 'abs_energy', 2)} FROM e GROUP BY key")
def g13_moments(spark, d):
    got = series.moments(recordings(spark, d))
    return got.select("key", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("minimum", 4), ("mean", 4), ("sum_values", 3), ("abs_energy", 2))])


@query(f"""WITH {E_CTE}, c AS (SELECT key, round(v) AS q, count(*) AS n FROM e GROUP BY key, round(v))
SELECT key, {r('count(*) / sum(n)', 'distinct_ratio')}, {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)', 'recurring_points')}, {r('count(*) FILTER (WHERE n > 1) / count(*)', 'recurring_values')} FROM c GROUP BY key""")
def g17_recurring(spark, d):
    return rounded(series.recurring(recordings(spark, d).withColumn("v", F.round("v"))))


@query(f"""WITH {V_CTE}, m AS (SELECT *, avg(v) OVER (PARTITION BY key) AS mu, lead(v, 8) OVER (PARTITION BY key ORDER BY seq) AS o FROM v)
SELECT key, {r('sum((v - mu) * (o - mu)) / ((count(*) - 8) * var_pop(v))', 'autocorrelation')} FROM m GROUP BY key HAVING var_pop(v) > 0""")
def g19_autocorrelation(spark, d):
    return rounded(series.autocorrelation(vectors(spark, d), 8))


@query(oracles.lag_sums(V_CTE, 6))
def g20_partial_autocorrelation(spark, d):
    return rounded(series.by_kernel(vectors(spark, d), lambda x: {f"lag{k}": signal.pacf(x, k) for k in (3, 5, 6)}, "lag3 double, lag5 double, lag6 double"))


@query(f"""WITH {V_CTE}, q AS (SELECT key, quantile_cont(v, 0.0) AS lo, quantile_cont(v, 0.2) AS hi FROM v GROUP BY key), l AS (SELECT *, lead(v) OVER (PARTITION BY key ORDER BY seq) AS o FROM v)
SELECT l.key, {r('coalesce(avg(CASE WHEN v BETWEEN lo AND hi AND o BETWEEN lo AND hi THEN abs(o - v) END), 0)', 'change')} FROM l JOIN q ON l.key = q.key GROUP BY l.key""")
def g21_change_in_corridor(spark, d):
    return rounded(series.change_in_corridor(vectors(spark, d)))


@query(f"""WITH {V_CTE}, m AS (SELECT *, max(v) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, max(v) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS q, count(*) OVER (PARTITION BY key) AS n FROM v)
SELECT key, count(*) FILTER (WHERE v > l AND v > q AND seq >= 5 AND seq < n - 5) AS peaks FROM m GROUP BY key""")
def g22_number_of_peaks(spark, d):
    return series.count_peaks(vectors(spark, d))


@query(f"WITH {V_CTE}, c AS (SELECT key, seq // 5 AS chunk, min(v) AS a FROM v GROUP BY key, seq // 5) SELECT key, {r('regr_intercept(a, chunk)', 'intercept')}, {r('regr_slope(a, chunk)', 'slope')}, {r('corr(chunk, a)', 'rvalue')} FROM c GROUP BY key")
def g23_linear_trend(spark, d):
    return rounded(series.linear_trend(vectors(spark, d), 5, F.min))


@query(f"WITH {V_CTE}, c AS (SELECT key, seq // 10 AS chunk, var_samp(v) AS a FROM v GROUP BY key, seq // 10) SELECT key, {r('regr_intercept(a, chunk)', 'intercept')}, {r('regr_slope(a, chunk)', 'slope')}, {r('corr(chunk, a)', 'rvalue')} FROM c GROUP BY key")
def g23_linear_trend_of_variance(spark, d):
    return rounded(series.linear_trend(vectors(spark, d), 10, F.var_samp))


@query(f"""WITH {V_CTE}, {oracles.welch_power('v', 256, 1.0)} SELECT key, {', '.join(r(f'max(p) FILTER (WHERE k = {k})', f'c{k}') for k in (2, 5, 8))} FROM p GROUP BY key""")
def g24_welch_density(spark, d):
    return rounded(series.by_kernel(vectors(spark, d), lambda x: {f"c{k}": float(signal.welch(x)[1][k]) for k in (2, 5, 8)}, "c2 double, c5 double, c8 double"))


@query(f"""WITH {V_CTE}, k AS (SELECT unnest(range(0, 33)) AS k), f AS (SELECT key, k, sqrt(pow(sum(v * cos(2 * pi() * ((k * seq) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((k * seq) % 64) / 64)), 2)) AS m FROM v, k GROUP BY key, k)
SELECT key, {r('sum(k * m) / sum(m)', 'centroid')} FROM f GROUP BY key""")
def g25_fft_centroid(spark, d):
    return rounded(series.by_kernel(vectors(spark, d), lambda x: {"centroid": signal.fft_centroid(x)}, "centroid double"))


@query(f"WITH {V_CTE} SELECT key, {r('sum(v * cos(2 * pi() * 23 * seq / 64))', 're')}, {r('-sum(v * sin(2 * pi() * 23 * seq / 64))', 'im')}, {r('sqrt(pow(sum(v * cos(2 * pi() * 23 * seq / 64)), 2) + pow(sum(v * sin(2 * pi() * 23 * seq / 64)), 2))', 'magnitude')} FROM v GROUP BY key")
def g26_fft_coefficient(spark, d):
    return rounded(series.spectrum_line(vectors(spark, d), 23))


@query(f"""WITH {V_CTE}, t AS MATERIALIZED (SELECT key, seq, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM v WINDOW w AS (PARTITION BY key ORDER BY seq)), s AS (SELECT key, 0.3 * stddev_pop(v) AS tol, count(*) AS n FROM v GROUP BY key),
m AS (SELECT x.key, x.seq, n, sum(CASE WHEN greatest(abs(x.a - y.a), abs(x.b - y.b)) <= tol THEN 1 ELSE 0 END) AS two, sum(CASE WHEN x.c IS NOT NULL AND y.c IS NOT NULL AND greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.c - y.c)) <= tol THEN 1 ELSE 0 END) AS three, max(CASE WHEN x.c IS NOT NULL THEN 1 ELSE 0 END) AS whole
  FROM t x JOIN t y ON x.key = y.key AND x.b IS NOT NULL AND y.b IS NOT NULL JOIN s ON s.key = x.key GROUP BY x.key, x.seq, n)
SELECT key, {r('abs(avg(ln(two / (n - 1))) - avg(CASE WHEN whole = 1 THEN ln(three / (n - 2)) END))', 'apen')} FROM m GROUP BY key""")
def g27_approximate_entropy(spark, d):
    return rounded(series.by_kernel(vectors(spark, d), lambda x: {"apen": signal.approximate_entropy(x)}, "apen double"))


@query(f"""WITH {V_CTE}, s AS (SELECT key, sum(v) AS s, max_by(v, seq) AS z, min_by(v, seq) AS a FROM v GROUP BY key) SELECT key, {r('((s - a) / 100.0 + (s - z)) / 200.0', 'integral')} FROM s""")
def g29_integration(spark, d):
    a = series.ordered(vectors(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size("values") - 1
    return rounded(a.select("key", ((total(F.slice("values", 2, n)) / 100.0 + total(F.slice("values", 1, n))) / 200.0).alias("integral")))


@query(f"WITH {E_CTE}, c AS (SELECT key, floor(seq / 7) AS s, count(*) AS n FROM e WHERE seq / 7.0 < 60 GROUP BY key, floor(seq / 7)) SELECT key, {r('avg(n)', 'sampling_rate')} FROM c GROUP BY key")
def g30_sampling_rate(spark, d):
    from motionloom.sources.readers import sampling_rate

    return rounded(sampling_rate(recordings(spark, d).withColumn("td", F.col("seq") / 7.0), "key"))


@query(f"WITH {V_CTE} SELECT key, {r('quantile_cont(v, 0.95) - quantile_cont(v, 0.05)', 'spread')}, {r('stddev_samp(v)', 'sd')} FROM v GROUP BY key")
def g31_spread(spark, d):
    got = vectors(spark, d).groupBy("key").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.stddev_samp("v").alias("sd"))
    return rounded(got.select("key", (F.col("q")[1] - F.col("q")[0]).alias("spread"), "sd"))


@query(f"""WITH {V_CTE}, m AS (SELECT *, min(v) OVER (PARTITION BY key) AS lo, max(v) OVER (PARTITION BY key) AS hi FROM v),
b AS (SELECT key, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS n FROM m WHERE hi > lo GROUP BY 1, 2), p AS (SELECT key, n / sum(n) OVER (PARTITION BY key) AS p, count(*) OVER (PARTITION BY key) AS k FROM b)
SELECT key, {r('-sum(p * ln(p)) / ln(max(k))', 'entropy')} FROM p GROUP BY key HAVING max(k) > 1""")
def g32_histogram_entropy(spark, d):
    w = Window.partitionBy("key")
    m = vectors(spark, d).withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w)).where("hi > lo")
    b = m.groupBy("key", F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)), F.lit(9)).alias("b")).agg(F.count("*").alias("n"))
    p = b.select("key", (F.col("n") / F.sum("n").over(w)).alias("p"), F.count("*").over(w).alias("k"))
    return rounded(p.groupBy("key").agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.max("k"))).alias("entropy"), F.max("k").alias("k")).where("k > 1").drop("k"))


@query(f"WITH {V_CTE} SELECT key, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'sd')}, {r('median(v)', 'median')} FROM v GROUP BY key")
def g33_frame_statistics(spark, d):
    return rounded(vectors(spark, d).groupBy("key").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.median("v").alias("median")))


@query("SELECT DISTINCT label FROM embeddings")
def g34_distinct(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("label").distinct()


# ordered operators


def _bins_cte(step: int, column: str = "v") -> str:
    """CTEs ending in ``j`` (key, seq, v): bins of ``step`` seconds, empty ones filled linearly."""
    return f"""{E_CTE}, bn AS (SELECT key, floor(td / {step}) AS bin, avg({column}) AS v FROM e GROUP BY 1, 2), gr AS (SELECT key, unnest(range(0, max(bin)::BIGINT + 1)) AS bin FROM bn GROUP BY key),
sp AS (SELECT gr.key, gr.bin, bn.v, CASE WHEN bn.v IS NOT NULL THEN gr.bin END AS spot FROM gr LEFT JOIN bn ON gr.key = bn.key AND gr.bin = bn.bin),
ip AS (SELECT *, last_value(v IGNORE NULLS) OVER lo AS y0, last_value(spot IGNORE NULLS) OVER lo AS x0, first_value(v IGNORE NULLS) OVER hi AS y1, first_value(spot IGNORE NULLS) OVER hi AS x1 FROM sp
  WINDOW lo AS (PARTITION BY key ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY key ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
j AS MATERIALIZED (SELECT key, bin AS seq, coalesce(v, y0 + (y1 - y0) * (bin - x0) / (x1 - x0)) AS v FROM ip)"""


@query(f"WITH {_bins_cte(86400)} SELECT key, seq AS bin, {r('v', 'v')} FROM j")
def w01_resample(spark, d):
    return rounded(series.resample(recordings(spark, d), 86400.0))


@query(oracles.filtered(V_CTE, "high"))
def w03_high_pass(spark, d):
    return rounded(by_sample(series.by_kernel(vectors(spark, d), lambda x: {"filtered": signal.high_pass(x).tolist()}, "filtered array<double>"), "filtered"))


@query(oracles.filtered(V_CTE, "low"))
def w04_low_pass(spark, d):
    return rounded(by_sample(series.by_kernel(vectors(spark, d), lambda x: {"filtered": signal.low_pass(x).tolist()}, "filtered array<double>"), "filtered"))


def _dft_sql(low: float, high: float) -> str:
    return f"""WITH RECURSIVE {V_CTE}, w AS (SELECT key, seq, v * (0.5 - 0.5 * cos(2 * pi() * seq / 63)) AS v FROM v), k AS (SELECT unnest(range(0, 32)) AS k),
f AS (SELECT key, k, sqrt(pow(sum(v * cos(2 * pi() * k * seq / 64)), 2) + pow(sum(v * sin(2 * pi() * k * seq / 64)), 2)) / 64 AS m FROM w, k GROUP BY key, k)
SELECT key, {r('sum(m)', 'amplitude')}, {r('max_by(k * 100.0 / 64, m)', 'frequency')} FROM f WHERE k * 100.0 / 64 > {low} AND k * 100.0 / 64 < {high} GROUP BY key"""


@query(_dft_sql(2, 10))
def w07_amplitude_by_fft(spark, d):
    def kernel(x):
        a, f = signal.amplitude_fft(x, window=64)
        return {"amplitude": a, "frequency": f}

    return rounded(series.by_kernel(vectors(spark, d), kernel, "amplitude double, frequency double"))


@query(f"""WITH {V_CTE}, {oracles.welch_power('v', 32, 100.0)} SELECT key, {r('sum(p) FILTER (WHERE k * 100.0 / n > 2 AND k * 100.0 / n < 10)', 'amplitude')}, {r('max_by(k * 100.0 / n, p)', 'frequency')} FROM p GROUP BY key""")
def w08_amplitude_by_welch(spark, d):
    def kernel(x):
        a, f = signal.amplitude_welch(x, window=32)
        return {"amplitude": a, "frequency": f}

    return rounded(series.by_kernel(vectors(spark, d), kernel, "amplitude double, frequency double"))


def _tremor(window: int, low: float, high: float, centre: bool):
    def kernel(x):
        x = x - x.mean() if centre else x
        y = signal.high_pass(x)
        (a, f), (b, g) = signal.amplitude_fft(y, low=low, high=high, window=window), signal.amplitude_welch(y, low=low, high=high, window=window)
        return {"fft_amplitude": a, "fft_frequency": f, "welch_amplitude": b, "welch_frequency": g}

    return kernel


SPECTRAL = "fft_amplitude double, fft_frequency double, welch_amplitude double, welch_frequency double"


@query(oracles.tremor(_bins_cte(3600), 2.0, 10.0, False))
def w09_tremor_amplitude(spark, d):
    """Resample, high-pass, window, transform: amplitude and dominant frequency of every recording."""
    bins = series.resample(recordings(spark, d), 3600.0).withColumnRenamed("bin", "seq")
    return rounded(series.by_kernel(bins, _tremor(256, 2.0, 10.0, False), SPECTRAL))


@query(oracles.tremor(_bins_cte(3600), 0.0, 4.0, True))
def w10_bradykinesia(spark, d):
    bins = series.resample(recordings(spark, d), 3600.0).withColumnRenamed("bin", "seq")
    return rounded(series.by_kernel(bins, _tremor(256, 0.0, 4.0, True), SPECTRAL))


def _three_axes_cte(n: str = "xa") -> str:
    return f"{X_CTE}, {n} AS MATERIALIZED (SELECT key, axis, seq, v::DOUBLE AS v FROM (SELECT key, seq, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS v FROM x))"


def three_axes(spark, d) -> DataFrame:
    """X by axis: the key is a struct of recording and axis, so that each axis is a series of its own."""
    long = axes(spark, d).select("key", "seq", F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in "xyz"])).alias("s"))
    return long.select(F.concat_ws("/", F.col("key").cast("string"), "s.axis").alias("key"), "seq", "s.v")


@query(f"""WITH {_three_axes_cte()}, n AS (SELECT key, axis, count(*) AS n FROM xa GROUP BY 1, 2), en AS (SELECT key, axis, unnest(range(257, n, 50)) AS stop FROM n),
c AS MATERIALIZED (SELECT en.key, en.axis, stop, seq - stop + 256 AS i, v - avg(v) OVER (PARTITION BY en.key, en.axis, stop) AS v FROM en JOIN xa ON xa.key = en.key AND xa.axis = en.axis AND seq >= stop - 256 AND seq < stop),
k AS (SELECT unnest(range(0, 20)) AS k), p AS MATERIALIZED (SELECT key, axis, stop, k, (pow(sum(v * cos(2 * pi() * ((k * i) % 256) / 256)), 2) + pow(sum(v * sin(2 * pi() * ((k * i) % 256) / 256)), 2)) / 256 AS p FROM c, k GROUP BY key, axis, stop, k),
g AS (SELECT key, axis, stop, (sum(p) FILTER (WHERE k BETWEEN 1 AND 6) / 100 + sum(p) FILTER (WHERE k BETWEEN 0 AND 5)) / 200 AS wk, (sum(p) FILTER (WHERE k BETWEEN 7 AND 19) / 100 + sum(p) FILTER (WHERE k BETWEEN 6 AND 18)) / 200 AS fz FROM p GROUP BY key, axis, stop)
SELECT key || '/' || axis AS key, stop AS time, {r('(fz / wk)::REAL::DOUBLE', 'freeze_index', 4)}, {r('(fz + wk)::REAL::DOUBLE', 'locomotion', 4)} FROM g""")
def w11_freeze_of_gait(spark, d):
    def kernel(x):
        t, i, p = signal.freeze_of_gait(x)
        return {"r": [{"time": a, "freeze_index": b, "locomotion": c} for a, b, c in zip(t, i, p, strict=True)]}

    got = series.by_kernel(three_axes(spark, d), kernel, "r array<struct<time: bigint, freeze_index: double, locomotion: double>>")
    return rounded(got.select("key", F.inline("r")), 4)


@query()
def w12_gait_measures(spark, d):
    """Peak frequency, speed, regularity and the walk's summary in one pass over each recording."""

    def kernel(x):
        g = signal.gait(x, distance=100.0) if len(x) > 64 else {}
        step, stride, symmetry = signal.step_regularity(x, 0.05)
        return {"peak_frequency": signal.frequency_of_peaks(x, 10, 10), "speed": signal.speed_of_gait(x), "step": step, "stride": stride, "symmetry": symmetry, "steps": g.get("number_of_steps"), "cadence": g.get("cadence"), "avg_step_time": g.get("avg_step_time"), "avg_stride_time": g.get("avg_stride_time")}

    return series.by_kernel(axes(spark, d).withColumnRenamed("x", "v"), kernel, "peak_frequency double, speed double, step double, stride double, symmetry double, steps double, cadence double, avg_step_time double, avg_stride_time double")


@query()
def w15_heel_strikes(spark, d):
    def kernel(x):
        t, p = signal.heel_strikes(x) if len(x) > 16 else ([], [])
        return {"times": t, "positions": p}

    return series.by_kernel(axes(spark, d).withColumnRenamed("x", "v"), kernel, "times array<double>, positions array<int>")


@query(f"""WITH {V_CTE}, m AS (SELECT key, seq, v - avg(v) OVER (PARTITION BY key) AS c FROM v), p AS (SELECT a.key, b.seq - a.seq AS lag, sum(a.c * b.c) AS s FROM m a JOIN m b ON a.key = b.key AND b.seq >= a.seq GROUP BY 1, 2),
z AS (SELECT key, var_pop(v) AS q FROM v GROUP BY key) SELECT p.key, lag, {r('s / (q * (64 - lag))', 'acf')} FROM p JOIN z ON p.key = z.key WHERE q > 0""")
def w17_autocorrelation(spark, d):
    got = series.by_kernel(vectors(spark, d), lambda x: {"a": signal.acf_unbiased(x).tolist()}, "a array<double>")
    flat = got.select("key", F.posexplode("a").alias("lag", "acf")).where("not isnan(acf)")
    return rounded(flat.select("key", F.col("lag").cast("long").alias("lag"), "acf"))


@query(f"""WITH {V_CTE}, c AS (SELECT a.key, b.seq - a.seq AS lag, sum(a.v * b.v) AS c FROM v a JOIN v b ON a.key = b.key AND b.seq >= a.seq GROUP BY 1, 2),
z AS (SELECT key, max(c) FILTER (WHERE lag = 0) / max(c) FILTER (WHERE lag = 63) AS first FROM c GROUP BY key), u AS (SELECT c.key, lag, c / (first + (1 - first) * lag / 63) AS c FROM c JOIN z ON c.key = z.key)
SELECT key, lag, {r('c / max(abs(c)) OVER (PARTITION BY key)', 'acf')} FROM u""")
def w18_raw_autocorrelation(spark, d):
    return rounded(by_sample(series.by_kernel(vectors(spark, d), lambda x: {"acf": signal.raw_acf(x).tolist()}, "acf array<double>"), "acf", "lag"))


@query(f"""WITH {V_CTE}, k AS (SELECT unnest(range(0, 33)) AS k), f AS (SELECT key, k, sum(v * cos(2 * pi() * ((k * seq) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((k * seq) % 64) / 64)) AS im FROM v, k GROUP BY key, k),
p AS (SELECT key, CASE WHEN k = 0 THEN 0 ELSE 2 * k - 1 END AS spot, re AS x FROM f UNION ALL SELECT key, 2 * k, im FROM f WHERE k BETWEEN 1 AND 31), o AS (SELECT key, spot, row_number() OVER (PARTITION BY key ORDER BY x DESC) AS n FROM p)
SELECT key, CASE WHEN spot = 0 THEN 64 ELSE round(64.0 / least(spot, 64 - spot))::INTEGER END AS samples FROM o WHERE n = 2""")
def w19_interpeak(spark, d):
    return series.by_kernel(vectors(spark, d), lambda x: {"samples": signal.interpeak(x, 100.0)}, "samples int")


@query(f"""WITH RECURSIVE {V_CTE}, vm AS MATERIALIZED (SELECT key, seq, v FROM v), {oracles.peakdet('vm', 0.5)}
SELECT key, top AS seq, 'max' AS kind FROM pd WHERE top >= 0 UNION ALL SELECT key, dip, 'min' FROM pd WHERE dip >= 0""")
def w20_peak_detection(spark, d):
    def kernel(x):
        tops, dips = signal.peakdet(x, 0.5)
        return {"r": [{"seq": p, "kind": "max"} for p, _ in tops] + [{"seq": p, "kind": "min"} for p, _ in dips]}

    return series.by_kernel(vectors(spark, d), kernel, "r array<struct<seq: bigint, kind: string>>").select("key", F.inline("r"))


@query(f"WITH {V_CTE}, l AS (SELECT *, lead(v) OVER (PARTITION BY key ORDER BY seq) AS o FROM v) SELECT key, seq FROM l WHERE v > 0 AND o <= 0")
def w21_falls_through_zero(spark, d):
    return series.falls_through_zero(vectors(spark, d))


@query(f"WITH {V_CTE}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM v WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, v FROM l WHERE v > a AND v > b")
def w22_local_peaks(spark, d):
    return series.local_peaks(vectors(spark, d))


@query(f"WITH {V_CTE}, {oracles.peaks_cte()} SELECT key, seq, {r('prominence', 'prominence')} FROM pr")
def w22_prominences(spark, d):
    def kernel(x):
        p = signal.find_peaks(x)
        return {"r": [{"seq": int(i), "prominence": float(v)} for i, v in zip(p, signal.prominences(x, p), strict=True)]}

    return rounded(series.by_kernel(vectors(spark, d), kernel, "r array<struct<seq: bigint, prominence: double>>").select("key", F.inline("r")))


@query(f"""WITH RECURSIVE {V_CTE}, sg AS MATERIALIZED (SELECT key, seq, sign(v)::DOUBLE AS v, lead(sign(v)::DOUBLE) OVER (PARTITION BY key ORDER BY seq) AS next FROM v),
f AS (SELECT key, seq, v AS y FROM sg WHERE seq = 0 UNION ALL SELECT f.key, sg.seq, CASE WHEN f.y = sg.next THEN f.y ELSE sg.v END FROM f JOIN sg ON sg.key = f.key AND sg.seq = f.seq + 1)
SELECT key, seq, y AS smoothed FROM f""")
def w23_smoothing(spark, d):
    return by_sample(series.by_kernel(vectors(spark, d).withColumn("v", F.signum("v")), lambda x: {"smoothed": signal.smoothing(x).tolist()}, "smoothed array<double>"), "smoothed")


@query(f"""WITH {V_CTE}, f AS (SELECT unnest(range(0, 57, 8)) AS a) SELECT key, a // 8 AS frame, {r('sum(v)', 'total')}, count(*) AS n FROM v JOIN f ON seq BETWEEN a AND a + 15 WHERE a <= 48 GROUP BY key, a // 8""")
def w24_frames(spark, d):
    f = series.frames(vectors(spark, d), 16, 8)
    return rounded(f.select("key", F.col("frame").cast("long").alias("frame"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("values").cast("long").alias("n")))


@query(f"""WITH {E_CTE}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY key ORDER BY seq) THEN 0 ELSE 1 END AS c FROM e), s AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY seq) AS run FROM c)
SELECT key, min(event_type) AS label, min(seq) AS first, max(seq) AS last FROM s GROUP BY key, run HAVING count(*) > 1""")
def w28_sections(spark, d):
    return series.runs(recordings(spark, d), "event_type", 1)


@query(f"""WITH {V_CTE}, {oracles.peaks_cte()}, o AS MATERIALIZED (SELECT key, seq, prominence AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n FROM pr WINDOW w AS (PARTITION BY key ORDER BY seq)),
c AS (SELECT a.key, a.i AS j, var_pop(b.x) FILTER (WHERE b.i <= a.i) * a.i + var_pop(b.x) FILTER (WHERE b.i > a.i) * (a.n - a.i) AS cost FROM o a JOIN o b ON a.key = b.key WHERE a.i < a.n GROUP BY a.key, a.i, a.n),
best AS (SELECT key, min_by(j, cost) AS j FROM c GROUP BY key) SELECT o.key, o.seq, (CASE WHEN o.i > coalesce(j, o.n) THEN 1 ELSE 0 END)::BIGINT AS segment FROM o LEFT JOIN best ON o.key = best.key""")
def w29_segmentation(spark, d):
    def kernel(x):
        p = signal.find_peaks(x)
        return {"r": [{"seq": int(i), "segment": int(g)} for i, g in zip(p, signal.segments(signal.prominences(x, p), 2), strict=True)]}

    return series.by_kernel(vectors(spark, d), kernel, "r array<struct<seq: bigint, segment: bigint>>").select("key", F.inline("r"))


@query(f"WITH {V_CTE}, l AS (SELECT key, seq, v - lag(v) OVER (PARTITION BY key ORDER BY seq) AS d FROM v) SELECT key, seq, {r('d', 'd')} FROM l WHERE d IS NOT NULL")
def w33_difference(spark, d):
    return rounded(series.difference(vectors(spark, d)))


@query(f"WITH {V_CTE} SELECT key, seq, {r('sum(v) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)', 's')} FROM v")
def w33_cumulative(spark, d):
    return rounded(series.cumulative(vectors(spark, d)))


@query(f"WITH {V_CTE} SELECT key, seq, {r('v * v - coalesce(lag(v) OVER w * lead(v) OVER w, 0)', 'tkeo')} FROM v WINDOW w AS (PARTITION BY key ORDER BY seq)")
def w34_teager(spark, d):
    return rounded(series.teager(vectors(spark, d)))


# whole recordings


@query(f"SELECT a.key, a.bin, a.v, b.y FROM (WITH {_bins_cte(86400)} SELECT key, seq AS bin, {r('v', 'v')} FROM j) a JOIN (WITH {_bins_cte(86400, 'y')} SELECT key, seq AS bin, {r('v', 'y')} FROM j) b ON a.key = b.key AND a.bin = b.bin")
def w02_resample_columns(spark, d):
    return rounded(series.resample_columns(recordings(spark, d), ["v", "y"], 86400.0))


_B, _A = (x.tolist() for x in signal.butterworth(4, 0.2, "low"))


@query(f"""WITH RECURSIVE {_three_axes_cte()}, xk AS MATERIALIZED (SELECT key || '/' || axis AS key, seq, v FROM xa), {oracles.recursion('xk', _B, _A)}
SELECT split_part(key, '/', 1)::BIGINT AS key, seq, {', '.join(r(f"max(y) FILTER (WHERE key LIKE '%/{c}')", c) for c in 'xyz')} FROM filtered GROUP BY 1, 2""")
def w05_filter_columns(spark, d):
    return rounded(series.filtered(axes(spark, d), ["x", "y", "z"], signal.low_pass))


@query(f"""WITH RECURSIVE {_three_axes_cte()}, c AS MATERIALIZED (SELECT key || '/' || axis AS key, seq, v - avg(v) OVER (PARTITION BY key, axis) AS c FROM xa), n AS (SELECT key, count(*) AS n, sum(c * c) / count(*) AS var FROM c GROUP BY key),
p AS (SELECT a.key, b.seq - a.seq AS seq, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.key = b.key AND b.seq >= a.seq GROUP BY 1, 2),
acf AS MATERIALIZED (SELECT p.key, p.seq, s / (var * (n - p.seq)) AS v FROM p JOIN n ON p.key = n.key WHERE var > 0), {oracles.peakdet('acf', 0.05)},
t AS (SELECT key, top, row_number() OVER (PARTITION BY key ORDER BY top) AS i FROM pd WHERE top >= 0),
z AS (SELECT t.key, max(v) FILTER (WHERE i = 2) AS step, max(v) FILTER (WHERE i = 3) AS stride FROM t JOIN acf ON acf.key = t.key AND acf.seq = t.top GROUP BY t.key HAVING max(i) >= 3)
SELECT split_part(n.key, '/', 1)::BIGINT AS key, split_part(n.key, '/', 2) AS axis, {r('step', 'step')}, {r('stride', 'stride')}, {r('step - stride', 'symmetry')} FROM n LEFT JOIN z ON n.key = z.key""")
def w14_regularity_by_axis(spark, d):
    got = motion.regularity_by_axis(axes(spark, d), ["x", "y", "z"], 0.05)
    flat = got.select("key", F.inline(F.arrays_zip(F.array(*map(F.lit, "xyz")).alias("axis"), "step", "stride", "symmetry")))
    return rounded(flat.select("key", "axis", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("step", "stride", "symmetry")]))


@query()
def w27_gait_summary(spark, d):
    """The sixteen fields of every walk along every axis."""
    return motion.gait_summary(three_axes(spark, d), distance=100.0)


@query(f"""WITH {V_CTE}, {oracles.peaks_cte()}, o AS MATERIALIZED (SELECT key, seq, prominence AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n FROM pr WINDOW w AS (PARTITION BY key ORDER BY prominence, seq)),
c AS (SELECT a.key, a.i AS j, var_pop(b.x) FILTER (WHERE b.i <= a.i) * a.i + var_pop(b.x) FILTER (WHERE b.i > a.i) * (a.n - a.i) AS cost FROM o a JOIN o b ON a.key = b.key WHERE a.i < a.n GROUP BY a.key, a.i, a.n),
best AS (SELECT key, min_by(j, cost) AS j FROM c GROUP BY key) SELECT o.key, o.seq, {r('x', 'prominence')}, CASE WHEN o.i > coalesce(j, o.n) THEN 1 ELSE 0 END AS cluster FROM o LEFT JOIN best ON o.key = best.key""")
def w30_clustered_peaks(spark, d):
    return rounded(motion.clustered_peaks(vectors(spark, d)))


@query()
def w32_walks_and_turns(spark, d):
    return motion.walks_and_turns(vectors(spark, d))


_J = V_CTE + ", j AS MATERIALIZED (SELECT key, seq, v FROM v)"
_SQL = registry.ORACLES
_SPECTRAL_NAMES = lambda pre: {"fft_amplitude": f"{pre}amplitude_by_fft", "fft_frequency": f"{pre}frequency_by_fft", "welch_amplitude": f"{pre}amplitude_by_welch", "welch_frequency": f"{pre}frequency_by_welch"}
_MAGNITUDE = {
    "apen": (_SQL["g27_approximate_entropy"], {"apen": "approximate_entropy"}),
    "lag8": (_SQL["g19_autocorrelation"], {"autocorrelation": "autocorrelation_lag_8"}),
    "lag9": (_SQL["g19_autocorrelation"].replace("lead(v, 8)", "lead(v, 9)").replace("count(*) - 8", "count(*) - 9"), {"autocorrelation": "autocorrelation_lag_9"}),
    "pacf": (_SQL["g20_partial_autocorrelation"], {f"lag{k}": f"partial_autocorrelation_lag_{k}" for k in (3, 5, 6)}),
    "mom": (f"WITH {V_CTE} SELECT key, {r('min(v)', 'minimum')}, {r('avg(v)', 'mean')}, {r('sum(v)', 'sum_values')}, {r('sum(v * v)', 'abs_energy')} FROM v GROUP BY key", {c: c for c in ("minimum", "mean", "sum_values", "abs_energy")}),
    "rec": (f"WITH {V_CTE}, c AS (SELECT key, v, count(*) AS n FROM v GROUP BY key, v) SELECT key, {r('count(*) / sum(n)', 'distinct_ratio')}, {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)', 'again')} FROM c GROUP BY key", {"distinct_ratio": "ratio_value_number_to_time_series_length", "again": "percentage_of_reoccurring_datapoints_to_all_datapoints"}),
    "cor": (_SQL["g21_change_in_corridor"], {"change": "change_quantiles"}),
    "num": (_SQL["g22_number_of_peaks"], {"peaks": "number_peaks"}),
    "t5": (_SQL["g23_linear_trend"], {"intercept": "agg_linear_trend_min_chunk_len_5_attr_intercept"}),
    "tv": (_SQL["g23_linear_trend_of_variance"], {"rvalue": "agg_linear_trend_var_chunk_len_10_attr_rvalue"}),
    "t10": (_SQL["g23_linear_trend"].replace("seq // 5", "seq // 10"), {"intercept": "agg_linear_trend_min_chunk_len_10_attr_intercept"}),
    "den": (_SQL["g24_welch_density"], {f"c{k}": f"spkt_welch_density_coeff_{k}" for k in (2, 5, 8)}),
    "cen": (_SQL["g25_fft_centroid"], {"centroid": "fft_aggregated_centroid"}),
    "f0": (_SQL["g26_fft_coefficient"].replace("pi() * 23", "pi() * 0"), {"re": "fft_coefficient_real_coeff_0", "magnitude": "fft_coefficient_abs_coeff_0"}),
    "f23": (_SQL["g26_fft_coefficient"], {"re": "fft_coefficient_real_coeff_23"}),
}
_PARTS = {"tr": (oracles.tremor(_J, 2.0, 10.0, False), _SPECTRAL_NAMES("")), "br": (oracles.tremor(_J, 0.0, 4.0, True), _SPECTRAL_NAMES("bradykinesia_"))} | {a: (q, {c: f"magnitude_{n}" for c, n in names.items()}) for a, (q, names) in _MAGNITUDE.items()}
TREMOR_FEATURES = [n for _, names in _PARTS.values() for n in names.values()] + [f"magnitude_fft_coefficient_abs_coeff_{k}" for k in (44, 63)]


@query(oracles.joined(_PARTS, {f"magnitude_fft_coefficient_abs_coeff_{k}": "NULL::DOUBLE" for k in (44, 63)}).replace("num.peaks AS", "num.peaks::DOUBLE AS"))
def g28_tremor_features(spark, d):
    """All 34 features of every recording in one pass; coefficients that a recording is too short for are null."""
    long = motion.tremor_features(vectors(spark, d).withColumn("td", F.col("seq") / 100.0))
    wide = long.groupBy("key").pivot("feature", TREMOR_FEATURES).agg(F.first("value"))
    return rounded(wide.select("key", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in TREMOR_FEATURES]))


# implicit joins, sorting, sets


@query(f"WITH {E_CTE} SELECT key, {', '.join(f'coalesce(round(sum(v) FILTER (WHERE event_type = {chr(39)}{n}{chr(39)}), 4), 0.0) AS {n}' for n in ('click', 'view'))} FROM e GROUP BY key")
def j01_feature_matrix(spark, d):
    long = recordings(spark, d).groupBy(F.col("key").alias("id"), F.col("event_type").alias("feature")).agg((F.round(F.sum("v"), 4)).alias("value"))
    return scoring.feature_matrix(long, ["click", "view"]).withColumnRenamed("id", "key")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j02_labels(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")


@query(f"""WITH {E_CTE}, i AS (SELECT * FROM (VALUES ('rest', 0, 10, 0), ('walk', 8, 30, 1), ('turn', 25, 40, 2)) t(label, a, b, p)), h AS (SELECT key, seq, label, p FROM e LEFT JOIN i ON seq BETWEEN a AND b)
SELECT key, seq, max_by(label, p) AS label FROM h GROUP BY key, seq""")
def j04_stamp_intervals(spark, d):
    i = spark.createDataFrame([("rest", 0, 10, 0), ("walk", 8, 30, 1), ("turn", 25, 40, 2)], "label string, start long, end long, priority int")
    return series.nearest_label(recordings(spark, d).select("key", "seq"), F.broadcast(i))


CENTROIDS = [[-0.5] * 64, [0.0] * 64, [0.5] * 64]


@query(f"""WITH {V_CTE}, c AS (SELECT * FROM (VALUES (0, -0.5), (1, 0.0), (2, 0.5)) t(k, c)), s AS (SELECT key, k, sqrt(sum(pow(v - c, 2))) AS q FROM v, c GROUP BY key, k)
SELECT key, min_by(k, q) AS score FROM s GROUP BY key""")
def j05_nearest_centroid(spark, d):
    p = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("p"))
    return scoring.nearest_centroid(p, CENTROIDS).select("key", "score")


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT p.vec_id AS id, t.label, list_distance(p.e, t.e) AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_distance(p.e, t.e), t.vec_id) AS n FROM p, p t),
m AS (SELECT *, min(d) OVER (PARTITION BY id) = 0 AS exact FROM q WHERE n <= 3), v AS (SELECT id, label, sum(CASE WHEN exact THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END) AS w FROM m GROUP BY id, label), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS n FROM v)
SELECT id, label AS predicted FROM b WHERE n = 1""")
def j06_nearest_neighbours(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    training = e.select(F.col("vec_id").alias("tid"), F.col("e").alias("q"), "label")
    return scoring.nearest_neighbours(e.select(F.col("vec_id").alias("id"), F.col("e").alias("p")), training)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j11_not_present(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return c.join(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"WITH {T_CTE} SELECT d0.key, d0.i, {r('d0.td', 'down')}, {r('u0.td', 'up')} FROM d0 JOIN u0 ON d0.key = u0.key AND d0.i = u0.i")
def j12_ordinal_pairs(spark, d):
    t = taps(spark, d)
    a, b = tapping._ranked(t, 0.0).select("key", "i", F.col("td").alias("down")), tapping._ranked(t, 1.0).select("key", "i", F.col("td").alias("up"))
    return rounded(a.join(b, ["key", "i"]).select("key", F.col("i").cast("long").alias("i"), "down", "up"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t03_top(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(f"WITH {V_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v DESC, seq) AS n FROM v) SELECT key, seq, {r('v', 'v')} FROM n WHERE n = 2")
def t04_second_largest(spark, d):
    w = Window.partitionBy("key").orderBy(F.desc("v"), "seq")
    return rounded(vectors(spark, d).withColumn("n", F.row_number().over(w)).where("n = 2").select("key", "seq", "v"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE n = 1")
def t06_latest(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return spark.read.parquet(f"{d}/orders.parquet").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey")


@query("""WITH o AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY o_custkey)
SELECT id, a, 0.0::DOUBLE AS b FROM o UNION ALL SELECT c_custkey, 0.0, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM o)""")
def u01_append_sessions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))
    return scoring.append_sessions(o, c).select("id", "a", "b")


# scalar functions


@query(f"SELECT p_partkey, {r('2595 * log10(1 + p_retailprice / 700)', 'mel')}, {r('1 / (1 + exp(-p_size / 10.0))', 'logistic')}, {r('CASE WHEN p_size - 25 > 0 THEN ln(p_size - 25) ELSE 0 END', 'safe_log')}, CASE WHEN abs(p_size - 25) < 1e-18 THEN 0.0 ELSE round(p_retailprice / (p_size - 25), 6) + 0.0 END AS safe_ratio, pow(2, ceil(log2(p_size)))::BIGINT AS next_power FROM part")
def f01_scalars(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size, x = F.col("p_size"), F.col("p_size") - 25
    got = p.select("p_partkey", (2595 * F.log10(1 + F.col("p_retailprice") / 700)).alias("mel"), (1 / (1 + F.exp(-size / 10.0))).alias("logistic"), F.when(x > 0, F.ln(x)).otherwise(0.0).alias("safe_log"), F.when(F.abs(x) < 1e-18, 0.0).otherwise(F.col("p_retailprice") / x).alias("safe_ratio"), F.pow(F.lit(2), F.ceil(F.log2(size))).cast("long").alias("next_power"))
    return rounded(got)


@query("SELECT n_nationkey, n_nationkey::VARCHAR || CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, regexp_extract(n_name, '([A-Z]+)', 1) AS word, replace(n_name, 'A', '_') AS plain FROM nation")
def f06_text(spark, d):
    k = F.col("n_nationkey")
    end = F.when((k % 100).between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat(k.cast("string"), end).alias("ordinal"), F.regexp_extract("n_name", "([A-Z]+)", 1).alias("word"), F.replace("n_name", F.lit("A"), F.lit("_")).alias("plain"))


@query(f"SELECT event_id, minute(ts) AS m, second(ts) AS s, (epoch_us(ts) // 1000000)::BIGINT AS epoch, {r('round_even(value, 0)', 'even')} FROM events")
def f09_time(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.minute(ts).cast("long").alias("m"), F.second(ts).cast("long").alias("s"), F.floor(F.unix_micros(ts) / 1_000_000).alias("epoch"), (F.rint("value") + 0.0).alias("even"))


@query(f"WITH i AS (SELECT unnest(range(0, 64)) AS i) SELECT i, {r('0.5 - 0.5 * cos(2 * pi() * i / 63)', 'hann')}, {r('0.54 - 0.46 * cos(2 * pi() * i / 63)', 'hamming')}, {r('exp(-0.5 * pow(2.5 * (i - 31.5) / 31.5, 2))', 'gaussian')} FROM i")
def f12_windows(spark, d):
    i = spark.range(64).select(F.col("id").alias("i"))
    a = 2 * math.pi * F.col("i") / 63
    return rounded(i.select("i", (0.5 - 0.5 * F.cos(a)).alias("hann"), (0.54 - 0.46 * F.cos(a)).alias("hamming"), F.exp(-0.5 * F.pow(2.5 * (F.col("i") - 31.5) / 31.5, F.lit(2))).alias("gaussian")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f13_json(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# voice and scoring


@query(f"""WITH {V_CTE}, m AS (SELECT key, seq, v - avg(v) OVER (PARTITION BY key) AS c FROM v) SELECT key, seq, {r('c / (max(abs(c)) OVER (PARTITION BY key) + 1e-6)', 'v')} FROM m""")
def v01_normalise(spark, d):
    c = series.centred(vectors(spark, d))
    return rounded(c.select("key", "seq", (F.col("dc_v") / (F.max(F.abs("dc_v")).over(series.whole()) + 1e-6)).alias("v")))


@query()
def v14_perturbation(spark, d):
    from motionloom.functions import voice

    def kernel(x):
        return {"m": voice.jitter_shimmer(x + 5, "Jitter->F0_")}

    return series.by_kernel(vectors(spark, d), kernel, "m map<string,double>")


@query()
def v20_voice_measures(spark, d):
    """Long rows ``key, feature, value`` of the quantities of every eight suppliers in a row, read as sound at 8 kHz (about 0.6 s).

    A measure that a recording is too short or too silent for is NaN; what has no track (of pitch, of cycles) has no row.
    """
    from motionloom.functions import voice

    def kernel(x):
        return {"m": {k: float(v) for k, v in voice.voice_measures(x, 8000).items()}}

    w = Window.partitionBy("key").orderBy("supplier", "part")
    sound = axes(spark, d).select(F.floor(F.col("key") / 8).alias("key"), F.col("key").alias("supplier"), F.col("seq").alias("part"), F.col("x").alias("v"))
    got = series.by_kernel(sound.select("key", (F.row_number().over(w) - 1).cast("long").alias("seq"), "v"), kernel, "m map<string,double>")
    return got.select("key", F.explode_outer("m").alias("feature", "value"))


@query(f"""WITH {V_CTE}, c AS (SELECT key, seq, sum(v) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS y FROM v), n AS (SELECT unnest([4, 8, 16]) AS n), s AS (SELECT key, n, seq // n AS seg, seq % n AS t, y FROM c, n),
q AS (SELECT key, n, seg, sqrt(greatest(regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t), 0) / count(*)) AS rms FROM s GROUP BY key, n, seg), a AS (SELECT key, log10(n) AS x, log10(avg(rms)) AS m FROM q GROUP BY key, n)
SELECT key, {r('regr_slope(m, x)', 'dfa')} FROM a GROUP BY key""")
def v29_detrended_fluctuation(spark, d):
    c = series.cumulative(vectors(spark, d)).withColumn("n", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16))))
    s = c.select("key", "n", F.floor(F.col("seq") / F.col("n")).alias("seg"), (F.col("seq") % F.col("n")).alias("t"), F.col("s").alias("y"))
    q = s.groupBy("key", "n", "seg").agg(F.sqrt(F.greatest(F.regr_syy("y", "t") - F.pow(F.regr_sxy("y", "t"), F.lit(2)) / F.regr_sxx("y", "t"), F.lit(0.0)) / F.count("*")).alias("rms"))
    a = q.groupBy("key", "n").agg(F.log10("n").alias("x"), F.log10(F.avg("rms")).alias("m"))
    return rounded(a.groupBy("key").agg(F.regr_slope("m", "x").alias("dfa")))


@query()
def m01_cluster_scores(spark, d):
    p = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("p"))
    return scoring.nearest_centroid(scoring.whitened(p), scoring.train_clusters(p)).select("key", "score")


@query()
def m03_observation_scores(spark, d):
    """A score of each of the sixteen observations for every session, by centroids of the same table."""
    matrix = _observations(spark, d)
    return scoring.score_observations(matrix, scoring.train_observations(matrix))


def _observations(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/embeddings.parquet")
    return p.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"{scoring.CODES[k % 16]}-{k}") for k in range(64)])


def _labels_sql(codes: range) -> str:
    """Nearest neighbours of each code's four dimensions: whitened training rows, queries as they are."""
    parts = []
    for c in codes:
        dims = [c + 16 * k + 1 for k in range(4)]
        sd = ", ".join(f"stddev_pop(embedding[{i}]::DOUBLE) AS s{i}" for i in dims)
        white = ", ".join(f"embedding[{i}]::DOUBLE / s{i}" for i in dims)
        plain = ", ".join(f"embedding[{i}]::DOUBLE" for i in dims)
        parts.append(f"""(WITH s AS (SELECT {sd} FROM embeddings), t AS (SELECT vec_id AS tid, label, [{white}] AS q FROM embeddings, s), p AS (SELECT vec_id AS id, [{plain}] AS p FROM embeddings),
n AS (SELECT id, label, list_distance(p, q) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(p, q), tid) AS n FROM p, t), m AS (SELECT *, min(d) OVER (PARTITION BY id) = 0 AS exact FROM n WHERE n <= 3),
v AS (SELECT id, label, sum(CASE WHEN exact THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END) AS w FROM m GROUP BY id, label), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS n FROM v)
SELECT id, label FROM b WHERE n = 1) c{c}""")
    names = ", ".join(f'c{c}.label AS "{scoring.CODES[c]}"' for c in codes)
    return f"SELECT c{codes[0]}.id, {names} FROM {parts[0]} " + " ".join(f"JOIN {q} ON c{c}.id = c{codes[0]}.id" for c, q in zip(codes[1:], parts[1:], strict=True))


@query(_labels_sql(range(4)))
def m04_clinical_labels(spark, d):
    """Labels of four observations by three neighbours, whitened on training alone."""
    matrix = _observations(spark, d)
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), *[F.col("label").alias(c) for c in scoring.CODES[:4]])
    return scoring.predict_labels(matrix, matrix, labels, scoring.CODES[:4])


@query()
def m05_importances(spark, d):
    p = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"{scoring.CODES[k % len(scoring.CODES)]}-{k}" for k in range(64)]
    matrix = p.select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return scoring.top_observations(scoring.importances(matrix, "label", names))


@query(f"WITH {F_CTE} SELECT key AS id, {', '.join(f'coalesce(round({c}::DOUBLE, {n}) + 0.0, 0.0) AS {chr(34)}{o}{c}{chr(34)}' for o, c, n in [('TT-RH-', c, n) for c, n in TAP_FEATURES.items()] + [('OT-RH-', 'minimum', 4), ('OT-RH-', 'mean', 4), ('OT-RH-', 'abs_energy', 2)])} FROM tf")
def m10_result_set(spark, d):
    """Sessions with tap and series features, one row each."""
    long = tapping.tap_features(taps(spark, d), "TT-RH-").withColumnRenamed("key", "id")
    more = series.moments(recordings(spark, d)).select(F.col("key").alias("id"), F.explode(F.create_map(*[x for c in ("minimum", "mean", "abs_energy") for x in (F.lit(f"OT-RH-{c}"), F.col(c))])).alias("feature", "value"))
    digits = {f"TT-RH-{c}": n for c, n in TAP_FEATURES.items()} | {"OT-RH-minimum": 4, "OT-RH-mean": 4, "OT-RH-abs_energy": 2}
    matrix = scoring.feature_matrix(long.union(more), list(digits)).withColumn("TT-RH-incoordination_score", F.col("TT-RH-incoordination_score") / 1e9)
    return matrix.select("id", *[(F.round(F.col(f"`{c}`"), n) + 0.0).alias(c) for c, n in digits.items()])


registry.FLAGSHIP = w09_tremor_amplitude
