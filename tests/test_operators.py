import pytest

from motionloom.operators import scoring, series, tapping
from motionloom.streaming import live


def taps_of(spark, rows):
    return spark.createDataFrame([(1, k, float(t), float(a), float(x), 0.0, 3.0, 4.0) for k, (t, a, x) in enumerate(rows)], "key int, seq long, td double, action_type double, x double, y double, x_target double, y_target double")


def test_tap_metrics_by_hand(spark):
    t = taps_of(spark, [(0, 0, 3), (1, 1, 3), (2, 0, 0), (4, 1, 0), (5, 0, 3), (8, 1, 3), (9, 0, 3), (10, 1, 3)])
    assert tapping.frequency(t).first()["frequency"] == pytest.approx(0.4)
    assert tapping.frequency(t, crop=True).first()["frequency"] == pytest.approx(-0.6)
    assert [r["continuous_frequency"] for r in tapping.continuous_frequency(t).orderBy("i").collect()] == pytest.approx([1 / 3, 1 / 4])
    assert tapping.mean_moving_time(t).first()["mean_moving_time"] == pytest.approx(4000)
    assert tapping.kinesia(t).first()["kinesia_scores"] == 4
    assert tapping.akinesia(t).first()["akinesia_times"] == pytest.approx(abs((-1 - 2 - 3 - 1) / 4))
    assert tapping.dysmetria(t).first()["dysmetria_score"] == pytest.approx((4 + 5 + 4 + 4) / 4)
    assert tapping.tap_features(t, "a-").count() == 7 and tapping.tap_features(t, targets=False).count() == 6


@pytest.mark.parametrize("crop", [False, True])
def test_tap_features_are_the_metrics(spark, crop):
    import random

    r = random.Random(5)
    rows = [(k, 10 * k + i, float(i) + r.random() / 2, float(r.random() < 0.5), r.random() * 9, r.random() * 9, 4.0, 5.0) for k in range(12) for i in range(r.randint(1, 14))]
    t = spark.createDataFrame(rows, "key int, seq long, td double, action_type double, x double, y double, x_target double, y_target double")
    got = {(x["key"], x["feature"]): x["value"] for x in tapping.tap_features(t, "", True, crop).where("value is not null").collect()}
    want = {}
    parts = (tapping.frequency(t, crop), tapping.mean_moving_time(t, crop), tapping.incoordination(t, crop=crop), tapping.alternate_distance(t, crop=crop), tapping.kinesia(t, crop), tapping.akinesia(t, crop), tapping.dysmetria(t, crop))
    for part in parts:
        name = part.columns[1]
        want |= {(x["key"], name): float(x[name]) for x in part.where(f"{name} is not null").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_order_of_rows_does_not_matter(spark):
    rows = spark.createDataFrame([(k % 3, k // 3, float((k * 7) % 11)) for k in range(60)], "key int, seq long, v double")
    for f in (series.teager, series.cumulative, lambda x: series.autocorrelation(x, 2), lambda x: series.frames(x, 5, 2)):
        a, b = (sorted(map(tuple, f(x).collect())) for x in (rows, rows.orderBy("v").repartition(5)))
        assert a == b and a


def test_runs_and_gaps(spark):
    rows = spark.createDataFrame([(1, k, c) for k, c in enumerate("aabbbac")], "key int, seq long, c string")
    got = sorted((r["label"], r["first"], r["last"]) for r in series.runs(rows, "c", 1).collect())
    assert got == [("a", 0, 1), ("b", 2, 4)]
    gaps = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, None), (1, 3, 4.0)], "key int, bin long, v double")
    assert [r["v"] for r in series.interpolate(gaps, "bin").orderBy("bin").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_scores(spark):
    p = spark.createDataFrame([(k, [float(k // 10) * 10, float(k % 10)]) for k in range(40)], "key int, p array<double>")
    c = scoring.train_clusters(p, 4)
    assert c == scoring.centroid_order(c) and len(c) == 4
    assert scoring.nearest_centroid(p, [[0.0, 5.0], [30.0, 5.0]]).where("key = 35").first()["score"] == 1
    train = spark.createDataFrame([(0, [0.0], 1), (1, [1.0], 2), (2, [1.1], 2), (3, [9.0], 3)], "tid int, q array<double>, label int")
    q = spark.createDataFrame([(0, [0.0]), (1, [0.9]), (2, [9.5])], "id int, p array<double>")
    assert {r["id"]: r["predicted"] for r in scoring.nearest_neighbours(q, train).collect()} == {0: 1, 1: 2, 2: 3}
    imp = spark.createDataFrame([("TT-RH-a", 0.2), ("TT-RH-b", 0.3), ("PS-LH-a", 0.4)], "feature string, importance double")
    assert [r["observation"] for r in scoring.top_observations(imp, 1).collect()] == ["TT-RH"]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(40).select((F.col("id") % 2).alias("key"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((lambda s: live.binned(s, "4 seconds"), live.moving_rate, live.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"live{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert f(spark.read.parquet(str(tmp_path / "in"))).count() > 0
