import math

import numpy as np
import pytest

from motionloom.functions import signal
from motionloom.operators import motion, scoring, series, sessions
from motionloom.sources import readers, sinks

R = np.random.default_rng(11)


def motion_file(path, n, nanos=True):
    t = np.arange(n) * (10_000_000 if nanos else 0.01)
    xyz = R.normal(size=(n, 3))
    path.write_text("\n".join(f"{t[k]},{a},{b},{c}" for k, (a, b, c) in enumerate(xyz)) + "\n")


def tap_file(path, n):
    rows = [f"{1000 + 100 * k},0,{k % 2},{100 + k},{200},0.3,0.1,240,645" for k in range(n)]
    path.write_text("\n".join([*rows, f"Total number of taps: {n}"]) + "\n")


def test_folders_become_rows(spark, tmp_path):
    for folder, session in (("100", 100), ("200", 200), ("_300", 300)):
        (tmp_path / folder).mkdir()
        tail = f"_2016-10-14_10-38-48_-_f7_-_{session}.csv"
        motion_file(tmp_path / folder / f"T_-_KINETIC_TREMOR_-_LEFT_HAND{tail}", 400)
        tap_file(tmp_path / folder / f"FT_-_TWO_TARGET_-_LEFT_HAND{tail}", 30)
        tap_file(tmp_path / folder / f"FT_-_ONE_TARGET_-_RIGHT_HAND{tail}", 20)
        (tmp_path / folder / f"WELLBEING_ENTRY{tail}").write_text("1|2\n")
    got = sessions.assemble(spark, str(tmp_path))
    rows = {r["id"]: r.asDict() for r in got.collect()}
    assert sorted(rows) == ["100", "200"] and len(got.columns) == 1 + 34 + 2 * 7
    assert [v for k, v in rows["100"].items() if k.endswith("kinesia_scores")] in ([10.0, 15.0], [15.0, 10.0])
    assert all(v is not None for v in rows["200"].values())


def test_a_session_in_two_folders_counts_once(spark, tmp_path):
    for folder, n in (("a", 30), ("b", 20)):
        (tmp_path / folder).mkdir()
        tap_file(tmp_path / folder / "FT_-_TWO_TARGET_-_LEFT_HAND_2016_-_f7_-_5.csv", n)
    got = sessions.assemble(spark, str(tmp_path)).collect()
    assert len(got) == 1 and [v for k, v in got[0].asDict().items() if k.endswith("kinesia_scores")] == [15.0]


def test_smartphone_folders(spark, tmp_path):
    (tmp_path / "s-1").mkdir()
    name = lambda kind, at: tmp_path / "s-1" / f"v1-{kind}_2020_01_0{at}-x-y-z.csv"
    motion_file(name("rest-tremor_accel", 1), 300, nanos=False)
    motion_file(name("rest-tremor_gyro", 1), 300, nanos=False)
    (name("fast_tap", 1)).write_text("\n".join(f"{k / 10},{k},5" for k in range(30)) + "\n")
    (name("fast_tap", 2)).write_text("\n".join(f"{k / 10},{k},5" for k in range(21)) + "\n")
    (name("button_react", 1)).write_text("\n".join(f"{k},0,0,{int(k % 4 in (1, 2))},{int(k % 4 == 2)}" for k in range(20)) + "\n")
    got = sessions.assemble_opdc(spark, str(tmp_path))
    row = got.collect()
    assert len(row) == 1 and len(got.columns) == 1 + 2 * 34 + 6 + 3
    assert [v for k, v in row[0].asDict().items() if k.endswith("kinesia_scores")] == [20.0]  # the later file, without its last line


def test_names_of_smartphone_files(spark):
    files = spark.createDataFrame([("p", "d", "OPDCv1.0.0-rest-tremor-left_accel_ab-12_20200101_101500.csv")], "path string, directory string, name string")
    r = sessions.opdc_names(files).first()
    assert (r["kind"], r["measure"], r["session"]) == ("accel", "rest-tremor-left-accel-", "left-12-20200101-101500.csv-")


def test_scores_of_observations(spark, tmp_path):
    names = ["TT-RH-a", "TT-RH-b", "PS-LH-a"]
    x = np.concatenate([R.normal(size=(20, 3)) + c for c in (0, 30, 60, 90)])
    rows = [(k, *map(float, v)) for k, v in enumerate(x)]
    matrix = spark.createDataFrame(rows, "id int, `TT-RH-a` double, `TT-RH-b` double, `PS-LH-a` double")
    models = scoring.train_observations(matrix)
    assert sorted(models) == ["PS-LH", "TT-RH"] and models["TT-RH"]["columns"] == names[:2]
    assert np.allclose(models["TT-RH"]["sd"], x[:, :2].std(axis=0))
    got = {r["id"]: r for r in scoring.score_observations(matrix, models).collect()}
    for k, v in enumerate(x):
        assert got[k]["TT-RH"] == np.argmin([np.linalg.norm(v[:2] / models["TT-RH"]["sd"] - c) for c in models["TT-RH"]["centroids"]])
    assert [got[k]["TT-RH"] for k in (0, 20, 40, 60)] == [0, 1, 2, 3]
    sinks.write_scores(scoring.score_observations(matrix, models), str(tmp_path / "scores"))
    lines = next((tmp_path / "scores").glob("*.csv")).read_text().split("\n")
    assert lines[0] == "id," + ",".join(models) and len(lines) == 82 and lines[1].startswith("0,")
    matrix.write.option("header", True).csv(str(tmp_path / "m"))
    assert scoring.read_matrix(spark, str(tmp_path / "m")).count() == 80


def test_neighbours_in_blocks(spark):
    q, t = R.normal(size=(40, 3)), R.normal(size=(50, 3))
    t[7], label = q[3], R.integers(0, 4, 50)
    a = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(q)], "id int, p array<double>")
    b = spark.createDataFrame([(k, list(map(float, v)), int(label[k])) for k, v in enumerate(t)], "tid int, q array<double>, label int")
    want = {}
    for k, v in enumerate(q):
        d = np.linalg.norm(t - v, axis=1)
        near = np.argsort(d, kind="stable")[:3]
        votes = {}
        for j in near:
            votes[label[j]] = votes.get(label[j], 0) + ((d[j] == 0) * 1.0 if d[near].min() == 0 else 1 / d[j])
        want[k] = min(votes, key=lambda c: (-votes[c], c))
    for size in (7, 1000):
        assert {r["id"]: r["predicted"] for r in scoring.nearest_neighbours(a, b, 3, size).collect()} == want


def test_labels_use_whitened_training_only(spark):
    train = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 20.0)], "id int, `OT-RH-a` double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, `OT-RH` int")
    sd = float(np.std([0.0, 10.0, 20.0]))
    query = spark.createDataFrame([(9, 10.0 / sd), (8, 10.0)], "id int, `OT-RH-a` double")
    got = {r["id"]: r["OT-RH"] for r in scoring.predict_labels(query, train, labels, k=1).collect()}
    assert got == {9: 1, 8: 2}


def test_closed_sections_and_filters(spark):
    rows = spark.createDataFrame([(1, k, c, float(k)) for k, c in enumerate("aabbba")], "key int, seq long, c string, v double")
    assert sorted((r["label"], r["first"], r["last"]) for r in series.runs(rows, "c", 0, closed=True).collect()) == [("a", 0, 1), ("b", 2, 4)]
    assert sorted(r["label"] for r in series.runs(rows, "c", 0, keep=["a"]).collect()) == ["a", "a"]
    got = series.filtered(rows, ["v"], signal.low_pass, keep=["c"]).orderBy("seq").collect()
    assert np.allclose([r["v"] for r in got], signal.low_pass(np.arange(6.0))) and "".join(r["c"] for r in got) == "aabbba"
    with pytest.raises(ValueError):
        series.filtered(rows, ["v"], signal.low_pass, keep=["nothing"])
    with pytest.raises(ValueError):
        readers.read_recording(spark, "/nowhere", "cloudupdr", strict=True)


def test_gait_summary_and_turns(spark):
    t = np.arange(1000) / 100
    x = np.cos(2 * np.pi * 2 * t) + 0.2 * np.cos(2 * np.pi * t)
    g = signal.gait_summary(x, distance=10.0)
    assert g["number_of_steps"] == pytest.approx(18, abs=2) and g["avg_step_duration"] == pytest.approx(0.5, abs=0.05)
    assert g["avg_stride_duration"] == pytest.approx(1.0, abs=0.1) and g["velocity"] == pytest.approx(1.0)
    times = signal.heel_strikes(x)[0]
    assert g["stride_durations"] == [np.diff(times[0::2]).tolist(), np.diff(times[1::2]).tolist()] and g["step_durations"] == np.diff(times).tolist()
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "key int, seq long, v double")
    r = motion.gait_summary(rows, distance=10.0).first()
    assert len(r) == 17 and r["cadence"] == pytest.approx(g["cadence"])
    y = np.concatenate([np.sin(2 * np.pi * 2 * t) * 3, np.sin(2 * np.pi * 2 * t) * 0.5, np.sin(2 * np.pi * 2 * t) * 3])
    walks, turns = signal.walks_and_turns(y)
    assert len(walks) == 2 and len(turns[-1]) == pytest.approx(20, abs=2)  # the first peak has no side to fall to
    assert signal.two_means([1.0, 9.0, 1.2, 8.0]).tolist() == [0, 1, 0, 1]
    assert motion.clustered_peaks(rows, lambda p: (p > 1).astype(int)).count() == len(signal.find_peaks(x))


def test_tremor_features_by_hand():
    x = np.array([3.0, 1.0, 2.0, 2.0, 5.0, 0.0, 4.0, 1.0, 6.0, 2.0, 7.0, 1.0, 3.0, 9.0, 2.0, 2.0])
    f = signal.tremor_features(np.arange(16) / 100, x)
    assert len(f) == 34 and f["magnitude_sum_values"] == x.sum() and f["magnitude_minimum"] == 0
    assert f["magnitude_ratio_value_number_to_time_series_length"] == len(set(x)) / 16
    assert f["magnitude_percentage_of_reoccurring_datapoints_to_all_datapoints"] == sum((x == v).sum() > 1 for v in x) / 16
    assert math.isnan(f["magnitude_fft_coefficient_abs_coeff_44"]) and f["magnitude_fft_coefficient_real_coeff_0"] == pytest.approx(x.sum())
    assert signal.tremor_features([], []) == {}
