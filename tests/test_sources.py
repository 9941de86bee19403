import struct
import wave

import pytest

from motionloom.operators import tapping
from motionloom.sources import readers, sinks


def put(d, name, text):
    (d / name).write_text(text)
    return str(d / name)


def test_motion_formats(spark, tmp_path):
    p = put(tmp_path, "a.csv", "1000000000,1,2,2,9\n2000000000,0,3,4,9\nbad,1,x,2,9\n1,2\n")
    r = readers.read_recording(spark, p).orderBy("seq").collect()
    assert [(x["seq"], x["td"], x["mag_sum_acc"]) for x in r] == [(0, 0.0, 3.0), (1, 1.0, 5.0), (2, None, None)]
    p = put(tmp_path, "o.csv", "5,0,3,4\n6.5,0,3,4\n")
    assert [x["td"] for x in readers.read_recording(spark, p, "opdc").orderBy("seq").collect()] == [0.0, 1.5]
    p = put(tmp_path, "m.json", '[{"timestamp": 3, "x": 0, "y": 3, "z": 4}, {"timestamp": 4, "x": 0, "y": 0, "z": 1}]')
    assert [(x["td"], x["mag_sum_acc"]) for x in readers.read_recording(spark, p, "mpower").orderBy("seq").collect()] == [(0.0, 5.0), (1.0, 1.0)]
    p = put(tmp_path, "h.txt", "#c\nacc_lt_x\tq\tacc_lt_y\tacc_lt_z\n0\t9\t3\t4\n1\t9\t0\t0\n")
    assert [(x["td"], x["mag_sum_acc"]) for x in readers.read_recording(spark, p, "huga").orderBy("seq").collect()] == [(0.0, 5.0), (0.017, 1.0)]
    p = put(tmp_path, "p.csv", "time,x,y,z\n1,0,3,4\n1.5,0,0,1\n")
    assert [x["td"] for x in readers.read_recording(spark, p, "physics").orderBy("seq").collect()] == [0.0, 0.5]
    p = put(tmp_path, "t.tsv", "i\t1000\t0\t3\t4\tz\ni\t1500\t0\t0\t1\tz\n")
    assert [(x["td"], x["mag_sum_acc"]) for x in readers.read_recording(spark, p, "accapp").orderBy("seq").collect()] == [(0.0, 5.0), (0.5, 1.0)]
    p = put(tmp_path, "f.txt", "15 1 2 3 4 5 6 0 3 4 1\n30 1 2 3 4 5 6 0 0 1 2\n")
    assert [(x["td"], x["mag_sum_acc"], x["anno"]) for x in readers.read_recording(spark, p, "freeze").orderBy("seq").collect()] == [(15.0, 5.0, 1), (30.0, 1.0, 2)]
    p = put(tmp_path, "s.csv", ",td,x,y,z,mag_sum_acc,segmentation\n1970-01-01 00:00:01,1,0,3,4,5,walk\n")
    assert readers.read_recording(spark, p, "segmented").first()["segmentation"] == "walk"


def test_tap_and_reaction_formats(spark, tmp_path):
    p = put(tmp_path, "ft.csv", "100,0,0,1,2,0,0,4,6\n600,0,1,1,2,0,0,4,6\nTotal number of taps: 2\n")
    r = readers.read_recording(spark, p, "ft_cloudupdrs").orderBy("seq").collect()
    assert [(x["td"], x["action_type"], x["x_target"]) for x in r] == [(0.0, 0.0, 4.0), (0.5, 1.0, 4.0)]
    p = put(tmp_path, "fo.csv", "1,2,3\n2,2,3\n3,2,3\n")
    assert readers.read_recording(spark, p, "ft_opdc").count() == 2
    p = put(tmp_path, "fm.json", '[{"TapTimeStamp": 0, "TapCoordinate": "{89.5, -4}", "TappedButtonId": "TappedButtonLeft"}]')
    r = readers.read_recording(spark, p, "ft_mpower", left=(0, 0, 10, 20), right=(50, 0, 10, 20)).first()
    assert (r["x"], r["y"], r["x_target"], r["y_target"]) == (89.5, -4.0, 5.0, 10.0)
    p = put(tmp_path, "re.csv", "1,0,0,1,0\n2,0,0,1,1\n3,0,0,0,0\n4,0,0,0,0\n")
    r = readers.read_recording(spark, p, "opdc_react").orderBy("seq").collect()
    assert [(x["b_vis"], x["b_pres"]) for x in r] == [(True, False), (True, True), (False, False)]
    rows = readers.read_recording(spark, p, "opdc_react").withColumnRenamed("path", "key")
    assert tapping.reaction_times(rows).first()["mean_total_reaction_time"] == pytest.approx(1.0)
    assert tapping.reaction_times(rows, fixed=True).first()["mean_release_button_time"] == pytest.approx(0.5)


def test_validation_names_and_sinks(spark, tmp_path):
    put(tmp_path, "T_-_KINETIC_TREMOR_-_RIGHT_HAND_12.csv", "0,1,2,2\n1,0,3,4\n")
    put(tmp_path, "T_-_KINETIC_TREMOR_-_LEFT_HAND_13.csv", "0,1,2,2\n1,0,300,4\n")
    rows = readers.read_recording(spark, str(tmp_path))
    good, bad = readers.validated(rows, "motion")
    assert good.select("path").distinct().count() == 1 == bad.count()
    names = {(r["session"], r["code"]) for r in readers.name_parts(rows.select("path").distinct()).collect()}
    assert names == {("12", "KT-RH"), ("13", "KT-LH")}
    df = spark.createDataFrame([("a-1", 2.0)], ["id", "TT-RH-x"])
    sinks.write_features(df, str(tmp_path / "o"), plain_names=True)
    assert spark.read.csv(str(tmp_path / "o"), header=True).columns == ["id", "TT_RH_x"]


def test_audio(spark, tmp_path):
    (tmp_path / "s").mkdir()
    with wave.open(str(tmp_path / "s" / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<3h", 0, 16384, -32768))
    r = readers.read_audio(spark, str(tmp_path / "s")).first()
    assert (r["fs"], r["samples"]) == (8000, [0.0, 0.5, -1.0])
