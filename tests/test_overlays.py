"""Session list, source hints, top-up of negatives and exact digits on small tables."""

import pytest
from pyspark.sql import functions as F

from kerbline.functions import casts as C
from kerbline.operators import manifests as M
from kerbline.operators import overlay as O
from kerbline.operators import tracks as T


def test_session_list_takes_the_last_version_and_sorts_by_start(spark):
    log = [(1, 100, 1, False, "a"), (2, 300, 2, False, "b"), (1, 500, 5, False, "c"), (3, 300, 3, False, "d"), (2, 300, 4, True, "b"), (4, None, 6, False, "e"), (2, 50, 9, False, "f"), (5, 1, 7, True, "g")]
    df = spark.createDataFrame(log, "session_id long, started_ms long, version long, deleted boolean, title string")
    got = O.session_list(df.repartition(3)).orderBy("position").collect()
    assert [(r["position"], r["session_id"], r["title"]) for r in got] == [(1, 4, "e"), (2, 1, "c"), (3, 3, "d"), (4, 2, "f")]
    assert O.session_list(df.filter("false")).count() == 0


def test_every_hint_with_and_without_a_file_named_by_hand(spark):
    found = [("a", "gpx", 5), ("a", "embedded", 9), ("b", "embedded", 3), ("b", "imu", 4), ("c", "imu", 0), ("d", "track_json", 2), ("d", "imu", 1)]
    candidates = spark.createDataFrame(found, "recording string, source_type string, rows long")
    named = spark.createDataFrame([("b", "gpx", 7), ("d", "embedded", 8)], "recording string, source_type string, rows long")

    def chosen(hint):
        return {r["recording"]: (r["source_type"], r["rows"], r["problem"]) for r in T.choose_source(candidates, named, ["recording"], hint).collect()}

    lost, wrong = (lambda h: ("none", 0, f"no usable {h} source")), (lambda h: ("none", 0, f"explicit source does not fit {h}"))
    assert chosen("auto") == {"a": ("gpx", 5, None), "b": ("gpx", 7, None), "c": ("none", 0, None), "d": ("embedded", 8, None)}
    assert chosen("sidecar") == {"a": ("gpx", 5, None), "b": ("gpx", 7, None), "c": lost("sidecar"), "d": ("embedded", 8, None)}
    assert chosen("embedded") == {"a": ("embedded", 9, None), "b": ("gpx", 7, None), "c": lost("embedded"), "d": ("embedded", 8, None)}
    assert chosen("imu") == {"a": lost("imu"), "b": ("gpx", 7, None), "c": lost("imu"), "d": wrong("imu")}
    assert set(chosen("none").values()) == {("none", 0, None)} and len(chosen("none")) == 4
    with pytest.raises(ValueError):
        chosen("usb")


def test_negatives_are_topped_up_from_what_is_left(spark):
    rows = [(f"p{i}", "s", "d" if i < 4 else None, "train", ["none"]) for i in range(20)] + [("crack", "s", None, "val", ["crack"])]
    df = spark.createDataFrame(rows, "image_path string, source_dataset string, domain string, split string, labels array<string>")
    for cap, want in ((0, 0), (3, 3), (4, 4), (11, 11), (20, 20), (50, 20)):
        got = M.select_for_embedding(df, cap).collect()
        paths = [r["image_path"] for r in got if r["selected_reason"] == "pure_none_subset"]
        assert len(paths) == len(set(paths)) == want and sum(r["selected_reason"] == "defect_positive" for r in got) == 1
        assert sum(int(p[1:]) < 4 for p in paths) >= min(cap, 4)


def test_digits_follow_the_binary_value(spark):
    values = [0.0, 0.005, 0.015, 0.125, 0.285, 0.375, 1.005, 2.675, 59.995, 59.994999, 59.999, 0.1 + 0.2, 12.345, 1e-9, 4999.9995, 33.335, -0.125, -2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", C.fixed_digits(F.col("v"), 2, 5).alias("a"), C.fixed_digits(F.col("v"), 3, 10).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(f"{v:05.2f}", f"{v:010.3f}") for v in values]
