"""Hand-computed edge cases: ties, nulls, rounding and bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import casts as C
from kerbline.functions import geometry as G
from kerbline.functions import labels as L
from kerbline.operators import knn as K
from kerbline.operators import manifests as M
from kerbline.operators import metrics as E
from kerbline.operators import motion as MO
from kerbline.operators import overlay as O
from kerbline.operators import rollup as R
from kerbline.operators import rules
from kerbline.operators import tracks as T


def one(df):
    return df.collect()[0]


def test_tile_boxes_round_half_even(spark):
    b = one(spark.createDataFrame([(101, 75)], "w int, h int").select(G.tile_boxes(F.col("w"), F.col("h")).alias("b")))["b"]
    assert [x["left"] for x in b[:3]] == [0, 34, 67] and b[2]["right"] == 101
    assert (b[0]["upper"], b[0]["lower"], b[3]["lower"]) == (37, 56, 75)


def test_overlap_must_exceed_a_tenth(spark):
    d = spark.createDataFrame([(100.0, 10.0), (101.0, 10.0)], "w double, h double")
    tile = F.struct(F.lit(0).alias("left"), F.lit(0).alias("upper"), F.lit(200).alias("right"), F.lit(50).alias("lower"))
    share = G.overlap_share(tile, F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))
    assert [r[0] for r in d.select(share > 0.10).collect()] == [False, True]


def test_width_bands(spark):
    d = spark.createDataFrame([(1.599,), (1.6,), (3.2,), (3.21,), (None,)], "w double")
    assert [r[0] for r in d.select(G.crack_width_band(F.col("w"))).collect()] == ["narrow", "moderate", "moderate", "wide", None]


def test_domain_quirk_and_gate(spark):
    d = spark.createDataFrame([("/data/raw/sdnet2018/P", "x.jpg")], "p string, n string")
    assert one(d.select(L.infer_domain(F.col("p"), F.col("n"), F.lit("asphalt"))))[0] == "bridge"
    d = spark.createDataFrame([("asphalt", "bridge"), ("unknown", "bridge")], "s string, d string")
    assert [r[0] for r in d.select(L.label_applicable("spalling", F.col("s"), F.col("d"))).collect()] == [False, True]


def test_unknown_labels_raise(spark):
    with pytest.raises(Exception, match="unsupported surface type"):
        spark.createDataFrame([("lava",)], "s string").select(L.surface_type(F.col("s"))).collect()


def votes(spark, rows):
    schema = "id int, neighbours array<struct<sim: double, ref: int, lab: string>>"
    return spark.createDataFrame([(1, rows)], schema)


def test_vote_rules_differ(spark):
    n = F.col("neighbours")
    tie = votes(spark, [(0.5, 1, "z"), (0.5, 2, "a")])
    assert one(tie.select(K.similarity_vote(n, "lab"), K.distance_vote(n, "lab")))[:] == ("z", "a")
    copy = votes(spark, [(1.0, 1, "z"), (0.99, 2, "a"), (0.99, 3, "a")])
    assert one(copy.select(K.similarity_vote(n, "lab"), K.distance_vote(n, "lab")))[:] == ("a", "z")


def test_pseudo_label_bounds_are_inclusive(spark):
    ok = K.pseudo_label_accepted(F.lit(0.80), F.lit(0.10), F.lit(0.08))
    assert one(spark.range(1).select(ok))[0] is True


def test_shipped_and_blocked_neighbours_agree(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6)).astype("float32")
    v[40] = v[7]
    rows = [(i, [float(x) for x in v[i]], f"p{i}") for i in range(90)]
    d = spark.createDataFrame(rows, "image_id bigint, embedding array<float>, path string")
    q, r = d.where("image_id >= 60"), d.where("image_id < 60")
    shipped = K.ranked(K.knn(q, r, 5, payload=["path"]), ["image_id"])
    spark.conf.set("kerbline.maxBroadcastBytes", "10")
    old = K.BLOCK_ROWS
    K.BLOCK_ROWS = 13
    try:
        blocked = K.ranked(K.knn(q, r, 5, payload=["path"]), ["image_id"])
        assert sorted(map(tuple, shipped.collect())) == sorted(map(tuple, blocked.collect()))
    finally:
        K.BLOCK_ROWS = old
        spark.conf.unset("kerbline.maxBroadcastBytes")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [int(x) for x in np.argsort(-(unit[61] @ unit[:60].T), kind="stable")[:5]]
    assert [x["ref"] for x in shipped.where("image_id = 61").orderBy("rank").collect()] == want


def test_calibrated_threshold(spark):
    d = spark.createDataFrame([(i / 1000.0,) for i in range(100)], "mean_cosine double")
    assert one(K.calibrated_threshold(d))["threshold"] == pytest.approx(0.005)
    assert one(K.calibrated_threshold(d.where("mean_cosine > 9")))["threshold"] == pytest.approx(0.45)


def test_median_grade_is_half_even(spark):
    d = spark.createDataFrame([(0, 1, 1, 0, 0), (0, 0, 1, 1, 0), (0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int")
    assert [r[0] for r in d.select(R.median_grade([F.col(c) for c in "abcde"])).collect()] == [2, 4, None]


def test_threshold_search_takes_the_lowest(spark):
    d = spark.createDataFrame([(1, 0.97), (0, 0.97)], "y int, p double")
    assert one(E.threshold_search(d, [], F.col("y"), F.col("p")))["threshold"] == pytest.approx(0.05)


def test_threshold_index_matches_comparison(spark):
    points = E.grid_points(E.HEAD_GRID)
    values = points + [np.nextafter(p, 0) for p in points] + [0.0, 1.0, 0.333]
    d = spark.createDataFrame([(float(v),) for v in values], "p double")
    got = [r[0] for r in d.select(E.threshold_index(F.col("p"), points)).collect()]
    assert got == [sum(p <= v for p in points) for v in values]


def test_auc_is_null_with_one_class(spark):
    d = spark.createDataFrame([("s", "a", 1, 0.9), ("s", "a", 1, 0.2), ("s", "b", 0, 0.4)], "split string, src string, y int, p double")
    got = {r["src"]: r for r in E.binary_metrics(d, "y", "p", 0.5, ["split"], "src").collect()}
    assert got["a"]["roc_auc"] is None and got["overall"]["roc_auc"] == pytest.approx(0.5)


def test_split_bounds(spark):
    rows = [(s, f"{s}{i}") for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for i in range(n)]
    d = M.stratified_split(spark.createDataFrame(rows, "s string, image_path string"), ["s"])
    got = {(r["s"], r["split"]): r["count"] for r in d.groupBy("s", "split").count().collect()}
    want = {"a": (1, 0, 0), "b": (1, 1, 0), "c": (1, 1, 1), "d": (7, 2, 1)}
    assert {s: tuple(got.get((s, x), 0) for x in ("train", "val", "test")) for s in want} == want


def test_largest_remainder(spark):
    d = spark.createDataFrame([("a", 4), ("b", 4), ("c", 2)], "k string, n bigint")
    got = {r["k"]: r["quota"] for r in M.proportional_quotas(d, ["k"], F.lit(4)).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_round_robin(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2)]
    d = M.top_per_group(spark.createDataFrame(rows, "g string, k int"), "g", [F.col("k")], 9)
    assert [(r["g"], r["k"]) for r in M.round_robin(d, "g", 5).collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("c", 2)]


TRACK = "session_id bigint, point_id bigint, utc_ms double, t double, lat double, lon double, alt_m double, speed_mps double, heading_deg double"


def track(spark, ts, **kw):
    rows = [(1, i, None, t, 48.0 + i * 1e-4, 17.0, kw.get("alt", [None] * 9)[i], kw.get("speed", [None] * 9)[i], kw.get("head", [None] * 9)[i]) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, TRACK)


def test_track_times(spark):
    def times(ts):
        return [r["t"] for r in T.finalize_track(track(spark, ts), "x").orderBy("point_id").collect()]

    assert times([None, None, None]) == [0.0, 1.0, 2.0]
    assert times([5.0, 5.0]) == [0.0, 1.0]
    assert times([0.0, 1.0, 1.0]) == pytest.approx([0.0, 1.000001, 1.000002])
    # Both ends take the nearest known time; the repeated one is then nudged by position.
    assert times([None, 2.0, None, 4.0]) == pytest.approx([2.0, 2.000001, 3.000002, 4.000003], abs=1e-9)
    assert times([1.0, 2.0, None, 4.0]) == [1.0, 2.0, 3.0, 4.0]


def test_derived_speed_repeats_the_second(spark):
    r = T.finalize_track(track(spark, [0.0, 1.0, 3.0]), "x").orderBy("t").collect()
    assert r[0]["speed_mps"] == pytest.approx(r[1]["speed_mps"]) and r[1]["speed_mps"] == pytest.approx(11.132, abs=1e-3)
    assert r[2]["speed_mps"] == pytest.approx(11.132 / 2, abs=1e-3) and r[0]["heading_deg"] == pytest.approx(0.0)


def test_interpolation_clamps_and_unwraps(spark):
    t = track(spark, [0.0, 10.0], alt=[7.0, None], head=[350.0, 10.0]).withColumn("speed_kmh", F.lit(None).cast("double"))
    s = spark.createDataFrame([(1, 1, -5.0), (1, 2, 5.0), (1, 3, 50.0)], "session_id bigint, sample_id int, t double")
    r = {x["sample_id"]: x for x in T.interpolate_track(s, t).collect()}
    assert r[1]["lat"] == 48.0 and r[3]["lat"] == pytest.approx(48.0001) and r[2]["lat"] == pytest.approx(48.00005)
    assert [r[i]["alt_m"] for i in (1, 2, 3)] == [7.0] * 3 and r[2]["speed_mps"] is None
    assert r[2]["heading_deg"] == pytest.approx(0.0, abs=1e-9)
    f = spark.createDataFrame([(1, 0, 5)], "session_id bigint, frame_index bigint, utc_ms bigint")
    gps = spark.createDataFrame([(1, 0, 1.0, 1.0, 350.0), (1, 10, 1.0, 1.0, 10.0)], "session_id bigint, utc_ms bigint, lat double, lon double, heading_deg double")
    assert one(T.attach_gps(f, gps, ["heading_deg"]))["heading_deg"] == pytest.approx(180.0)


def test_nearest_sample_prefers_the_earlier(spark):
    s = spark.createDataFrame([(1, 0, 100, 0.0), (1, 1, 101, 2.0)], "session_id bigint, sample_order bigint, frame_index bigint, t double")
    p = spark.createDataFrame([(1, 1, None, 1.0, 3), (1, 2, 100, 9.0, 4), (1, 3, 100, 9.5, 5)], "session_id bigint, problem_id bigint, frame_index bigint, t double, quality_grade int")
    m = T.nearest_sample(p, s)
    assert {r["problem_id"]: r["sample_order"] for r in m.collect()} == {1: 0, 2: 0, 3: 0}
    o = T.overlay_problems(s.withColumn("quality_grade", F.lit(1)), m, ["quality_grade"]).orderBy("sample_order").collect()
    assert [r["quality_grade"] for r in o] == [5, 1]


def test_time_gap_needs_more_than_five_seconds(spark):
    t = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 11.0, 16.01, 17.0, 18.0]
    d = spark.createDataFrame([(1, i, x, 0.0, 0.0, None) for i, x in enumerate(t)], "session_id bigint, point_id bigint, t double, lat double, lon double, speed_mps double")
    p = T.pair_measures(d, ["t"])
    g = T.gap_markers(p, T.session_medians(p)).collect()
    assert [(r["sample_order"], r["reason"]) for r in g] == [(7, "time_gap")]


def imu(spark, rows):
    return spark.createDataFrame([(1, t, i, a, 0.0, 0.0) for i, (t, a) in enumerate(rows)], "session_id bigint, utc_ms bigint, seq bigint, ax double, ay double, az double")


def test_variance_window(spark):
    rows = [(i * 100, float(i % 2)) for i in range(10)] + [(1000, 1.0)]
    r = MO.trailing_variance(imu(spark, rows)).orderBy("seq").collect()
    assert (r[6]["enough"], r[7]["enough"]) == (False, True) and r[0]["variance"] == 0.0
    assert r[9]["variance"] == pytest.approx(np.var([i % 2 for i in range(10)], ddof=1))
    assert r[10]["variance"] == pytest.approx(np.var([i % 2 for i in range(1, 10)] + [1], ddof=1))


def test_pause_after_more_than_three_seconds(spark):
    calm = [(i * 100, 1.0) for i in range(8)]
    base = 700
    rows = calm + [(base + k, 1.0) for k in range(100, 3000, 100)] + [(base + 3000, 1.0), (base + 3001, 1.0), (base + 3100, 1.0), (base + 3200, 9.0)]
    m = imu(spark, rows)
    gps = spark.createDataFrame([], "session_id bigint, utc_ms bigint, seq bigint, speed_mps double")
    r = {x["utc_ms"]: x for x in MO.auto_pause(MO.motion_events(gps, MO.trailing_variance(m))).collect()}
    assert not r[base + 3000]["paused"] and r[base + 3001]["paused"] and r[base + 3100]["paused"]
    assert not r[base + 3200]["paused"] and r[base + 3200]["segment"] == 2
    assert MO.PauseSettings().resume_variance == pytest.approx(0.12889, abs=1e-5)


def signals(spark, quality, domain="pavement", present=(), area=None, ratio=0.0):
    d = spark.range(1).select(F.lit(quality).cast("int").alias("quality_grade"), F.lit(domain).alias("inferred_domain"), F.lit(area).cast("double").alias("crack_area_pct"), F.lit(None).cast("string").alias("width_band"))
    for x in L.vocab.DEFECT_LABELS:
        d = d.withColumn(f"signal_{x}", F.struct(F.lit(x in present).alias("present"), F.lit(ratio if x == "crack" else 0.0).alias("tile_ratio")))
    r = one(rules.repair_priority(rules.condition_grade(d)))
    return r["overall_condition_grade"], r["repair_priority"]


def test_grade_and_priority_rules(spark):
    assert signals(spark, None) == (3, "none")
    assert signals(spark, 1, "bridge", ("exposed_rebar",)) == (5, "urgent")
    assert signals(spark, 1, area=1.0) == (4, "plan_repair")
    assert signals(spark, 1, ratio=0.5) == (4, "plan_repair")


def test_confirmation_reasons(spark):
    rows = [(0.6, 0.3, 64), (0.59, 0.3, 64), (0.6, 0.29, 64), (0.6, 0.3, 63), (None, 9.0, 999)]
    d = rules.confirm_crack(spark.createDataFrame(rows, "max_crack_prob double, seg_area_pct double, seg_component_px int"))
    assert [r["crack_confirmation_reason"] for r in d.collect()] == [
        "confirmed", "classifier_below_threshold", "seg_area_below_threshold", "component_length_below_threshold", "classifier_below_threshold"]


def test_edit_fold(spark):
    rows = [("i", 1, "a", "1", False), ("i", 2, "a", None, False), ("i", 3, "b", "2", False), ("i", 4, None, None, True), ("i", 5, "c", "3", False), ("j", 1, "a", None, False)]
    d = O.fold_edits(spark.createDataFrame(rows, "id string, seq int, key string, value string, revert_all boolean"))
    assert [(r["id"], r["labels"]) for r in d.collect()] == [("i", {"c": "3"})]


def test_minute_label_and_lenient_casts(spark):
    r = one(spark.range(1).select(C.minute_label(F.lit(65.25)), C.finite(F.lit("NaN")), C.gating_enabled(F.lit(None).cast("string"))))
    assert r[:] == ("01:05.25", None, True)
