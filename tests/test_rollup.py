"""Frame rollup against a plain computation, and where its buffers are held."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from kerbline.operators import rollup as R

TILES = "frame_index long, source_path string, filename string, tile_pos long, surface_type string, predicted_quality int, confidence double, non_road boolean, tile_crack_prob double, crack_prob_raw double, corrosion_prob_raw double"
CUTS = {"crack": 0.4, "corrosion": 0.8}


@pytest.fixture(scope="module")
def tiles(spark):
    rows = []
    for i in range(240):
        surface = ["asphalt", "concrete", "unpaved", "unknown"][i * 7 % 11 % 4]
        rows.append((i % 37, f"/survey/bridge_{i % 37 % 2}", f"f{i % 37}.jpg", i * 13 % 240, surface, [1, 2, 4, 5, None][i % 5], i % 9 / 10,
                     [True, False, False, None][i % 4] if i % 37 else True, None if i % 6 == 0 else i % 10 / 10, None if i % 8 == 0 else i % 7 / 7, i % 11 / 10))
    return spark.createDataFrame(rows, TILES).repartition(5)


def best(values):
    return max((v for v in values if v is not None), default=None)


def test_rollup_equals_plain_counting(tiles):
    gated = R.gate_tiles(tiles, CUTS, 0.5)
    frames = {}
    for t in gated.collect():
        frames.setdefault(t["frame_index"], []).append(t)
    got = {r["frame_index"]: r for r in R.frame_rollup(gated, list(CUTS)).collect()}
    assert got.keys() == frames.keys()
    for key, all_tiles in frames.items():
        road = [t for t in all_tiles if t["non_road"] is False]
        g, grades = got[key], [t["predicted_quality"] for t in road if t["predicted_quality"] is not None]
        first, n = {}, Counter(t["surface_type"] for t in road)
        for t in road:
            first[t["surface_type"]] = min(t["tile_pos"], first.get(t["surface_type"], 1000))
        assert (g["tile_count"], g["road_tile_count"], g["predicted_quality"]) == (len(all_tiles), len(road), round(median(grades)) if grades else None)
        assert g["surface_type"] == (min(n, key=lambda s: (-n[s], first[s])) if road else "non_road")
        assert g["crack_ratio"] == pytest.approx(sum(t["tile_crack"] for t in road) / len(road) if road else 0)
        for x in CUTS:
            ok = [t for t in all_tiles if t[f"{x}_applicable"]]
            assert g[f"defect_{x}_ratio"] == pytest.approx(sum(t[f"{x}_flag"] for t in road) / len(road) if road else 0)
            assert (g[f"_{x}_seen"], g[f"_{x}_prob"]) == (bool(ok), best(t[f"{x}_prob"] for t in ok))
            assert g[f"_{x}_raw"] == best(t[f"{x}_prob_raw"] if t[f"{x}_prob_raw"] is not None else t[f"{x}_prob"] for t in all_tiles)
            assert g[f"_{x}_share"] == (pytest.approx(sum(t[f"{x}_flag"] for t in ok) / len(ok)) if ok else None)


@pytest.mark.parametrize("column, value", [("surface_type", "lava"), ("predicted_quality", 9)])
def test_values_outside_the_vocabulary_are_refused(tiles, column, value):
    odd = tiles.withColumn(column, F.lit(value)).withColumn("non_road", F.lit(False))
    with pytest.raises(Exception, match="outside the vocabulary"):
        R.frame_rollup(R.gate_tiles(odd, CUTS, 0.5), list(CUTS)).collect()


def test_no_buffers_on_the_map_side_and_no_second_shuffle_for_a_join(spark, tiles):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = R.frame_rollup(R.gate_tiles(tiles, CUTS, 0.5), list(CUTS))
        joined = frames.join(spark.range(5).withColumnRenamed("id", "frame_index"), "frame_index", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(frame_index" in line]
    sums = [i for i, line in enumerate(plan) if "HashAggregate" in line]
    assert len(sums) == 2 and len(shuffles) == 2 and max(sums) < shuffles[0]  # the second one deals the other side
