"""Tile to frame to session aggregation.

Vocabularies are closed, so medians and modes are read off fixed-width counters:
packed tiles meet in the task of their frame, one shuffle, one hash aggregate, and
no per-group lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import labels as L

TILE_SURFACES = [*vocab.SURFACE_TYPES, "unknown"]


def gate_tiles(tiles: DataFrame, thresholds: dict[str, float], crack_threshold: float, gating: bool = True) -> DataFrame:
    """Adds the tile domain, the crack flag and, per label, applicability, gated probability and flag."""
    domain = L.infer_domain(F.col("source_path"), F.col("filename"), F.col("surface_type"))
    crack = F.coalesce(F.col("tile_crack_prob") >= crack_threshold, F.lit(False))
    out = tiles.withColumns({"defect_domain": domain, "tile_crack": crack})
    # The same test serves every gated label; it is evaluated once per tile.
    out = out.withColumn("_gate", L.structural_context(F.col("surface_type"), F.col("defect_domain")))
    cols: list[Column] = []
    for label, cut in thresholds.items():
        raw = F.col(f"{label}_prob_raw")
        ok = F.col("_gate") if gating and label in vocab.GATED_LABELS else F.lit(True)
        cols += [
            ok.alias(f"{label}_applicable"),
            L.gated_probability(raw, ok).alias(f"{label}_prob"),
            (ok & F.coalesce(raw >= cut, F.lit(False))).alias(f"{label}_flag"),
        ]
    return out.select("*", *cols).drop("_gate")


def _plus(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def median_grade(counts: list[Column]) -> Column:
    """Half-even rounded median of grades 1..n given their counts; null without any."""
    total = _plus(counts)

    def at(rank: Column) -> Column:
        cases, seen = None, F.lit(0)
        for grade, count in enumerate(counts, start=1):
            seen = seen + count
            cases = F.when(seen > rank, grade) if cases is None else cases.when(seen > rank, grade)
        return cases

    pair = at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))
    return F.when(total > 0, F.rint(pair / 2.0).cast("int"))


def _packed(tiles: DataFrame, labels: list[str], keys: tuple[str, ...]) -> DataFrame:
    """The values of a tile that the rollup reads, with its tests, grade and surface as the bits of `_tests`.

    From the lowest bit: road, crack, per label applicable and flagged, the grade in
    three bits (7: outside the vocabulary, 0: none), the surface in the rest (0: outside).
    """
    quality, surface = F.col("predicted_quality"), F.col("surface_type")
    tests = [~F.col("non_road"), F.col("tile_crack"), *[F.col(f"{x}_{t}") for x in labels for t in ("applicable", "flag")]]
    grade = F.when(quality.isin(list(vocab.QUALITY_GRADES)), quality).when(quality.isNotNull(), 7).otherwise(0)
    kind = _plus([F.when(surface == name, i).otherwise(0) for i, name in enumerate(TILE_SURFACES, start=1)])
    bits = [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)]
    bits += [grade * (1 << len(tests)), kind * (1 << len(tests) + 3)]
    probs = [c for x in labels for c in (
        F.when(F.col(f"{x}_applicable"), F.col(f"{x}_prob")).alias(f"{x}_prob"),
        F.coalesce(f"{x}_prob_raw", f"{x}_prob").alias(f"{x}_prob_raw"),
    )]
    return tiles.select(*keys, "tile_pos", "confidence", "tile_crack_prob", _plus(bits).cast("int").alias("_tests"), *probs)


def frame_rollup(tiles: DataFrame, labels: list[str], keys: tuple[str, ...] = ("frame_index", "source_path", "filename")) -> DataFrame:
    """Gated tiles to one row per frame: grade, surface, ratios, and the raw material of the defect signals.

    The frame's own text columns are grouping keys, so that every buffer has a fixed
    width and the hash aggregate applies. Tiles of a frame may lie anywhere in the input:
    buffers on the map side would be as many as tiles and several times as wide, so
    packed tiles are dealt by the first key and each task holds the buffers of its frames
    alone. The rows of a frame stay together for joins on that key.
    """
    tests = F.col("_tests")

    def bit(i: int) -> Column:
        return F.getbit(tests, F.lit(i)) == 1

    road = bit(0)
    top = 2 + 2 * len(labels)
    quality, surface = F.shiftright(tests, top).bitwiseAND(7), F.shiftright(tests, top + 3)
    aggs = [F.count_if(road & (quality == g)).alias(f"_q{g}") for g in vocab.QUALITY_GRADES]
    for i in range(len(TILE_SURFACES)):
        aggs.append(F.count_if(road & (surface == i + 1)).alias(f"_s{i}"))
        aggs.append(F.min(F.when(road & (surface == i + 1), F.col("tile_pos"))).alias(f"_f{i}"))
    aggs += [
        F.sum(F.when(road, F.col("confidence"))).alias("_conf"),
        F.count_if(road & (quality == 7)).alias("_q_other"),
        F.count_if(road).alias("road_tile_count"),
        F.count(F.lit(1)).alias("tile_count"),
        F.count_if(road & bit(1)).alias("_cracked"),
        F.max(F.when(road, F.col("tile_crack_prob"))).alias("_road_crack_prob"),
        F.max("tile_crack_prob").alias("_any_crack_prob"),
    ]
    for i, label in enumerate(labels):
        ok, flag = bit(2 + 2 * i), bit(3 + 2 * i)
        aggs += [
            F.count_if(road & flag).alias(f"_{label}_road"),
            F.count_if(ok).alias(f"_{label}_ok"),
            F.count_if(ok & flag).alias(f"_{label}_hits"),
            F.max(f"{label}_prob").alias(f"_{label}_prob"),
            F.max(f"{label}_prob_raw").alias(f"_{label}_raw"),
        ]
    g = _packed(tiles, labels, keys).repartition(keys[0]).groupBy(*keys).agg(*aggs)
    n = F.col("road_tile_count")
    votes = [F.struct(F.col(f"_s{i}").alias("n"), (-F.col(f"_f{i}")).alias("p"), F.lit(s).alias("s")) for i, s in enumerate(TILE_SURFACES)]
    counted = _plus([F.col(f"_s{i}") for i in range(len(TILE_SURFACES))])
    mode = F.when(counted < n, F.raise_error(F.lit("tile surface outside the vocabulary"))).otherwise(F.greatest(*votes)["s"])

    def per_road(total: Column) -> Column:
        return F.when(n > 0, total / n).otherwise(F.lit(0.0))

    out = g.select(
        *keys,
        F.when(F.col("_q_other") > 0, F.raise_error(F.lit("tile grade outside the vocabulary"))).otherwise(median_grade([F.col(f"_q{q}") for q in vocab.QUALITY_GRADES])).cast("int").alias("predicted_quality"),
        F.when(n > 0, mode).otherwise("non_road").alias("surface_type"),
        per_road(F.col("_conf")).alias("confidence"),
        "road_tile_count",
        "tile_count",
        per_road(F.col("_cracked")).alias("crack_ratio"),
        (F.col("_cracked") > 0).alias("frame_has_crack"),
        F.coalesce("_road_crack_prob", "_any_crack_prob").alias("max_crack_prob"),
        "_any_crack_prob",
        *[per_road(F.col(f"_{x}_road")).alias(f"defect_{x}_ratio") for x in labels],
        *[(F.col(f"_{x}_road") > 0).alias(f"frame_has_defect_{x}") for x in labels],
        *[(F.col(f"_{x}_ok") > 0).alias(f"_{x}_seen") for x in labels],
        *[F.try_divide(F.col(f"_{x}_hits").cast("double"), F.col(f"_{x}_ok").cast("double")).alias(f"_{x}_share") for x in labels],
        *[F.col(f"_{x}_{y}") for x in labels for y in ("prob", "raw")],
    )
    found = F.array_compact(F.array(*[F.when(F.col(f"frame_has_defect_{x}"), F.lit(x)) for x in labels]))
    return out.withColumn("structural_defects", found).withColumn("frame_has_structural_defect", F.size("structural_defects") > 0)


def defect_signals(frames: DataFrame, labels: list[str], gating: Column | None = None) -> DataFrame:
    """Per label `signal_<label>: struct<present, probability, probability_raw, tile_ratio, applicable>`."""
    domain = L.infer_domain(F.col("source_path"), F.col("filename"), F.col("surface_type"))
    out = frames.withColumn("inferred_domain", domain)
    out = out.withColumn("_gate", L.structural_context(F.col("surface_type"), F.col("inferred_domain")))
    on = F.lit(True) if gating is None else gating
    zero = F.lit(0.0)
    cols = []
    for label in labels:
        frame_flag, frame_ratio = F.col(f"frame_has_defect_{label}"), F.col(f"defect_{label}_ratio")
        if label == "crack":
            applicable = F.lit(True)
            ratio = F.greatest("crack_ratio", frame_ratio)
            best = F.greatest("_any_crack_prob", f"_{label}_prob", f"_{label}_raw")
            present = F.col("frame_has_crack") | frame_flag
            prob, raw = F.coalesce(best, ratio), F.coalesce(best, ratio)
        else:
            seen = F.col(f"_{label}_seen")
            applicable = ~on | F.col("_gate") | seen
            ratio = F.when(seen, F.col(f"_{label}_share")).when(applicable, frame_ratio).otherwise(zero)
            present = F.when(seen, F.col(f"_{label}_share") > 0).otherwise(applicable & frame_flag)
            prob = F.coalesce(F.col(f"_{label}_prob"), F.when(applicable, frame_ratio), ratio)
            raw = F.coalesce(F.col(f"_{label}_raw"), prob)
            ratio, prob = F.when(applicable, ratio).otherwise(zero), F.when(applicable, prob).otherwise(zero)
            present = applicable & present
        cols.append(
            F.struct(
                (present | (ratio > 0)).alias("present"),
                prob.alias("probability"),
                raw.alias("probability_raw"),
                ratio.alias("tile_ratio"),
                applicable.alias("applicable"),
            ).alias(f"signal_{label}")
        )
    return out.select("*", *cols).drop("_gate")


def signals_long(frames: DataFrame, labels: list[str], keys: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"signal_{x}").alias("s")) for x in labels]))
    return frames.select(*keys, entries.alias("e")).select(*keys, "e.label", "e.s.*")


def region_mode(tiles: DataFrame, frames: int = 3, top: int = 3) -> DataFrame:
    """`lower_half` when the leading tiles of the leading frames are mostly off the road, else `full`."""
    leading = tiles.select("frame_index").distinct().orderBy("frame_index").limit(frames)
    head = tiles.join(F.broadcast(leading), "frame_index", "left_semi")
    # The rank filter below is pushed under the shuffle as a per-group limit.
    picked = head.groupBy("frame_index", "tile_pos").agg(F.max(F.col("non_road").cast("int")).alias("off"))
    order = Window.partitionBy("frame_index").orderBy("tile_pos")
    picked = picked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    share = picked.groupBy("frame_index").agg(F.avg("off").alias("share")).agg(F.avg("share").alias("off_road_share"))
    mode = F.when(F.col("off_road_share") >= 0.67, "lower_half").otherwise("full")
    return share.select("off_road_share", mode.alias("region"))


def key_counts(df: DataFrame, column: str, keys: list, name: str) -> DataFrame:
    """Counts over all of `keys`, zero-filled, from one aggregate row."""
    one = df.agg(*[F.count_if(F.col(column) == k).alias(f"_{i}") for i, k in enumerate(keys)])
    rows = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("key"), F.col(f"_{i}").alias("n")) for i, k in enumerate(keys)]))
    return one.select(F.lit(name).alias("metric"), rows.alias("r")).select("metric", "r.key", "r.n")


def condition_summary(assessed: DataFrame) -> DataFrame:
    """Frame count, mean grade, and zero-filled priority and descriptor counts, in long form."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg("overall_condition_grade"), F.lit(0.0)).alias("_g")]
    descriptors = list(vocab.CONDITION_DESCRIPTORS.values())
    aggs += [F.count_if(F.col("repair_priority") == p).alias(f"_p{i}") for i, p in enumerate(vocab.PRIORITIES)]
    aggs += [F.count_if(F.col("descriptor") == d).alias(f"_d{i}") for i, d in enumerate(descriptors)]
    one = assessed.agg(*aggs)

    def entry(metric: str, key: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(key).alias("key"), value.cast("double").alias("value"))

    rows = [entry("frames", "all", F.col("_n")), entry("mean_grade", "all", F.col("_g"))]
    rows += [entry("priority", p, F.col(f"_p{i}")) for i, p in enumerate(vocab.PRIORITIES)]
    rows += [entry("descriptor", d, F.col(f"_d{i}")) for i, d in enumerate(descriptors)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def issue_counts(problems: DataFrame, issues: str = "issues") -> DataFrame:
    return problems.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def issue_carriers(problems: DataFrame, issue: str, issues: str = "issues") -> Column:
    return F.count_if(F.array_contains(issues, issue))


def smallest_mode(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent value, the smallest on a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    # Smallest value among those with the top count: order by (-count, value).
    return counts.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def run_summary(frames: DataFrame, labels: list[str]) -> DataFrame:
    """One row of run metrics; the modal surface is read off vocabulary counters."""
    surfaces = sorted([*TILE_SURFACES, "non_road"])
    aggs = [
        F.count(F.lit(1)).alias("frames_analyzed"),
        *[F.count_if(F.col("predicted_quality") == g).alias(f"quality_{g}") for g in vocab.QUALITY_GRADES],
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.avg("crack_ratio").alias("mean_crack_ratio"),
        F.count_if("frame_has_crack").alias("frames_with_crack"),
        F.count_if("frame_has_structural_defect").alias("frames_with_structural_defects"),
        *[F.coalesce(F.avg(f"defect_{x}_ratio"), F.lit(0.0)).alias(f"mean_defect_{x}_ratio") for x in labels],
        *[F.count_if(F.col("surface_type") == s).alias(f"_s{i}") for i, s in enumerate(surfaces)],
    ]
    one = frames.agg(*aggs)
    # Rank is negated so that the alphabetically first surface wins a tie.
    best = F.greatest(*[F.struct(F.col(f"_s{i}").alias("n"), F.lit(-i).alias("r"), F.lit(s).alias("s")) for i, s in enumerate(surfaces)])
    dominant = F.when(F.col("frames_analyzed") > 0, best["s"]).otherwise("unknown")
    return one.withColumn("dominant_surface_type", dominant).drop(*[f"_s{i}" for i in range(len(surfaces))])


def survey_summary(samples: DataFrame, problems: DataFrame, telemetry: DataFrame, source_type: str) -> DataFrame:
    """One row: counts, mean speeds, quality distribution, and the low-speed warning."""
    s = samples.agg(
        F.count(F.lit(1)).alias("samples_analyzed"),
        F.coalesce(F.avg("speed_kmh"), F.lit(0.0)).alias("mean_speed_kmh"),
        *[F.count_if(F.col("quality_grade") == g).alias(f"quality_{g}") for g in vocab.QUALITY_GRADES],
    )
    p = problems.agg(F.count(F.lit(1)).alias("problems_found"), issue_carriers(problems, "crack").alias("confirmed_crack_count"))
    t = telemetry.agg(F.coalesce(F.avg("speed_kmh"), F.lit(0.0)).alias("telemetry_mean_speed_kmh"))
    # Three one-row results side by side.
    joined = s.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")
    slow = F.lit(source_type == "imu_deadreckon") & (F.col("samples_analyzed") > 1) & (F.col("mean_speed_kmh") < 5.0)
    return joined.withColumn("speed_warning", F.when(slow, F.lit(vocab.IMU_SPEED_WARNING)))


def measurement_report(measurements: DataFrame) -> DataFrame:
    """Mean crack area and length and the modal segmenter (smallest on a tie)."""
    counts = measurements.groupBy("segmenter").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("crack_area_pct").alias("_a"), F.sum("total_length_px").alias("_l")
    )
    return counts.agg(
        (F.sum("_a") / F.sum("_n")).alias("mean_area_pct"),
        (F.sum("_l") / F.sum("_n")).alias("mean_length_px"),
        F.min_by("segmenter", F.struct(-F.col("_n"), F.col("segmenter"))).alias("segmenter"),
    )


def session_rollup(segments: DataFrame) -> DataFrame:
    """Segment rows to one session row: sums, start of the first segment, end of the last."""
    first, last = F.col("segment_index"), F.col("segment_index")
    return segments.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("frame_count").alias("frame_count"),
        F.sum("gps_sample_count").alias("gps_sample_count"),
        F.sum("imu_sample_count").alias("imu_sample_count"),
        F.min_by("started_ms", first).alias("started_ms"),
        F.max_by("ended_ms", last).alias("ended_ms"),
        F.min_by("start_lat", first).alias("start_lat"),
        F.max_by("end_lat", last).alias("end_lat"),
    )


def fuse_windows(cells: DataFrame, keys: tuple[str, ...], threshold: float, weighted: bool = True) -> DataFrame:
    """Overlapping window scores to one score per cell, and the thresholded mask."""
    p, w = F.col("p"), (F.col("w") if weighted else F.lit(1.0))
    fused = F.sum(p * w) / F.greatest(F.sum(w), F.lit(1e-6))
    return cells.groupBy(*keys).agg(fused.alias("score")).withColumn("mask", F.col("score") >= threshold)
