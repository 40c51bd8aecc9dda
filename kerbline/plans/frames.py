"""Queries over the tile table: gating, frame rollup, signals, rules, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import casts as C
from kerbline.functions import geometry as G
from kerbline.functions import labels as L
from kerbline.operators import metrics as M
from kerbline.operators import rollup as R
from kerbline.operators import rules
from kerbline.plans import views
from kerbline.plans.registry import query
from kerbline.plans.views import CRACK_THRESHOLD, LABEL_THRESHOLDS

LABELS = list(LABEL_THRESHOLDS)
MM_PER_PIXEL = 0.5


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gate_tiles(views.v_tiles(spark, sf_dir), LABEL_THRESHOLDS, CRACK_THRESHOLD)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_rollup(gated(spark, sf_dir), LABELS)


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame crack measurements."""
    o = views.table(spark, sf_dir, "orders")
    cents = F.rint(F.col("o_totalprice") * 100).cast("bigint")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("frame_index"),
        (F.col("o_custkey") % 5000).cast("double").alias("crack_area_px"),
        F.when(k % 9 != 0, (cents % 700) / 100.0).alias("crack_area_pct"),
        (F.col("o_custkey") % 400).cast("double").alias("crack_length_px"),
        F.when(k % 4 != 0, (cents % 90) / 10.0).alias("crack_mean_width_px"),
        F.when(k % 4 != 0, (cents % 120) / 10.0).alias("crack_max_width_px"),
        F.lit(None).cast("double").alias("crack_area_mm2"),
        F.lit(None).cast("double").alias("crack_length_mm"),
        F.when(k % 3 == 0, (cents % 45) / 10.0).alias("crack_mean_width_mm"),
        F.lit(None).cast("double").alias("crack_max_width_mm"),
        F.when(k % 9 != 0, (cents % 700) / 1000.0).alias("seg_area_pct"),
        (cents % 130).cast("int").alias("seg_component_px"),
        F.when(k % 2 == 0, "classical").otherwise("dense_head").alias("segmenter"),
    )


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.defect_signals(frames(spark, sf_dir), LABELS)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signalled(spark, sf_dir).withColumn("quality_grade", F.col("predicted_quality"))
    return rules.with_geometry(f.join(geometry(spark, sf_dir), "frame_index", "left"), MM_PER_PIXEL)


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(measured(spark, sf_dir))


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("quality_grade", F.col("predicted_quality"))
    return rules.confirm_crack(f.join(geometry(spark, sf_dir), "frame_index", "left"))


def sql_domain(path: str, name: str, surface: str) -> str:
    text = f"lower({path} || '/' || {name})"
    kind = f"lower(trim(coalesce({surface}, 'unknown')))"
    return f"""CASE
      WHEN contains({text}, 'codebrim') OR contains({text}, 'bridge') THEN 'bridge'
      WHEN contains({text}, 'building') OR contains({text}, 'wall') THEN 'building'
      WHEN contains({text}, 'sdnet2018') AND (contains({text}, '/d') OR contains({text}, 'deck')) THEN 'bridge'
      WHEN contains({text}, 'sdnet2018') AND contains({text}, '/w') THEN 'building'
      WHEN contains({text}, 'sdnet2018') AND (contains({text}, '/p') OR contains({text}, 'pavement')) THEN 'pavement'
      WHEN contains({text}, 'runway') OR contains({text}, 'airport') THEN 'runway'
      WHEN {kind} IN ('asphalt','concrete','paving_stones','sett','unpaved') THEN 'pavement'
      ELSE 'unknown' END"""


def sql_applicable(label: str, surface: str, domain: str) -> str:
    if label == "crack":
        return "true"
    kind = f"lower(trim(coalesce({surface}, 'unknown')))"
    return f"({kind} NOT IN ('asphalt','unpaved','paving_stones','sett','gravel','mud') AND ({kind} = 'concrete' OR {domain} IN ('bridge','building')))"


SQL_GATED = f"""
  dom AS (SELECT *, {sql_domain('source_path', 'filename', 'surface_type')} AS defect_domain,
      coalesce(tile_crack_prob >= {CRACK_THRESHOLD}, false) AS tile_crack FROM v_tiles),
  gated AS (SELECT *, {", ".join(
    f"{sql_applicable(x, 'surface_type', 'defect_domain')} AS {x}_applicable, "
    f"CASE WHEN {sql_applicable(x, 'surface_type', 'defect_domain')} THEN {x}_prob_raw ELSE 0.0::DOUBLE END AS {x}_prob, "
    f"({sql_applicable(x, 'surface_type', 'defect_domain')} AND {x}_prob_raw >= {t}) AS {x}_flag"
    for x, t in LABEL_THRESHOLDS.items())} FROM dom)
"""

SQL_FRAMES = f"""{SQL_GATED},
  modes AS (
    SELECT frame_index, surface_type FROM (
      SELECT frame_index, surface_type, row_number() OVER (PARTITION BY frame_index ORDER BY count(*) DESC, min(tile_pos), surface_type DESC) AS o
      FROM gated WHERE NOT non_road GROUP BY frame_index, surface_type) WHERE o = 1),
  agg AS (
    SELECT frame_index, any_value(source_path) AS source_path, any_value(filename) AS filename,
      CAST(round_even(median(predicted_quality) FILTER (WHERE NOT non_road), 0) AS INTEGER) AS predicted_quality,
      coalesce(avg(confidence) FILTER (WHERE NOT non_road), 0) AS confidence,
      count(*) FILTER (WHERE NOT non_road) AS road_tile_count, count(*) AS tile_count,
      coalesce(avg(CAST(tile_crack AS INTEGER)) FILTER (WHERE NOT non_road), 0) AS crack_ratio,
      coalesce(max(tile_crack_prob) FILTER (WHERE NOT non_road), max(tile_crack_prob)) AS max_crack_prob,
      max(tile_crack_prob) AS any_crack_prob,
      {", ".join(
        f"coalesce(avg(CAST({x}_flag AS INTEGER)) FILTER (WHERE NOT non_road), 0) AS defect_{x}_ratio, "
        f"bool_or({x}_applicable) AS {x}_seen, avg(CAST({x}_flag AS INTEGER)) FILTER (WHERE {x}_applicable) AS {x}_share, "
        f"max({x}_prob) FILTER (WHERE {x}_applicable) AS {x}_best, max({x}_prob_raw) AS {x}_raw"
        for x in LABELS)}
    FROM gated GROUP BY frame_index),
  frames AS (SELECT agg.*, coalesce(modes.surface_type, 'non_road') AS surface_type,
      crack_ratio > 0 AS frame_has_crack,
      concat_ws(',', {", ".join(f"CASE WHEN defect_{x}_ratio > 0 THEN '{x}' END" for x in LABELS)}) AS structural_defects
    FROM agg LEFT JOIN modes USING (frame_index))
"""

_S = []
for _x in LABELS:
    if _x == "crack":
        _S.append(
            "(crack_ratio > 0 OR defect_crack_ratio > 0) AS crack_present, "
            "coalesce(greatest(any_crack_prob, crack_best, crack_raw), greatest(crack_ratio, defect_crack_ratio)) AS crack_probability, "
            "coalesce(greatest(any_crack_prob, crack_best, crack_raw), greatest(crack_ratio, defect_crack_ratio)) AS crack_probability_raw, "
            "greatest(crack_ratio, defect_crack_ratio) AS crack_tile_ratio, true AS crack_ok"
        )
    else:
        _ok = f"({sql_applicable(_x, 'surface_type', 'inferred_domain')} OR {_x}_seen)"
        _ratio = f"(CASE WHEN {_x}_seen THEN {_x}_share ELSE defect_{_x}_ratio END)"
        _S.append(
            f"({_ok} AND {_ratio} > 0) AS {_x}_present, "
            f"CASE WHEN {_ok} THEN coalesce({_x}_best, defect_{_x}_ratio) ELSE 0.0::DOUBLE END AS {_x}_probability, "
            f"{_x}_raw AS {_x}_probability_raw, CASE WHEN {_ok} THEN {_ratio} ELSE 0.0::DOUBLE END AS {_x}_tile_ratio, {_ok} AS {_x}_ok"
        )
SQL_SIGNALS = f"""{SQL_FRAMES},
  placed AS (SELECT *, {sql_domain('source_path', 'filename', 'surface_type')} AS inferred_domain FROM frames),
  sig AS (SELECT *, {", ".join(_S)} FROM placed)
"""
SQL_GEOMETRY = """
  geo AS (SELECT o_orderkey AS frame_index, CAST(o_custkey % 5000 AS DOUBLE) AS crack_area_px,
    CASE WHEN o_orderkey % 9 <> 0 THEN (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 700) / 100.0::DOUBLE END AS crack_area_pct,
    CAST(o_custkey % 400 AS DOUBLE) AS crack_length_px,
    CASE WHEN o_orderkey % 4 <> 0 THEN (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 90) / 10.0::DOUBLE END AS crack_mean_width_px,
    CASE WHEN o_orderkey % 4 <> 0 THEN (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 120) / 10.0::DOUBLE END AS crack_max_width_px,
    CASE WHEN o_orderkey % 3 = 0 THEN (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 45) / 10.0::DOUBLE END AS given_width_mm,
    CASE WHEN o_orderkey % 9 <> 0 THEN (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 700) / 1000.0::DOUBLE END AS seg_area_pct,
    CAST(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 130 AS INTEGER) AS seg_component_px,
    CASE WHEN o_orderkey % 2 = 0 THEN 'classical' ELSE 'dense_head' END AS segmenter
    FROM orders)
"""
SQL_MEASURED = f"""{SQL_SIGNALS}, {SQL_GEOMETRY},
  m0 AS (SELECT sig.*, sig.predicted_quality AS quality_grade, geo.* EXCLUDE (frame_index),
      coalesce(given_width_mm, crack_mean_width_px * {MM_PER_PIXEL}) AS crack_mean_width_mm,
      crack_max_width_px * {MM_PER_PIXEL} AS crack_max_width_mm, crack_length_px * {MM_PER_PIXEL} AS crack_length_mm,
      crack_area_px * {MM_PER_PIXEL**2} AS crack_area_mm2
    FROM sig LEFT JOIN geo USING (frame_index)),
  measured AS (SELECT *, CASE WHEN crack_mean_width_mm < 1.6 THEN 'narrow' WHEN crack_mean_width_mm <= 3.2 THEN 'moderate'
      WHEN crack_mean_width_mm IS NOT NULL THEN 'wide' END AS width_band FROM m0)
"""

# Rule conditions written out again as SQL predicates, in the same order.
_GRADE_SQL = [
    ("critical_structural_defect", 5, "(exposed_rebar_present OR corrosion_present) AND inferred_domain IN ('bridge','building')"),
    ("wide_crack", 5, "width_band = 'wide'"),
    ("large_crack_area", 5, "crack_area_pct >= 5.0"),
    ("spalling", 4, "spalling_present"),
    ("moderate_crack", 4, "width_band = 'moderate'"),
    ("material_crack_area", 4, "crack_area_pct >= 1.0"),
    ("many_cracked_tiles", 4, "crack_tile_ratio >= 0.5"),
    ("minor_crack", 3, "crack_present"),
    ("efflorescence", 3, "efflorescence_present"),
]
_PRIORITY_SQL = [
    ("structural_exposed_rebar_or_corrosion", 3, "(exposed_rebar_present OR corrosion_present) AND inferred_domain IN ('bridge','building')"),
    ("wide_crack", 3, "width_band = 'wide'"),
    ("quality_grade_5", 3, "quality_grade >= 5"),
    ("large_crack_area", 3, "crack_area_pct >= 5.0"),
    ("moderate_crack", 2, "width_band = 'moderate'"),
    ("spalling", 2, "spalling_present"),
    ("quality_grade_4", 2, "quality_grade >= 4"),
    ("material_crack_area", 2, "crack_area_pct >= 1.0"),
    ("many_cracked_tiles", 2, "crack_tile_ratio >= 0.5"),
    ("minor_crack", 1, "crack_present"),
    ("efflorescence", 1, "efflorescence_present"),
    ("quality_grade_3", 1, "quality_grade = 3"),
]
_GRADE_EXPR = "least(5, greatest(1, coalesce(quality_grade, 3), " + ", ".join(f"CASE WHEN {c} THEN {g} ELSE 0 END" for _, g, c in _GRADE_SQL) + "))"
_GRADE_IDS = "concat_ws(', ', CASE WHEN quality_grade IS NOT NULL THEN 'quality_baseline' END, " + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for i, _, c in _GRADE_SQL) + ")"
_PRIO_EXPR = "(['none','monitor','plan_repair','urgent'])[1 + greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {g} ELSE 0 END" for _, g, c in _PRIORITY_SQL) + ")]"
_PRIO_IDS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for i, _, c in _PRIORITY_SQL) + ")"
SQL_ASSESSED = f"""{SQL_MEASURED},
  graded AS (SELECT *, CAST({_GRADE_EXPR} AS INTEGER) AS overall_condition_grade, {_GRADE_IDS} AS condition_rules,
     {_PRIO_EXPR} AS repair_priority, {_PRIO_IDS} AS repair_rules FROM measured),
  assessed AS (SELECT *, (['Good','Satisfactory','Fair','Poor','Serious'])[overall_condition_grade] AS descriptor,
     concat_ws(', ', {", ".join(f"CASE WHEN {x}_present THEN '{x}' END" for x in LABELS)}) AS key_defects FROM graded)
"""
SQL_CONFIRMED = f"""{SQL_FRAMES}, {SQL_GEOMETRY},
  confirmed AS (SELECT *, CASE WHEN coalesce(max_crack_prob, 0) < 0.6 THEN 'classifier_below_threshold'
      WHEN coalesce(seg_area_pct, 0) < 0.3 THEN 'seg_area_below_threshold'
      WHEN coalesce(seg_component_px, 0) < 64 THEN 'component_length_below_threshold' ELSE 'confirmed' END AS reason
    FROM frames LEFT JOIN geo USING (frame_index)),
  flagged AS (SELECT *, concat_ws(',', CASE WHEN reason = 'confirmed' THEN 'crack' END,
      {", ".join(f"CASE WHEN defect_{x}_ratio > 0 THEN '{x}' END" for x in LABELS if x != "crack")},
      CASE WHEN predicted_quality >= 4 THEN 'quality_grade_' || predicted_quality END) AS issues FROM confirmed)
"""


@query("P6_infer_domain", f"""SELECT DISTINCT source_path, surface_type, {sql_domain('source_path', 'filename', 'surface_type')} AS domain
    FROM v_tiles""", ("v_tiles",))
def p6(spark, sf_dir):
    t = views.v_tiles(spark, sf_dir)
    return t.select("source_path", "surface_type", L.infer_domain(F.col("source_path"), F.col("filename"), F.col("surface_type")).alias("domain")).distinct()


@query("P7_applicability_gate", f"WITH {SQL_GATED} SELECT frame_index, tile_pos, spalling_applicable, spalling_prob, spalling_flag, crack_flag, corrosion_flag, defect_domain FROM gated", ("v_tiles",))
def p7(spark, sf_dir):
    return gated(spark, sf_dir).select("frame_index", "tile_pos", "spalling_applicable", "spalling_prob", "spalling_flag", "crack_flag", "corrosion_flag", "defect_domain")


@query("A5_frame_rollup", f"""WITH {SQL_FRAMES} SELECT frame_index, predicted_quality, surface_type, round(confidence, 6) AS confidence,
    road_tile_count, tile_count, round(crack_ratio, 6) AS crack_ratio, frame_has_crack, round(defect_spalling_ratio, 6) AS spalling_ratio,
    structural_defects FROM frames""", ("v_tiles",))
def a5(spark, sf_dir):
    return frames(spark, sf_dir).select(
        "frame_index", "predicted_quality", "surface_type", F.round("confidence", 6).alias("confidence"), "road_tile_count",
        "tile_count", F.round("crack_ratio", 6).alias("crack_ratio"), "frame_has_crack",
        F.round("defect_spalling_ratio", 6).alias("spalling_ratio"), F.concat_ws(",", "structural_defects").alias("structural_defects"))


@query("A6_max_crack_probability", f"WITH {SQL_FRAMES} SELECT frame_index, max_crack_prob FROM frames", ("v_tiles",))
def a6(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_index", "max_crack_prob")


@query("A7_defect_signals", f"WITH {SQL_SIGNALS} " + " UNION ALL ".join(
    f"SELECT frame_index, '{x}' AS label, {x}_present AS present, round({x}_probability, 6) AS probability, "
    f"round({x}_probability_raw, 6) AS probability_raw, round({x}_tile_ratio, 6) AS tile_ratio, {x}_ok AS applicable FROM sig" for x in LABELS), ("v_tiles",))
def a7(spark, sf_dir):
    s = R.signals_long(signalled(spark, sf_dir), LABELS)
    return s.select("frame_index", "label", "present", *[F.round(c, 6).alias(c) for c in ("probability", "probability_raw", "tile_ratio")], "applicable")


@query("A20_region_mode", """
    WITH f AS (SELECT DISTINCT frame_index FROM v_tiles ORDER BY 1 LIMIT 3),
    p AS (SELECT frame_index, tile_pos, max(CAST(non_road AS INTEGER)) AS off FROM v_tiles WHERE frame_index IN (SELECT * FROM f) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY tile_pos) AS o FROM p),
    s AS (SELECT avg(share) AS share FROM (SELECT frame_index, avg(off) AS share FROM t WHERE o <= 3 GROUP BY 1))
    SELECT round(share, 6) AS off_road_share, CASE WHEN share >= 0.67 THEN 'lower_half' ELSE 'full' END AS region FROM s""", ("v_tiles",))
def a20(spark, sf_dir):
    return R.region_mode(views.v_tiles(spark, sf_dir)).select(F.round("off_road_share", 6).alias("off_road_share"), "region")


@query("P11_P12_geometry_units", f"""WITH {SQL_GEOMETRY}, w AS (SELECT *, coalesce(given_width_mm, crack_mean_width_px * {MM_PER_PIXEL}) AS mm FROM geo)
    SELECT frame_index, mm AS mean_width_mm, crack_area_px * {MM_PER_PIXEL**2} AS area_mm2, crack_length_px * {MM_PER_PIXEL} AS length_mm,
      CASE WHEN mm < 1.6 THEN 'narrow' WHEN mm <= 3.2 THEN 'moderate' WHEN mm IS NOT NULL THEN 'wide' END AS width_band FROM w""")
def p11(spark, sf_dir):
    g = rules.with_geometry(geometry(spark, sf_dir), MM_PER_PIXEL)
    return g.select("frame_index", F.col("crack_mean_width_mm").alias("mean_width_mm"), F.col("crack_area_mm2").alias("area_mm2"),
                    F.col("crack_length_mm").alias("length_mm"), "width_band")


@query("R1_condition_grade", f"WITH {SQL_ASSESSED} SELECT frame_index, overall_condition_grade, condition_rules FROM assessed", ("v_tiles",))
def r1(spark, sf_dir):
    g = rules.condition_grade(measured(spark, sf_dir))
    return g.select("frame_index", "overall_condition_grade", F.concat_ws(", ", "applied_condition_rules").alias("condition_rules"))


@query("R2_repair_priority", f"WITH {SQL_ASSESSED} SELECT frame_index, repair_priority, repair_rules FROM assessed", ("v_tiles",))
def r2(spark, sf_dir):
    g = rules.repair_priority(measured(spark, sf_dir))
    return g.select("frame_index", "repair_priority", F.concat_ws(", ", "applied_repair_rules").alias("repair_rules"))


_SQL_DEFECT_TEXT = "concat_ws(', ', " + ", ".join(f"CASE WHEN {x}_present THEN '{x} p=' || printf('%.2f', {x}_probability) END" for x in LABELS) + ")"
_SQL_RATIONALE = f"""
  surface_type || ' (' || inferred_domain || ') with ' ||
  coalesce('quality grade ' || quality_grade, 'no quality vote') || '; ' ||
  coalesce(nullif({_SQL_DEFECT_TEXT}, ''), 'no positive defect flags') || '; ' ||
  coalesce(nullif(concat_ws('; ', CASE WHEN crack_area_pct IS NOT NULL THEN 'crack area ' || printf('%.3f', crack_area_pct) || '%' END,
     CASE WHEN crack_mean_width_mm IS NOT NULL THEN 'mean crack width ' || printf('%.2f', crack_mean_width_mm) || ' mm (' || width_band || ')'
          WHEN crack_mean_width_px IS NOT NULL THEN 'mean crack width ' || printf('%.2f', crack_mean_width_px) || ' px' END), ''), 'no crack geometry columns') ||
  '. Proxy grade ' || overall_condition_grade || ' (' || descriptor || ') and priority ' || repair_priority || ' from condition rules [' ||
  coalesce(nullif(condition_rules, ''), 'default proxy rules') || '] and repair rules [' || coalesce(nullif(repair_rules, ''), 'no repair trigger') ||
  ']. {vocab.PROXY_DISCLAIMER} {vocab.VISUAL_LIMITATIONS}'"""


@query("R3_assessment_record", f"""WITH {SQL_ASSESSED} SELECT frame_index, surface_type, inferred_domain, quality_grade, descriptor, key_defects,
    {_SQL_RATIONALE} AS rationale, corrosion_present AS defect_corrosion, round(corrosion_probability, 6) AS defect_corrosion_prob FROM assessed""", ("v_tiles",))
def r3(spark, sf_dir):
    return assessed(spark, sf_dir).select(
        "frame_index", "surface_type", "inferred_domain", "quality_grade", "descriptor", F.concat_ws(", ", "key_defects").alias("key_defects"),
        "rationale", "defect_corrosion", F.round("defect_corrosion_prob", 6).alias("defect_corrosion_prob"))


@query("A8_condition_summary", f"""WITH {SQL_ASSESSED}
    SELECT 'frames' AS metric, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM assessed
    UNION ALL SELECT 'mean_grade', 'all', round(coalesce(avg(overall_condition_grade), 0), 6) FROM assessed
    UNION ALL SELECT 'priority', k, CAST((SELECT count(*) FROM assessed WHERE repair_priority = k) AS DOUBLE) FROM (SELECT unnest(['none','monitor','plan_repair','urgent']) AS k)
    UNION ALL SELECT 'descriptor', k, CAST((SELECT count(*) FROM assessed WHERE descriptor = k) AS DOUBLE) FROM (SELECT unnest(['Good','Satisfactory','Fair','Poor','Serious']) AS k)""", ("v_tiles",))
def a8(spark, sf_dir):
    return R.condition_summary(assessed(spark, sf_dir)).select("metric", "key", F.round("value", 6).alias("value"))


@query("R4_crack_confirmation", f"WITH {SQL_CONFIRMED} SELECT frame_index, coalesce(max_crack_prob >= 0.6, false) AS crack_candidate, reason AS crack_confirmation_reason FROM confirmed", ("v_tiles",))
def r4(spark, sf_dir):
    return confirmed(spark, sf_dir).select("frame_index", "crack_candidate", "crack_confirmation_reason")


@query("R5_problem_rule", f"WITH {SQL_CONFIRMED} SELECT frame_index, issues, issues <> '' AS is_problem FROM flagged", ("v_tiles",))
def r5(spark, sf_dir):
    return rules.flag_problems(confirmed(spark, sf_dir)).select("frame_index", F.concat_ws(",", "issues").alias("issues"), "is_problem")


def problems(spark, sf_dir):
    return rules.flag_problems(confirmed(spark, sf_dir)).where("is_problem")


@query("A9_issue_counts", f"""WITH {SQL_CONFIRMED} SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM flagged WHERE issues <> '') GROUP BY issue""", ("v_tiles",))
def a9(spark, sf_dir):
    return R.issue_counts(problems(spark, sf_dir))


@query("R6_reconfirmation", f"""WITH {SQL_CONFIRMED},
    old AS (SELECT *, frame_has_crack AS crack_detected FROM flagged WHERE issues <> ''),
    new AS (SELECT *, seg_component_px >= 100 AND seg_area_pct IS NOT NULL AS fresh FROM old)
    SELECT frame_index, issues AS raw_issues, crack_detected OR reason = 'confirmed' AS raw_crack_detected,
      (crack_detected OR reason = 'confirmed') AND NOT coalesce(fresh, false) AS crack_unconfirmed,
      concat_ws(',', CASE WHEN fresh THEN 'crack' END,
        {", ".join(f"CASE WHEN defect_{x}_ratio > 0 THEN '{x}' END" for x in LABELS if x != "crack")},
        CASE WHEN predicted_quality >= 4 THEN 'quality_grade_' || predicted_quality END) AS issues FROM new""", ("v_tiles",))
def r6(spark, sf_dir):
    old = problems(spark, sf_dir).withColumn("crack_detected", F.col("frame_has_crack"))
    fresh = geometry(spark, sf_dir).select("frame_index", ((F.col("seg_component_px") >= 100) & F.col("seg_area_pct").isNotNull()).alias("crack_confirmed"))
    out = rules.reconfirm(old, fresh)
    return out.select("frame_index", F.concat_ws(",", "raw_issues").alias("raw_issues"), "raw_crack_detected", "crack_unconfirmed",
                      F.concat_ws(",", "issues").alias("issues"))


@query("A29_measurement_report", f"""WITH {SQL_GEOMETRY}
    SELECT round(avg(crack_area_px / 100.0), 4) AS mean_area_pct, round(avg(crack_length_px), 4) AS mean_length_px,
      (SELECT segmenter FROM geo GROUP BY segmenter ORDER BY count(*) DESC, segmenter LIMIT 1) AS segmenter FROM geo""")
def a29(spark, sf_dir):
    g = geometry(spark, sf_dir).select((F.col("crack_area_px") / 100.0).alias("crack_area_pct"), F.col("crack_length_px").alias("total_length_px"), "segmenter")
    return R.measurement_report(g).select(F.round("mean_area_pct", 4).alias("mean_area_pct"), F.round("mean_length_px", 4).alias("mean_length_px"), "segmenter")


@query("K6_run_summary", f"""WITH {SQL_FRAMES} SELECT count(*) AS frames_analyzed,
    {", ".join(f"count(*) FILTER (WHERE predicted_quality = {g}) AS quality_{g}" for g in vocab.QUALITY_GRADES)},
    round(avg(confidence), 6) AS mean_confidence, round(avg(crack_ratio), 6) AS mean_crack_ratio,
    count(*) FILTER (WHERE frame_has_crack) AS frames_with_crack, count(*) FILTER (WHERE structural_defects <> '') AS frames_with_structural_defects,
    round(avg(defect_spalling_ratio), 6) AS mean_spalling_ratio,
    (SELECT surface_type FROM frames GROUP BY 1 ORDER BY count(*) DESC, surface_type LIMIT 1) AS dominant_surface_type FROM frames""", ("v_tiles",))
def k6(spark, sf_dir):
    s = R.run_summary(frames(spark, sf_dir), LABELS)
    return s.select("frames_analyzed", *[f"quality_{g}" for g in vocab.QUALITY_GRADES], F.round("mean_confidence", 6).alias("mean_confidence"),
                    F.round("mean_crack_ratio", 6).alias("mean_crack_ratio"), "frames_with_crack", "frames_with_structural_defects",
                    F.round("mean_defect_spalling_ratio", 6).alias("mean_spalling_ratio"), "dominant_surface_type")


@query("A25_survey_summary", f"""WITH {SQL_CONFIRMED},
    s AS (SELECT predicted_quality AS quality_grade, CAST(frame_index % 90 AS DOUBLE) AS speed_kmh, issues FROM flagged),
    t AS (SELECT avg(coalesce(speed_mps, 0) * 3.6) AS v FROM v_track)
    SELECT count(*) AS samples_analyzed, round(avg(speed_kmh), 6) AS mean_speed_kmh,
      {", ".join(f"count(*) FILTER (WHERE quality_grade = {g}) AS quality_{g}" for g in vocab.QUALITY_GRADES)},
      count(*) FILTER (WHERE issues <> '') AS problems_found, count(*) FILTER (WHERE list_contains(string_split(issues, ','), 'crack')) AS confirmed_crack_count,
      (SELECT round(v, 6) FROM t) AS telemetry_mean_speed_kmh, CAST(NULL AS VARCHAR) AS speed_warning FROM s""", ("v_tiles", "v_track"))
def a25(spark, sf_dir):
    s = rules.flag_problems(confirmed(spark, sf_dir)).withColumn("speed_kmh", (F.col("frame_index") % 90).cast("double"))
    t = views.v_track(spark, sf_dir).select((F.coalesce("speed_mps", F.lit(0.0)) * 3.6).alias("speed_kmh"))
    out = R.survey_summary(s, s.where("is_problem"), t, "imu_deadreckon")
    return out.select(*[F.round(c, 6).alias(c) if "speed_kmh" in c else F.col(c) for c in out.columns])


@query("T8_problem_preview", f"""WITH {SQL_CONFIRMED} SELECT frame_index, issues, surface_type, printf('%02d:%05.2f', frame_index * 7 // 60, CAST(frame_index * 7 % 60 AS DOUBLE)) AS timestamp
    FROM flagged WHERE issues <> '' ORDER BY frame_index LIMIT 8""", ("v_tiles",))
def t8(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("t", (F.col("frame_index") * 7).cast("double"))
    return p.orderBy("t").limit(8).select("frame_index", F.concat_ws(",", "issues").alias("issues"), "surface_type", C.minute_label(F.col("t")).alias("timestamp"))


@query("A17_pixel_confusion", """
    WITH px AS (SELECT source_path AS source, tile_crack_prob >= 0.485 AS p, crack_prob_raw >= 0.42 AS y FROM v_tiles WHERE tile_crack_prob IS NOT NULL),
    c AS (SELECT coalesce(source, 'overall') AS source, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp,
      count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM px GROUP BY GROUPING SETS ((), (source)))
    SELECT source, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS dice, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM c""", ("v_tiles",))
def a17(spark, sf_dir):
    t = views.v_tiles(spark, sf_dir).where("tile_crack_prob IS NOT NULL")
    px = M.confusion_rows(t, F.col("tile_crack_prob") >= CRACK_THRESHOLD, F.col("crack_prob_raw") >= 0.42, ["source_path"])
    out = M.pixel_metrics(px, "source_path")
    return out.select(F.col("source_path").alias("source"), "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "precision", "recall", "accuracy")])


@query("A24_score_fusion", """
    WITH win AS (SELECT frame_index, tile_pos, tile_crack_prob AS p, unnest(generate_series(tile_pos % 5, tile_pos % 5 + 3)) AS cell, tile_pos % 5 AS start
                 FROM v_tiles WHERE tile_crack_prob IS NOT NULL),
    w AS (SELECT *, CASE WHEN cell - start IN (0, 3) THEN 0.001::DOUBLE ELSE 0.75::DOUBLE END AS w FROM win)
    SELECT frame_index, cell, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS score, sum(p * w) / greatest(sum(w), 1e-6) >= 0.437 AS mask FROM w GROUP BY ALL""", ("v_tiles",))
def a24(spark, sf_dir):
    t = views.v_tiles(spark, sf_dir).where("tile_crack_prob IS NOT NULL")
    start = F.col("tile_pos") % 5
    cells = t.select("frame_index", F.col("tile_crack_prob").alias("p"), F.explode(F.sequence(start, start + 3)).alias("cell"), start.alias("start"))
    cells = cells.withColumn("w", G.hann_weight(F.col("cell") - F.col("start"), 4))
    out = R.fuse_windows(cells, ("frame_index", "cell"), 0.437)
    return out.select("frame_index", "cell", F.round("score", 6).alias("score"), "mask")
