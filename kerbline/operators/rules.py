"""Condition grade, repair priority, problem and confirmation rules, as data plus a column fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geometry as G


@dataclass(frozen=True)
class Rule:
    id: str
    outcome: int | str
    defects: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    band: str | None = None
    min_area_pct: float | None = None
    min_crack_ratio: float | None = None
    quality: tuple[int | None, int | None] = (None, None)

    def matches(self) -> Column:
        hit = F.lit(True)
        low, high = self.quality
        if low is not None:
            hit = hit & (F.col("quality_grade") >= low)
        if high is not None:
            hit = hit & (F.col("quality_grade") <= high)
        if self.defects:
            some = F.lit(False)
            for label in self.defects:
                some = some | F.col(f"signal_{label}.present")
            hit = hit & some
        if self.domains:
            hit = hit & F.col("inferred_domain").isin(list(self.domains))
        if self.band:
            hit = hit & (F.col("width_band") == self.band)
        if self.min_area_pct is not None:
            hit = hit & (F.col("crack_area_pct") >= self.min_area_pct)
        if self.min_crack_ratio is not None:
            hit = hit & (F.col("signal_crack.tile_ratio") >= self.min_crack_ratio)
        return F.coalesce(hit, F.lit(False))


# --- fixed values: rule ids, outcomes and bounds, in evaluation order --------
GRADE_RULES = [
    Rule("critical_structural_defect", 5, defects=("exposed_rebar", "corrosion"), domains=("bridge", "building")),
    Rule("wide_crack", 5, band="wide"),
    Rule("large_crack_area", 5, min_area_pct=5.0),
    Rule("spalling", 4, defects=("spalling",)),
    Rule("moderate_crack", 4, band="moderate"),
    Rule("material_crack_area", 4, min_area_pct=1.0),
    Rule("many_cracked_tiles", 4, min_crack_ratio=0.5),
    Rule("minor_crack", 3, defects=("crack",)),
    Rule("efflorescence", 3, defects=("efflorescence",)),
]
PRIORITY_RULES = [
    Rule("structural_exposed_rebar_or_corrosion", "urgent", defects=("exposed_rebar", "corrosion"), domains=("bridge", "building")),
    Rule("wide_crack", "urgent", band="wide"),
    Rule("quality_grade_5", "urgent", quality=(5, None)),
    Rule("large_crack_area", "urgent", min_area_pct=5.0),
    Rule("moderate_crack", "plan_repair", band="moderate"),
    Rule("spalling", "plan_repair", defects=("spalling",)),
    Rule("quality_grade_4", "plan_repair", quality=(4, None)),
    Rule("material_crack_area", "plan_repair", min_area_pct=1.0),
    Rule("many_cracked_tiles", "plan_repair", min_crack_ratio=0.5),
    Rule("minor_crack", "monitor", defects=("crack",)),
    Rule("efflorescence", "monitor", defects=("efflorescence",)),
    Rule("quality_grade_3", "monitor", quality=(3, 3)),
]
DEFAULT_GRADE = 3
CRACK_PROB = 0.6
MIN_CRACK_AREA_PCT = 0.3
MIN_COMPONENT_PX = 64
PROBLEM_QUALITY = 4
# --- end of fixed values ------------------------------------------------------


def _with_hits(frames: DataFrame, rules: list[Rule], rank: Callable[[Rule], int]) -> DataFrame:
    """Adds `_hits`: id and rank of every matching rule, so that each predicate is evaluated once."""
    hits = [F.when(r.matches(), F.struct(F.lit(r.id).alias("id"), F.lit(rank(r)).alias("rank"))) for r in rules]
    return frames.withColumn("_hits", F.array_compact(F.array(*hits)))


def condition_grade(frames: DataFrame) -> DataFrame:
    """Grade is the largest floor of all matching rules; expects `quality_grade`, signals, geometry."""
    quality = F.col("quality_grade")
    out = _with_hits(frames, GRADE_RULES, lambda r: r.outcome)
    grade = F.greatest(F.coalesce(quality, F.lit(DEFAULT_GRADE)), F.array_max(F.transform("_hits", lambda h: h["rank"])))
    baseline = F.array_compact(F.array(F.when(quality.isNotNull(), F.lit("quality_baseline"))))
    return out.withColumn("applied_condition_rules", F.concat(baseline, F.transform("_hits", lambda h: h["id"]))).withColumn(
        "overall_condition_grade", F.least(F.greatest(grade, F.lit(1)), F.lit(5)).cast("int")
    ).drop("_hits")


def repair_priority(frames: DataFrame) -> DataFrame:
    out = _with_hits(frames, PRIORITY_RULES, lambda r: vocab.PRIORITIES.index(r.outcome))
    names = F.array(*map(F.lit, vocab.PRIORITIES))
    rank = F.greatest(F.lit(0), F.array_max(F.transform("_hits", lambda h: h["rank"])))
    return out.withColumn("applied_repair_rules", F.transform("_hits", lambda h: h["id"])).withColumn("repair_priority", F.element_at(names, rank + 1)).drop("_hits")


def with_geometry(frames: DataFrame, mm_per_pixel: float | None = None) -> DataFrame:
    """Fills the millimetre columns from pixels where they are missing and adds the width band."""
    out = frames
    for name in ("length", "mean_width", "max_width"):
        out = out.withColumn(f"crack_{name}_mm", G.fill_length_mm(F.col(f"crack_{name}_mm"), F.col(f"crack_{name}_px"), mm_per_pixel))
    out = out.withColumn("crack_area_mm2", G.fill_area_mm2(F.col("crack_area_mm2"), F.col("crack_area_px"), mm_per_pixel))
    return out.withColumn("width_band", G.crack_width_band(F.col("crack_mean_width_mm")))


def _or(text: Column, fallback: str) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(F.lit(fallback))


def assess(frames: DataFrame, labels: list[str] = vocab.DEFECT_LABELS) -> DataFrame:
    """The flat assessment record; `frames` carries signals, geometry and `quality_grade`."""
    out = repair_priority(condition_grade(frames))
    grade = F.col("overall_condition_grade")
    names = F.array(*map(F.lit, vocab.CONDITION_DESCRIPTORS.values()))
    out = out.withColumn("descriptor", F.element_at(names, grade))
    present = [F.when(F.col(f"signal_{x}.present"), F.lit(x)) for x in labels]
    out = out.withColumn("key_defects", F.array_compact(F.array(*present)))
    shown = [
        F.when(F.col(f"signal_{x}.present"), F.format_string(f"{x} p=%.2f", F.col(f"signal_{x}.probability")))
        for x in labels
    ]
    defect_text = _or(F.concat_ws(", ", *shown), "no positive defect flags")
    width = F.when(
        F.col("crack_mean_width_mm").isNotNull(),
        F.format_string("mean crack width %.2f mm (%s)", F.col("crack_mean_width_mm"), F.col("width_band")),
    ).when(F.col("crack_mean_width_px").isNotNull(), F.format_string("mean crack width %.2f px", F.col("crack_mean_width_px")))
    area = F.when(F.col("crack_area_pct").isNotNull(), F.format_string("crack area %.3f%%", F.col("crack_area_pct")))
    geometry_text = _or(F.concat_ws("; ", area, width), "no crack geometry columns")
    quality_text = F.when(
        F.col("quality_grade").isNotNull(), F.format_string("quality grade %d", F.col("quality_grade"))
    ).otherwise("no quality vote")
    rationale = F.concat(
        F.col("surface_type"), F.lit(" ("), F.col("inferred_domain"), F.lit(") with "), quality_text, F.lit("; "),
        defect_text, F.lit("; "), geometry_text, F.lit(". Proxy grade "), grade.cast("string"), F.lit(" ("),
        F.col("descriptor"), F.lit(") and priority "), F.col("repair_priority"), F.lit(" from condition rules ["),
        _or(F.concat_ws(", ", "applied_condition_rules"), "default proxy rules"), F.lit("] and repair rules ["),
        _or(F.concat_ws(", ", "applied_repair_rules"), "no repair trigger"),
        F.lit(f"]. {vocab.PROXY_DISCLAIMER} {vocab.VISUAL_LIMITATIONS}"),
    )
    flat = []
    for x in labels:
        s = F.col(f"signal_{x}")
        flat += [
            s["present"].alias(f"defect_{x}"),
            s["probability"].alias(f"defect_{x}_prob"),
            s["probability_raw"].alias(f"defect_{x}_prob_raw"),
            s["tile_ratio"].alias(f"defect_{x}_tile_ratio"),
            s["applicable"].alias(f"defect_{x}_applicable"),
        ]
    return out.withColumn("rationale", rationale).select("*", *flat)


def confirm_crack(
    samples: DataFrame,
    min_prob: float = CRACK_PROB,
    min_area_pct: float = MIN_CRACK_AREA_PCT,
    min_component_px: int = MIN_COMPONENT_PX,
) -> DataFrame:
    """Candidate, confirmed and the reason code by the first failing test."""
    candidate = F.coalesce(F.col("max_crack_prob") >= min_prob, F.lit(False))
    area = F.coalesce(F.col("seg_area_pct"), F.lit(0.0))
    length = F.coalesce(F.col("seg_component_px"), F.lit(0))
    reason = (
        F.when(~candidate, "classifier_below_threshold")
        .when(area < min_area_pct, "seg_area_below_threshold")
        .when(length < min_component_px, "component_length_below_threshold")
        .otherwise("confirmed")
    )
    return (
        samples.withColumn("crack_candidate", candidate)
        .withColumn("crack_confirmation_reason", reason)
        .withColumn("crack_confirmed", F.col("crack_confirmation_reason") == "confirmed")
    )


def issues_of(crack: Column, structural: Column, quality: Column, threshold: int = PROBLEM_QUALITY) -> Column:
    first = F.array_compact(F.array(F.when(crack, F.lit("crack"))))
    grade = F.array_compact(F.array(F.when(quality >= threshold, F.format_string("quality_grade_%d", quality))))
    return F.concat(first, F.filter(structural, lambda x: x != "crack"), grade)


def flag_problems(samples: DataFrame, threshold: int = PROBLEM_QUALITY) -> DataFrame:
    issues = issues_of(F.col("crack_confirmed"), F.col("structural_defects"), F.col("quality_grade"), threshold)
    return samples.withColumn("issues", issues).withColumn("is_problem", F.size("issues") > 0)


def reconfirm(problems: DataFrame, confirmations: DataFrame, key: str = "frame_index", threshold: int = PROBLEM_QUALITY) -> DataFrame:
    """Issues rebuilt from new confirmations; the raw state is kept next to it."""
    fresh = confirmations.select(key, F.col("crack_confirmed").alias("_new"))
    joined = problems.join(fresh, key, "left")
    crack = F.coalesce(F.col("_new"), F.lit(False))
    raw = F.coalesce(F.col("crack_detected"), F.lit(False)) | F.array_contains("issues", "crack")
    issues = issues_of(crack, F.col("structural_defects"), F.col("quality_grade"), threshold)
    return (
        joined.withColumn("raw_issues", F.col("issues"))
        .withColumn("raw_crack_detected", raw)
        .withColumn("crack_unconfirmed", raw & ~crack)
        .withColumn("crack_confirmed", crack)
        .withColumn("crack_detected", crack)
        .withColumn("issues", issues)
        .withColumn("is_problem", F.size("issues") > 0)
        .drop("_new")
    )
