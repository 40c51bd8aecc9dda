"""Evaluation metrics and acceptance gates.

Rows are first reduced to counts per (group, score) or per confusion cell with
map-side combining; curves are then cumulative sums over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import KeyProfile, running_sum

OVERALL = "overall"

# --- fixed values: search grids ------------------------------------------------
HEAD_GRID = (0.05, 0.95, 181)
SEGMENTATION_GRID = (0.05, 0.95, 37)
# --- end of fixed values -------------------------------------------------------


def ratio(num: Column, den: Column) -> Column:
    """num / den with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def with_overall(df: DataFrame, group: str) -> DataFrame:
    """Every row once under its own group and once under `overall`."""
    return df.withColumn(group, F.explode(F.array(F.lit(OVERALL), F.col(group))))


def confusion_rows(df: DataFrame, pred: Column, truth: Column, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn per key."""
    return df.groupBy(*keys).agg(
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    )


def pixel_metrics(confusion: DataFrame, group: str) -> DataFrame:
    """Summed confusion overall and per group, with 0/0 = 0."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    summed = with_overall(confusion, group).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return summed.select(
        "*",
        ratio(tp, tp + fp + fn).alias("iou"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("dice"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def classification_metrics(preds: DataFrame, truth: str, pred: str, split: str = "split", ordinal: bool = False) -> DataFrame:
    """Accuracy, macro-F1 and, for grades, MAE and off-by-one on val, test and val_test."""
    cells = preds.groupBy(split, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn(split, F.explode(F.array(F.lit("val_test"), F.col(split))))
    cells = cells.groupBy(split, "y", "p").agg(F.sum("n").alias("n"))
    side = F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q")),
    ))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    per_class = (
        cells.select(split, side.alias("s"), hit.alias("h"))
        .groupBy(split, F.col("s.c").alias("c"))
        .agg(F.sum("s.t").alias("t"), F.sum("s.q").alias("q"), (F.sum("h") / 2).alias("tp"))
    )
    macro = per_class.groupBy(split).agg(F.avg(ratio(2 * F.col("tp"), F.col("t") + F.col("q"))).alias("macro_f1"))
    total = F.sum("n")
    aggs = [(F.sum(hit) / total).alias("accuracy")]
    if ordinal:
        gap = F.abs(F.col("y") - F.col("p"))
        aggs += [(F.sum(gap * F.col("n")) / total).alias("mae"), (F.sum(F.when(gap <= 1, F.col("n")).otherwise(0)) / total).alias("off_by_one")]
    return cells.groupBy(split).agg(*aggs, total.alias("rows")).join(macro, split)


def _score_counts(df: DataFrame, keys: Sequence[str], truth: Column, score: Column) -> DataFrame:
    return df.groupBy(*keys, score.alias("_score")).agg(F.count(F.lit(1)).alias("_n"), F.sum(truth.cast("long")).alias("_pos"))


def binary_metrics(
    df: DataFrame, truth: str, score: str, threshold: float, keys: Sequence[str], group: str
) -> DataFrame:
    """Precision, recall, F1, accuracy, ROC-AUC (null with one class) per key, overall and per group."""
    keys = list(keys)
    counts = with_overall(_score_counts(df, [*keys, group], F.col(truth), F.col(score)), group)
    counts = counts.groupBy(*keys, group, "_score").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"))
    counts = counts.withColumn("_neg", F.col("_n") - F.col("_pos"))
    # Average-rank AUC: a positive beats every lower negative and half of the equal ones.
    scanned = KeyProfile.of(counts, [*keys, group]).layout(counts, ["_score"]).scan(counts, _below=running_sum("_neg"))
    hit = F.col("_score") >= threshold
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2)
    g = scanned.groupBy(*keys, group).agg(
        F.sum("_n").alias("count"),
        F.sum("_pos").alias("positive_count"),
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("_fp"),
        F.sum(won).alias("_won"),
    )
    pos, n, tp, fp = F.col("positive_count"), F.col("count"), F.col("_tp"), F.col("_fp")
    return g.select(
        *keys,
        group,
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, pos).alias("recall"),
        ratio(2 * tp, tp + fp + pos).alias("f1"),
        ((tp + (n - pos - fp)) / n).alias("accuracy"),
        F.try_divide(F.col("_won"), (pos * (n - pos)).cast("double")).alias("roc_auc"),
        "count",
        "positive_count",
    )


def label_rows(df: DataFrame, thresholds: dict[str, float], keep: Sequence[str]) -> DataFrame:
    """One row per (row, label): truth `y_<label>`, score `p_<label>`, thresholded prediction."""
    entries = [
        F.struct(
            F.lit(x).alias("label"), F.col(f"y_{x}").alias("y"), F.col(f"p_{x}").alias("p"),
            (F.col(f"p_{x}") >= t).cast("int").alias("hit"),
        )
        for x, t in thresholds.items()
    ]
    return df.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.*")


def multilabel_per_label(df: DataFrame, thresholds: dict[str, float], group: str) -> DataFrame:
    """Per (group or overall, label): precision, recall, F1, AP (null with one class), support, predicted."""
    counts = (
        label_rows(df, thresholds, [group])
        .groupBy(group, "label", "p", "hit")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    counts = with_overall(counts, group).groupBy(group, "label", "p", "hit").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counts = counts.withColumn("_down", -F.col("p"))
    scanned = KeyProfile.of(counts, [group, "label"]).layout(counts, ["_down"]).scan(
        counts, _n=running_sum("n"), _tp=running_sum("pos")
    )
    g = scanned.groupBy(group, "label").agg(
        F.sum("n").alias("rows"),
        F.sum("pos").alias("support"),
        F.sum(F.col("hit") * F.col("n")).alias("predicted"),
        F.sum(F.col("hit") * F.col("pos")).alias("tp"),
        F.sum(F.col("pos") * F.col("_tp") / F.col("_n")).alias("_area"),
    )
    one_class = (F.col("support") == 0) | (F.col("support") == F.col("rows"))
    return g.select(
        group,
        "label",
        "rows",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.when(~one_class, F.col("_area") / F.col("support")).alias("ap"),
        "support",
        "predicted",
        "tp",
    )


def multilabel_by_group(per_label: DataFrame, group: str) -> DataFrame:
    """Macro figures over active labels, micro-F1 and macro-AP per group."""
    live = (F.col("support") > 0) | (F.col("predicted") > 0)

    def macro(c: str) -> Column:
        return F.coalesce(F.avg(F.when(live, F.col(c))), F.avg(c)).alias(f"macro_{c}")

    active = F.count_if(live)
    return per_label.groupBy(group).agg(
        F.max("rows").alias("rows"),
        F.sum("support").alias("positive_label_assignments"),
        F.when(active > 0, active).otherwise(F.count(F.lit(1))).alias("macro_label_count"),
        macro("precision"),
        macro("recall"),
        macro("f1"),
        ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("micro_f1"),
        F.avg("ap").alias("macro_ap"),
    )


def multilabel_summary(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row: exact match, assignment counts, and label counts per image."""
    hits = {x: (F.col(f"p_{x}") >= t).cast("int") for x, t in thresholds.items()}
    same, true_n, pred_n, tp = F.lit(True), F.lit(0), F.lit(0), F.lit(0)
    for x, hit in hits.items():
        y = F.col(f"y_{x}")
        same, true_n, pred_n, tp = same & (hit == y), true_n + y, pred_n + hit, tp + hit * y
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("exact_match"),
        F.sum(true_n).alias("true_assignments"),
        F.sum(pred_n).alias("predicted_assignments"),
        F.sum(tp).alias("tp"),
        F.sum(pred_n - tp).alias("fp"),
        F.sum(true_n - tp).alias("fn"),
        F.count_if(true_n > 0).alias("images_with_defect"),
        F.count_if(pred_n > 0).alias("images_with_prediction"),
        F.avg(true_n.cast("double")).alias("mean_true_labels"),
        F.avg(pred_n.cast("double")).alias("mean_predicted_labels"),
    )


def grid_points(grid: tuple[float, float, int], digits: int | None = None) -> list[float]:
    start, stop, n = grid
    step = (stop - start) / (n - 1)
    points = [*[i * step + start for i in range(n - 1)], stop]
    return [round(x, digits) for x in points] if digits is not None else points


def threshold_index(score: Column, points: list[float]) -> Column:
    """How many grid points are <= score; a computed guess corrected against the exact points."""
    table = F.array(*map(F.lit, points))
    step = (points[-1] - points[0]) / (len(points) - 1)
    guess = F.floor((score - points[0]) / step).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(len(points) - 1))
    up = F.coalesce(F.get(table, guess + 1) <= score, F.lit(False))
    down = F.get(table, guess) > score
    return F.when(down & (guess > 0), F.when(F.get(table, guess - 1) <= score, guess).otherwise(guess - 1)).when(
        down, F.lit(0)
    ).when(up, guess + 2).otherwise(guess + 1)


def threshold_search(
    df: DataFrame, keys: Sequence[str], truth: Column, score: Column, grid: tuple[float, float, int] = HEAD_GRID,
    metric: str = "f1", digits: int | None = None,
) -> DataFrame:
    """Lowest grid threshold with the best score, from one histogram pass over the rows."""
    points = grid_points(grid, digits)
    keys = list(keys)
    hist = df.groupBy(*keys, threshold_index(score, points).alias("_i")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(truth.cast("long")).alias("_pos")
    )
    totals = hist.groupBy(*keys).agg(F.sum("_pos").alias("_all_pos"))
    # Expand to every threshold: the histogram has at most len(grid) + 1 rows per key.
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(points)))).alias("_t")
    if keys:
        curve = totals.select(*keys, "_all_pos", steps)
    else:
        curve = totals.select("_all_pos", steps)
    cells = hist.where(F.col("_i") >= 1).select(*keys, F.explode(F.sequence(F.lit(1), F.col("_i"))).alias("_t"), "_n", "_pos")
    sums = cells.groupBy(*keys, "_t").agg(F.sum("_n").alias("_pred"), F.sum("_pos").alias("_tp"))
    curve = curve.join(sums, [*keys, "_t"], "left").na.fill(0, ["_pred", "_tp"])
    tp, pred, pos = F.col("_tp"), F.col("_pred"), F.col("_all_pos")
    precision, recall = ratio(tp, pred), ratio(tp, pos)
    value = {
        "f1": ratio(2 * tp, pos + pred),
        "dice": ratio(2 * tp, pos + pred),
        "iou": ratio(tp, pos + pred - tp),
        "f0.5": ratio(1.25 * precision * recall, 0.25 * precision + recall),
    }[metric]
    curve = curve.withColumn("_v", value)
    best = F.max_by(F.struct("_t", "_v"), F.struct(F.col("_v"), -F.col("_t"))).alias("_b")
    out = curve.groupBy(*keys).agg(best) if keys else curve.agg(best)
    table = F.array(*map(F.lit, points))
    return out.select(*keys, F.element_at(table, F.col("_b._t").cast("int")).alias("threshold"), F.col("_b._v").alias("score"))


def positive_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label: positives, negatives, and neg / max(pos, 1)."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"y_{x}")).alias(f"_{x}") for x in labels])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.col(f"_{x}"), F.lit(0)).alias("positives")) for x in labels]))
    out = one.select("_n", rows.alias("r")).select("r.label", "r.positives", (F.col("_n") - F.col("r.positives")).alias("negatives"))
    return out.withColumn("pos_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))


def sampler_weights(df: DataFrame, label: str) -> DataFrame:
    """1 / class count for both classes; an empty class counts as one row."""
    one = df.agg(*[F.count_if(F.col(label) == c).alias(f"_{c}") for c in (0, 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias(label), F.greatest(F.col(f"_{c}"), F.lit(1)).alias("n")) for c in (0, 1)]))
    return one.select(rows.alias("r")).select(f"r.{label}", (1.0 / F.col("r.n")).alias("weight"))


def cluster_purity(df: DataFrame, cluster: str, labels: dict[str, Column]) -> DataFrame:
    """Sum of the largest class count per cluster over all rows, per label column."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("target"), c.cast("string").alias("v")) for n, c in labels.items()]))
    counts = df.select(F.col(cluster).alias("_c"), parts.alias("e")).groupBy("_c", "e.target", "e.v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("_c", "target").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return best.groupBy("target").agg((F.sum("top") / F.sum("all")).alias("purity"))


def improvement_gates(
    baseline: DataFrame, candidate: DataFrame, max_accuracy_drop: float = 0.005
) -> DataFrame:
    """Two one-row metric tables to pass flags and deltas.

    Metrics are compared to nine digits: the last ones follow the order of summation.
    """
    cols = ["quality_macro_f1", "surface_quality_silhouette", "type_accuracy"]
    b = baseline.select(*[F.round(c, 9).alias(f"b_{c}") for c in cols], F.lit(1).alias("_k"))
    c = candidate.select(*[F.round(x, 9).alias(f"c_{x}") for x in cols], F.lit(1).alias("_k"))
    j = b.join(c, "_k").drop("_k")
    f1_up = F.col("c_quality_macro_f1") > F.col("b_quality_macro_f1")
    sil_up = F.col("c_surface_quality_silhouette") > F.col("b_surface_quality_silhouette")
    acc_ok = F.col("c_type_accuracy") >= F.round(F.col("b_type_accuracy") - max_accuracy_drop, 9)
    return j.select(
        "*",
        f1_up.alias("quality_pass"),
        sil_up.alias("silhouette_pass"),
        (f1_up & sil_up).alias("phase_gate_pass"),
        acc_ok.alias("type_accuracy_pass"),
        (f1_up & acc_ok).alias("candidate_accepted"),
        (F.col("c_quality_macro_f1") - F.col("b_quality_macro_f1")).alias("quality_macro_f1_delta"),
        (F.col("c_type_accuracy") - F.col("b_type_accuracy")).alias("type_accuracy_delta"),
    )


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One aggregate per named boolean check (an aggregate column), as (check, passed) rows."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("passed")) for i, n in enumerate(checks)]))
    return one.select(rows.alias("r")).select("r.*")


def never(bad: Column) -> Column:
    return F.count_if(F.coalesce(bad, F.lit(True))) == 0


def at_least(n: int) -> Column:
    return F.count(F.lit(1)) >= n


def covers(column: Column, values: Sequence[str]) -> Column:
    """Every value occurs at least once."""
    hit = F.lit(True)
    for v in values:
        hit = hit & F.bool_or(column == v)
    return hit


def class_ratio_between(flag: Column, low: float, high: float) -> Column:
    ratio_ = F.try_divide(F.count_if(flag == 1).cast("double"), F.count_if(flag == 0).cast("double"))
    return ratio_.between(low, high)
