"""Queries for model metrics, cluster statistics, gates, and Spark ML operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.operators import clusters as CL
from kerbline.operators import heads as H
from kerbline.operators import knn as K
from kerbline.operators import metrics as M
from kerbline.plans import views
from kerbline.plans.corpus import manifest
from kerbline.plans.frames import SQL_GATED, gated
from kerbline.plans.registry import query
from kerbline.plans.similarity import SQL_DISTANCE, SQL_NEIGHBOURS
from kerbline.plans.views import LABEL_THRESHOLDS
from kerbline.session import cut_lineage

LABELS = list(LABEL_THRESHOLDS)


def predictions(spark: SparkSession, sf_dir: str, vote) -> DataFrame:
    n = F.col("neighbours")
    e = views.v_embed(spark, sf_dir)
    nn = K.knn(e.where("split <> 'train'"), e.where("split = 'train'"), 10, payload=["quality", "surface_type"])
    return nn.select("split", "quality", "surface_type", vote(n, "quality").alias("p_quality"), vote(n, "surface_type").alias("p_surface"))


def sql_classification(rows: str, y: str, p: str, ordinal: bool, name: str) -> str:
    """CTE `name` with accuracy and macro-F1 per split of `rows` (split, y, p)."""
    extra = f", avg(abs({y} - {p})) AS mae, avg(CAST(abs({y} - {p}) <= 1 AS INTEGER)) AS off_by_one" if ordinal else ""
    return f"""
  {name}_x AS (SELECT split, {y}, {p} FROM {rows} UNION ALL SELECT 'val_test', {y}, {p} FROM {rows}),
  {name}_c AS (SELECT split, c, sum(t) AS t, sum(q) AS q, sum(tp) AS tp FROM (
     SELECT split, {y} AS c, 1 AS t, 0 AS q, CAST({y} = {p} AS INTEGER) AS tp FROM {name}_x UNION ALL SELECT split, {p}, 0, 1, 0 FROM {name}_x) GROUP BY 1, 2),
  {name}_f AS (SELECT split, avg(2 * tp / CAST(t + q AS DOUBLE)) AS macro_f1 FROM {name}_c GROUP BY 1),
  {name} AS (SELECT split, avg(CAST({y} = {p} AS INTEGER)) AS accuracy, macro_f1{extra}, count(*) AS rows FROM {name}_x JOIN {name}_f USING (split) GROUP BY split, macro_f1)
"""


SQL_DIST_PRED = f"""{SQL_NEIGHBOURS}, {SQL_DISTANCE},
  dpred AS (SELECT head.split, true_quality AS y, distq.label AS p, true_surface AS ys, dists.label AS ps FROM head JOIN distq USING (image_id) JOIN dists USING (image_id))
"""


@query("A13_quality_metrics", f"""WITH {SQL_DIST_PRED}, {sql_classification('dpred', 'y', 'p', True, 'm')}
    SELECT split, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(mae, 6) AS mae, round(off_by_one, 6) AS off_by_one, rows FROM m""", ("v_embed",))
def a13(spark, sf_dir):
    m = M.classification_metrics(predictions(spark, sf_dir, K.distance_vote), "quality", "p_quality", ordinal=True)
    return m.select("split", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "mae", "off_by_one")], "rows")


@query("A13_surface_metrics", f"""WITH {SQL_DIST_PRED}, {sql_classification('dpred', 'ys', 'ps', False, 'm')}
    SELECT split, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, rows FROM m""", ("v_embed",))
def a13_surface(spark, sf_dir):
    m = M.classification_metrics(predictions(spark, sf_dir, K.distance_vote), "surface_type", "p_surface")
    return m.select("split", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "rows")


@query("A14_binary_metrics", """
    WITH g AS (SELECT split, source_dataset AS source, y_crack AS y, p_crack AS p FROM v_scores UNION ALL SELECT split, 'overall', y_crack, p_crack FROM v_scores),
    r AS (SELECT *, rank() OVER (PARTITION BY split, source ORDER BY p) + (count(*) OVER (PARTITION BY split, source, p) - 1) / 2.0 AS rk FROM g),
    c AS (SELECT split, source, count(*) AS n, sum(y) AS pos, sum(CASE WHEN p >= 0.42 THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.42 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY 1, 2)
    SELECT split, source, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(tp + fp + pos, 0), 0), 6) AS f1,
      round((tp + n - pos - fp) / n, 6) AS accuracy, round((rs - pos * (pos + 1) / 2.0) / nullif(pos * (n - pos), 0), 6) AS roc_auc, n AS count, CAST(pos AS BIGINT) AS positive_count FROM c""", ("v_scores",))
def a14(spark, sf_dir):
    m = M.binary_metrics(views.v_scores(spark, sf_dir), "y_crack", "p_crack", 0.42, ["split"], "source_dataset")
    return m.select("split", F.col("source_dataset").alias("source"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "roc_auc")], "count", "positive_count")


SQL_LONG = "long AS (" + " UNION ALL ".join(f"SELECT image_id, domain, '{x}' AS label, y_{x} AS y, p_{x} AS p, CAST(p_{x} >= {t} AS INTEGER) AS hit FROM v_scores" for x, t in LABEL_THRESHOLDS.items()) + ")"
SQL_PER_LABEL = f"""{SQL_LONG},
  g AS (SELECT domain, label, y, p, hit FROM long UNION ALL SELECT 'overall', label, y, p, hit FROM long),
  s AS (SELECT domain, label, p, count(*) AS n, sum(y) AS pos, sum(hit) AS hits, sum(hit * y) AS tp FROM g GROUP BY 1, 2, 3),
  k AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM s WINDOW w AS (PARTITION BY domain, label ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  per AS (SELECT domain, label, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS support, CAST(sum(hits) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp,
      CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * cp / CAST(cn AS DOUBLE)) / sum(pos) END AS ap FROM k GROUP BY 1, 2),
  pl AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM per)
"""


@query("A15_per_label_metrics", f"WITH {SQL_PER_LABEL} SELECT domain, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap, 6) AS ap, support, predicted FROM pl", ("v_scores",))
def a15(spark, sf_dir):
    p = M.multilabel_per_label(views.v_scores(spark, sf_dir), LABEL_THRESHOLDS, "domain")
    return p.select("domain", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ap")], "support", "predicted")


@query("A15_domain_metrics", f"""WITH {SQL_PER_LABEL} SELECT domain, max(rows) AS rows, CAST(sum(support) AS BIGINT) AS positive_label_assignments,
    CASE WHEN count(*) FILTER (WHERE support > 0 OR predicted > 0) > 0 THEN count(*) FILTER (WHERE support > 0 OR predicted > 0) ELSE count(*) END AS macro_label_count,
    round(coalesce(avg(f1) FILTER (WHERE support > 0 OR predicted > 0), avg(f1)), 6) AS macro_f1, round(coalesce(2 * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0), 6) AS micro_f1, round(avg(ap), 6) AS macro_ap FROM pl GROUP BY 1""", ("v_scores",))
def a15_domain(spark, sf_dir):
    p = M.multilabel_by_group(M.multilabel_per_label(views.v_scores(spark, sf_dir), LABEL_THRESHOLDS, "domain"), "domain")
    return p.select("domain", "rows", "positive_label_assignments", "macro_label_count", *[F.round(c, 6).alias(c) for c in ("macro_f1", "micro_f1", "macro_ap")])


@query("A15_multilabel_summary", f"""WITH {SQL_LONG}, i AS (SELECT image_id, min(CAST(y = hit AS INTEGER)) AS same, sum(y) AS t, sum(hit) AS q, sum(y * hit) AS tp FROM long GROUP BY 1)
    SELECT count(*) AS rows, round(avg(same), 6) AS exact_match, CAST(sum(t) AS BIGINT) AS true_assignments, CAST(sum(q) AS BIGINT) AS predicted_assignments, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(q - tp) AS BIGINT) AS fp,
      CAST(sum(t - tp) AS BIGINT) AS fn, count(*) FILTER (WHERE t > 0) AS images_with_defect, count(*) FILTER (WHERE q > 0) AS images_with_prediction, round(avg(t), 6) AS mean_true_labels, round(avg(q), 6) AS mean_predicted_labels FROM i""", ("v_scores",))
def a15_summary(spark, sf_dir):
    s = M.multilabel_summary(views.v_scores(spark, sf_dir), LABEL_THRESHOLDS)
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("mean", "exact")) else F.col(c) for c in s.columns])


def sql_threshold(n: int, value: str, rows: str) -> str:
    return f"""
  th AS (SELECT i, CASE WHEN i = {n - 1} THEN 0.95::DOUBLE ELSE i * ((0.95::DOUBLE - 0.05::DOUBLE) / {n - 1}) + 0.05::DOUBLE END AS t FROM (SELECT unnest(generate_series(0, {n - 1})) AS i)),
  cf AS (SELECT label, i, t, sum(CASE WHEN p >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= t THEN 1 ELSE 0 END) AS q, sum(y) AS pos FROM {rows}, th GROUP BY 1, 2, 3),
  sc AS (SELECT *, {value} AS v FROM cf),
  best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, i) AS o FROM sc)
"""


@query("A16_threshold_search", f"""WITH {SQL_LONG}, {sql_threshold(181, 'coalesce(2 * tp / CAST(nullif(pos + q, 0) AS DOUBLE), 0)', 'long')} SELECT label, round(t, 6) AS threshold, round(v, 6) AS score FROM best WHERE o = 1""", ("v_scores",))
def a16(spark, sf_dir):
    rows = M.label_rows(views.v_scores(spark, sf_dir), LABEL_THRESHOLDS, ["image_id"])
    return M.threshold_search(rows, ["label"], F.col("y"), F.col("p")).select("label", F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


@query("A16_segmentation_threshold", f"""WITH long AS (SELECT 'px' AS label, CAST(crack_prob_raw >= 0.42 AS INTEGER) AS y, tile_crack_prob AS p FROM v_tiles WHERE tile_crack_prob IS NOT NULL),
    {sql_threshold(37, 'coalesce(tp / CAST(nullif(pos + q - tp, 0) AS DOUBLE), 0)', 'long').replace('AS t FROM (SELECT unnest', 'AS t0, 0 AS z FROM (SELECT unnest').replace('cf AS (SELECT label', 'tt AS (SELECT i, round(t0, 3) AS t FROM th), cf AS (SELECT label').replace('FROM long, th GROUP', 'FROM long, tt GROUP')}
    SELECT t AS threshold, round(v, 6) AS score FROM best WHERE o = 1""", ("v_tiles",))
def a16_seg(spark, sf_dir):
    t = views.v_tiles(spark, sf_dir).where("tile_crack_prob IS NOT NULL")
    out = M.threshold_search(t, [], F.col("crack_prob_raw") >= 0.42, F.col("tile_crack_prob"), M.SEGMENTATION_GRID, "iou", digits=3)
    return out.select("threshold", F.round("score", 6).alias("score"))


@query("A18_positive_weights", " UNION ALL ".join(f"SELECT '{x}' AS label, CAST(sum(y_{x}) AS BIGINT) AS positives, CAST(count(*) - sum(y_{x}) AS BIGINT) AS negatives, round((count(*) - sum(y_{x})) / greatest(sum(y_{x}), 1), 6) AS pos_weight FROM v_scores WHERE split = 'train'" for x in LABELS), ("v_scores",))
def a18(spark, sf_dir):
    w = M.positive_weights(views.v_scores(spark, sf_dir).where("split = 'train'"), LABELS)
    return w.select("label", "positives", "negatives", F.round("pos_weight", 6).alias("pos_weight"))


@query("A18_sampler_weights", "SELECT CAST(k AS INTEGER) AS has_crack, round(1.0 / greatest(1, (SELECT count(*) FROM v_manifest WHERE has_crack = k)), 9) AS weight FROM (SELECT unnest([0, 1]) AS k)", ("v_manifest",))
def a18_sampler(spark, sf_dir):
    return M.sampler_weights(manifest(spark, sf_dir), "has_crack").select("has_crack", F.round("weight", 9).alias("weight"))


# --- clusters ------------------------------------------------------------------------------------------

def clustered(spark, sf_dir):
    return views.v_embed(spark, sf_dir).withColumn("cluster", ((F.col("label") * 3 + F.col("image_id") % 4) % 7).cast("int"))


SQL_CLUSTERED = "cl AS (SELECT *, CAST((label * 3 + image_id % 4) % 7 AS INTEGER) AS cluster FROM v_embed)"


@query("A10_cluster_profile", f"""WITH {SQL_CLUSTERED},
    s AS (SELECT cluster, surface_type AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS size FROM cl GROUP BY 1, 2),
    q AS (SELECT cluster, quality AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS size FROM cl GROUP BY 1, 2),
    e AS (SELECT cluster, image_path, image_id, row_number() OVER (PARTITION BY cluster ORDER BY image_id) AS k FROM cl)
    SELECT a.cluster, a.size, a.dist AS surface_distribution, b.dist AS quality_distribution, a.top AS top_surface_type, b.top AS top_quality, c.ex AS examples FROM
      (SELECT cluster, CAST(max(size) AS BIGINT) AS size, string_agg(v || ':' || printf('%.4f', round_even(n / size, 4)), ',' ORDER BY v) AS dist, first(v ORDER BY n DESC, v) AS top FROM s GROUP BY 1) a
      JOIN (SELECT cluster, string_agg(v || ':' || printf('%.4f', round_even(n / size, 4)), ',' ORDER BY v) AS dist, first(v ORDER BY n DESC, v) AS top FROM q GROUP BY 1) b USING (cluster)
      JOIN (SELECT cluster, string_agg(image_path, ',' ORDER BY k) AS ex FROM e WHERE k <= 5 GROUP BY 1) c USING (cluster)""", ("v_embed",))
def a10(spark, sf_dir):
    p = CL.cluster_profile(clustered(spark, sf_dir), "cluster")
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["value"].cast("string"), F.lit(":"), F.format_string("%.4f", e["share"]))), ",")
    return p.select("cluster", "size", text("surface_type_distribution").alias("surface_distribution"), text("quality_distribution").alias("quality_distribution"),
                    "top_surface_type", "top_quality", F.array_join("examples", ",").alias("examples"))


@query("A11_cluster_purity", f"""WITH {SQL_CLUSTERED},
    p AS (SELECT 'surface_type' AS target, cluster, surface_type AS v FROM cl UNION ALL SELECT 'quality', cluster, CAST(quality AS VARCHAR) FROM cl UNION ALL SELECT 'surface_type_quality', cluster, surface_type || '__q' || quality FROM cl),
    c AS (SELECT target, cluster, v, count(*) AS n FROM p GROUP BY 1, 2, 3), b AS (SELECT target, cluster, max(n) AS top, sum(n) AS tot FROM c GROUP BY 1, 2)
    SELECT target, round(sum(top) / sum(tot), 6) AS purity FROM b GROUP BY 1""", ("v_embed",))
def a11(spark, sf_dir):
    labels = {"surface_type": F.col("surface_type"), "quality": F.col("quality"), "surface_type_quality": F.concat_ws("__q", "surface_type", F.col("quality").cast("string"))}
    return M.cluster_purity(clustered(spark, sf_dir), "cluster", labels).select("target", F.round("purity", 6).alias("purity"))


def sql_silhouette(label: str, name: str) -> str:
    return f"""
  {name}_u AS (SELECT image_id, {label} AS l, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS DOUBLE)) AS v FROM v_embed),
  {name}_d AS (SELECT a.image_id, a.l, b.l AS other, sum(1 - list_dot_product(a.v, b.v)) AS total, count(*) AS n FROM {name}_u a, {name}_u b GROUP BY 1, 2, 3),
  {name}_ab AS (SELECT image_id, max(CASE WHEN l = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN l <> other THEN total / n END) AS b, max(CASE WHEN l = other THEN n END) AS own FROM {name}_d GROUP BY 1),
  {name} AS (SELECT avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM {name}_ab)
"""


@query("A12_silhouette", f"WITH {sql_silhouette('surface_type', 's')} SELECT round(silhouette, 5) AS silhouette FROM s", ("v_embed",))
def a12(spark, sf_dir):
    return CL.silhouette(views.v_embed(spark, sf_dir), "surface_type").select(F.round("silhouette", 5).alias("silhouette"))


@query("R8_acceptance_gates", f"""WITH {SQL_DIST_PRED},
    topp AS (SELECT head.split, true_quality AS y, topq.label AS p, true_surface AS ys, tops.label AS ps FROM head JOIN topq USING (image_id) JOIN tops USING (image_id)),
    {sql_classification('topp', 'y', 'p', False, 'bq')}, {sql_classification('topp', 'ys', 'ps', False, 'bs')}, {sql_classification('dpred', 'y', 'p', False, 'cq')}, {sql_classification('dpred', 'ys', 'ps', False, 'cs')},
    {sql_silhouette("surface_type || '__q' || (image_id % 2)", 'bsil')}, {sql_silhouette("surface_type || '__q' || quality", 'csil')},
    j AS (SELECT (SELECT round(macro_f1, 9) FROM bq WHERE split = 'val_test') AS bf, (SELECT round(macro_f1, 9) FROM cq WHERE split = 'val_test') AS cf, (SELECT round(accuracy, 9) FROM bs WHERE split = 'val_test') AS ba, (SELECT round(accuracy, 9) FROM cs WHERE split = 'val_test') AS ca,
      (SELECT round(silhouette, 9) FROM bsil) AS bsv, (SELECT round(silhouette, 9) FROM csil) AS csv)
    SELECT cf > bf AS quality_pass, csv > bsv AS silhouette_pass, cf > bf AND csv > bsv AS phase_gate_pass, ca >= round(ba - 0.005, 9) AS type_accuracy_pass, cf > bf AND ca >= round(ba - 0.005, 9) AS candidate_accepted,
      round(cf - bf, 6) AS quality_macro_f1_delta, round(ca - ba, 6) AS type_accuracy_delta FROM j""", ("v_embed",))
def r8(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)

    def row(vote, quality):
        p = predictions(spark, sf_dir, vote)
        q = M.classification_metrics(p, "quality", "p_quality").where("split = 'val_test'").select(F.col("macro_f1").alias("quality_macro_f1"), F.lit(1).alias("_k"))
        s = M.classification_metrics(p, "surface_type", "p_surface").where("split = 'val_test'").select(F.col("accuracy").alias("type_accuracy"), F.lit(1).alias("_k"))
        sil = CL.silhouette(e.withColumn("_sq", F.concat_ws("__q", "surface_type", quality.cast("string"))), "_sq")
        return q.join(s, "_k").join(sil.select(F.col("silhouette").alias("surface_quality_silhouette"), F.lit(1).alias("_k")), "_k").drop("_k")

    g = M.improvement_gates(row(K.similarity_vote, F.col("image_id") % 2), row(K.distance_vote, F.col("quality")))
    return g.select("quality_pass", "silhouette_pass", "phase_gate_pass", "type_accuracy_pass", "candidate_accepted",
                    F.round("quality_macro_f1_delta", 6).alias("quality_macro_f1_delta"), F.round("type_accuracy_delta", 6).alias("type_accuracy_delta"))


@query("R9_manifest_expectations", """SELECT * FROM (
    SELECT 'rows_over_100' AS check, count(*) >= 100 AS passed FROM v_manifest UNION ALL SELECT 'quality_in_range', count(*) FILTER (WHERE quality NOT BETWEEN 1 AND 5) = 0 FROM v_manifest
    UNION ALL SELECT 'paths_present', count(*) FILTER (WHERE image_path IS NULL OR image_path = '') = 0 FROM v_manifest
    UNION ALL SELECT 'splits_covered', count(DISTINCT split) = 3 FROM v_manifest
    UNION ALL SELECT 'class_ratio', coalesce((count(*) FILTER (WHERE has_crack = 1)) / (count(*) FILTER (WHERE has_crack = 0)) BETWEEN 0.9 AND 1.2, false) FROM v_manifest)""", ("v_manifest",))
def r9(spark, sf_dir):
    return M.expectations(manifest(spark, sf_dir), {
        "rows_over_100": M.at_least(100),
        "quality_in_range": M.never(~F.col("quality").between(1, 5)),
        "paths_present": M.never(F.col("image_path") == ""),
        "splits_covered": M.covers(F.col("split"), ["train", "val", "test"]),
        "class_ratio": M.class_ratio_between(F.col("has_crack"), 0.9, 1.2),
    })


@query("R9_gating_expectations", f"""WITH {SQL_GATED} SELECT 'gated_flags_off_concrete' AS check, count(*) FILTER (WHERE surface_type IN ('asphalt','unpaved','paving_stones','sett','gravel','mud')
      AND ({" OR ".join(f"{x}_flag" for x in vocab.GATED_LABELS)})) = 0 AS passed FROM gated
    UNION ALL SELECT 'surface_present', count(*) FILTER (WHERE surface_type IS NULL) = 0 FROM gated""", ("v_tiles",))
def r9_gating(spark, sf_dir):
    wrong = F.lit(False)
    for x in vocab.GATED_LABELS:
        wrong = wrong | F.col(f"{x}_flag")
    off = F.col("surface_type").isin(vocab.NON_CONCRETE_SURFACES)
    return M.expectations(gated(spark, sf_dir), {"gated_flags_off_concrete": M.never(off & wrong), "surface_present": M.never(F.col("surface_type").isNull())})


# --- machine learning --------------------------------------------------------------------------------------

def off_centre(rows: DataFrame, cluster: str, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows to which another centroid is nearer (by 1e-9 and more) than that of their own cluster."""
    c = centroids.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("embedding").alias("c")))).alias("_c"))
    gap = F.transform("_c", lambda e: F.aggregate(F.zip_with(e["c"], vector, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return rows.crossJoin(F.broadcast(c)).withColumn("_d", gap).where(F.get("_d", F.col(cluster)) > F.array_min("_d") + 1e-9)


def off_mean(rows: DataFrame, cluster: str, centroids: DataFrame, within: float) -> DataFrame:
    """Centroids that lie further than `within` from the mean of their rows."""
    means = CL.vector_sums(rows, cluster).select(F.col(cluster).alias("cluster"), "vector_mean")
    gap = F.aggregate(F.zip_with("embedding", "vector_mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return centroids.join(means, "cluster").where(gap > within * within)


@query("L1_kmeans_search", """SELECT 'rows' AS check, count(*) AS value FROM v_embed WHERE kind = 'full'
    UNION ALL SELECT 'rows of another centroid', 0 UNION ALL SELECT 'centroids off the mean of their train rows', 0 UNION ALL SELECT 'candidates', 9 UNION ALL SELECT 'candidates better than the chosen, or as good and earlier', 0
    UNION ALL SELECT 'clusters without the count chosen', 0""", ("v_embed",))
def l1(spark, sf_dir):
    e = views.v_embed(spark, sf_dir).where("kind = 'full'")
    assigned, centroids, scores = CL.kmeans_search(e, F.col("split") == "train")
    assigned = cut_lineage(assigned)
    k = centroids.count()
    rivals = [c for c, s in scores.items() if s > scores[k] or (s == scores[k] and c < k)]
    checks = [
        assigned.agg(F.lit("rows").alias("check"), F.count(F.lit(1)).alias("value")),
        off_centre(assigned, "kmeans_cluster", centroids).agg(F.lit("rows of another centroid"), F.count(F.lit(1))),
        off_mean(assigned.where("split = 'train'"), "kmeans_cluster", centroids, 0.05).agg(F.lit("centroids off the mean of their train rows"), F.count(F.lit(1))),
        assigned.agg(F.lit("candidates"), F.lit(len(scores)).cast("bigint")), assigned.agg(F.lit("candidates better than the chosen, or as good and earlier"), F.lit(len(rivals)).cast("bigint")),
        assigned.where("split = 'train'").agg(F.lit("clusters without the count chosen"), F.lit(k) - F.count_distinct("kmeans_cluster")),
    ]
    return reduce(DataFrame.unionAll, checks)


@query("L1_kmeans_assignments")
def l1_assignments(spark, sf_dir):
    assigned, _, _ = CL.kmeans_search(views.v_embed(spark, sf_dir).where("kind = 'full'"), F.col("split") == "train")
    return assigned.select("image_id", "split", "kmeans_cluster")


@query("L2_survey_clusters", """WITH n AS (SELECT count(*) AS n FROM v_embed), k AS (SELECT n, CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN least(2, n) ELSE least(n, greatest(2, least(12, CAST(round_even(sqrt(n / 2.0), 0) AS BIGINT)))) END AS k FROM n)
    SELECT 'rows' AS check, n AS value FROM k UNION ALL SELECT 'clusters', k FROM k UNION ALL SELECT 'rows of another centroid', 0""", ("v_embed",))
def l2(spark, sf_dir):
    rows = cut_lineage(CL.survey_clusters(views.v_embed(spark, sf_dir)))
    centroids = CL.vector_sums(rows, "cluster").select("cluster", F.col("vector_mean").alias("embedding"))
    near = off_centre(rows, "cluster", centroids)
    return reduce(DataFrame.unionAll, [
        rows.agg(F.lit("rows").alias("check"), F.count(F.lit(1)).alias("value")), rows.agg(F.lit("clusters"), F.count_distinct("cluster")),
        near.agg(F.lit("rows of another centroid"), F.count(F.lit(1))),
    ])


@query("L3_projection")
def l3(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)
    parts = {m: e.where(F.col("image_id") % 4 == i) for i, m in enumerate(["labeled", "unlabeled", "defect", "survey"])}
    return CL.project_2d(parts).select("image_id", "mode", "x", "y")


@query("L3_projection_checks", """SELECT 'rows' AS check, count(*) AS value FROM v_embed UNION ALL SELECT 'modes', 4 UNION ALL SELECT 'axes that correlate', 0 UNION ALL SELECT 'axes out of the order of variance', 0
    UNION ALL SELECT 'components that vary more than the first axis', 0 UNION ALL SELECT 'axes against the sign rule', 0""", ("v_embed",))
def l3_checks(spark, sf_dir):
    """What holds of two principal axes: no correlation, variances in order and above that of any single component, largest loading positive.

    A loading has the sign of the covariance of its axis with the component, and its size is in proportion to it.
    """
    e = views.v_embed(spark, sf_dir)
    parts = {m: e.where(F.col("image_id") % 4 == i) for i, m in enumerate(["labeled", "unlabeled", "defect", "survey"])}
    p = cut_lineage(CL.project_2d(parts))
    one = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mode").alias("m"), F.abs(F.corr("x", "y")).alias("c"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    long = p.select("x", "y", F.posexplode("embedding").alias("d", "v")).groupBy("d").agg(F.var_samp("v").alias("v"), F.covar_samp("x", "v").alias("cx"), F.covar_samp("y", "v").alias("cy"))
    far = long.agg(F.max("v").alias("v"), *[F.max_by(c, F.abs(F.col(c))).alias(c) for c in ("cx", "cy")])
    wrong = lambda bad: F.count_if(bad).cast("bigint")
    both = one.crossJoin(F.broadcast(far))  # one row each
    checks = [("rows", F.max("n")), ("modes", F.max("m")), ("axes that correlate", wrong(F.col("c") > 1e-5)), ("axes out of the order of variance", wrong(F.col("vx") < F.col("vy"))),
              ("components that vary more than the first axis", wrong(F.col("v") > F.col("vx") * (1 + 1e-5))), ("axes against the sign rule", wrong((F.col("cx") < 0) | (F.col("cy") < 0)))]
    return reduce(DataFrame.unionAll, [both.agg(F.lit(name).alias("check"), value.cast("bigint").alias("value")) for name, value in checks])


HIDDEN = 8


def head_weights(dim: int) -> tuple:
    i, h = np.meshgrid(np.arange(dim), np.arange(HIDDEN), indexing="ij")
    w1 = ((i * 7 + h * 13) % 17 - 8) / 8.0
    b1 = (np.arange(HIDDEN) % 3 - 1) / 10.0
    hh, o = np.meshgrid(np.arange(HIDDEN), np.arange(len(LABELS)), indexing="ij")
    return (w1, b1), (((hh * 5 + o * 3) % 11 - 5) / 5.0, np.arange(len(LABELS)) / 10.0 - 0.2)


@query("L4_dense_head_scores", f"""
    WITH x AS (SELECT image_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM v_embed),
    h AS (SELECT image_id, h, greatest(0, sum(CAST(v AS DOUBLE) * (((i * 7 + h * 13) % 17 - 8) / 8.0::DOUBLE)) + (h % 3 - 1) / 10.0::DOUBLE) AS a FROM x, (SELECT unnest(generate_series(0, {HIDDEN - 1})) AS h) GROUP BY image_id, h),
    o AS (SELECT image_id, o, sum(a * (((h * 5 + o * 3) % 11 - 5) / 5.0::DOUBLE)) + o / 10.0::DOUBLE - 0.2 AS z FROM h, (SELECT unnest(generate_series(0, {len(LABELS) - 1})) AS o) GROUP BY image_id, o)
    SELECT image_id, {", ".join(f"round(max(CASE WHEN o = {k} THEN 1 / (1 + exp(-z)) END), 6) AS p_{x}" for k, x in enumerate(LABELS))} FROM o GROUP BY 1""", ("v_embed",))
def l4(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)
    dim = e.select(F.size("embedding").alias("d")).first()["d"]
    hidden, output = head_weights(dim)
    return CL.dense_head(e.select("image_id", "embedding"), hidden, output, LABELS).select("image_id", *[F.round(f"p_{x}", 6).alias(f"p_{x}") for x in LABELS])


@query("L5_head_training", "WITH p AS (SELECT split, embedding FROM v_embed WHERE split <> 'train') " + " UNION ALL ".join(
    f"SELECT split, '{x}' AS label, count(*) AS rows, count(*) FILTER (embedding[{k + 1}] > 0) AS support, TRUE AS learned FROM p GROUP BY split" for k, x in enumerate(LABELS))
    + " UNION ALL SELECT 'val', 'kept epoch is the first best', count(*), 1, TRUE FROM p WHERE split = 'val'", ("v_embed",))
def l5(spark, sf_dir):
    """Each label is the sign of one component, so that a head can learn it; a head that knows nothing has a macro-AP of about a half."""
    e = views.v_embed(spark, sf_dir)
    rows = e.select("image_id", "split", "embedding", *[(F.get("embedding", F.lit(k)) > 0).cast("int").alias(f"y_{x}") for k, x in enumerate(LABELS)])
    scored, trained = H.train_heads(rows, LABELS, F.col("split") == "train", F.col("split") == "val", hidden=64, batch=32, rate=1e-2)
    per = M.multilabel_per_label(scored.where("split <> 'train'"), trained.thresholds, "split").where("split IN ('val', 'test')")
    per = per.select("split", "label", "rows", F.col("support").cast("bigint").alias("support"), (F.col("ap") > 0.75).alias("learned"))
    scores = [h["val_macro_ap"] for h in trained.history]
    first = scores.index(max(scores)) + 1 == trained.best_epoch
    return per.unionAll(rows.where("split = 'val'").agg(F.lit("val"), F.lit("kept epoch is the first best"), F.count(F.lit(1)), F.lit(1).cast("bigint"), F.lit(first)))


def path_scorer(batch: pd.DataFrame) -> np.ndarray:
    """Stand-in for an image network: eight numbers from the path length and the crop box."""
    n = batch["image_path"].str.len().to_numpy(dtype="float64")
    box = batch[["left", "upper", "right", "lower"]].to_numpy(dtype="float64")
    return np.column_stack([np.ones(len(batch)), n, box, box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]])


@query("L6_embedding_table", """
    WITH b AS (SELECT image_path, split, 300 + row_id % 200 AS w, 200 + row_id % 100 AS h FROM v_manifest), g AS (SELECT *, unnest([0, 1]) AS r FROM b WHERE split = 'val'), t AS (SELECT *, unnest([0, 1, 2]) AS c FROM g)
    SELECT image_path, 'full' AS kind, CAST(w AS INTEGER) AS "right", 8 AS dim, 1.0::DOUBLE AS norm FROM b
    UNION ALL SELECT image_path, 'tile_' || (r * 3 + c), CAST(round_even((c + 1) * (w / 3.0::DOUBLE), 0) AS INTEGER), 8, 1.0::DOUBLE FROM t""", ("v_manifest",))
def l6(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("width", 300 + F.col("row_id") % 200).withColumn("height", 200 + F.col("row_id") % 100)
    t = CL.embedding_table(m, path_scorer, 8)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return t.select("image_path", "kind", "right", F.size("embedding").alias("dim"), F.round(length, 5).alias("norm"))
