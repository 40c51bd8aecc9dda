"""Queries over the embedding table: neighbours, votes, thresholds, pseudo labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.vectors import l2_normalise, norm
from kerbline.operators import knn as K
from kerbline.operators.clusters import vector_sums
from kerbline.plans import views
from kerbline.plans.registry import query

PAYLOAD = ["image_path", "quality", "surface_type"]

# Neighbours of every non-train vector among the train vectors, with the shared tie rule.
SQL_NEIGHBOURS = """
  q AS (SELECT * FROM v_embed WHERE split <> 'train'),
  r AS (SELECT * FROM v_embed WHERE split = 'train'),
  sims AS (
    SELECT q.image_id, q.split, q.quality AS true_quality, q.surface_type AS true_surface,
      r.image_id AS ref, r.image_path AS ref_path, r.quality, r.surface_type,
      round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))
        / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
         * sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))), 9) AS sim
    FROM q, r),
  nn AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sim DESC, ref) AS rank FROM sims)
    WHERE rank <= 10),
  vq AS (
    SELECT image_id, quality AS label, sum(greatest(sim, 0) + 1e-6) AS score, min(rank) AS first_rank
    FROM nn GROUP BY image_id, quality),
  vs AS (
    SELECT image_id, surface_type AS label, sum(greatest(sim, 0) + 1e-6) AS score, min(rank) AS first_rank
    FROM nn GROUP BY image_id, surface_type),
  head AS (
    SELECT image_id, any_value(split) AS split, any_value(true_quality) AS true_quality, any_value(true_surface) AS true_surface,
      avg(sim) AS mean_sim, max(CASE WHEN rank = 1 THEN ref END) AS nearest, max(CASE WHEN rank = 1 THEN sim END) AS nearest_sim
    FROM nn GROUP BY image_id),
  topq AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, first_rank) AS o FROM vq) WHERE o = 1),
  tops AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, first_rank) AS o FROM vs) WHERE o = 1)
"""


def neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    e = views.v_embed(spark, sf_dir)
    return K.knn(e.where("split <> 'train'"), e.where("split = 'train'"), k, payload=PAYLOAD)


@query("P18_l2_normalise", """
    SELECT image_id, round(sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])])), 6) AS raw_norm,
      round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])])), 6) AS first_unit
    FROM v_embed""", ("v_embed",))
def p18(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)
    unit = l2_normalise(F.col("embedding"))
    return e.select("image_id", F.round(norm(F.col("embedding")), 6).alias("raw_norm"),
                    F.round(F.element_at(unit, 1).cast("double"), 6).alias("first_unit"))


@query("J1_knn_topk", f"WITH {SQL_NEIGHBOURS} SELECT image_id, CAST(rank AS INTEGER) AS rank, ref, round(sim, 6) AS sim FROM nn", ("v_embed",))
def j1(spark, sf_dir):
    return K.ranked(neighbours(spark, sf_dir), ["image_id"]).select("image_id", "rank", "ref", F.round("sim", 6).alias("sim"))


@query("A2_similarity_vote", f"""WITH {SQL_NEIGHBOURS}
    SELECT head.image_id, topq.label AS predicted_quality, tops.label AS predicted_surface,
      round(mean_sim, 6) AS confidence, mean_sim < 0.45 AS non_road, nearest AS nearest_neighbor, round(nearest_sim, 6) AS nearest_similarity
    FROM head JOIN topq USING (image_id) JOIN tops USING (image_id)""", ("v_embed",))
def a2(spark, sf_dir):
    g = K.grade_tiles(neighbours(spark, sf_dir))
    return g.select("image_id", "predicted_quality", "predicted_surface", F.round("confidence", 6).alias("confidence"),
                    "non_road", "nearest_neighbor", F.round("nearest_similarity", 6).alias("nearest_similarity"))


SQL_DISTANCE = """
  dist AS (SELECT *, greatest(1 - sim, 0) AS d, bool_or(greatest(1 - sim, 0) = 0) OVER (PARTITION BY image_id) AS copies FROM nn),
  w AS (SELECT *, CASE WHEN copies THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / d END AS weight FROM dist),
  dq AS (SELECT image_id, quality AS label, sum(weight) AS score FROM w GROUP BY ALL),
  ds AS (SELECT image_id, surface_type AS label, sum(weight) AS score FROM w GROUP BY ALL),
  distq AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, label) AS o FROM dq) WHERE o = 1),
  dists AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, label) AS o FROM ds) WHERE o = 1)
"""


@query("A3_distance_vote", f"""WITH {SQL_NEIGHBOURS}, {SQL_DISTANCE}
    SELECT image_id, distq.label AS predicted_quality, dists.label AS predicted_surface FROM distq JOIN dists USING (image_id)""", ("v_embed",))
def a3(spark, sf_dir):
    n = F.col("neighbours")
    return neighbours(spark, sf_dir).select("image_id", K.distance_vote(n, "quality").alias("predicted_quality"),
                                            K.distance_vote(n, "surface_type").alias("predicted_surface"))


def margins(spark, sf_dir):
    n = F.col("neighbours")
    m = neighbours(spark, sf_dir).select("image_id", K.mean_similarity(n).alias("mean_cosine"),
                                         K.vote_margin(n, "surface_type").alias("s"), K.vote_margin(n, "quality").alias("q"))
    return m.select("image_id", "mean_cosine", F.col("s.label").alias("surface_type"), F.col("s.margin").alias("surface_margin"),
                    F.col("q.label").alias("quality"), F.col("q.margin").alias("quality_margin"),
                    F.size("s.scores").alias("surface_labels"))


SQL_MARGINS = """
  sm AS (
    SELECT image_id, max(share) - coalesce(max(CASE WHEN o = 2 THEN share END), 0) AS margin, max(CASE WHEN o = 1 THEN label END) AS label, CAST(count(*) AS INTEGER) AS labels
    FROM (SELECT image_id, label, score / sum(score) OVER (PARTITION BY image_id) AS share,
            row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, first_rank) AS o FROM vs) GROUP BY image_id),
  qm AS (
    SELECT image_id, max(share) - coalesce(max(CASE WHEN o = 2 THEN share END), 0) AS margin, max(CASE WHEN o = 1 THEN label END) AS label
    FROM (SELECT image_id, label, score / sum(score) OVER (PARTITION BY image_id) AS share,
            row_number() OVER (PARTITION BY image_id ORDER BY round(score, 8) DESC, first_rank) AS o FROM vq) GROUP BY image_id),
  scored AS (
    SELECT head.image_id, mean_sim AS mean_cosine, sm.label AS surface_type, sm.margin AS surface_margin, qm.label AS quality,
      qm.margin AS quality_margin, sm.labels AS surface_labels FROM head JOIN sm USING (image_id) JOIN qm USING (image_id))
"""


@query("A4_vote_margin", f"""WITH {SQL_NEIGHBOURS}, {SQL_MARGINS}
    SELECT image_id, round(mean_cosine, 6) AS mean_cosine, surface_type, round(surface_margin, 6) AS surface_margin,
      quality, round(quality_margin, 6) AS quality_margin, surface_labels FROM scored""", ("v_embed",))
def a4(spark, sf_dir):
    m = margins(spark, sf_dir)
    return m.select("image_id", F.round("mean_cosine", 6).alias("mean_cosine"), "surface_type",
                    F.round("surface_margin", 6).alias("surface_margin"), "quality",
                    F.round("quality_margin", 6).alias("quality_margin"), "surface_labels")


# The test vectors are less alike than road tiles, so the bound on the mean is lowered here.
MIN_COSINE = 0.15


def accepted(spark, sf_dir):
    m = margins(spark, sf_dir)
    ok = K.pseudo_label_accepted(F.col("mean_cosine"), F.col("surface_margin"), F.col("quality_margin"), min_cosine=MIN_COSINE)
    return m.withColumn("accepted", ok).withColumn("composite", F.concat_ws("__q", "surface_type", F.col("quality").cast("string")))


SQL_ACCEPTED = f"""
  acc AS (SELECT *, mean_cosine >= {MIN_COSINE} AND surface_margin >= 0.10 AND quality_margin >= 0.08 AS accepted,
          surface_type || '__q' || quality AS composite FROM scored)
"""


@query("R7_pseudo_label_acceptance", f"""WITH {SQL_NEIGHBOURS}, {SQL_MARGINS}, {SQL_ACCEPTED}
    SELECT image_id, composite, accepted FROM acc""", ("v_embed",))
def r7(spark, sf_dir):
    return accepted(spark, sf_dir).select("image_id", "composite", "accepted")


@query("A19_non_road_threshold", f"""WITH {SQL_NEIGHBOURS},
    m AS (SELECT mean_sim, row_number() OVER (ORDER BY mean_sim) - 1 AS i, count(*) OVER () AS n
          FROM head JOIN v_embed USING (image_id) WHERE v_embed.split = 'val' AND kind <> 'full')
    SELECT round(coalesce(least(0.45, min(mean_sim)), 0.45), 6) AS threshold FROM m
    WHERE i = greatest(0, CAST(ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) AS BIGINT) - 1)""", ("v_embed",))
def a19(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)
    nn = K.knn(e.where("split = 'val' AND kind <> 'full'"), e.where("split = 'train'"), 10)
    means = nn.select(K.mean_similarity(F.col("neighbours")).alias("mean_cosine"))
    return K.calibrated_threshold(means).select(F.round("threshold", 6).alias("threshold"))


def label_centroids(spark, sf_dir):
    """Mean train vector per label: one row per class."""
    train = views.v_embed(spark, sf_dir).where("split = 'train'")
    return vector_sums(train, "label").select(F.col("label").alias("cluster"), F.col("vector_mean").alias("embedding"))


@query("J2_nearest_centroid", """
    WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v_embed WHERE split = 'train'),
    m AS (SELECT label AS cluster, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL),
    c AS (SELECT cluster, list(m ORDER BY i) AS vec FROM m GROUP BY cluster),
    s AS (SELECT image_id, cluster, round(list_dot_product(CAST(embedding AS DOUBLE[]), vec)
            / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS sim FROM v_embed, c)
    SELECT image_id, CAST(cluster AS BIGINT) AS kmeans_cluster FROM
      (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sim DESC, cluster) AS o FROM s) WHERE o = 1""", ("v_embed",))
def j2(spark, sf_dir):
    e = views.v_embed(spark, sf_dir)
    return K.nearest_centroid(e, label_centroids(spark, sf_dir)).select("image_id", "kmeans_cluster")
