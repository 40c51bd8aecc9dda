"""Queries over corrections, annotations, pages, edits and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import labels as L
from kerbline.operators import overlay as O
from kerbline.operators import tracks as T
from kerbline.plans import views
from kerbline.plans.corpus import SQL_BOXES, box_rows, manifest
from kerbline.plans.registry import query
from kerbline.sinks import exports as X

# --- the four image tables and their corrections ---------------------------------------------

RULES = {"labeled": "row_id % 4 < 2", "unlabeled": "row_id % 4 = 2 OR row_id % 8 = 0", "defect": "row_id % 4 = 3 OR row_id % 12 = 0", "survey": "row_id % 10 = 5"}


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("row_id", "image_path", "source_dataset", "split", "has_crack").withColumn("id", L.image_id(F.col("image_path")))
    parts = {}
    for mode, rule in RULES.items():
        known = mode in ("labeled", "defect")
        parts[mode] = m.where(rule).withColumn("original_label", F.col("has_crack") if known else F.lit(-1)).drop("has_crack")
    return O.image_tables(parts)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image_path, labels map): `has_crack` where corrected, and a quality word."""
    c = views.v_corrections(spark, sf_dir)
    m = manifest(spark, sf_dir).select("row_id", "image_path")
    entries = F.array_compact(F.array(
        F.when(F.col("has_crack").isNotNull(), F.struct(F.lit("has_crack").alias("key"), F.col("has_crack").cast("string").alias("value"))),
        F.when(F.col("row_id") % 3 != 0, F.struct(F.lit("quality").alias("key"), F.col("quality_flag").cast("string").alias("value"))),
    ))
    return c.join(m, "row_id").select(L.image_id(F.col("image_path")).alias("id"), "image_path", F.map_from_entries(entries).alias("labels"), "row_id")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).where("row_id % 6 = 1")
    source = F.when(F.col("row_id") % 18 != 1, F.when(F.col("row_id") % 4 == 1, "manual").otherwise("model"))
    return m.select(L.image_id(F.col("image_path")).alias("id"), "image_path", F.concat(F.lit("masks/"), F.col("row_id").cast("string"), F.lit(".png")).alias("mask_path"), source.alias("source"), "row_id")


SQL_TABLES = """
  base AS (SELECT *, substr(md5(image_path), 1, 12) AS id FROM v_manifest),
  imgs AS (
    SELECT row_id, image_path, source_dataset, split, id, has_crack AS original_label, 'labeled' AS mode, 0 AS mode_rank FROM base WHERE row_id % 4 < 2
    UNION ALL SELECT row_id, image_path, source_dataset, split, id, -1, 'unlabeled', 1 FROM base WHERE row_id % 4 = 2 OR row_id % 8 = 0
    UNION ALL SELECT row_id, image_path, source_dataset, split, id, has_crack, 'defect', 2 FROM base WHERE row_id % 4 = 3 OR row_id % 12 = 0
    UNION ALL SELECT row_id, image_path, source_dataset, split, id, -1, 'survey', 3 FROM base WHERE row_id % 10 = 5),
  corr AS (SELECT b.id, b.image_path, c.has_crack, CASE WHEN row_id % 3 <> 0 THEN quality_flag END AS quality, row_id FROM v_corrections c JOIN base b USING (row_id)),
  eff AS (SELECT imgs.*, coalesce(corr.has_crack, original_label) AS effective_label, corr.id IS NOT NULL AS corrected FROM imgs LEFT JOIN corr USING (id)),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mode_rank, row_id) AS o FROM imgs) WHERE o = 1),
  masks AS (SELECT id, row_id FROM base WHERE row_id % 6 = 1)
"""
VIEWS = ("v_manifest", "v_corrections")


@query("J7_effective_labels", f"WITH {SQL_TABLES} SELECT id, mode, row_id, CAST(effective_label AS INTEGER) AS effective_label, corrected FROM eff", VIEWS)
def j7(spark, sf_dir):
    return O.effective_labels(tables(spark, sf_dir), corrections(spark, sf_dir)).select("id", "mode", "row_id", "effective_label", "corrected")


@query("J7_id_resolution", f"WITH {SQL_TABLES} SELECT id, mode, row_id FROM firsts", VIEWS)
def j7_ids(spark, sf_dir):
    return O.first_by_id(tables(spark, sf_dir)).select("id", "mode", "row_id")


@query("J7_legacy_corrections", """SELECT substr(md5(image_path), 1, 12) AS id, CAST(c.has_crack AS VARCHAR) AS has_crack FROM v_corrections c JOIN v_manifest m USING (row_id) WHERE c.has_crack IS NOT NULL""", VIEWS)
def j7_legacy(spark, sf_dir):
    c = corrections(spark, sf_dir)
    legacy = c.select("id", F.coalesce(F.try_element_at("labels", F.lit("has_crack")).cast("int"), F.lit(-1)).alias("corrected_label"))
    return O.migrate_corrections(legacy).select("id", F.element_at("labels", "has_crack").alias("has_crack"))


@query("J8_annotated_filters", f"""WITH {SQL_TABLES}
    SELECT 'annotated' AS filter, count(*) AS rows FROM imgs WHERE id IN (SELECT id FROM masks) UNION ALL SELECT 'unannotated', count(*) FROM imgs WHERE id NOT IN (SELECT id FROM masks)""", VIEWS)
def j8(spark, sf_dir):
    t, m = tables(spark, sf_dir), masks(spark, sf_dir)
    parts = [O.annotated(t, m, want).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("filter"), "rows") for n, want in (("annotated", True), ("unannotated", False))]
    return parts[0].unionByName(parts[1])


@query("J8_label_key_filters", f"""WITH {SQL_TABLES}
    SELECT id, mode, 'set' AS filter FROM imgs WHERE id IN (SELECT id FROM corr WHERE quality = 1) UNION ALL SELECT id, mode, 'unset' FROM imgs WHERE id NOT IN (SELECT id FROM corr WHERE has_crack IS NOT NULL)""", VIEWS)
def j8_keys(spark, sf_dir):
    t, c = tables(spark, sf_dir), corrections(spark, sf_dir)
    a = O.label_filter(t, c, "quality", "1").select("id", "mode", F.lit("set").alias("filter"))
    return a.unionByName(O.label_filter(t, c, "has_crack", None).select("id", "mode", F.lit("unset").alias("filter")))


@query("A22_source_statistics", f"""WITH {SQL_TABLES} SELECT source_dataset, count(*) AS total, count(*) FILTER (WHERE effective_label = 1) AS crack,
    count(*) FILTER (WHERE effective_label = 0) AS no_crack, count(*) FILTER (WHERE effective_label NOT IN (0, 1)) AS unknown FROM eff WHERE mode = 'labeled' GROUP BY 1""", VIEWS)
def a22(spark, sf_dir):
    return O.source_statistics(O.effective_labels(tables(spark, sf_dir).where("mode = 'labeled'"), corrections(spark, sf_dir)))


@query("A22_mode_totals", f"""WITH {SQL_TABLES}, one AS (SELECT imgs.*, CASE WHEN f.id IS NOT NULL THEN coalesce(corr.has_crack, imgs.original_label) ELSE imgs.original_label END AS e
      FROM imgs LEFT JOIN firsts f ON f.id = imgs.id AND f.mode = imgs.mode AND f.row_id = imgs.row_id LEFT JOIN corr ON corr.id = imgs.id)
    SELECT mode, count(*) AS total, count(*) FILTER (WHERE e = 1) AS crack, count(*) FILTER (WHERE e = 0) AS no_crack, count(*) FILTER (WHERE e = -1) AS unknown FROM one GROUP BY 1""", VIEWS)
def a22_modes(spark, sf_dir):
    return O.mode_totals(O.effective_labels(tables(spark, sf_dir), corrections(spark, sf_dir), first_row_only=True))


@query("T1_filtered_page", f"""WITH {SQL_TABLES}, h AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k, count(*) OVER () AS n FROM eff WHERE mode = 'labeled' AND split = 'train' AND effective_label = 0)
    SELECT id, row_id, n AS total, CAST(least(greatest(1, 3), greatest(1, CAST(ceil(n / 20.0) AS BIGINT))) AS INTEGER) AS page, greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) AS pages FROM h
    WHERE k BETWEEN (least(3, greatest(1, CAST(ceil(n / 20.0) AS BIGINT))) - 1) * 20 + 1 AND least(3, greatest(1, CAST(ceil(n / 20.0) AS BIGINT))) * 20""", VIEWS)
def t1(spark, sf_dir):
    e = O.effective_labels(tables(spark, sf_dir).where("mode = 'labeled'"), corrections(spark, sf_dir))
    p = O.filtered_page(e, (F.col("split") == "train") & (F.col("effective_label") == 0), ["row_id"], 3, 20)
    return p.select("id", "row_id", "total", "page", "pages")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter points of the labeled and defect images on an integer grid."""
    m = manifest(spark, sf_dir)
    return m.select(L.image_id(F.col("image_path")).alias("id"), "image_path", "source_dataset", "has_crack", "row_id",
                    (F.col("row_id") * 37 % 1009 / 100.0).alias("x"), (F.col("row_id") * 53 % 907 / 100.0).alias("y"))


SQL_POINTS = """
  pts AS (SELECT substr(md5(image_path), 1, 12) AS id, source_dataset, has_crack, row_id, (row_id * 37 % 1009) / 100.0::DOUBLE AS x, (row_id * 53 % 907) / 100.0::DOUBLE AS y FROM v_manifest)
"""


@query("T2_similar_items", f"""WITH {SQL_POINTS}, q AS (SELECT x AS qx, y AS qy, id AS qid FROM pts WHERE row_id = 7)
    SELECT id, round((x - qx) * (x - qx) + (y - qy) * (y - qy), 5) AS dist FROM pts, q WHERE id <> qid ORDER BY (x - qx) * (x - qx) + (y - qy) * (y - qy), id LIMIT 50""", ("v_manifest",))
def t2(spark, sf_dir):
    p = points(spark, sf_dir)
    target = p.where("row_id = 7").select("id").first()["id"]
    return O.similar_items(p, target, 50)


@query("T3_review_queue", f"""WITH {SQL_TABLES}, pool AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mode_rank, row_id) AS o FROM imgs WHERE mode <> 'survey' AND id NOT IN (SELECT id FROM masks))
    SELECT p.id, p.mode, p.row_id FROM pool p LEFT JOIN corr USING (id) WHERE o = 1 AND coalesce(corr.has_crack, original_label) = 1""", VIEWS)
def t3(spark, sf_dir):
    return O.review_queue(tables(spark, sf_dir), corrections(spark, sf_dir), masks(spark, sf_dir)).select("id", "mode", "row_id")


SQL_SCATTER = f"""{SQL_TABLES}, {SQL_POINTS},
  tagged AS (SELECT pts.*, coalesce(firsts.mode, 'labeled') AS mode, coalesce(corr.has_crack, pts.has_crack) AS hc, corr.id IS NOT NULL AS corrected
    FROM pts LEFT JOIN firsts USING (id) LEFT JOIN corr USING (id))
"""


@query("T9_scatter_by_mode", f"WITH {SQL_SCATTER} SELECT id, x, y, CAST(hc AS INTEGER) AS has_crack, corrected, mode, false AS survey_fallback FROM tagged WHERE mode = 'defect'", VIEWS)
def t9(spark, sf_dir):
    t = tables(spark, sf_dir)
    return O.scatter(points(spark, sf_dir), O.first_by_id(t), corrections(spark, sf_dir), mode="defect").drop("source")


@query("T9_scatter_fallback", f"WITH {SQL_SCATTER} SELECT id, CAST(hc AS INTEGER) AS has_crack, mode, true AS survey_fallback FROM tagged WHERE source_dataset = 'src3'", VIEWS)
def t9_fallback(spark, sf_dir):
    t = O.first_by_id(tables(spark, sf_dir).where("mode <> 'survey'"))
    s = O.scatter(points(spark, sf_dir), t, corrections(spark, sf_dir), mode="survey", source="src3")
    return s.select("id", "has_crack", "mode", "survey_fallback")


# --- edits and table maintenance ----------------------------------------------------------------------

@query("U4_label_edit_fold", """
    WITH rv AS (SELECT id, max(seq) AS rseq FROM v_edits WHERE revert_all GROUP BY 1),
    l AS (SELECT e.id, key, value, row_number() OVER (PARTITION BY e.id, key ORDER BY seq DESC) AS o FROM v_edits e LEFT JOIN rv USING (id) WHERE NOT revert_all AND (rseq IS NULL OR seq > rseq))
    SELECT id, string_agg(key || '=' || value, ',' ORDER BY key) AS labels FROM l WHERE o = 1 AND value IS NOT NULL GROUP BY id""", ("v_edits",))
def u4(spark, sf_dir):
    f = O.fold_edits(views.v_edits(spark, sf_dir))
    return f.select("id", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"))


@query("U5_delete_move_rename", """
    SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'moved' WHEN source_dataset = 'src1' THEN 'renamed' ELSE source_dataset END AS source_dataset FROM v_manifest WHERE row_id % 4 <> 1""", ("v_manifest",))
def u5(spark, sf_dir):
    m = manifest(spark, sf_dir)
    kept = O.delete_rows(m, m.where("row_id % 4 = 1").select("row_id"), "row_id")
    renamed = O.rename_dataset(kept, "src1", "renamed")
    return O.move_rows(renamed, m.where("row_id % 3 = 0").select("row_id"), "moved", "row_id").select("row_id", "source_dataset")


@query("U7_keyed_upsert", """SELECT session_id, version FROM (
      SELECT DISTINCT user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0)""")
def u7(spark, sf_dir):
    s = views.v_track(spark, sf_dir).select("session_id").distinct()
    old = s.where("session_id % 2 = 0").withColumn("version", F.lit("old"))
    return O.upsert(old, s.where("session_id % 3 = 0").withColumn("version", F.lit("new")), "session_id")


@query("U7_session_list", """
    WITH log AS (SELECT user_id AS session_id, event_id AS version, ts, event_type FROM events),
    last AS (SELECT session_id, max(version) AS version, arg_max(event_type, version) AS event_type, arg_max(epoch_ms(ts) // 60000000, version) AS started_ms FROM log GROUP BY 1)
    SELECT session_id, version, CAST(started_ms AS BIGINT) AS started_ms, row_number() OVER (ORDER BY started_ms DESC, version DESC, session_id) AS position FROM last WHERE event_type <> 'error'""")
def u7_list(spark, sf_dir):
    """Each event is a save of its session, or a delete when it is an error; the list after all of them."""
    e = views.table(spark, sf_dir, "events")
    started = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60_000_000).cast("bigint")
    log = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), started.alias("started_ms"), (F.col("event_type") == "error").alias("deleted"))
    return O.session_list(log).select("session_id", "version", "started_ms", "position")


# --- annotations ----------------------------------------------------------------------------------------

def box_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated images with their boxes in 0..1, at most three each."""
    b = box_rows(spark, sf_dir)
    f = lambda c: (F.col(c) / 100.0).alias(c.replace("b_y", "y").replace("bx", "x").replace("bw", "w").replace("bh", "h"))
    box = F.struct("j", f("bx"), f("b_y"), f("bw"), f("bh"), "label")
    g = b.groupBy("row_id", "image_path").agg(F.array_sort(F.collect_list(box)).alias("_b"))
    i = F.col("row_id")
    return g.select(L.image_id(F.col("image_path")).alias("img_id"), i.alias("pos"), "image_path",
                    F.when(i % 9 != 0, (640 + i % 3 * 100).cast("int")).alias("width"), F.when(i % 9 != 0, F.lit(480)).alias("height"),
                    F.transform("_b", lambda x: F.struct(x["x"].alias("x"), x["y"].alias("y"), x["w"].alias("w"), x["h"].alias("h"), x["label"].alias("label"))).alias("bboxes"))


SQL_COCO = f"""{SQL_BOXES},
  im AS (SELECT row_id, image_path, row_number() OVER (ORDER BY row_id) AS image_id, CASE WHEN row_id % 9 <> 0 THEN 640 + row_id % 3 * 100 ELSE 0 END AS iw, CASE WHEN row_id % 9 <> 0 THEN 480 ELSE 0 END AS ih
    FROM (SELECT DISTINCT row_id, image_path FROM boxes)),
  lab AS (SELECT * FROM boxes JOIN im USING (row_id, image_path) WHERE coalesce(label, '') <> ''),
  cat AS (SELECT label, row_number() OVER (ORDER BY label) AS cid FROM (SELECT DISTINCT label FROM lab))
"""


@query("K2_coco_annotations", f"""WITH {SQL_COCO}
    SELECT row_number() OVER (ORDER BY image_id, j) AS id, image_id, cid AS category_id, round_even(bx / 100.0::DOUBLE * iw, 2) AS x, round_even(b_y / 100.0::DOUBLE * ih, 2) AS y,
      round_even(bw / 100.0::DOUBLE * iw, 2) AS w, round_even(bh / 100.0::DOUBLE * ih, 2) AS h, round_even(bw / 100.0::DOUBLE * iw * (bh / 100.0::DOUBLE * ih), 2) AS area, 0 AS iscrowd FROM lab JOIN cat USING (label)""", ("v_manifest",))
def k2(spark, sf_dir):
    return X.coco_tables(box_index(spark, sf_dir))["annotations"]


@query("K2_coco_images", f"WITH {SQL_COCO} SELECT image_id AS id, image_path AS file_name, CAST(iw AS INTEGER) AS width, ih AS height FROM im", ("v_manifest",))
def k2_images(spark, sf_dir):
    return X.coco_tables(box_index(spark, sf_dir))["images"]


@query("K3_yolo_lines", f"""WITH {SQL_COCO} SELECT substr(md5(image_path), 1, 12) AS img_id, (cid - 1) || ' ' || printf('%.6f', bx / 100.0::DOUBLE + bw / 100.0::DOUBLE / 2) || ' ' || printf('%.6f', b_y / 100.0::DOUBLE + bh / 100.0::DOUBLE / 2)
    || ' ' || printf('%.6f', bw / 100.0::DOUBLE) || ' ' || printf('%.6f', bh / 100.0::DOUBLE) AS text FROM lab JOIN cat USING (label)""", ("v_manifest",))
def k3(spark, sf_dir):
    return X.yolo_lines(box_index(spark, sf_dir)).select("img_id", "text")


@query("K4_mask_manifest", """SELECT image_path, 'masks/' || row_id || '.png' AS mask_path, 'user_annotation' AS source_dataset, 'train' AS split FROM v_manifest WHERE row_id % 6 = 1 AND row_id % 4 <> 3 AND row_id % 5 <> 2""", ("v_manifest",))
def k4(spark, sf_dir):
    m = manifest(spark, sf_dir)
    there = m.where("row_id % 4 <> 3").select(F.col("image_path").alias("path"))
    there = there.union(m.where("row_id % 5 <> 2").select(F.concat(F.lit("masks/"), F.col("row_id").cast("string"), F.lit(".png"))))
    return X.mask_manifest(masks(spark, sf_dir), there)


@query("K5_labelled_frames", f"""WITH {SQL_TABLES} SELECT i.image_path, i.split, i.source_dataset, 'unknown' AS surface_type, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, CAST(coalesce(has_crack, -1) AS INTEGER) AS has_crack,
    'unknown_' || coalesce(CAST(quality AS VARCHAR), 'unknown') AS composite_label FROM imgs i JOIN corr USING (id) WHERE mode = 'survey'""", VIEWS)
def k5(spark, sf_dir):
    c = corrections(spark, sf_dir).select("id", F.to_json("labels").alias("labels_json"))
    return X.labelled_frames(tables(spark, sf_dir).where("mode = 'survey'"), c)


@query("A23_box_statistics", f"WITH {SQL_BOXES} SELECT coalesce(label, 'unknown') AS label, count(*) AS boxes FROM boxes GROUP BY 1", ("v_manifest",))
def a23(spark, sf_dir):
    return O.box_statistics(box_index(spark, sf_dir))


@query("A23_mask_statistics", "SELECT coalesce(CASE WHEN row_id % 18 <> 1 THEN (CASE WHEN row_id % 4 = 1 THEN 'manual' ELSE 'model' END) END, 'manual') AS source, count(*) AS masks FROM v_manifest WHERE row_id % 6 = 1 GROUP BY 1", ("v_manifest",))
def a23_masks(spark, sf_dir):
    return O.mask_statistics(masks(spark, sf_dir))


@query("A27_run_inventory", """
    WITH f AS (SELECT source_dataset AS run, row_id % 3 AS section, image_path AS path FROM v_manifest),
    k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY section, path) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM f),
    s AS (SELECT run, string_agg(path, '|' ORDER BY section, path) AS samples FROM k WHERE n < 4 OR i IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1) GROUP BY 1)
    SELECT run, count(*) AS frame_count, any_value(samples) AS samples, run IN ('src1', 'src2') AS imported FROM f JOIN s USING (run) GROUP BY run""", ("v_manifest",))
def a27(spark, sf_dir):
    f = manifest(spark, sf_dir).select(F.col("source_dataset").alias("run"), (F.col("row_id") % 3).alias("section"), F.col("image_path").alias("path"))
    done = manifest(spark, sf_dir).where(F.col("source_dataset").isin("src1", "src2")).select("source_dataset")
    return O.run_inventory(f, done).select("run", "frame_count", F.array_join("samples", "|").alias("samples"), "imported")


@query("J10_preferred_source", """
    WITH c AS (SELECT user_id AS recording, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT recording, CASE event_type WHEN 'error' THEN 'imu' WHEN 'click' THEN 'gpx' WHEN 'view' THEN 'embedded' ELSE 'track_json' END AS source_type, sum(CASE WHEN (recording + length(event_type)) % 3 = 0 THEN 0 ELSE n END) AS rows FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY list_position(['sidecar','track_json','gpx','embedded','imu'], source_type)) AS o FROM s WHERE rows > 0)
    SELECT DISTINCT c.recording, coalesce(r.source_type, 'none') AS source_type, CAST(coalesce(r.rows, 0) AS BIGINT) AS rows FROM c LEFT JOIN r ON r.recording = c.recording AND o = 1""")
def j10(spark, sf_dir):
    return T.prefer_source(source_candidates(spark, sf_dir), ["recording"], ["sidecar", "track_json", "gpx", "embedded", "imu"])


def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.table(spark, sf_dir, "events")
    c = ev.groupBy(F.col("user_id").alias("recording"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("event_type") == "error", "imu").when(F.col("event_type") == "click", "gpx").when(F.col("event_type") == "view", "embedded").otherwise("track_json")
    n = F.when((F.col("recording") + F.length("event_type")) % 3 == 0, 0).otherwise(F.col("n"))
    return c.groupBy("recording", kind.alias("source_type")).agg(F.sum(n).alias("rows"))


HINTS = ["auto", "none", "sidecar", "embedded", "imu"]


@query("J10_source_hints", """
    WITH c AS (SELECT user_id AS recording, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT recording, CASE event_type WHEN 'error' THEN 'imu' WHEN 'click' THEN 'gpx' WHEN 'view' THEN 'embedded' ELSE 'track_json' END AS source_type, sum(CASE WHEN (recording + length(event_type)) % 3 = 0 THEN 0 ELSE n END) AS rows FROM c GROUP BY ALL),
    e AS (SELECT recording, CASE WHEN recording % 3 = 0 THEN 'gpx' WHEN recording % 3 = 1 THEN 'embedded' ELSE 'imu' END AS own, sum(n) AS own_rows FROM c WHERE recording % 4 = 0 GROUP BY 1, 2),
    h AS (SELECT unnest(['auto', 'none', 'sidecar', 'embedded', 'imu']) AS hint),
    f AS (SELECT *, CASE source_type WHEN 'track_json' THEN 'sidecar' WHEN 'gpx' THEN 'sidecar' ELSE source_type END AS family, list_position(['track_json', 'gpx', 'embedded', 'imu'], source_type) AS o FROM s WHERE rows > 0),
    b AS (SELECT hint, recording, arg_min(source_type, o) AS source_type, arg_min(rows, o) AS rows FROM f, h WHERE hint IN ('auto', family) GROUP BY 1, 2),
    j AS (SELECT hint, recording, own, own_rows, b.source_type, b.rows, own IS NULL OR hint IN ('auto', 'sidecar') OR own = 'gpx' OR own = hint AS fits
      FROM (SELECT DISTINCT recording FROM c) CROSS JOIN h LEFT JOIN e USING (recording) LEFT JOIN b USING (hint, recording))
    SELECT hint, recording, CASE WHEN hint = 'none' OR NOT fits THEN 'none' ELSE coalesce(own, source_type, 'none') END AS source_type,
      CAST(CASE WHEN hint = 'none' OR NOT fits THEN 0 WHEN own IS NOT NULL THEN own_rows ELSE coalesce(rows, 0) END AS BIGINT) AS rows,
      CASE WHEN hint = 'none' THEN NULL WHEN NOT fits THEN 'explicit source does not fit ' || hint WHEN own IS NULL AND source_type IS NULL AND hint <> 'auto' THEN 'no usable ' || hint || ' source' END AS problem FROM j""")
def j10_hints(spark, sf_dir):
    """Every hint over all recordings; a quarter of them come with a file named by hand."""
    candidates, i = source_candidates(spark, sf_dir), F.col("user_id")
    own = F.when(i % 3 == 0, "gpx").when(i % 3 == 1, "embedded").otherwise("imu")
    named = views.table(spark, sf_dir, "events").where(i % 4 == 0).groupBy(i.alias("recording"), own.alias("source_type")).agg(F.count(F.lit(1)).alias("rows"))
    parts = [T.choose_source(candidates, named, ["recording"], hint).select(F.lit(hint).alias("hint"), "recording", "source_type", "rows", "problem") for hint in HINTS]
    return reduce(DataFrame.unionByName, parts)
