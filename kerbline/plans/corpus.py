"""Queries over manifests and label sources: ingest, normalisation, splits, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geometry as G
from kerbline.functions import labels as L
from kerbline.operators import manifests as M
from kerbline.plans import views
from kerbline.plans.registry import query
from kerbline.plans.similarity import SQL_ACCEPTED, SQL_MARGINS, SQL_NEIGHBOURS, accepted
from kerbline.session import work_path
from kerbline.sources import annotations as AN
from kerbline.sources import manifests as SM
from kerbline.sources import tables as ST

# --- raw label text derived from the documents ------------------------------------------------

RAW_SURFACES = ["Asphalt ", "concrete", "Paving-Stones", "SETT", " gravel", "Mud", "unpaved"]
RAW_QUALITIES = ["Excellent", "good", "INTERMEDIATE", "bad ", "Very-Bad"]
RAW_LABELS = ["crack", "spallation", "efflorescence", "exposed_bars", "corrosion_stain", "none", "crack"]


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_manifest(spark, sf_dir)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths of the documents: folders by source and language, mixed suffixes."""
    m = manifest(spark, sf_dir)
    suffix = views._pick(F.col("row_id") % 5, [".jpg", ".PNG", ".webp", ".txt", ".jpeg"])
    folder = views._pick(F.col("row_id") % 4, ["D/cracked", "W/uncracked", "P/cracked", "masks"])
    return m.select("row_id", F.concat(F.lit("/raw/"), F.col("source_dataset"), F.lit("/"), folder, F.lit("/im"), F.col("row_id").cast("string"), suffix).alias("path"))


SQL_IMAGES = """
  files AS (SELECT row_id, '/raw/' || source_dataset || '/' || (['D/cracked','W/uncracked','P/cracked','masks'])[(row_id % 4) + 1] || '/im' || row_id ||
      (['.jpg','.PNG','.webp','.txt','.jpeg'])[(row_id % 5) + 1] AS path FROM v_manifest),
  inv AS (SELECT *, 'im' || row_id AS stem, lower((['.jpg','.PNG','.webp','.txt','.jpeg'])[(row_id % 5) + 1]) AS suffix FROM files WHERE row_id % 5 <> 3)
"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    i = F.col("row_id")
    line = F.concat_ws(",", F.concat(F.lit("im"), i.cast("string")), views._pick(i % 7, RAW_SURFACES), views._pick(F.floor(i / 7) % 5, RAW_QUALITIES),
                       F.when(i % 3 == 0, "True").otherwise("False"))
    return m.where("row_id % 11 <> 0").select(F.from_csv(line, SM.LABEL_CSV_SCHEMA).alias("r")).select("r.*")


@query("S1_label_csv_manifest", f"""WITH {SQL_IMAGES}
    SELECT path AS image_path, surface_type, CAST((row_id // 7) % 5 + 1 AS INTEGER) AS quality, CASE WHEN row_id % 3 = 0 THEN 'True' ELSE 'False' END AS train
    FROM inv JOIN v_manifest USING (row_id) WHERE row_id % 11 <> 0""", ("v_manifest",))
def s1(spark, sf_dir):
    m = SM.label_manifest(raw_labels(spark, sf_dir), SM.inventory(images(spark, sf_dir)), "streetsurfacevis")
    return m.select("image_path", "surface_type", "quality", "train")


@query("S1_unmatched_labels", f"""WITH {SQL_IMAGES} SELECT count(*) AS unmatched FROM v_manifest WHERE row_id % 11 <> 0 AND row_id NOT IN (SELECT row_id FROM inv)""", ("v_manifest",))
def s1_unmatched(spark, sf_dir):
    return SM.unmatched(raw_labels(spark, sf_dir), SM.inventory(images(spark, sf_dir)))


@query("S2_image_inventory", f"WITH {SQL_IMAGES} SELECT path, stem, suffix, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM inv", ("v_manifest",))
def s2(spark, sf_dir):
    return SM.inventory(images(spark, sf_dir)).select("path", "stem", "suffix", F.size("dirs").alias("depth"))


@query("S3_folder_labels", f"""WITH {SQL_IMAGES}
    SELECT path AS image_path, 'full' AS tile, 1 AS has_crack FROM inv WHERE row_id % 4 <> 3""", ("v_manifest",))
def s3(spark, sf_dir):
    return SM.folder_labels(SM.inventory(images(spark, sf_dir)), "crack500").select("image_path", "tile", "has_crack")


@query("S3_coded_domain_labels", f"""WITH {SQL_IMAGES}
    SELECT path AS image_path, (['bridge','building','pavement'])[(row_id % 4) + 1] AS domain, CASE WHEN row_id % 4 = 1 THEN 'none' ELSE 'crack' END AS labels FROM inv WHERE row_id % 4 <> 3""", ("v_manifest",))
def s3_coded(spark, sf_dir):
    d = SM.coded_domain_labels(SM.inventory(images(spark, sf_dir)))
    return d.select("image_path", "domain", F.concat_ws(",", "labels").alias("labels"))


@query("S4_pair_lines", """
    SELECT CASE WHEN row_id % 3 = 0 THEN 'src' || row_id ELSE 'img' || row_id END AS image_path,
      CASE row_id % 4 WHEN 0 THEN 'sm' || row_id WHEN 1 THEN 'm' || row_id ELSE 'l' || row_id END AS mask_path,
      CASE WHEN row_id % 5 = 0 THEN 'unknown' ELSE source_dataset END AS source_dataset, 1 AS has_crack FROM v_manifest WHERE row_id % 13 <> 0""", ("v_manifest",))
def s4(spark, sf_dir):
    m = manifest(spark, sf_dir)
    i = F.col("row_id")
    tag = lambda p: F.concat(F.lit(p), i.cast("string"))
    row = F.struct(tag("img").alias("image_path"), F.when(i % 3 == 0, tag("src")).alias("source_image"), F.when(i % 4 == 0, tag("sm")).alias("source_mask"),
                   F.when(i % 4 == 1, tag("m")).alias("mask_path"), tag("l").alias("label_path"), F.when(i % 5 != 0, F.col("source_dataset")).alias("source_dataset"))
    lines = m.select(F.when(i % 13 == 0, F.lit("  ")).otherwise(F.to_json(row)).alias("value"))
    return SM.parse_pairs(lines).select("image_path", "mask_path", "source_dataset", "has_crack")


@query("S5_tile_labels", """SELECT image_path, 'runway_roboflow' AS source_dataset, CASE WHEN row_id % 3 = 0 THEN 'full' ELSE 'tile_' || (row_id % 3) END AS tile, has_crack FROM v_manifest""", ("v_manifest",))
def s5(spark, sf_dir):
    folder = work_path(spark, "tile-labels")
    m = manifest(spark, sf_dir).select("image_path", F.when(F.col("row_id") % 3 != 0, F.concat(F.lit("tile_"), (F.col("row_id") % 3).cast("string"))).alias("tile"), "has_crack")
    ST.write_table(m, f"{folder}/tile_labels.csv")
    return SM.read_tile_labels(spark, folder)


@query("S13_table_round_trip", "SELECT image_path, source_dataset, quality, has_crack, split FROM v_manifest", ("v_manifest",))
def s13(spark, sf_dir):
    path = work_path(spark, "manifest")
    ST.write_table(manifest(spark, sf_dir), path, partition_by=["split"])
    return ST.read_table(spark, path).select("image_path", "source_dataset", "quality", "has_crack", "split")


# --- boxes ------------------------------------------------------------------------------------------

def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0..3 boxes per image in whole hundredths of the image size."""
    m = manifest(spark, sf_dir)
    i, j = F.col("row_id"), F.col("j")
    n = (i % 4).cast("int")
    m = m.where(n > 0).select("row_id", "image_path", F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    return m.select("row_id", "image_path", "j",
                    ((i * 7 + j * 13) % 80).alias("bx"), ((i * 3 + j * 17) % 70).alias("b_y"), ((i + j) % 20 + 1).alias("bw"), ((i + j * 2) % 25 + 1).alias("bh"),
                    F.when((i + j) % 7 != 0, views._pick((i + j) % 4, ["crack", "pothole", "", "patch"])).alias("label"))


SQL_BOXES = """
  boxes AS (SELECT row_id, image_path, j, (row_id * 7 + j * 13) % 80 AS bx, (row_id * 3 + j * 17) % 70 AS b_y, (row_id + j) % 20 + 1 AS bw, (row_id + j * 2) % 25 + 1 AS bh,
      CASE WHEN (row_id + j) % 7 <> 0 THEN (['crack','pothole','','patch'])[((row_id + j) % 4) + 1] END AS label
    FROM (SELECT *, unnest(generate_series(0, row_id % 4 - 1)) AS j FROM v_manifest))
"""
WIDTH, HEIGHT = 600, 400


def coco_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO documents of at most fifty images each."""
    doc = F.floor(F.col("row_id") / 50).alias("doc")
    b = box_rows(spark, sf_dir)
    kind = views._pick((F.col("row_id") + F.col("j")) % 4, ["1", "2", "3", "4"]).cast("bigint")
    px = F.array((F.col("bx") * WIDTH / 100).cast("double"), (F.col("b_y") * HEIGHT / 100).cast("double"), (F.col("bw") * WIDTH / 100).cast("double"), (F.col("bh") * HEIGHT / 100).cast("double"))
    ann = b.groupBy(doc).agg(F.collect_list(F.struct(F.col("row_id").alias("image_id"), kind.alias("category_id"), px.alias("bbox"))).alias("annotations"))
    img = manifest(spark, sf_dir).groupBy(doc).agg(F.collect_list(F.struct(
        F.col("row_id").alias("id"), F.col("image_path").alias("file_name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))).alias("images"))
    names = ["Mild_Cracks", "pothole", "severe-crack", "Crack "]
    cats = F.array(*[F.struct(F.lit(k + 1).alias("id"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    return img.join(ann, "doc").select("doc", F.to_json(F.struct("images", cats.alias("categories"), "annotations")).alias("value"))


@query("S6_coco_boxes", f"""WITH {SQL_BOXES}
    SELECT row_id AS image_id, image_path AS file_name, (['mildcrack','pothole','severecrack','crack'])[((row_id + j) % 4) + 1] AS label,
      bx * {WIDTH} / 100.0::DOUBLE AS x, b_y * {HEIGHT} / 100.0::DOUBLE AS y, bw * {WIDTH} / 100.0::DOUBLE AS w, bh * {HEIGHT} / 100.0::DOUBLE AS h FROM boxes WHERE (row_id + j) % 4 <> 1""", ("v_manifest",))
def s6(spark, sf_dir):
    return AN.coco_boxes(AN.parse_coco(coco_docs(spark, sf_dir), "value")).select("image_id", "file_name", "label", "x", "y", "w", "h")


@query("S7_voc_objects", f"""WITH {SQL_BOXES}
    SELECT 'im' || row_id AS stem, coalesce(label, '') AS name, CAST(bx + 0.5 AS DOUBLE)::INTEGER - (CASE WHEN CAST(bx + 0.5 AS DOUBLE)::INTEGER > bx THEN 1 ELSE 0 END) AS xmin,
      CAST(b_y AS INTEGER) AS ymin, CAST(bx + bw AS INTEGER) AS xmax, CASE WHEN row_id % 6 = 1 THEN 0 ELSE CAST(b_y + bh AS INTEGER) END AS ymax FROM boxes WHERE row_id % 5 <> 2""", ("v_manifest",))
def s7(spark, sf_dir):
    b = box_rows(spark, sf_dir)
    n = lambda c: c.cast("string")
    # Fractions truncate, a missing corner is 0, an unreadable number drops the object.
    ymax = F.when(F.col("row_id") % 6 == 1, F.lit("")).otherwise(F.concat(F.lit("<ymax>"), n(F.col("b_y") + F.col("bh")), F.lit("</ymax>")))
    xmin = F.when(F.col("row_id") % 5 == 2, F.lit("n/a")).otherwise(F.concat(n(F.col("bx")), F.lit(".5")))
    one = F.concat(F.lit("<object><name>"), F.coalesce("label", F.lit("")), F.lit("</name><bndbox><xmin>"), xmin, F.lit("</xmin><ymin>"), n(F.col("b_y")),
                   F.lit("</ymin><xmax>"), n(F.col("bx") + F.col("bw")), F.lit("</xmax>"), ymax, F.lit("</bndbox></object>"))
    # At most three boxes per image.
    docs = b.groupBy("row_id").agg(F.concat(F.lit("<annotation>"), F.array_join(F.collect_list(one), ""), F.lit("</annotation>")).alias("value"))
    rows = docs.select(F.concat(F.lit("im"), F.col("row_id").cast("string")).alias("stem"), F.from_xml("value", AN.VOC_SCHEMA).alias("x")).select("stem", "x.*")
    return AN.voc_objects(rows)


@query("P3_annotation_labels", f"""WITH {SQL_BOXES},
    c AS (SELECT row_id, bool_or(k IN (0, 1, 2)) AS crack, bool_or(k = 3) AS hole FROM (SELECT row_id, (row_id + j) % 5 AS k FROM boxes) GROUP BY 1)
    SELECT m.row_id, CASE WHEN m.row_id % 4 = 0 AND m.row_id % 8 = 0 THEN 'crack' WHEN c.row_id IS NULL THEN 'none'
        ELSE coalesce(nullif(concat_ws(',', CASE WHEN crack THEN 'crack' END, CASE WHEN hole THEN 'pothole' END), ''), 'none') END AS labels
    FROM v_manifest m LEFT JOIN c USING (row_id)""", ("v_manifest",))
def p3(spark, sf_dir):
    b = box_rows(spark, sf_dir)
    stem = F.col("row_id").cast("string").alias("stem")
    objects = b.select(stem, views._pick((F.col("row_id") + F.col("j")) % 5, ["D00", "D10", "D20", "D40", "D50"]).alias("name"))
    m = manifest(spark, sf_dir).select("row_id", stem)
    out = AN.voc_image_labels(m, objects, m.where("row_id % 8 <> 0"))
    return out.select("row_id", F.concat_ws(",", "labels").alias("labels"))


DEFECT_BITS = ["Background", "Crack", "Spallation", "Efflorescence", "ExposedBars", "CorrosionStain"]


def defect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    i = F.col("row_id")
    bits = [F.concat(F.lit(f"<{t}>"), F.when(F.floor(i / 2**k) % 3 == 1, F.lit("1" if k % 2 else "true")).otherwise("0"), F.lit(f"</{t}>")) for k, t in enumerate(DEFECT_BITS)]
    xml = F.concat(F.lit('<Defect name="crop'), i.cast("string"), F.lit('.png">'), *bits, F.lit("</Defect>"))
    schema = "_name string, " + ", ".join(f"{t} string" for t in DEFECT_BITS)
    rows = m.select(F.col("source_dataset").alias("file_stem"), F.from_xml(xml, schema).alias("x")).select("file_stem", "x.*")
    return AN.defect_records(rows, DEFECT_BITS)


@query("S8_defect_records", """
    SELECT 'crop' || row_id || '.png' AS key, coalesce(nullif(concat_ws(',', CASE WHEN row_id % 3 = 1 THEN 'background' END,
        CASE WHEN row_id // 32 % 3 = 1 THEN 'corrosion_stain' END, CASE WHEN row_id // 2 % 3 = 1 THEN 'crack' END, CASE WHEN row_id // 8 % 3 = 1 THEN 'efflorescence' END,
        CASE WHEN row_id // 16 % 3 = 1 THEN 'exposed_bars' END, CASE WHEN row_id // 4 % 3 = 1 THEN 'spallation' END), ''), 'background') AS labels FROM v_manifest""", ("v_manifest",))
def s8(spark, sf_dir):
    return defect_rows(spark, sf_dir).select("key", F.concat_ws(",", "labels").alias("labels"))


@query("S8_defect_label_join", """
    SELECT row_id, row_id % 2 = 0 AS by_path FROM v_manifest WHERE row_id % 7 <> 0""", ("v_manifest",))
def s8_join(spark, sf_dir):
    # Every seventh image has no record; odd ones are only reachable by their bare name.
    rec = defect_rows(spark, sf_dir)
    m = manifest(spark, sf_dir)
    i = F.col("row_id")
    name = F.when(i % 7 != 0, F.concat(F.lit("crop"), i.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("other"), i.cast("string")))
    im = m.select("row_id", name.alias("name"), F.concat_ws("/", F.when(i % 2 == 0, F.col("source_dataset")).otherwise("elsewhere"), name).alias("relpath"))
    return AN.attach_defect_labels(im, rec).select("row_id", (i % 2 == 0).alias("by_path"))


# --- scalar label functions ---------------------------------------------------------------------------

@query("P1_label_normalisation", "SELECT row_id, surface_type, CAST((row_id // 7) % 5 + 1 AS INTEGER) AS quality FROM v_manifest", ("v_manifest",))
def p1(spark, sf_dir):
    i = F.col("row_id")
    return manifest(spark, sf_dir).select("row_id", L.surface_type(views._pick(i % 7, RAW_SURFACES)).alias("surface_type"),
                                          L.quality_grade(views._pick(F.floor(i / 7) % 5, RAW_QUALITIES)).alias("quality"))


def raw_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_id")
    picks = F.array_compact(F.array(*[F.when(F.floor(i / 3**k) % 3 == 0, F.lit(x)) for k, x in enumerate(RAW_LABELS)]))
    return manifest(spark, sf_dir).withColumn("labels", L.label_set(picks))


SQL_SETS = """
  sets AS (SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN row_id % 3 = 0 OR row_id // 729 % 3 = 0 THEN 'crack' END, CASE WHEN row_id // 3 % 3 = 0 THEN 'spalling' END,
      CASE WHEN row_id // 9 % 3 = 0 THEN 'efflorescence' END, CASE WHEN row_id // 27 % 3 = 0 THEN 'exposed_rebar' END, CASE WHEN row_id // 81 % 3 = 0 THEN 'corrosion' END), ''), 'none') AS labels FROM v_manifest)
"""


@query("P2_label_sets", f"WITH {SQL_SETS} SELECT row_id, labels FROM sets", ("v_manifest",))
def p2(spark, sf_dir):
    return raw_sets(spark, sf_dir).select("row_id", F.concat_ws(",", "labels").alias("labels"))


@query("P4_multi_hot", f"WITH {SQL_SETS} SELECT row_id, concat_ws('', " + ", ".join(f"CASE WHEN list_contains(string_split(labels, ','), '{x}') THEN '1' ELSE '0' END" for x in vocab.DEFECT_LABELS) + ") AS hot FROM sets", ("v_manifest",))
def p4(spark, sf_dir):
    hot = L.multi_hot(F.col("labels"))
    return raw_sets(spark, sf_dir).select("row_id", F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query("P5_image_id", "SELECT row_id, substr(md5(image_path), 1, 12) AS id FROM v_manifest", ("v_manifest",))
def p5(spark, sf_dir):
    return manifest(spark, sf_dir).select("row_id", L.image_id(F.col("image_path")).alias("id"))


@query("P8_tile_boxes", """
    WITH b AS (SELECT row_id, 100 + n_chars % 900 AS w, 75 + n_chars % 700 AS h FROM v_manifest),
    g AS (SELECT *, unnest([0, 1]) AS r FROM b), t AS (SELECT *, unnest([0, 1, 2]) AS c FROM g)
    SELECT row_id, 'tile_' || (r * 3 + c) AS tile, CAST(round_even(c * (w / 3.0::DOUBLE), 0) AS INTEGER) AS "left", CAST(round_even(h // 2 + r * ((h - h // 2) / 2.0::DOUBLE), 0) AS INTEGER) AS upper,
      CAST(round_even((c + 1) * (w / 3.0::DOUBLE), 0) AS INTEGER) AS "right", CAST(round_even(h // 2 + (r + 1) * ((h - h // 2) / 2.0::DOUBLE), 0) AS INTEGER) AS lower FROM t""", ("v_manifest",))
def p8(spark, sf_dir):
    m = manifest(spark, sf_dir).select("row_id", (100 + F.col("n_chars") % 900).alias("w"), (75 + F.col("n_chars") % 700).alias("h"))
    return m.select("row_id", F.explode(G.tile_boxes(F.col("w"), F.col("h"))).alias("b")).select("row_id", "b.*")


@query("P9_tile_overlap_labels", f"""WITH {SQL_BOXES},
    g AS (SELECT row_id, unnest([0, 1]) AS r FROM v_manifest), t AS (SELECT *, unnest([0, 1, 2]) AS c FROM g),
    px AS (SELECT row_id, bx * 6.0 AS x, b_y * 4.0 AS y, bw * 6.0 AS w, bh * 4.0 AS h FROM boxes WHERE (row_id + j) % 4 <> 1),
    o AS (SELECT t.row_id, r, c, max(CASE WHEN x IS NOT NULL AND least((c + 1) * 200, x + w) > greatest(c * 200, x) AND least(200 + (r + 1) * 100, y + h) > greatest(200 + r * 100, y)
        THEN (least((c + 1) * 200, x + w) - greatest(c * 200, x)) * (least(200 + (r + 1) * 100, y + h) - greatest(200 + r * 100, y)) / 20000 ELSE 0 END) AS share FROM t LEFT JOIN px USING (row_id) GROUP BY ALL)
    SELECT row_id AS image_id, 'tile_' || (r * 3 + c) AS tile, CAST(coalesce(share, 0) > 0.10 AS INTEGER) AS has_crack FROM o""", ("v_manifest",))
def p9(spark, sf_dir):
    docs = AN.parse_coco(coco_docs(spark, sf_dir), "value")
    images = AN.coco_images(docs)
    return AN.tile_labels(images, AN.coco_boxes(docs).drop("width", "height"), ["doc", "image_id"]).select("image_id", "tile", "has_crack")


@query("P10_window_starts", """
    WITH s AS (SELECT row_id, 30 + n_chars % 400 AS size FROM v_manifest),
    a AS (SELECT row_id, unnest(CASE WHEN size <= 64 THEN [0] ELSE list_distinct(list_concat(generate_series(0, size - 64, 48), [size - 64])) END) AS start, 'clamped' AS kind FROM s),
    b AS (SELECT row_id, unnest(list_distinct(list_concat(generate_series(0, greatest(size - 64, 0), 48), [size - 64]))) AS start, 'flush' AS kind FROM s)
    SELECT row_id, CAST(start AS BIGINT) AS start, kind FROM a UNION ALL SELECT row_id, CAST(start AS BIGINT), kind FROM b""", ("v_manifest",))
def p10(spark, sf_dir):
    s = manifest(spark, sf_dir).select("row_id", (30 + F.col("n_chars") % 400).cast("int").alias("size"))
    parts = [s.select("row_id", F.explode(G.window_starts(F.col("size"), 64, 48, clamp).cast("array<bigint>")).alias("start"), F.lit(kind).alias("kind"))
             for clamp, kind in ((True, "clamped"), (False, "flush"))]
    return parts[0].unionByName(parts[1])


@query("J9_mask_pairs", """SELECT '/m/' || source_dataset || '/Im-' || row_id || '.jpg' AS image_path, '/m/' || source_dataset || '/im' || row_id || '_mask.png' AS mask_path
    FROM v_manifest WHERE row_id % 3 <> 0""", ("v_manifest",))
def j9(spark, sf_dir):
    m = manifest(spark, sf_dir)
    i = F.col("row_id").cast("string")
    folder = F.concat(F.lit("/m/"), F.col("source_dataset"), F.lit("/"))
    im = SM.inventory(m.select(F.concat(folder, F.lit("Im-"), i, F.lit(".jpg")).alias("path")))
    mk = SM.inventory(m.where("row_id % 3 <> 0").select(F.concat(folder, F.lit("im"), i, F.lit("_mask.png")).alias("path")))
    return SM.pair_images_and_masks(im, mk).select("image_path", "mask_path")


@query("J9_split_folder_pairs", """SELECT '/c/' || (['traincrop','val','testcrop'])[(row_id % 3) + 1] || '/images/s' || row_id || '.jpg' AS image_path,
    (['train','val','test'])[(row_id % 3) + 1] AS split FROM v_manifest WHERE row_id % 4 <> 0""", ("v_manifest",))
def j9_split(spark, sf_dir):
    m = manifest(spark, sf_dir)
    i = F.col("row_id")
    folder = F.concat(F.lit("/c/"), views._pick(i % 3, ["traincrop", "val", "testcrop"]))
    im = SM.inventory(m.select(F.concat(folder, F.lit("/images/s"), i.cast("string"), F.lit(".jpg")).alias("path")))
    mk = SM.inventory(m.where("row_id % 4 <> 0").select(F.concat(folder, F.lit("/mask/S"), i.cast("string"), F.lit("_GT.png")).alias("path")))
    return SM.pair_within_splits(im, mk).select("image_path", "split")


# --- statistics, unions, splits, sampling -----------------------------------------------------------------

@query("A1_manifest_statistics", "SELECT surface_type, quality, split, count(*) AS rows FROM v_manifest GROUP BY ALL", ("v_manifest",))
def a1(spark, sf_dir):
    return M.group_counts(manifest(spark, sf_dir), ["surface_type", "quality", "split"])


@query("A1_label_totals", f"WITH {SQL_SETS} SELECT x AS label, (SELECT count(*) FROM sets WHERE list_contains(string_split(labels, ','), x)) AS rows FROM (SELECT unnest([" + ",".join(f"'{x}'" for x in vocab.LABEL_VOCAB) + "]) AS x)", ("v_manifest",))
def a1_labels(spark, sf_dir):
    return M.label_totals(raw_sets(spark, sf_dir))


def two_parts(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.where("row_id % 3 <> 0"), m.where("row_id % 2 = 0").withColumn("has_crack", F.lit(9))


@query("U1_union_dedupe", """SELECT image_path, source_dataset, CASE WHEN row_id % 3 <> 0 THEN has_crack ELSE 9 END AS has_crack FROM v_manifest WHERE row_id % 3 <> 0 OR row_id % 2 = 0""", ("v_manifest",))
def u1(spark, sf_dir):
    a, b = two_parts(spark, sf_dir)
    return M.union_manifests([a, b.drop("n_chars")], ["image_path", "source_dataset"]).select("image_path", "source_dataset", "has_crack")


@query("U2_incremental_append", """SELECT image_path, CASE WHEN row_id % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM v_manifest WHERE row_id % 3 <> 0 OR row_id % 2 = 0""", ("v_manifest",))
def u2(spark, sf_dir):
    a, b = two_parts(spark, sf_dir)
    return M.append_new(a.withColumn("origin", F.lit("old")), b.withColumn("origin", F.lit("new"))).select("image_path", "origin")


@query("U3_augmented_manifest", f"""WITH {SQL_NEIGHBOURS}, {SQL_MARGINS}, {SQL_ACCEPTED}
    SELECT source_dataset, split, surface_type, quality, count(*) AS rows FROM (
      SELECT source_dataset, split, surface_type, quality FROM v_embed UNION ALL SELECT 'recorded_video_pseudo', 'train', surface_type, quality FROM acc WHERE accepted) GROUP BY ALL""", ("v_embed",))
def u3(spark, sf_dir):
    base = views.v_embed(spark, sf_dir)
    acc = accepted(spark, sf_dir).where("accepted")
    pseudo = acc.select(F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("image_path"), F.lit("recorded_video_pseudo").alias("source_dataset"),
                        "surface_type", "quality", F.lit("train").alias("split"))
    return M.group_counts(M.augmented_manifest(base, pseudo), ["source_dataset", "split", "surface_type", "quality"])


@query("U6_composite_codes", """
    WITH f AS (SELECT surface_type || '__q' || quality AS composite, min(row_id) AS first FROM v_manifest GROUP BY 1),
    c AS (SELECT composite, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
    SELECT row_id, composite, code FROM v_manifest JOIN c ON composite = surface_type || '__q' || quality""", ("v_manifest",))
def u6(spark, sf_dir):
    return M.composite_codes(manifest(spark, sf_dir), "row_id").select("row_id", "composite", "code")


@query("W1_stratified_split", """
    WITH r AS (SELECT image_path, row_number() OVER (PARTITION BY source_dataset, has_crack ORDER BY md5(image_path), image_path) AS rn, count(*) OVER (PARTITION BY source_dataset, has_crack) AS n FROM v_manifest),
    b AS (SELECT *, greatest(1, CAST(round_even(0.7::DOUBLE * n, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(0.15::DOUBLE * n, 0) AS BIGINT)) AS v FROM r),
    e AS (SELECT *, CASE WHEN n <= 2 THEN 1 WHEN t + v >= n THEN greatest(1, n - 2) ELSE t END AS te, CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN t + v >= n THEN greatest(1, n - 2) + 1 ELSE t + v END AS ve FROM b)
    SELECT image_path, CASE WHEN rn <= te THEN 'train' WHEN rn <= ve THEN 'val' ELSE 'test' END AS split FROM e""", ("v_manifest",))
def w1(spark, sf_dir):
    return M.stratified_split(manifest(spark, sf_dir).drop("split"), ["source_dataset", "has_crack"]).select("image_path", "split")


def sql_quota(rows: str, strata: str, target: str, prefix: str) -> str:
    """CTEs `<prefix>_chosen` (rows with chosen flag): largest remainder over strata, md5 order inside."""
    return f"""
  {prefix}_g AS (SELECT {strata}, count(*) AS n FROM {rows} GROUP BY ALL),
  {prefix}_t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM {prefix}_g),
  {prefix}_s AS (SELECT *, n / CAST(total AS DOUBLE) * CAST({target} AS DOUBLE) AS share, CAST({target} AS BIGINT) AS tgt FROM {prefix}_g, {prefix}_t),
  {prefix}_q AS (SELECT *, least(n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, {strata}) <= tgt - (SELECT sum(floor(share)) FROM {prefix}_s) THEN 1 ELSE 0 END) AS quota FROM {prefix}_s),
  {prefix}_chosen AS (SELECT r.*, row_number() OVER (PARTITION BY {", ".join("r." + s.strip() for s in strata.split(","))} ORDER BY md5(image_path), image_path) <= quota AS chosen FROM {rows} r JOIN {prefix}_q USING ({strata}))
"""


@query("W2_holdout_by_flag", f"""WITH held AS (SELECT * FROM v_manifest WHERE row_id % 3 <> 0), {sql_quota('held', 'surface_type, quality', 'floor(total * 0.5::DOUBLE)', 'h')}
    SELECT image_path, CASE WHEN chosen THEN 'val' ELSE 'test' END AS split FROM h_chosen UNION ALL SELECT image_path, 'train' FROM v_manifest WHERE row_id % 3 = 0""", ("v_manifest",))
def w2(spark, sf_dir):
    m = manifest(spark, sf_dir).drop("split").withColumn("train", F.when(F.col("row_id") % 3 == 0, "True").otherwise("False"))
    return M.holdout_split(m).select("image_path", "split")


@query("W2_holdout_without_flag", f"""WITH {sql_quota('v_manifest', 'surface_type, quality', 'floor(total * 0.7::DOUBLE)', 'a')},
    rest AS (SELECT * EXCLUDE (chosen) FROM a_chosen WHERE NOT chosen), {sql_quota('rest', 'surface_type, quality', 'floor(total * 0.5::DOUBLE)', 'b')}
    SELECT image_path, 'train' AS split FROM a_chosen WHERE chosen UNION ALL SELECT image_path, CASE WHEN chosen THEN 'val' ELSE 'test' END FROM b_chosen""", ("v_manifest",))
def w2_plain(spark, sf_dir):
    return M.holdout_split(manifest(spark, sf_dir).drop("split"), flag=None).select("image_path", "split")


@query("T4_per_group_cap", f"""WITH {SQL_NEIGHBOURS}, {SQL_MARGINS}, {SQL_ACCEPTED},
    rk AS (SELECT *, row_number() OVER (PARTITION BY composite ORDER BY round(mean_cosine, 9) DESC, round(surface_margin, 9) DESC, round(quality_margin, 9) DESC, image_id) AS rank_in_group FROM acc WHERE accepted)
    SELECT image_id, composite, CAST(rank_in_group AS INTEGER) AS rank_in_group FROM rk WHERE rank_in_group <= 5""", ("v_embed",))
def t4(spark, sf_dir):
    return capped(spark, sf_dir).select("image_id", "composite", "rank_in_group")


def capped(spark, sf_dir):
    order = [F.round(c, 9).desc() for c in ("mean_cosine", "surface_margin", "quality_margin")] + [F.col("image_id").asc()]
    return M.top_per_group(accepted(spark, sf_dir).where("accepted"), "composite", order, 5)


@query("T5_round_robin", f"""WITH {SQL_NEIGHBOURS}, {SQL_MARGINS}, {SQL_ACCEPTED},
    rk AS (SELECT *, row_number() OVER (PARTITION BY composite ORDER BY round(mean_cosine, 9) DESC, round(surface_margin, 9) DESC, round(quality_margin, 9) DESC, image_id) AS k FROM acc WHERE accepted)
    SELECT image_id, composite FROM rk WHERE k <= 5 ORDER BY k, composite LIMIT 17""", ("v_embed",))
def t5(spark, sf_dir):
    return M.round_robin(capped(spark, sf_dir), "composite", 17).select("image_id", "composite")


@query("T6_stratified_negatives", f"""WITH {SQL_SETS}, none AS (SELECT * FROM sets WHERE labels = 'none'), {sql_quota('none', 'source_dataset, domain, split', 'least(60, total)', 'n')}
    SELECT image_path, 'pure_none_subset' AS selected_reason FROM n_chosen WHERE chosen UNION ALL SELECT image_path, 'defect_positive' FROM sets WHERE labels <> 'none'""", ("v_manifest",))
def t6(spark, sf_dir):
    return M.select_for_embedding(raw_sets(spark, sf_dir), 60).select("image_path", "selected_reason")


@query("T6_capped_negatives", f"""WITH {SQL_SETS}, none AS (SELECT * FROM sets WHERE labels = 'none'), {sql_quota('none', 'source_dataset, domain, split', 'least(10, total)', 'n')}
    SELECT image_path, 'pure_none_subset' AS selected_reason FROM n_chosen WHERE chosen UNION ALL SELECT image_path, 'defect_positive' FROM sets WHERE labels <> 'none'""", ("v_manifest",))
def t6_capped(spark, sf_dir):
    return M.select_for_embedding(raw_sets(spark, sf_dir), 10).select("image_path", "selected_reason")


@query("T6_cap_and_top_up", f"""WITH {SQL_SETS}, gaps AS (SELECT * REPLACE (CASE WHEN row_id % 4 = 0 THEN domain END AS domain) FROM sets WHERE labels = 'none'), none AS (SELECT * FROM gaps WHERE domain IS NOT NULL),
    {sql_quota('none', 'source_dataset, domain, split', '20', 'n')},
    spare AS (SELECT image_path, row_number() OVER (ORDER BY md5(image_path), image_path) AS k FROM gaps WHERE image_path NOT IN (SELECT image_path FROM n_chosen WHERE chosen))
    SELECT image_path, 'pure_none_subset' AS selected_reason FROM n_chosen WHERE chosen UNION ALL SELECT image_path, 'pure_none_subset' FROM spare WHERE k <= 20 - (SELECT count(*) FROM n_chosen WHERE chosen)
    UNION ALL SELECT image_path, 'defect_positive' FROM sets WHERE labels <> 'none'""", ("v_manifest",))
def t6_top_up(spark, sf_dir):
    """Most rows have no domain, so their strata cannot fill the cap; the rest comes from all that is left."""
    sets = raw_sets(spark, sf_dir).withColumn("domain", F.when(F.col("row_id") % 4 == 0, F.col("domain")))
    return M.select_for_embedding(sets, 20).select("image_path", "selected_reason")


@query("T7_class_cap", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY has_crack ORDER BY md5(image_path), image_path) AS k FROM v_manifest) SELECT image_path, has_crack FROM r WHERE k <= 75""", ("v_manifest",))
def t7(spark, sf_dir):
    return M.cap_per_class(manifest(spark, sf_dir), "has_crack", 150).select("image_path", "has_crack")
