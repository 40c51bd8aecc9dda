"""COCO, Pascal-VOC and multi-target defect annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geometry as G
from kerbline.functions import labels as L
from kerbline.functions.casts import finite

COCO_SCHEMA = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "categories array<struct<id: bigint, name: string>>, "
    "annotations array<struct<image_id: bigint, category_id: bigint, bbox: array<double>>>"
)
_BOX = "struct<xmin: string, ymin: string, xmax: string, ymax: string>"
VOC_SCHEMA = f"filename string, object array<struct<name: string, bndbox: {_BOX}>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(COCO_SCHEMA).option("multiLine", True).json(path)
    return docs.withColumn("doc", F.input_file_name())


def parse_coco(docs: DataFrame, text: str, doc: str = "doc") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.from_json(text, COCO_SCHEMA).alias("c")).select("doc", "c.*")


def class_name(raw: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(raw)), "[_-]", "")
    return F.regexp_replace(flat, "s$", "")


def coco_boxes(docs: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """One row per annotation of the wanted classes: doc, image, class, x, y, w, h."""
    images = docs.select("doc", F.explode("images").alias("i")).select(
        "doc", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height"
    )
    names = docs.select("doc", F.explode("categories").alias("c")).select(
        "doc", F.col("c.id").alias("category_id"), class_name(F.col("c.name")).alias("label")
    )
    boxes = docs.select("doc", F.explode("annotations").alias("a")).select("doc", "a.image_id", "a.category_id", "a.bbox")
    wanted = names.where(F.col("label").isin(classes or vocab.CRACK_CLASSES))
    j = boxes.join(wanted, ["doc", "category_id"]).join(images, ["doc", "image_id"])
    return j.select("doc", "image_id", "file_name", "width", "height", "label", *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")])


def coco_images(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")


def tile_labels(images: DataFrame, boxes: DataFrame, keys: list[str], region: str = "lower_half", min_share: float = 0.10) -> DataFrame:
    """One row per image tile: 1 when some box covers more than `min_share` of it.

    Boxes meet only the tiles of their own image, and each (image, tile) is
    reduced to one flag before images without boxes are filled in.
    """
    grid = G.tile_boxes(F.col("width"), F.col("height"), region=region)
    tiles = images.select(*keys, F.explode(grid).alias("tile"))
    hit = boxes.join(images.select(*keys, "width", "height"), keys).select(*keys, F.explode(grid).alias("tile"), "x", "y", "w", "h")
    hit = hit.where(G.overlap_share(F.col("tile"), F.col("x"), F.col("y"), F.col("w"), F.col("h")) > min_share)
    marked = hit.groupBy(*keys, F.col("tile.tile").alias("name")).agg(F.lit(1).alias("has_crack"))
    out = tiles.select(*keys, F.col("tile.tile").alias("name")).join(marked, [*keys, "name"], "left")
    return out.select(*keys, F.col("name").alias("tile"), F.coalesce("has_crack", F.lit(0)).alias("has_crack"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    return rows.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def voc_objects(rows: DataFrame) -> DataFrame:
    """`stem, name, xmin, ymin, xmax, ymax`; objects without a box or with bad numbers are dropped."""
    o = rows.select("stem", F.explode("object").alias("o")).where(F.col("o.bndbox").isNotNull())

    def corner(name: str) -> Column:
        raw = F.coalesce(F.nullif(F.trim(F.col(f"o.bndbox.{name}")), F.lit("")), F.lit("0"))
        return finite(raw).cast("int").alias(name)

    corners = ["xmin", "ymin", "xmax", "ymax"]
    out = o.select("stem", F.trim(F.coalesce("o.name", F.lit(""))).alias("name"), *[corner(c) for c in corners])
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in corners))


def voc_image_labels(images: DataFrame, objects: DataFrame, annotated: DataFrame) -> DataFrame:
    """Labels per image stem; an image that has no annotation file counts as crack.

    Only the distinct class names of an image are gathered.
    """
    names = objects.select("stem", "name").distinct().groupBy("stem").agg(F.collect_list("name").alias("classes"))
    known = annotated.select("stem").distinct().join(names, "stem", "left").withColumn(
        "classes", F.coalesce("classes", F.array().cast("array<string>"))
    )
    j = images.join(known, "stem", "left")
    return j.withColumn("labels", L.annotation_label(F.col("classes"))).drop("classes")


DEFECT_TAGS = ["Background", "Crack", "Spallation", "Efflorescence", "ExposedBars", "CorrosionStain"]
DEFECT_SCHEMA = "_name string, " + ", ".join(f"{t} string" for t in DEFECT_TAGS)


def read_defect_xml(spark: SparkSession, path: str, tags: list[str] = DEFECT_TAGS) -> DataFrame:
    schema = "_name string, " + ", ".join(f"`{t}` string" for t in tags)
    rows = spark.read.format("xml").option("rowTag", "Defect").schema(schema).load(path)
    return rows.withColumn("file_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def defect_records(rows: DataFrame, tags: list[str] = DEFECT_TAGS) -> DataFrame:
    """`key, file_stem, labels`: child values by tag name, or by position if the tags are generic."""
    def plain(tag: str) -> str:
        text = tag.strip().lower().replace("-", "_").replace(" ", "_")
        return vocab.DEFECT_XML_ALIASES.get(text, text)

    names = [plain(t) for t in tags]
    if not set(names) & set(vocab.DEFECT_XML_ORDER):
        names = vocab.DEFECT_XML_ORDER[: len(tags)]
    flags = [F.when(F.trim(F.col(t)).isin("1", "1.0", "true", "True"), F.lit(n)) for t, n in zip(tags, names)]
    labels = F.array_sort(F.array_compact(F.array(*flags)))
    labels = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("background")))
    return rows.where(F.col("_name").isNotNull()).select(F.col("_name").alias("key"), "file_stem", labels.alias("labels"))


def attach_defect_labels(images: DataFrame, records: DataFrame) -> DataFrame:
    """Images matched on `dir/name` first, then on the bare name."""
    full = records.select(F.concat_ws("/", "file_stem", "key").alias("relpath"), F.col("labels").alias("_a"))
    bare = records.groupBy(F.col("key").alias("name")).agg(F.max_by("labels", "file_stem").alias("_b"))
    j = images.join(full, "relpath", "left").join(bare, "name", "left")
    return j.withColumn("labels", F.coalesce("_a", "_b")).where(F.col("labels").isNotNull()).drop("_a", "_b")
