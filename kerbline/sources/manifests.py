"""Image inventories and label sources that become manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import labels as L
from kerbline.sources.tables import read_table

LABEL_CSV_SCHEMA = "mapillary_image_id string, surface_type string, surface_quality string, train string"
PAIR_SCHEMA = (
    "image_path string, mask_path string, source_image string, source_mask string, label_path string, "
    "split string, source_dataset string"
)
# --- fixed values: file-name tokens ---
MASK_TOKENS = ["_mask", "-mask", " mask", "_label", "-label", "_gt", "-gt", "_groundtruth"]
STEM_TOKENS = ["_mask", "-mask", "_gt", "-gt", "_label", "-label", "_groundtruth"]
SPLIT_FOLDERS = {
    "traincrop": "train", "validationcrop": "val", "testcrop": "test",
    "train": "train", "val": "val", "validation": "val", "test": "test",
}
# --- end of fixed values ---


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """File listing below `root`; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def inventory(paths: DataFrame, suffixes: Sequence[str] = tuple(vocab.IMAGE_SUFFIXES), path: str = "path") -> DataFrame:
    """`path, name, stem, suffix, dirs` of the rows with an allowed suffix, in any case."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    parts = F.split(F.col(path), "/")
    out = paths.select("*", name.alias("name"), F.slice(parts, 1, F.size(parts) - 1).alias("dirs"))
    out = out.withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)))
    out = out.withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", ""))
    return out.where(F.col("suffix").isin(list(suffixes)))


def by_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """One file per stem; the last path wins."""
    return files.groupBy("stem").agg(F.max(path).alias(path))


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_CSV_SCHEMA).option("header", True).csv(path)


def label_manifest(labels: DataFrame, images: DataFrame, source: str, strict: bool = True) -> DataFrame:
    """Label rows joined to the image with that stem; use `unmatched` for the rest."""
    j = labels.join(by_stem(images), labels["mapillary_image_id"] == F.col("stem"))
    return j.select(
        F.col("path").alias("image_path"),
        F.lit(source).alias("source_dataset"),
        L.surface_type(F.col("surface_type"), strict).alias("surface_type"),
        L.quality_grade(F.col("surface_quality"), strict).alias("quality"),
        "train",
    )


def unmatched(labels: DataFrame, images: DataFrame) -> DataFrame:
    gone = labels.join(images.select("stem"), labels["mapillary_image_id"] == F.col("stem"), "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("unmatched"))


def folder_labels(files: DataFrame, source: str) -> DataFrame:
    """Crack images by folder name; mask and label folders, and unnamed ones, are left out."""
    parts = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    skip = F.exists(parts, lambda p: p.contains("mask") | p.contains("label"))
    crack = F.exists(parts, lambda p: p.contains("crack"))
    kept = files.where(~skip & crack)
    return kept.select(F.col("path").alias("image_path"), F.lit(source).alias("source_dataset"), F.lit("full").alias("tile"), F.lit(1).alias("has_crack"))


def two_folder_labels(files: DataFrame, source: str, positive: str, negative: str) -> DataFrame:
    """Label by the first folder below the dataset root named `positive` or `negative`."""
    named = F.filter("dirs", lambda d: d.isin(positive, negative))
    rows = files.withColumn("_d", F.get(named, F.lit(0))).where(F.col("_d").isNotNull())
    return rows.select(
        F.col("path").alias("image_path"), F.lit(source).alias("source_dataset"), F.lit("full").alias("tile"),
        (F.col("_d") == positive).cast("int").alias("has_crack"),
    )


def coded_domain_labels(files: DataFrame, source: str = "sdnet2018") -> DataFrame:
    """`<D|W|P>/<cracked|uncracked>/...` folders to domain and labels."""
    domains = {"D": "bridge", "W": "building", "P": "pavement"}
    code = F.get(F.filter("dirs", lambda d: d.isin(*domains)), F.lit(0))
    state = F.get(F.filter("dirs", lambda d: d.isin("cracked", "uncracked")), F.lit(0))
    rows = files.select("path", code.alias("_c"), state.alias("_s")).where("_c IS NOT NULL AND _s IS NOT NULL")
    crack = F.col("_s") == "cracked"
    return rows.select(
        F.col("path").alias("image_path"), F.lit(source).alias("source_dataset"), L.lookup(F.col("_c"), domains).alias("domain"),
        F.lit("concrete").alias("structure_material"), F.array(F.when(crack, "crack").otherwise("none")).alias("labels"),
        crack.cast("int").alias("has_crack"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair lines; a missing or near-empty file gives no rows, blank lines are skipped."""
    lines = spark.read.text(path)
    return parse_pairs(lines.where(F.length(F.trim("value")) > 0))


def parse_pairs(lines: DataFrame, text: str = "value") -> DataFrame:
    p = lines.where(F.length(F.trim(F.col(text))) > 0).select(F.from_json(text, PAIR_SCHEMA).alias("p"))
    return p.select(
        F.coalesce(F.nullif("p.source_image", F.lit("")), F.col("p.image_path")).alias("image_path"),
        F.coalesce(F.nullif("p.source_mask", F.lit("")), F.nullif("p.mask_path", F.lit("")), F.col("p.label_path")).alias("mask_path"),
        F.coalesce("p.source_dataset", F.lit("unknown")).alias("source_dataset"),
        F.col("p.split").alias("split"),
        F.lit(1).alias("has_crack"),
    )


def read_tile_labels(spark: SparkSession, folder: str, source: str = "runway_roboflow") -> DataFrame:
    """`tile_labels` as Parquet, else CSV, else JSON lines; a missing tile is `full`."""
    schema = "image_path string, tile string, has_crack int"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for suffix in ("parquet", "csv", "jsonl"):
        path = f"{folder}/tile_labels.{suffix}"
        target = fs_path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            rows = read_table(spark, path, None if suffix == "parquet" else schema)
            tile = F.coalesce("tile", F.lit("full")) if "tile" in rows.columns else F.lit("full")
            return rows.select("image_path", F.lit(source).alias("source_dataset"), tile.alias("tile"), F.col("has_crack").cast("int").alias("has_crack"))
    return spark.createDataFrame([], "image_path string, source_dataset string, tile string, has_crack int")


def _strip(text: Column, tokens: Sequence[str]) -> Column:
    for token in tokens:
        text = F.replace(text, F.lit(token))
    return text


def pair_key(stem: Column) -> Column:
    return F.regexp_replace(_strip(F.lower(stem), MASK_TOKENS), r"[^\p{L}\p{N}]", "")


def pair_images_and_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """First image and first mask per normalised stem."""
    i = images.groupBy(pair_key(F.col("stem")).alias("key")).agg(F.min("path").alias("image_path"))
    m = masks.groupBy(pair_key(F.col("stem")).alias("key")).agg(F.min("path").alias("mask_path"))
    return i.join(m, "key")


def pair_within_splits(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image stem = stripped mask stem inside each split folder; the last path of a stem wins."""
    def folder(df: DataFrame) -> DataFrame:
        name = F.get(F.filter("dirs", lambda d: d.isin(*SPLIT_FOLDERS)), F.lit(0))
        return df.withColumn("split_folder", name).where(F.col("split_folder").isNotNull())

    i = folder(images).groupBy("split_folder", F.col("stem").alias("key")).agg(F.max("path").alias("image_path"))
    m = folder(masks).groupBy("split_folder", _strip(F.lower("stem"), STEM_TOKENS).alias("key")).agg(F.max("path").alias("mask_path"))
    j = i.join(m, ["split_folder", "key"])
    return j.select("image_path", "mask_path", L.lookup(F.col("split_folder"), SPLIT_FOLDERS).alias("split"))
