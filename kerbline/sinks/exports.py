"""Exports: GeoJSON, COCO, YOLO, mask manifests, labelled frames.

Documents are produced as ordered lines, so a route or an annotation set of any
size is written by many tasks; concatenating the parts gives the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geometry import has_fix
from kerbline.operators.ordered import KeyProfile, group_count, row_number

SESSION = "session_id"


def _number(value: Column, digits: int | None) -> Column:
    return value.cast("string") if digits is None else F.format_string(f"%.{digits}f", value)


def route_coordinate_lines(track: DataFrame, order: Sequence[str], digits: int | None = 5) -> DataFrame:
    """One `[lon,lat]` line per valid fix of sessions with at least two, in time order."""
    ok = track.where(has_fix(F.col("lat"), F.col("lon")))
    s = KeyProfile.of(ok, [SESSION]).layout(ok, list(order)).scan(ok, _rn=row_number(), _n=group_count()).where("_n >= 2")
    pair = F.concat(F.lit("["), _number(F.col("lon"), digits), F.lit(","), _number(F.col("lat"), digits), F.lit("]"))
    comma = F.when(F.col("_rn") > 1, F.lit(",")).otherwise(F.lit(""))
    return s.select("*", (F.col("_rn") - 1).alias("position"), F.concat(comma, pair).alias("text")).drop("_rn", "_n")


def problem_feature(properties: Sequence[str]) -> Column:
    """JSON text of one problem point; geometry is null without a fix."""
    point = F.when(
        has_fix(F.col("lat"), F.col("lon")),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")),
    )
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def geojson_lines(track: DataFrame, problems: DataFrame, order: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """(session_id, section, position, text) lines of one FeatureCollection per session."""
    route = route_coordinate_lines(track, order, digits=None)
    route = route.select(SESSION, F.lit(2).alias("section"), "position", "text")
    heads = track.groupBy(SESSION).agg(
        F.min_by("route_approximate", F.struct(*order)).alias("approximate"),
        F.min_by("notice", F.struct(*order)).alias("notice"),
        F.min_by("telemetry_source", F.struct(*order)).alias("telemetry_source"),
        F.count_if(has_fix(F.col("lat"), F.col("lon"))).alias("_fixes"),
    )
    everyone = track.select(SESSION).union(problems.select(SESSION)).distinct()
    open_text = F.lit('{"type":"FeatureCollection","features":[')
    props = F.to_json(F.struct(F.lit("Survey route").alias("name"), "approximate", "notice", "telemetry_source"))
    line_open = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"LineString","coordinates":['))
    zero = F.lit(0).cast("bigint")
    drawn = heads.where("_fixes >= 2")
    opening = everyone.select(SESSION, F.lit(0).alias("section"), zero.alias("position"), open_text.alias("text"))
    before = drawn.select(SESSION, F.lit(1).alias("section"), zero.alias("position"), line_open.alias("text"))
    after = drawn.select(SESSION, F.lit(3).alias("section"), zero.alias("position"), F.lit("]}}").alias("text"))
    p = KeyProfile.of(problems, [SESSION]).layout(problems, ["t", "frame_index"]).scan(problems, _rn=row_number())
    p = p.join(drawn.select(SESSION, F.lit(True).alias("_route")), SESSION, "left")
    lead_comma = F.when((F.col("_rn") > 1) | F.coalesce("_route", F.lit(False)), F.lit(",")).otherwise(F.lit(""))
    points = p.select(SESSION, F.lit(4).alias("section"), F.col("_rn").alias("position"), F.concat(lead_comma, problem_feature(properties)).alias("text"))
    closing = everyone.select(SESSION, F.lit(5).alias("section"), zero.alias("position"), F.lit("]}").alias("text"))
    out = opening
    for part in (before, route, after, points, closing):
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Text folder per key whose parts, in name order, form the document."""
    (
        lines.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .select(key, "text")
        .write.mode("overwrite")
        .partitionBy(key)
        .text(path)
    )


def write_line_table(lines: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """All documents in one table of ordered lines, where a folder each would cost more than their text; `read_line_table` joins them."""
    at = F.struct(*order).alias("at")
    lines.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, at, "text").write.mode("overwrite").parquet(path)


def labelled_boxes(index: DataFrame) -> DataFrame:
    """Boxes with a non-empty label, one row each, with their place in the image."""
    keep = [c for c in index.columns if c != "bboxes"]
    rows = index.select(*keep, F.posexplode("bboxes").alias("box_pos", "b"))
    return rows.where(F.coalesce(F.col("b.label"), F.lit("")) != "").select(*keep, "box_pos", "b.*")


def class_ids(boxes: DataFrame, first: int) -> DataFrame:
    """Sorted distinct labels with consecutive ids from `first`."""
    names = boxes.select("label").distinct()
    s = KeyProfile.of(names).layout(names, ["label"]).scan(names, _rn=row_number())
    return s.select("label", (F.col("_rn") - 1 + first).alias("class_id"))


def coco_tables(index: DataFrame, order: str = "pos") -> dict[str, DataFrame]:
    """`images`, `categories`, `annotations` with sequential ids."""
    boxes = labelled_boxes(index)
    categories = class_ids(boxes, 1)
    keys = index.select("img_id", order)
    numbered = KeyProfile.of(keys).layout(keys, [order]).scan(keys, _rn=row_number())
    image_ids = numbered.select("img_id", F.col("_rn").alias("image_id"))
    images = index.join(image_ids, "img_id").select(
        F.col("image_id").alias("id"), F.col("image_path").alias("file_name"),
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
    )
    rows = boxes.join(image_ids, "img_id").join(categories, "label")
    s = KeyProfile.of(rows).layout(rows, ["image_id", "box_pos"]).scan(rows, _rn=row_number())
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))

    def r2(v: Column) -> Column:
        return F.bround(v, 2)

    annotations = s.select(
        F.col("_rn").alias("id"), "image_id", F.col("class_id").alias("category_id"),
        r2(F.col("x") * w).alias("x"), r2(F.col("y") * h).alias("y"), r2(F.col("w") * w).alias("w"), r2(F.col("h") * h).alias("h"),
        r2(F.col("w") * w * (F.col("h") * h)).alias("area"), F.lit(0).alias("iscrowd"),
    )
    return {"images": images, "categories": categories.withColumnRenamed("class_id", "id"), "annotations": annotations}


def write_coco(index: DataFrame, path: str) -> None:
    """The three COCO arrays as JSON-lines folders."""
    for name, df in coco_tables(index).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def yolo_lines(index: DataFrame) -> DataFrame:
    """(img_id, position, text): `class cx cy w h` per labelled box."""
    boxes = labelled_boxes(index)
    rows = boxes.join(class_ids(boxes, 0), "label")
    text = F.format_string(
        "%d %.6f %.6f %.6f %.6f", "class_id", F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h")
    )
    return rows.select("img_id", F.col("box_pos").alias("position"), text.alias("text"))


def write_yolo(index: DataFrame, path: str) -> None:
    write_lines(yolo_lines(index), f"{path}/labels", "img_id", ["position"])
    names = class_ids(labelled_boxes(index), 0)
    names.repartitionByRange("class_id").sortWithinPartitions("class_id").select(F.col("label").alias("value")).write.mode(
        "overwrite"
    ).text(f"{path}/classes")


def mask_manifest(masks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Annotated masks whose image and mask files both exist."""
    here = inventory.select(F.col("path").alias("_p")).distinct()
    kept = masks.join(here, masks["image_path"] == here["_p"], "left_semi")
    kept = kept.join(here, kept["mask_path"] == here["_p"], "left_semi")
    return kept.select("image_path", "mask_path", F.lit("user_annotation").alias("source_dataset"), F.lit("train").alias("split"))


def labelled_frames(frames: DataFrame, corrections: DataFrame) -> DataFrame:
    """Survey frames with corrections; labels come out of the JSON map with defaults."""
    parsed = corrections.select("id", F.from_json("labels_json", "map<string,string>").alias("_m"))
    j = frames.join(parsed, "id")

    def label(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("_m", F.lit(key)), F.lit(default))

    surface, quality = label("surface_type", "unknown"), label("quality", "unknown")
    return j.select(
        "image_path",
        F.coalesce("split", F.lit("train")).alias("split"),
        F.coalesce("source_dataset", F.lit("")).alias("source_dataset"),
        surface.alias("surface_type"),
        quality.alias("quality"),
        label("has_crack", "-1").cast("int").alias("has_crack"),
        F.concat_ws("_", surface, quality).alias("composite_label"),
    )
