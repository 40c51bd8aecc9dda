"""Label corrections: overlay on the image tables, filters, pages, edits, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.manifests import keep_first
from kerbline.operators.ordered import KeyProfile, page, row_number
from kerbline.operators.tracks import evenly_spaced
from kerbline.session import cut_lineage

# --- fixed values: table order for id resolution ---
MODES = ["labeled", "unlabeled", "defect", "survey"]
# --- end of fixed values ---


def image_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables with their mode and its priority; original_label defaults to -1."""
    out = None
    for mode, df in tables.items():
        if "original_label" not in df.columns:
            df = df.withColumn("original_label", F.lit(-1))
        part = df.withColumn("mode", F.lit(mode)).withColumn("mode_rank", F.lit(MODES.index(mode)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_by_id(images: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per id: the earliest row of the first table holding it."""
    return keep_first(images, ["id"], ["mode_rank", order])


def migrate_corrections(rows: DataFrame) -> DataFrame:
    """`(id, labels map)` from either form; legacy -1 means no correction."""
    if "labels_json" in rows.columns:
        return rows.select("id", F.from_json("labels_json", "map<string,string>").alias("labels"))
    legacy = rows.where(F.col("corrected_label") != -1)
    return legacy.select("id", F.create_map(F.lit("has_crack"), F.col("corrected_label").cast("string")).alias("labels"))


def effective_labels(images: DataFrame, corrections: DataFrame, first_row_only: bool = False, order: str = "row_id") -> DataFrame:
    """Adds `effective_label` and `corrected`.

    A correction applies wherever its id occurs, or with `first_row_only` just to
    the first row of the id across the tables.
    """
    fixed = corrections.select(
        "id", F.try_element_at("labels", F.lit("has_crack")).cast("int").alias("_hc"), F.lit(True).alias("_has")
    )
    j = images.join(fixed, "id", "left")
    if first_row_only:
        firsts = images.groupBy("id").agg(F.min(F.struct("mode_rank", order)).alias("_at"))
        j = j.join(firsts, "id").withColumn("_hc", F.when(F.struct("mode_rank", order) == F.col("_at"), F.col("_hc"))).drop("_at")
    return j.withColumn("effective_label", F.coalesce("_hc", "original_label").cast("int")).withColumn(
        "corrected", F.coalesce("_has", F.lit(False))
    ).drop("_hc", "_has")


def source_statistics(effective: DataFrame) -> DataFrame:
    e = F.col("effective_label")
    return effective.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(e == 1).alias("crack"),
        F.count_if(e == 0).alias("no_crack"),
        F.count_if(~e.isin(0, 1)).alias("unknown"),
    )


def mode_totals(effective: DataFrame) -> DataFrame:
    e = F.col("effective_label")
    return effective.groupBy("mode").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e == 1).alias("crack"),
        F.count_if(e == 0).alias("no_crack"), F.count_if(e == -1).alias("unknown"),
    )


def annotated(images: DataFrame, annotations: DataFrame, wanted: bool = True) -> DataFrame:
    return images.join(annotations.select("id"), "id", "left_semi" if wanted else "left_anti")


def label_filter(images: DataFrame, corrections: DataFrame, key: str, value: str | None) -> DataFrame:
    """Images whose correction sets `key` to `value`; with None those that do not set it."""
    found = F.try_element_at("labels", F.lit(key))
    if value is None:
        return images.join(corrections.where(F.map_contains_key("labels", key)).select("id"), "id", "left_anti")
    return images.join(corrections.where(F.coalesce(found, F.lit("")) == value).select("id"), "id", "left_semi")


def filtered_page(images: DataFrame, where: Column, order: Sequence[str], page_no: int, per_page: int) -> DataFrame:
    """The page clamped to the existing ones, each row with total, page and pages.

    The filter runs once: its hits are stored, counted and cut up for the page.
    """
    hits = cut_lineage(images.where(where))
    total = hits.count()
    pages = max(1, -(-total // per_page))
    current = min(max(1, page_no), pages)
    rows = page(hits, list(order), (current - 1) * per_page, per_page)
    return rows.select("*", F.lit(total).cast("bigint").alias("total"), F.lit(current).alias("page"), F.lit(pages).cast("bigint").alias("pages"))


def review_queue(images: DataFrame, corrections: DataFrame, masks: DataFrame, order: str = "row_id") -> DataFrame:
    """Crack images without a mask, first row per id, survey tables left out."""
    pool = images.where(F.col("mode") != "survey").join(masks.select("id"), "id", "left_anti")
    return effective_labels(first_by_id(pool, order), corrections).where("effective_label = 1")


def similar_items(points: DataFrame, query_id: str, n: int, where: Column | None = None) -> DataFrame:
    """Nearest other points in the plane, one row per id, distance rounded."""
    # The query is one row of known size.
    at = points.where(F.col("id") == query_id).agg(F.first("x").alias("_x"), F.first("y").alias("_y")).withColumn("_k", F.lit(1))
    pool = points.where(F.col("id") != query_id)
    if where is not None:
        pool = pool.where(where)
    j = pool.withColumn("_k", F.lit(1)).join(F.broadcast(at), "_k").drop("_k")
    d = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    near = j.withColumn("_d", d).groupBy("id").agg(F.min("_d").alias("_d"))
    return near.orderBy("_d", "id").limit(n).select("id", F.round("_d", 5).alias("dist"))


def scatter(points: DataFrame, id_modes: DataFrame, corrections: DataFrame, mode: str = "", source: str = "") -> DataFrame:
    """Points of a mode with corrected labels; all points, flagged, when the mode has none."""
    tagged = points.join(id_modes.select("id", "mode"), "id", "left").withColumn("mode", F.coalesce("mode", F.lit("labeled")))
    if mode:
        # One counted row decides between the mode's points and all of them.
        seen = tagged.agg((F.count_if(F.col("mode") == mode) > 0).alias("_seen")).withColumn("_k", F.lit(1))
        tagged = tagged.withColumn("_k", F.lit(1)).join(F.broadcast(seen), "_k").drop("_k")
        tagged = tagged.where(~F.col("_seen") | (F.col("mode") == mode))
        fallback = ~F.col("_seen") & F.lit(mode == "survey")
    else:
        fallback = F.lit(False)
    tagged = tagged.withColumn("survey_fallback", fallback)
    if source:
        tagged = tagged.where(F.col("source_dataset") == source)
    fixed = corrections.select("id", F.try_element_at("labels", F.lit("has_crack")).cast("int").alias("_hc"), F.lit(True).alias("_has"))
    j = tagged.join(fixed, "id", "left")
    return j.select(
        "id", "x", "y", F.coalesce("_hc", "has_crack", F.lit(-1)).cast("int").alias("has_crack"),
        F.coalesce("_has", F.lit(False)).alias("corrected"), F.col("source_dataset").alias("source"), "mode", "survey_fallback",
    )


def fold_edits(edits: DataFrame) -> DataFrame:
    """Edit log to `(id, labels map)`: last value per key after the last revert; null removes a key.

    Edits are reduced to one entry per (id, key) before the ids are gathered.
    """
    at = F.struct("seq")
    last = edits.where(~F.col("revert_all")).groupBy("id", "key").agg(
        F.max_by(F.struct("value"), at)["value"].alias("value"), F.max("seq").alias("seq")
    )
    reverts = edits.where("revert_all").groupBy("id", F.lit(None).cast("string").alias("key")).agg(
        F.lit(None).cast("string").alias("value"), F.max("seq").alias("seq")
    )
    both = last.withColumn("_rev", F.lit(None).cast(edits.schema["seq"].dataType)).unionByName(reverts.withColumn("_rev", F.col("seq")))
    # One entry per label key of the schema reaches each id.
    g = both.groupBy("id").agg(
        F.max("_rev").alias("_rev"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value", "seq"))).alias("_e")
    )
    alive = F.filter("_e", lambda e: e["value"].isNotNull() & (F.col("_rev").isNull() | (e["seq"] > F.col("_rev"))))
    entries = F.array_sort(F.transform(alive, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return g.select("id", entries.alias("_e")).where(F.size("_e") > 0).select("id", F.map_from_entries("_e").alias("labels"))


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def move_rows(df: DataFrame, ids: DataFrame, target: str, key: str = "id") -> DataFrame:
    """Rows of `ids` get a new source_dataset."""
    marks = ids.select(key).distinct().withColumn("_moved", F.lit(True))
    j = df.join(marks, key, "left")
    moved = F.when(F.col("_moved"), F.lit(target)).otherwise(F.col("source_dataset"))
    return j.withColumn("source_dataset", moved).drop("_moved").select(*df.columns)


def rename_dataset(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("source_dataset", F.when(F.col("source_dataset") == old, F.lit(new)).otherwise(F.col("source_dataset")))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of `changes` replace those of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def session_list(log: DataFrame, key: str = "session_id", started: str = "started_ms", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The sessions left after all saves and deletes, newest first, with their 1-based `position`.

    `log` holds one row per save or delete; of a key the row with the highest version
    counts, whatever order they arrive in. Sessions that started together are listed
    latest save first, then by key; an unknown start counts as the newest. The list is numbered in chunks when it is long.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), version).alias("_r")).select(key, "_r.*")
    alive = last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    rows = alive.withColumn("_newest", -F.col(started)).withColumn("_latest", -F.col(version))
    return KeyProfile.of(rows).layout(rows, ["_newest", "_latest", key]).scan(rows, position=row_number()).drop("_newest", "_latest")


def box_statistics(index: DataFrame) -> DataFrame:
    """Boxes per class; a missing class counts as `unknown`."""
    boxes = index.select(F.explode("bboxes").alias("b"))
    return boxes.groupBy(F.coalesce("b.label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("boxes"))


def mask_statistics(masks: DataFrame) -> DataFrame:
    return masks.groupBy(F.coalesce("source", F.lit("manual")).alias("source")).agg(F.count(F.lit(1)).alias("masks"))


def run_inventory(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Per run: images, whether it is imported, and four evenly spaced sample paths.

    `files`: run, path, section (0 frames, 1 problem images, 2 root).
    """
    picks = evenly_spaced(files, ["run"], ["section", "path"])
    order = F.struct("section", "path")
    samples = picks.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["path"]).alias("samples"))
    counts = files.groupBy("run").agg(F.count(F.lit(1)).alias("frame_count"))
    known = imported.select(F.col("source_dataset").alias("run")).distinct().withColumn("_known", F.lit(True))
    out = counts.join(samples, "run").join(known, "run", "left")
    return out.withColumn("imported", F.coalesce("_known", F.lit(False))).drop("_known")
