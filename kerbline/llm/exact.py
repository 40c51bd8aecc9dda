"""Exact dedup of assessment rationales by content hash, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def _normal(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _keyed(assessments: DataFrame, key: str, text: str) -> DataFrame:
    normal = _normal(text)
    return assessments.select(
        F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), F.md5(normal.cast("binary")).alias("h"), F.sha2(normal.cast("binary"), 256).alias("sha")
    )


def _collided(assessments: DataFrame, text: str) -> DataFrame:
    """Content hashes under which the bytes of two texts differ.

    Grouping by the hash and the text itself compares the bytes; copies collapse
    in the task that reads them, so a group of any size stays small.
    """
    texts = assessments.select(F.md5(_normal(text).cast("binary")).alias("h"), _normal(text).alias("t")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("c"))
    return texts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", F.lit(True).alias("collided"))


def _groups(assessments: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows by (group, length, id) with their number, and the row of each group that stays."""
    rows = _keyed(assessments, key, text).groupBy("h", "sha", "n", "id").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(_collided(assessments, text), "h", "left")
    rows = rows.select(F.when(F.col("collided"), F.concat("h", "sha")).otherwise(F.col("h")).alias("g"), "sha", "n", "id", "c")
    first = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("unknown"), "id", "c", "sha")
    stays = rows.groupBy("g").agg(F.min(first).alias("best"), F.sum("c").alias("group_size"))
    return rows, stays.select("g", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_n"), F.col("best.c").alias("alike"), F.col("best.sha").alias("keep_sha"), "group_size")


def exact_duplicates(assessments: DataFrame, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """One row per assessment: the assessment of its group of equal rationales that stays.

    Rationales are equal when they are the same after white space (tab to carriage
    return, space) is deleted. They are grouped by a 128-bit content hash; inside
    each hash the bytes are compared, and texts that collide are told apart by a
    second digest. The longest original text stays, then the smallest `key`.

    Columns: `key`, `keep_id`, `group_size`, `kept`, `text_sha256`. A null text counts
    as empty; a null key sorts last; of rows that repeat key and text one is kept;
    other columns are not read. An empty table gives no rows.
    """
    rows, stays = _groups(assessments, key, text)
    out = rows.join(stays, "g").select("*", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("i"))
    kept = (F.col("i") == 1) & (F.col("n") == F.col("keep_n")) & F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(assessments: DataFrame, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """The assessments that `exact_duplicates` keeps, with all their columns."""
    stays = _groups(assessments, key, text)[1].select(F.struct(F.col("keep_sha").alias("sha"), F.col("keep_n").alias("n"), F.col("keep_id").alias("id"), F.col("alike")).alias("__stays"))
    names = assessments.columns
    wide = assessments.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.struct(F.sha2(_normal(text).cast("binary"), 256).alias("sha"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), F.col(key).alias("id")).alias("__key"))
    on = (F.col("__key.sha") == F.col("__stays.sha")) & (F.col("__key.n") == F.col("__stays.n")) & F.col("__key.id").eqNullSafe(F.col("__stays.id"))
    kept = wide.join(stays, on)
    once = kept.filter("__stays.alike = 1").select("__row")
    again = kept.filter("__stays.alike > 1").groupBy("__stays").agg(F.first("__row").alias("__row")).select("__row")
    return once.unionAll(again).select("__row.*")
