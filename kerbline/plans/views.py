"""The survey tables, derived from the given ones by plain column arithmetic.

`SQL` holds the same definitions for the SQL check; both sides use integer
arithmetic wherever the result feeds a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.sources.tables import read_table

# Seconds between events run into hours; one survey second stands for this many.
TIME_SCALE_S = 36_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp, whatever the session zone."""
    span = (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return (span.cast("decimal(24,6)") * 1_000_000).cast("bigint")


EMBED_SURFACES = ["asphalt", "concrete", "paving_stones", "sett", "unpaved"]
TILE_PATHS = ["/survey/bridge_07", "/survey/wall_02", "/data/raw/sdnet2018/P", "/survey/airport", "/survey/street", "/survey/lane"]
SOURCES = ["auto", "sidecar", "embedded", "imu", "none"]


def v_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    bucket = F.col("vec_id") % 20
    return e.select(
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.when(F.col("vec_id") % 7 == 0, "full").otherwise(F.concat(F.lit("tile_"), (F.col("vec_id") % 6).cast("string"))).alias("kind"),
        F.concat(F.lit("src"), (F.col("vec_id") % 3).cast("string")).alias("source_dataset"),
        _pick(F.col("label") % 5, EMBED_SURFACES).alias("surface_type"),
        (F.floor(F.col("label") / 2) + 1).cast("int").alias("quality"),
        F.when(bucket < 14, "train").when(bucket < 17, "val").otherwise("test").alias("split"),
        F.col("label").cast("int").alias("label"),
        "embedding",
    )


def v_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    combo = F.concat("l_returnflag", "l_linestatus")
    surface = (
        F.when(combo.isin("AF", "AO"), "asphalt").when(combo == "NO", "concrete")
        .when(combo == "NF", "unknown").when(combo == "RF", "paving_stones").otherwise("gravel")
    )
    path = _pick(F.col("l_orderkey") % 6, TILE_PATHS)
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".jpg"))
    pct = F.rint(F.col("l_discount") * 100).cast("int")
    tax = F.rint(F.col("l_tax") * 100).cast("int")
    return li.select(
        F.col("l_orderkey").alias("frame_index"),
        (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1_000 + F.col("l_suppkey") % 1_000).alias("tile_pos"),
        F.concat(F.lit("tile_"), F.col("l_linenumber").cast("string")).alias("tile"),
        path.alias("source_path"),
        name.alias("filename"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("int").alias("predicted_quality"),
        surface.alias("surface_type"),
        (1.0 - pct / 100.0).alias("confidence"),
        F.when(F.col("l_partkey") % 11 != 0, tax / 10.0).alias("tile_crack_prob"),
        (pct >= 9).alias("non_road"),
        *[
            ((F.col("l_partkey") * m + F.col("l_suppkey") * 3) % 101 / 100.0).alias(f"{label}_prob_raw")
            for label, m in RAW_MULTIPLIERS.items()
        ],
    )


RAW_MULTIPLIERS = {"crack": 5, "spalling": 7, "efflorescence": 11, "exposed_rebar": 13, "corrosion": 17}
LABEL_THRESHOLDS = {"crack": 0.42, "spalling": 0.95, "efflorescence": 0.95, "exposed_rebar": 0.875, "corrosion": 0.895}
CRACK_THRESHOLD = 0.485


def v_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fix; `utc_ms` is a scaled clock, some fixes and readings are missing."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    ms = F.floor(micros(F.col("ts")) / (TIME_SCALE_S * 1000)).cast("bigint")
    return ev.select(
        F.col("user_id").alias("session_id"),
        i.alias("point_id"),
        ms.alias("utc_ms"),
        F.when(i % 101 == 0, 0.0).when(i % 17 != 0, 48.0 + (i * 7 % 1000) / 100_000.0).alias("lat"),
        F.when(i % 101 == 0, 0.0).when(i % 17 != 0, 17.0 + (i * 11 % 1000) / 100_000.0).alias("lon"),
        F.when(i % 3 != 0, 100.0 + (i % 50) / 10.0).alias("alt_m"),
        F.when(i % 5 != 0, F.rint(F.col("value") * 100).cast("bigint") % 3000 / 100.0).alias("speed_mps"),
        F.when(i % 7 != 0, (i * 37 % 360).cast("double")).alias("heading_deg"),
    )


def v_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("row_id"),
        F.concat_ws("/", F.col("source"), F.col("lang"), i.cast("string")).alias("image_path"),
        F.col("source").alias("source_dataset"),
        F.col("lang").alias("domain"),
        _pick(i % 7, ["asphalt", "concrete", "paving_stones", "sett", "gravel", "mud", "unpaved"]).alias("surface_type"),
        (F.floor(i / 7) % 5 + 1).cast("int").alias("quality"),
        (F.col("n_chars") % 3 == 0).cast("int").alias("has_crack"),
        F.when(i % 10 < 7, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"),
        F.col("n_chars"),
    )


def v_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections on the manifest rows; `has_crack` is absent on every fifth."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).cast("int").alias("has_crack"),
        F.col("quality").cast("int").alias("quality_flag"),
    )


def v_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label edits: key, value (null removes), and a revert on every ninth edit."""
    c = table(spark, sf_dir, "conversations")
    size = F.length("text")
    return c.select(
        F.col("conv_id").alias("id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("key"),
        F.when(size % 4 != 0, (size % 10).cast("string")).alias("value"),
        ((F.col("conv_id") + F.col("turn")) % 9 == 8).alias("revert_all"),
    )


def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score and truth per label: a rounded squash of a vector component."""
    e = v_embed(spark, sf_dir)
    cols = [
        F.bround(1.0 / (1.0 + F.exp(-6.0 * F.element_at("embedding", k + 1).cast("double"))), 3).alias(f"p_{label}")
        for k, label in enumerate(LABEL_THRESHOLDS)
    ]
    truth = [((F.col("label") + k) % 5 < 2).cast("int").alias(f"y_{label}") for k, label in enumerate(LABEL_THRESHOLDS)]
    return e.select("image_id", "split", "source_dataset", F.col("surface_type").alias("domain"), *cols, *truth)


_E_LIST = "['" + "','".join(EMBED_SURFACES) + "']"
_P_LIST = "['" + "','".join(TILE_PATHS) + "']"

SQL = {
    "v_embed": f"""
        SELECT vec_id AS image_id, 'img/' || vec_id || '.jpg' AS image_path,
          CASE WHEN vec_id % 7 = 0 THEN 'full' ELSE 'tile_' || (vec_id % 6) END AS kind,
          'src' || (vec_id % 3) AS source_dataset,
          ({_E_LIST})[(label % 5) + 1] AS surface_type,
          CAST(label // 2 + 1 AS INTEGER) AS quality,
          CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END AS split,
          CAST(label AS INTEGER) AS label, embedding
        FROM embeddings""",
    "v_tiles": f"""
        SELECT l_orderkey AS frame_index,
          l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS tile_pos,
          'tile_' || l_linenumber AS tile,
          ({_P_LIST})[(l_orderkey % 6) + 1] AS source_path,
          'f' || l_orderkey || '.jpg' AS filename,
          CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS predicted_quality,
          CASE WHEN l_returnflag = 'A' THEN 'asphalt'
               WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'concrete'
               WHEN l_returnflag = 'N' THEN 'unknown'
               WHEN l_linestatus = 'F' THEN 'paving_stones' ELSE 'gravel' END AS surface_type,
          CAST(1.0 AS DOUBLE) - CAST(round(l_discount * 100) AS INTEGER) / 100.0::DOUBLE AS confidence,
          CASE WHEN l_partkey % 11 <> 0 THEN CAST(round(l_tax * 100) AS INTEGER) / 10.0::DOUBLE END AS tile_crack_prob,
          round(l_discount * 100) >= 9 AS non_road,
          {", ".join(f"((l_partkey * {m} + l_suppkey * 3) % 101) / 100.0::DOUBLE AS {label}_prob_raw" for label, m in RAW_MULTIPLIERS.items())}
        FROM lineitem""",
    "v_track": f"""
        SELECT user_id AS session_id, event_id AS point_id,
          epoch_us(ts) // {TIME_SCALE_S * 1000} AS utc_ms,
          CASE WHEN event_id % 101 = 0 THEN 0.0::DOUBLE WHEN event_id % 17 <> 0 THEN 48.0::DOUBLE + (event_id * 7 % 1000) / 100000.0::DOUBLE END AS lat,
          CASE WHEN event_id % 101 = 0 THEN 0.0::DOUBLE WHEN event_id % 17 <> 0 THEN 17.0::DOUBLE + (event_id * 11 % 1000) / 100000.0::DOUBLE END AS lon,
          CASE WHEN event_id % 3 <> 0 THEN 100.0::DOUBLE + (event_id % 50) / 10.0::DOUBLE END AS alt_m,
          CASE WHEN event_id % 5 <> 0 THEN (CAST(round_even(value * 100, 0) AS BIGINT) % 3000) / 100.0::DOUBLE END AS speed_mps,
          CASE WHEN event_id % 7 <> 0 THEN CAST(event_id * 37 % 360 AS DOUBLE) END AS heading_deg
        FROM events""",
    "v_manifest": """
        SELECT doc_id AS row_id, source || '/' || lang || '/' || doc_id AS image_path,
          source AS source_dataset, lang AS domain,
          (['asphalt','concrete','paving_stones','sett','gravel','mud','unpaved'])[(doc_id % 7) + 1] AS surface_type,
          CAST((doc_id // 7) % 5 + 1 AS INTEGER) AS quality,
          CAST(n_chars % 3 = 0 AS INTEGER) AS has_crack,
          CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
          n_chars
        FROM documents""",
    "v_corrections": """
        SELECT doc_id AS row_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(toxic AS INTEGER) END AS has_crack,
          CAST(quality AS INTEGER) AS quality_flag
        FROM labels""",
    "v_edits": """
        SELECT conv_id AS id, turn AS seq, role AS key,
          CASE WHEN length(text) % 4 <> 0 THEN CAST(length(text) % 10 AS VARCHAR) END AS value,
          (conv_id + turn) % 9 = 8 AS revert_all
        FROM conversations""",
}
SQL["v_scores"] = (
    "SELECT image_id, split, source_dataset, surface_type AS domain, "
    + ", ".join(
        f"round_even(1.0 / (1.0 + exp(-6.0 * CAST(embedding[{k + 1}] AS DOUBLE))), 3) AS p_{label}"
        for k, label in enumerate(LABEL_THRESHOLDS)
    )
    + ", "
    + ", ".join(f"CAST((label + {k}) % 5 < 2 AS INTEGER) AS y_{label}" for k, label in enumerate(LABEL_THRESHOLDS))
    + " FROM v_embed"
)


def with_views(query: str, *names: str) -> str:
    """SQL text with the named view definitions in front."""
    wanted = list(names)
    if "v_scores" in wanted and "v_embed" not in wanted:
        wanted.insert(wanted.index("v_scores"), "v_embed")
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    text = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{ctes}, {text[len(start):]}"
    return f"WITH {ctes} {text}"
