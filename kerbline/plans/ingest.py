"""Queries for track formats, lenient parsing, streams and dead reckoning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import casts as C
from kerbline.plans import frames as FR
from kerbline.plans import tracks as TR
from kerbline.plans import views
from kerbline.plans.registry import query
from kerbline.session import work_path
from kerbline.sources import tracks as SRC
from kerbline.streaming import autopause as AP
from kerbline.streaming import deadreckon as DR
from kerbline.streaming import survey as SV

# --- documents derived from the track table: at most 500 consecutive points each ------------------

BLOCK = 500


def blocks(spark: SparkSession, sf_dir: str, entry) -> DataFrame:
    """(session_id as text, list of `entry` in point order): bounded by the block of point ids."""
    v = views.v_track(spark, sf_dir)
    key = F.concat_ws("/", F.col("session_id").cast("string"), F.floor(F.col("point_id") / BLOCK).cast("string"))
    g = v.groupBy(key.alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("point_id", entry.alias("e")))).alias("_l"))
    return g.select("session_id", F.transform("_l", lambda x: x["e"]).alias("items"))


def text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


@query("S9_track_json", f"""
    WITH k AS (SELECT session_id || '/' || (point_id // {BLOCK}) AS sid, *, row_number() OVER (PARTITION BY session_id, point_id // {BLOCK} ORDER BY point_id) - 1 AS pos FROM v_track)
    SELECT sid AS session_id, pos AS point_id, CAST(utc_ms AS DOUBLE) AS utc_ms, lat, CASE WHEN point_id % 6 = 5 THEN NULL ELSE alt_m END AS alt_m,
      round(CASE WHEN point_id % 2 = 0 THEN speed_mps ELSE point_id % 90 / 3.6::DOUBLE END, 6) AS speed_mps FROM k WHERE lat IS NOT NULL AND point_id % 8 <> 7""", ("v_track",))
def s9(spark, sf_dir):
    i = F.col("point_id")
    kv = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    # Keys alternate; a present null lat hides the latitude next to it; a null altitude hides `alt_m`.
    lat = F.when(i % 8 == 7, F.concat(F.lit('"lat":null,'), kv("latitude", text("lat")))).when(i % 3 == 0, kv("latitude", text("lat"))).otherwise(kv("lat", text("lat")))
    alt = F.when(i % 6 == 5, F.concat(F.lit('"alt":null,'), kv("alt_m", text("alt_m")))).otherwise(kv("altitude", text("alt_m")))
    speed = F.when(i % 2 == 0, kv("speed", text("speed_mps"))).otherwise(kv("speed_kmh", (i % 90).cast("string")))
    one = F.concat(F.lit("{"), F.concat_ws(",", kv("timestamp_ms", text("utc_ms")), lat, kv("lng", text("lon")), alt, speed), F.lit("}"))
    b = blocks(spark, sf_dir, one)
    listed = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    doc = F.when(F.crc32("session_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"frames":'), listed, F.lit("}")))
    out = SRC.parse_track_json(b.select("session_id", doc.alias("value")))
    return out.select("session_id", "point_id", "utc_ms", "lat", "alt_m", F.round("speed_mps", 6).alias("speed_mps"))


def stamp(ms):
    """UTC wall clock of an epoch, whatever the session zone."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def gpx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.v_track(spark, sf_dir)
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f"<{n}>"), F.col(c).cast("string"), F.lit(f"</{n}>")), F.lit(""))
    zone = F.when(F.col("point_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("+00:00"))
    xml = F.concat(F.lit('<trkpt lat="'), F.coalesce(F.col("lat").cast("string"), F.lit("")), F.lit('" lon="'), F.coalesce(F.col("lon").cast("string"), F.lit("")), F.lit('">'),
                   tag("ele", "alt_m"), F.lit("<time>"), stamp(F.col("utc_ms")), zone, F.lit("</time>"), tag("course", "heading_deg"), F.lit("</trkpt>"))
    return v.select("session_id", "point_id", xml.alias("value"))


@query("S10_gpx_points", """SELECT point_id, CAST(utc_ms AS DOUBLE) AS utc_ms, lat, lon, alt_m, heading_deg FROM v_track WHERE lat IS NOT NULL""", ("v_track",))
def s10(spark, sf_dir):
    return SRC.parse_gpx_elements(gpx_text(spark, sf_dir)).select("point_id", "utc_ms", "lat", "lon", "alt_m", "heading_deg")


@query("S10_gpx_files", """SELECT CAST(utc_ms AS DOUBLE) AS utc_ms, lat, lon, alt_m, heading_deg FROM v_track WHERE lat IS NOT NULL""", ("v_track",))
def s10_files(spark, sf_dir):
    """All points written as text, each inside a segment of its own, and read back in byte ranges."""
    path = work_path(spark, "gpx")
    gpx_text(spark, sf_dir).select(F.concat(F.lit("<trk><trkseg>\n"), "value", F.lit("\n</trkseg></trk>"))).write.text(path)
    return SRC.read_gpx(spark, path).select("utc_ms", "lat", "lon", "alt_m", "heading_deg")


def subtitle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even blocks carry labelled values, odd ones a GPS(lat, lon) pair; every ninth has no clock line."""
    v = views.v_track(spark, sf_dir)
    i, ms = F.col("point_id"), F.col("utc_ms") % 86_400_000
    clock = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    labelled = F.concat(F.lit("[latitude: "), text("lat"), F.lit("] [Longitude : "), text("lon"), F.lit("] [abs_alt: "), text("alt_m"), F.lit("] speed="), text("speed_mps"))
    paired = F.concat(F.lit("GPS: ("), text("lat"), F.lit(", "), text("lon"), F.lit(")"))
    exif = F.regexp_replace(stamp(F.col("utc_ms")), r"^(\d+)-(\d+)-(\d+)T", "$1:$2:$3 ")
    body = F.concat_ws("\n", F.when(i % 2 == 0, labelled).otherwise(paired), exif)
    return v.select("session_id", "point_id", F.concat_ws("\n", (i + 1).cast("string"), F.when(i % 9 != 8, F.concat(clock, F.lit(" --> "), clock)), body).alias("value"))


@query("S11_subtitle_blocks", """SELECT point_id, CAST(utc_ms AS DOUBLE) AS utc_ms, round((utc_ms % 86400000) / 1000.0::DOUBLE, 3) AS t, lat, lon, CASE WHEN point_id % 2 = 0 THEN alt_m END AS alt_m,
    CASE WHEN point_id % 2 = 0 THEN speed_mps END AS speed_mps FROM v_track WHERE lat IS NOT NULL AND point_id % 9 <> 8""", ("v_track",))
def s11(spark, sf_dir):
    out = SRC.parse_srt_blocks(subtitle_text(spark, sf_dir))
    return out.select("point_id", "utc_ms", F.round("t", 3).alias("t"), "lat", "lon", "alt_m", "speed_mps")


@query("S11_subtitle_files", """SELECT CAST(utc_ms AS DOUBLE) AS utc_ms, round((utc_ms % 86400000) / 1000.0::DOUBLE, 3) AS t, lat, lon, CASE WHEN point_id % 2 = 0 THEN alt_m END AS alt_m,
    CASE WHEN point_id % 2 = 0 THEN speed_mps END AS speed_mps FROM v_track WHERE lat IS NOT NULL AND point_id % 9 <> 8""", ("v_track",))
def s11_files(spark, sf_dir):
    path = work_path(spark, "subtitles")
    subtitle_text(spark, sf_dir).select(F.concat("value", F.lit("\n"))).write.text(path)
    return SRC.read_srt(spark, path).select("utc_ms", F.round("t", 3).alias("t"), "lat", "lon", "alt_m", "speed_mps")


@query("S12_metadata_arrays", f"""
    WITH k AS (SELECT session_id || '/' || (point_id // {BLOCK}) AS sid, *, row_number() OVER (PARTITION BY session_id, point_id // {BLOCK} ORDER BY point_id) - 1 AS pos FROM v_track)
    SELECT sid AS session_id, pos AS point_id, lat, lon, heading_deg, round((point_id % 5000) / 10.0::DOUBLE, 3) AS t FROM k WHERE lat IS NOT NULL""", ("v_track",))
def s12(spark, sf_dir):
    item = F.struct("lat", "lon", "heading_deg", (F.col("point_id") % 5000 / 10.0).alias("t"))
    b = blocks(spark, sf_dir, item)
    col = lambda c: F.array_join(F.transform("items", lambda x: F.coalesce(x[c].cast("string"), F.lit("null"))), ",")
    # The plain group comes first in the dump but the preferred one is used first; speeds are absent.
    doc = F.concat(F.lit('{"GoPro:GPSLatitude":['), col("lat"), F.lit('],"GoPro:GPSLongitude":['), col("lon"), F.lit('],"GoPro:GPS-Heading":['), col("heading_deg"),
                   F.lit('],"Track1:SampleTime":['), col("t"), F.lit("]}"))
    out = SRC.parse_metadata_dump(b.select("session_id", doc.alias("value")), prefer_gpmf=True)
    return out.select("session_id", "point_id", "lat", "lon", "heading_deg", F.round("t", 3).alias("t"))


@query("S14_geojson_points", f"""
    WITH k AS (SELECT session_id || '/' || (point_id // {BLOCK}) AS sid, *, row_number() OVER (PARTITION BY session_id, point_id // {BLOCK} ORDER BY point_id) - 1 AS pos FROM v_track WHERE lat IS NOT NULL)
    SELECT sid AS session_id, 0 AS feature, CAST(pos AS INTEGER) AS position, lat, lon FROM k
    UNION ALL SELECT sid, 1, 0, lat, lon FROM k WHERE pos = 0""", ("v_track",))
def s14(spark, sf_dir):
    pair = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    v = views.v_track(spark, sf_dir).where("lat IS NOT NULL")
    key = F.concat_ws("/", F.col("session_id").cast("string"), F.floor(F.col("point_id") / BLOCK).cast("string"))
    g = v.groupBy(key.alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("point_id", pair.alias("e")))).alias("_l"))
    points = F.transform("_l", lambda x: x["e"])
    doc = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":['), F.array_join(points, ","),
                   F.lit(']}},{"type":"Feature","geometry":{"type":"Point","coordinates":'), points[0], F.lit("}}]}"))
    return SRC.parse_geojson(g.select("session_id", doc.alias("value"))).select("session_id", "feature", "position", "lat", "lon")


# --- lenient parsing -------------------------------------------------------------------------------------

@query("P17_lenient_casts", """
    WITH e AS (SELECT event_id, (['1','true','YES','off','no','0','on',NULL])[(event_id % 8) + 1] AS flag, (['12.5','NaN','inf','x','-3',NULL,'1e3'])[(event_id % 7) + 1] AS num FROM events)
    SELECT event_id, coalesce(lower(flag) IN ('1','true','yes','on'), false) AS truthy, coalesce(lower(flag) NOT IN ('0','false','no','off'), true) AS gating,
      CASE num WHEN '12.5' THEN 12.5 WHEN '-3' THEN -3.0 WHEN '1e3' THEN 1000.0 END::DOUBLE AS number, CASE WHEN num = '-3' THEN -3 END::BIGINT AS whole, CAST(event_id % 3 AS INTEGER) AS items FROM e""")
def p17(spark, sf_dir):
    i = F.col("event_id")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("1", "true", "YES", "off", "no", "0", "on", None)]), (i % 8 + 1).cast("int"))
    num = F.element_at(F.array(*[F.lit(x) for x in ("12.5", "NaN", "inf", "x", "-3", None, "1e3")]), (i % 7 + 1).cast("int"))
    doc = F.when(i % 3 == 0, F.lit("not json")).when(i % 3 == 1, F.lit('["a"]')).otherwise(F.lit('["a","b"]'))
    ev = views.table(spark, sf_dir, "events").select("event_id", flag.alias("flag"), num.alias("num"), doc.alias("doc"))
    return ev.select("event_id", C.truthy(F.col("flag")).alias("truthy"), C.gating_enabled(F.col("flag")).alias("gating"), C.finite(F.col("num")).alias("number"),
                     C.whole(F.when(F.col("num") == "-3", F.col("num"))).alias("whole"), F.size(C.json_list(F.col("doc"))).alias("items"))


@query("P21_source_status", f"""
    WITH s AS (SELECT user_id AS recording, (['sidecar','embedded_video','imu_deadreckon','none'])[(user_id % 4) + 1] AS kind, CASE WHEN user_id % 3 <> 0 THEN 'gpx' END AS parser, user_id % 8 = 3 AS has_start, count(*) AS n FROM events GROUP BY 1)
    SELECT recording, kind IN ('sidecar','embedded_video') AS parsed, CASE WHEN kind IN ('sidecar','embedded_video') THEN coalesce(parser, kind) ELSE 'no_gps' END AS status, CASE WHEN kind IN ('sidecar','embedded_video') THEN n ELSE 0 END AS sample_count,
      CASE WHEN kind = 'imu_deadreckon' THEN '{vocab.IMU_ROUTE_NOTICE}' WHEN kind = 'none' AND has_start THEN 'No timed GPS track was found; map shows only the single start point.' WHEN kind = 'none' THEN 'No GPS track was found; map route is omitted.'
        WHEN kind = 'sidecar' THEN 'GPS route from sidecar (' || coalesce(parser, 'sidecar') || ').' ELSE 'GPS route from embedded timed metadata (' || coalesce(parser, 'embedded') || ').' END AS notice,
      CASE kind WHEN 'imu_deadreckon' THEN 'est. (IMU, unreliable)' WHEN 'none' THEN '(no GPS)' ELSE '(GPS)' END AS speed_label FROM s""")
def p21(spark, sf_dir):
    u = F.col("recording")
    s = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("recording")).agg(F.count(F.lit(1)).alias("n"))
    s = s.select("recording", "n", views._pick(u % 4, ["sidecar", "embedded_video", "imu_deadreckon", "none"]).alias("kind"), F.when(u % 3 != 0, F.lit("gpx")).alias("parser"), (u % 8 == 3).alias("has_start"))
    status = C.source_status(F.col("kind"), F.col("parser"), F.lit("none found"), F.col("n"))
    return s.select("recording", status["parsed"].alias("parsed"), status["status"].alias("status"), status["sample_count"].alias("sample_count"),
                    C.route_notice(F.col("kind"), F.col("parser"), F.col("has_start"), vocab.IMU_ROUTE_NOTICE).alias("notice"), C.speed_label(F.col("kind")).alias("speed_label"))


@query("P22_coordinate_text", """SELECT point_id, CASE WHEN lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon, CASE WHEN point_id % 3 = 0 AND lat IS NOT NULL AND lon IS NOT NULL THEN alt_m END AS alt_m FROM v_track""", ("v_track",))
def p22(spark, sf_dir):
    i = F.col("point_id")
    v = views.v_track(spark, sf_dir)
    signed = lambda c: F.concat(F.when(F.col(c) < 0, "").otherwise("+"), F.col(c).cast("string"))
    alt = F.coalesce(signed("alt_m"), F.lit(""))
    iso = F.concat(signed("lat"), signed("lon"), F.when(i % 3 == 0, alt).otherwise(""), F.lit("/"))
    loose = F.concat(F.lit("at "), F.col("lat").cast("string"), F.lit(" , "), F.col("lon").cast("string"), F.when(i % 3 == 0, F.coalesce(F.concat(F.lit(" "), F.col("alt_m").cast("string")), F.lit(""))).otherwise(""))
    c = C.coordinate_triple(F.when(i % 2 == 0, iso).otherwise(loose))
    return v.select("point_id", c["lat"].alias("lat"), c["lon"].alias("lon"), c["alt"].alias("alt_m"))


@query("P23_dms_to_degrees", """SELECT event_id, round((CASE WHEN event_id % 4 < 2 THEN 1 ELSE -1 END) * (event_id % 90 + (event_id % 60) / 60.0 + (event_id % 37) / 3600.0), 9) AS degrees FROM events WHERE event_id % 5 <> 0
    UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0""")
def p23(spark, sf_dir):
    i = F.col("event_id")
    parts = F.when(i % 5 != 0, F.array((i % 90).cast("double"), (i % 60).cast("double"), (i % 37).cast("double")))
    ref = views._pick(i % 4, ["N", "e", "s", "W"])
    return views.table(spark, sf_dir, "events").select("event_id", F.round(C.dms_to_degrees(parts, ref), 9).alias("degrees"))


DELAY = "2 days"
LATE_MS = 10 * 86_400_000  # delay of the stream that gets late rows

# --- streams ------------------------------------------------------------------------------------------------

def drained(stream: DataFrame, spark: SparkSession, schema: str, *later: Callable[[], None]) -> tuple[DataFrame, int]:
    """Runs the stream over all available files into Parquet, again after each of `later` has brought more; the result table and the number of late rows."""
    out, ckpt = work_path(spark, "stream-out"), work_path(spark, "stream-ckpt")
    dropped = 0
    for bring in (None, *later):
        if bring:
            bring()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += AP.late_rows(q)
    return spark.read.schema(schema).parquet(out), dropped


def far_row(df: DataFrame) -> DataFrame:
    """A row of no session, far ahead, that moves the watermark past everything."""
    return df.agg((F.max("utc_ms") + 10**12).alias("utc_ms")).select(*[
        (F.col(f.name) if f.name == "utc_ms" else F.lit(-1).cast(f.dataType) if f.name == "session_id" else F.lit(0 if f.name == "seq" else None).cast(f.dataType)).alias(f.name) for f in df.schema])


def replayed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The table as a stream, with the far row at last."""
    path = work_path(spark, "stream-in")
    SV.replay(df, path, "utc_ms", "session_id")
    far_row(df).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


@query("X1_variance_stream", f"WITH {TR.SQL_IMU} SELECT session_id, seq, round(variance, 7) AS variance, enough FROM var", ("v_track",))
def x1(spark, sf_dir):
    stream = replayed(spark, TR.imu(spark, sf_dir).drop("pts_ms"))
    out, _ = drained(AP.variance_stream(stream, TR.MOTION, DELAY, 10**9), spark, AP.VARIANCE_SCHEMA)
    return out.select("session_id", "seq", F.round("variance", 7).alias("variance"), "enough")


@query("X1_late_rows", f"""WITH s AS (SELECT * FROM v_track WHERE point_id % 4 <> 3), e AS (SELECT max(utc_ms) - {LATE_MS} AS seen FROM s)
    SELECT 'dropped as late' AS rows, count(*) FILTER (utc_ms <= seen) AS n FROM s, e UNION ALL SELECT 'handled', count(*) + count(*) FILTER (utc_ms > seen) FROM s, e""", ("v_track",))
def x1_late(spark, sf_dir):
    """All samples come once more after the stream has seen them; only those within the delay of the newest are still taken."""
    imu = TR.imu(spark, sf_dir).drop("pts_ms")
    late = imu.withColumn("seq", F.col("seq") + 1_000_000_000)
    path = work_path(spark, "stream-in")
    imu.write.parquet(path)
    stream = AP.variance_stream(spark.readStream.schema(imu.schema).parquet(path), TR.MOTION, f"{LATE_MS} milliseconds", 10**9)
    # A run takes all its files at once, and the next one begins behind its watermark.
    more = [lambda df=df: df.write.mode("append").parquet(path) for df in (late, far_row(imu))]
    out, dropped = drained(stream, spark, AP.VARIANCE_SCHEMA, *more)
    return out.agg(F.lit("dropped as late").alias("rows"), F.lit(dropped).cast("bigint").alias("n")).unionAll(out.agg(F.lit("handled"), F.count(F.lit(1))))


@query("X2_auto_pause_stream", f"WITH {TR.SQL_PAUSE} SELECT session_id, seq, kind, stationary, paused, segment FROM paused", ("v_track",))
def x2_stream(spark, sf_dir):
    none = F.lit(None).cast("double")
    m = TR.imu(spark, sf_dir).select("session_id", "utc_ms", "seq", F.lit("imu").alias("kind"), "ax", "ay", "az", none.alias("speed_mps"))
    g = TR.gps(spark, sf_dir).select("session_id", "utc_ms", "seq", F.lit("gps").alias("kind"), none.alias("ax"), none.alias("ay"), none.alias("az"), "speed_mps")
    out, _ = drained(AP.pause_stream(replayed(spark, m.unionByName(g)), TR.MOTION, DELAY, 10**9), spark, AP.PAUSE_SCHEMA)
    return out.select("session_id", "seq", "kind", "stationary", "paused", "segment")


@query("X4_survey_stream", f"""WITH {FR.SQL_CONFIRMED} SELECT 'samples' AS sink, frame_index, issues FROM flagged UNION ALL SELECT 'problems', frame_index, issues FROM flagged WHERE issues <> ''""", ("v_tiles",))
def x4(spark, sf_dir):
    f = FR.frames(spark, sf_dir).withColumn("quality_grade", F.col("predicted_quality")).join(FR.geometry(spark, sf_dir), "frame_index", "left")
    f = f.select("frame_index", "max_crack_prob", "seg_area_pct", "seg_component_px", "structural_defects", "quality_grade", F.concat(F.lit("asset_"), F.col("frame_index").cast("string")).alias("asset"))
    path, out, ckpt = (work_path(spark, n) for n in ("survey-in", "survey-out", "survey-ckpt"))
    f.write.parquet(path)
    SV.start_survey(SV.read_frames(spark, path, f.schema), out, ckpt, heavy=["asset"]).awaitTermination()
    cols = [F.lit("samples").alias("sink"), "frame_index", F.concat_ws(",", "issues").alias("issues")]
    return spark.read.parquet(f"{out}/samples").select(*cols).unionByName(spark.read.parquet(f"{out}/problems").select(F.lit("problems").alias("sink"), *cols[1:]))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-axis samples at about 10 Hz of a compressed clock: rest, then push, turn and rest again."""
    v = views.v_track(spark, sf_dir)
    i = F.col("point_id")
    phase = F.floor(F.col("utc_ms") % 72_000 / 12_000)
    push = F.when(phase % 3 == 1, 1.5).when(phase % 3 == 2, -0.8).otherwise(0.0)
    return v.select("session_id", i.alias("seq"), (F.col("utc_ms") % 72_000 / 10_000.0).alias("t"), (push * 0.2 + (i % 5 - 2) / 200.0).alias("ax"), (push + (i % 7 - 3) / 200.0).alias("ay"),
                    (9.81 + (i % 3 - 1) / 200.0).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.when(phase % 3 == 2, 0.3).otherwise(0.001).alias("gz"))


SQL_RECKONED = f"""WITH RECURSIVE motion AS (
      SELECT session_id, point_id AS seq, (utc_ms % 72000) / 10000.0::DOUBLE AS t, CAST(floor((utc_ms % 72000) / 12000.0::DOUBLE) AS BIGINT) % 3 AS phase, point_id AS i FROM v_track
    ), ranged AS (
      SELECT session_id, seq, t, CASE phase WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN -0.8::DOUBLE ELSE 0.0::DOUBLE END * 0.2::DOUBLE + (i % 5 - 2) / 200.0::DOUBLE AS ax,
        CASE phase WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN -0.8::DOUBLE ELSE 0.0::DOUBLE END + (i % 7 - 3) / 200.0::DOUBLE AS ay, 9.81::DOUBLE + (i % 3 - 1) / 200.0::DOUBLE AS az,
        CASE WHEN phase = 2 THEN 0.3::DOUBLE ELSE 0.001::DOUBLE END AS gz
      FROM motion WHERE t <= CASE WHEN session_id % 10 = 0 THEN 0.0 ELSE 7.0 END
    ), s AS (
      SELECT *, row_number() OVER w AS rn, lag(t) OVER w AS pt, count(*) OVER (PARTITION BY session_id) AS n, least(3.0::DOUBLE, greatest(0.1::DOUBLE, max(t) OVER (PARTITION BY session_id))) AS lim
      FROM ranged WINDOW w AS (PARTITION BY session_id ORDER BY t, seq) QUALIFY n >= 2
    ), opening AS (
      SELECT * FROM (SELECT *, bool_or(t <= lim) OVER (PARTITION BY session_id) AS rested FROM s) WHERE CASE WHEN rested THEN t <= lim ELSE rn <= 240 END
    ), med AS (
      SELECT session_id, mx, my, sqrt(mx * mx + my * my + mz * mz) AS len FROM (
        SELECT session_id, quantile_cont(ax, 0.5) AS mx, quantile_cont(ay, 0.5) AS my, quantile_cont(az, 0.5) AS mz FROM opening GROUP BY 1)
    ), rate AS (
      SELECT session_id, 1.0::DOUBLE / greatest(coalesce(1.0::DOUBLE / quantile_cont(t - pt, 0.5) FILTER (t > pt), 120.0::DOUBLE), 1.0::DOUBLE) AS dt0 FROM s GROUP BY 1
    ), p AS (
      SELECT session_id, seq, t, rn, CASE WHEN t - pt > 0 AND t - pt <= 0.2 THEN t - pt ELSE dt0 END AS dt, gz,
        ay - CASE WHEN len < 1e-6 THEN 0.0::DOUBLE ELSE my / len * {vocab.GRAVITY_MPS2}::DOUBLE END AS lr, ax - CASE WHEN len < 1e-6 THEN 0.0::DOUBLE ELSE mx / len * {vocab.GRAVITY_MPS2}::DOUBLE END AS li,
        abs(sqrt(ax * ax + ay * ay + az * az) - {vocab.GRAVITY_MPS2}::DOUBLE) < 0.25 AND abs(gz) < 0.035 AS still
      FROM s JOIN med USING (session_id) JOIN rate USING (session_id)
    ), q AS (
      SELECT *, radians(90.0::DOUBLE) + sum(CASE WHEN rn > 1 THEN gz * dt ELSE 0.0::DOUBLE END) OVER (PARTITION BY session_id ORDER BY rn) AS yaw FROM p
    ), route AS (
      SELECT session_id, rn, 0.0::DOUBLE AS pr, 0.0::DOUBLE AS pi, 0.0::DOUBLE AS vr, 0.0::DOUBLE AS vi, 0.0::DOUBLE AS east, 0.0::DOUBLE AS north FROM q WHERE rn = 1
      UNION ALL
      SELECT session_id, rn, pr, pi, ur * k, ui * k, east + ur * k * dt, north + ui * k * dt FROM (
        SELECT *, CASE WHEN still AND size < 0.15 THEN 0.0::DOUBLE WHEN NOT still AND size > 35.0 THEN 35.0::DOUBLE / size ELSE 1.0::DOUBLE END AS k FROM (
          SELECT *, sqrt(ur * ur + ui * ui) AS size FROM (
            SELECT *, CASE WHEN still THEN vr * 0.5::DOUBLE ELSE (vr + (pr * cos(yaw) - pi * sin(yaw)) * dt) * 0.999::DOUBLE END AS ur,
              CASE WHEN still THEN vi * 0.5::DOUBLE ELSE (vi + (pr * sin(yaw) + pi * cos(yaw)) * dt) * 0.999::DOUBLE END AS ui FROM (
              SELECT q.session_id, q.rn, 0.9::DOUBLE * r.pr + (1.0::DOUBLE - 0.9::DOUBLE) * q.lr AS pr, 0.9::DOUBLE * r.pi + (1.0::DOUBLE - 0.9::DOUBLE) * q.li AS pi,
                r.vr, r.vi, r.east, r.north, q.yaw, q.dt, q.still FROM route AS r JOIN q ON q.session_id = r.session_id AND q.rn = r.rn + 1))))
    ), placed AS (
      SELECT session_id, seq, t, east, north, sqrt(vr * vr + vi * vi) AS speed_mps, CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE degrees(yaw) - 360 * floor(degrees(yaw) / 360) END AS heading_deg, '{DR.IMU_SOURCE}' AS telemetry_source
      FROM route JOIN q USING (session_id, rn)
      UNION ALL
      SELECT session_id, unnest([0, 1, 2, 3, 4, 5, 6, 7][: CASE WHEN session_id % 10 = 0 THEN 1 ELSE 8 END])::BIGINT AS k, k::DOUBLE, 8.0::DOUBLE * k, 0.0::DOUBLE, 8.0::DOUBLE, 90.0::DOUBLE, '{DR.FALLBACK_SOURCE}'
      FROM (SELECT DISTINCT session_id FROM v_track) WHERE session_id NOT IN (SELECT session_id FROM s)
    )
    SELECT session_id, seq, t, round(48.0 + north / {vocab.EARTH_RADIUS_TRACK_M}::DOUBLE * (180 / pi()), 7) AS lat, round(17.0 + east / ({vocab.EARTH_RADIUS_TRACK_M}::DOUBLE * cos(radians(48.0))) * (180 / pi()), 7) AS lon,
      round(speed_mps, 6) AS speed_mps, round(heading_deg, 6) AS heading_deg, telemetry_source FROM placed"""


@query("X5_dead_reckoning", SQL_RECKONED, ("v_track",))
def x5(spark, sf_dir):
    m = motion(spark, sf_dir)
    starts = m.select("session_id").distinct().select("session_id", F.lit(48.0).alias("lat0"), F.lit(17.0).alias("lon0"), F.when(F.col("session_id") % 10 == 0, 0.0).otherwise(7.0).alias("duration_s"))
    route = DR.dead_reckon(m, starts)
    return route.select("session_id", "seq", "t", *[F.round(c, d).alias(c) for c, d in (("lat", 7), ("lon", 7), ("speed_mps", 6), ("heading_deg", 6))], "telemetry_source")


@query("X5_fallback_route", f"""WITH d AS (SELECT session_id, (max(utc_ms) - min(utc_ms)) / 8000.0::DOUBLE AS d FROM v_track GROUP BY 1),
    g AS (SELECT session_id, d, CAST(unnest(generate_series(0, CAST(floor(d + 1e-6) AS BIGINT))) AS DOUBLE) AS t FROM d), a AS (SELECT session_id, t FROM g UNION ALL SELECT session_id, d FROM d WHERE floor(d + 1e-6) < d)
    SELECT session_id, t, 48.0::DOUBLE AS lat, round(17.0 + 8.0 * t / ({vocab.EARTH_RADIUS_TRACK_M}::DOUBLE * cos(radians(48.0))) * (180 / pi()), 9) AS lon, 8.0::DOUBLE AS speed_mps FROM a""", ("v_track",))
def x5_fallback(spark, sf_dir):
    d = views.v_track(spark, sf_dir).groupBy("session_id").agg(((F.max("utc_ms") - F.min("utc_ms")) / 8000.0).alias("duration_s"))
    out = DR.fallback_route(d.withColumn("lat0", F.lit(48.0)).withColumn("lon0", F.lit(17.0)), "no usable motion samples")
    return out.select("session_id", "t", "lat", F.round("lon", 9).alias("lon"), "speed_mps")
