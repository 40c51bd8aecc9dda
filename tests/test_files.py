"""File readers and writers on small files, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from kerbline.operators import tracks as T
from kerbline.sinks import exports as X
from kerbline.sources import annotations as AN
from kerbline.sources import manifests as SM
from kerbline.sources import tracks as SRC
from kerbline.streaming import deadreckon as DR


def test_track_json_file(spark, tmp_path):
    frames = [{"utc_ms": 1_700_000_000_000 + i * 1000, "lat": 48.1 + i * 1e-4, "lon": 17.1 + i * 1e-4, "speed": 6, "heading": 45} for i in range(5)]
    (tmp_path / "a.track.json").write_text(json.dumps({"session": {"id": "s"}, "frames": frames, "imu": []}, indent=1))
    r = T.finalize_track(SRC.read_track_json(spark, str(tmp_path)), "track_json_sidecar").orderBy("t").collect()
    assert [x["t"] for x in r] == [0, 1, 2, 3, 4] and r[0]["speed_kmh"] == pytest.approx(21.6) and r[4]["heading_deg"] == 45


def test_gpx_file(spark, tmp_path):
    pts = "".join(f'<trkpt lat="{48 + i}" lon="17"><ele>{i}</ele><time>2024-01-01T00:00:0{i}Z</time></trkpt>' for i in range(3))
    (tmp_path / "a.gpx").write_text(f'<?xml version="1.0"?><gpx><trk><trkseg>\n{pts}\n</trkseg></trk><wpt lat="1" lon="2"></wpt></gpx>')
    r = SRC.read_gpx(spark, str(tmp_path)).orderBy("lat").collect()
    assert [(x["lat"], x["alt_m"]) for x in r] == [(1, None), (48, 0), (49, 1), (50, 2)] and r[2]["utc_ms"] - r[1]["utc_ms"] == 1000


def test_srt_file(spark, tmp_path):
    text = "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n[latitude: {48 + i}.5] [longitude: 17.25] [abs_alt: 12.5]" for i in range(5))
    (tmp_path / "a.srt").write_text("﻿" + text + "\n")
    r = SRC.read_srt(spark, str(tmp_path)).orderBy("t").collect()
    assert [(x["t"], x["lat"], x["alt_m"]) for x in r] == [(float(i), 48.5 + i, 12.5) for i in range(5)]


def test_srt_file_with_other_line_ends(spark, tmp_path):
    blocks = [f"{i}\r\n00:00:0{i},000 --> 00:00:0{i},900\r\n[latitude: {48 + i}.5] [longitude: 17.25]" for i in range(5)]
    (tmp_path / "b.srt").write_bytes((" \r\n".join(b + "\r\n" for b in blocks)).encode())
    r = SRC.read_srt(spark, str(tmp_path)).orderBy("t").collect()
    assert [(x["t"], x["lat"]) for x in r] == [(float(i), 48.5 + i) for i in range(5)]


def test_voc_and_defect_files(spark, tmp_path):
    (tmp_path / "voc").mkdir()
    box = "<bndbox><xmin>1.9</xmin><ymin>2</ymin><xmax>3</xmax></bndbox>"
    (tmp_path / "voc" / "im1.xml").write_text(f"<annotation><object><name>D00</name>{box}</object><object><name>D40</name></object></annotation>")
    r = AN.voc_objects(AN.read_voc(spark, str(tmp_path / "voc"))).collect()
    assert [tuple(x) for x in r] == [("im1", "D00", 1, 2, 3, 0)]
    (tmp_path / "d").mkdir()
    kids = "".join(f"<{t}>{int(t == 'Crack')}</{t}>" for t in AN.DEFECT_TAGS)
    (tmp_path / "d" / "set.xml").write_text(f'<Annotation><Defect name="c1.png">{kids}</Defect></Annotation>')
    rec = AN.defect_records(AN.read_defect_xml(spark, str(tmp_path / "d"))).collect()
    assert [tuple(x) for x in rec] == [("c1.png", "set", ["crack"])]


def test_inventory_and_tile_label_fallback(spark, tmp_path):
    for p in ("a/x.JPG", "b/y.png", "b/z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    assert sorted(r["stem"] for r in SM.inventory(SM.read_inventory(spark, str(tmp_path))).collect()) == ["x", "y"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tile_labels.jsonl").write_text('{"image_path":"i","has_crack":1}\n')
    assert [tuple(r) for r in SM.read_tile_labels(spark, str(tmp_path / "t")).collect()] == [("i", "runway_roboflow", "full", 1)]
    assert SM.read_tile_labels(spark, str(tmp_path / "none")).count() == 0


def test_geojson_document_parses_and_round_trips(spark, tmp_path):
    track = spark.createDataFrame([(1, float(i), 48.0 + i, 17.0 + i, False, "n", "gps") for i in range(3)],
                                  "session_id bigint, t double, lat double, lon double, route_approximate boolean, notice string, telemetry_source string")
    problems = spark.createDataFrame([(1, 5, 1.0, 48.5, 17.5, "crack"), (1, 6, 2.0, None, None, "x")], "session_id bigint, frame_index int, t double, lat double, lon double, issue string")
    lines = X.geojson_lines(track, problems, ["t"], ["frame_index", "issue"])
    out = str(tmp_path / "g")
    X.write_lines(lines, out, "session_id", ["section", "position"])
    parts = sorted((tmp_path / "g" / "session_id=1").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    doc = json.loads(text)
    assert [f["geometry"] and f["geometry"]["type"] for f in doc["features"]] == ["LineString", "Point", None]
    assert doc["features"][0]["geometry"]["coordinates"] == [[17, 48], [18, 49], [19, 50]]
    back = SRC.parse_geojson(spark.createDataFrame([("s", text)], "session_id string, value string")).orderBy("feature", "position").collect()
    assert [(r["lat"], r["lon"]) for r in back] == [(48, 17), (49, 18), (50, 19), (48.5, 17.5)]


def test_dead_reckoning_matches_a_plain_loop(spark):
    rows = [(1, i, i * 0.01, 0.0, 1.0 if 50 < i < 150 else 0.0, 9.80665, 0.0, 0.0, 0.1) for i in range(400)]
    imu = spark.createDataFrame(rows, "session_id bigint, seq bigint, t double, ax double, ay double, az double, gx double, gy double, gz double")
    starts = spark.createDataFrame([(1, 48.0, 17.0, 9.0), (2, 48.0, 17.0, 2.5)], "session_id bigint, lat0 double, lon0 double, duration_s double")
    got = DR.dead_reckon(imu, starts)
    r = got.where("session_id = 1").orderBy("seq").collect()
    assert len(r) == 400 and r[0]["speed_mps"] == 0 and max(x["speed_mps"] for x in r) > 0.5
    assert r[-1]["heading_deg"] == pytest.approx(90 + 0.1 * 3.99 * 180 / 3.141592653589793, abs=1e-6)
    f = got.where("session_id = 2").orderBy("t").collect()
    assert [x["t"] for x in f] == [0, 1, 2, 2.5] and f[0]["telemetry_source"] == DR.FALLBACK_SOURCE


def test_metadata_tuples_are_the_fallback(spark):
    doc = json.dumps({"Track1:GPSCoordinates": ["48.5 17.25 100", "48.6 17.35", "bad"], "Track1:SampleTime": ["0:00:01", "2.5"]})
    r = SRC.parse_metadata_dump(spark.createDataFrame([("s", doc)], "session_id string, value string")).orderBy("point_id").collect()
    assert [(x["lat"], x["lon"], x["alt_m"], x["t"]) for x in r] == [(48.5, 17.25, 100.0, 1.0), (48.6, 17.35, None, 2.5)]


def test_gpx_prefixes_extensions_and_order(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(
        '<g:gpx xmlns:g="x" xmlns:d="y"><g:wpt lon="3" lat="1"/><g:trk><g:trkseg>\n'
        '<g:trkpt lat="10.5" lon="-20.25"><g:ele> 7 </g:ele><g:time>2024-01-01T00:00:01Z</g:time>'
        "<g:extensions><d:Point><d:speed>3.5</d:speed><d:course unit='deg'>90</d:course></d:Point></g:extensions></g:trkpt>\n"
        "</g:trkseg></g:trk><g:rte><g:rtept lat='11' lon='21'></g:rtept><g:rtept lat='x' lon='21'/></g:rte></g:gpx>"
    )
    got = SRC.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("point_id").collect()
    assert [(r["lat"], r["lon"], r["alt_m"], r["speed_mps"], r["heading_deg"]) for r in got] == [
        (1.0, 3.0, None, None, None), (10.5, -20.25, 7.0, 3.5, 90.0), (11.0, 21.0, None, None, None)]
    assert [r["utc_ms"] for r in got] == [None, 1704067201000.0, None]


def _in_ranges(spark, monkeypatch_bytes, read):
    """The result of a reader whose files are cut into ranges of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(monkeypatch_bytes))
    spark.conf.set("kerbline.maxRowsPerTask", "40")
    try:
        df = read()
        return df.rdd.getNumPartitions(), df.orderBy("session_id", "point_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("kerbline.maxRowsPerTask")


def test_gpx_ranges_give_the_points_of_the_whole_file(spark, tmp_path):
    """Elements across cuts, on one line, self-closing, nested, opened and never closed; one file is empty."""
    import re

    points = [f'<{"g:" * (i % 3 == 0)}trkpt lat="{i % 80}.5" lon="{i}.25"><ele>{i}</ele><x><trkpt lat="0" lon="0"/></x></{"g:" * (i % 3 == 0)}trkpt >' if i % 5 else f'<wpt lon="{i}" lat="{i % 80}"/>' for i in range(150)]
    body = "<gpx><trk><trkseg>" + "".join(points) + '</trkseg></trk><trkpt lat="1" lon="1"><ele>1</ele><wpt lat="2" lon="2"/></gpx>'
    (tmp_path / "a.gpx").write_text(body)
    (tmp_path / "b.gpx").write_text('<gpx>\n  <rtept lat="7" lon="8"/>\n</gpx>\n')
    (tmp_path / "c.gpx").write_text("")
    plain = re.findall(SRC.GPX_ELEMENT, re.sub(r"(</?)[\w.-]+:", r"\1", body))
    parts, got = _in_ranges(spark, 300, lambda: SRC.gpx_elements(spark, str(tmp_path)))
    mine = [re.sub(r"(</?)[\w.-]+:", r"\1", r["value"]) for r in got if r["session_id"].endswith("a.gpx")]
    assert mine == plain and len(mine) == 151
    assert [r["point_id"] for r in got if r["session_id"].endswith("a.gpx")] == list(range(151))
    assert [r["value"] for r in got if r["session_id"].endswith("b.gpx")] == ['<rtept lat="7" lon="8"/>']
    rows = SRC.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("point_id").collect()
    assert [(r["lat"], r["lon"]) for r in rows[:3]] == [(0.0, 0.0), (1.5, 1.25), (2.5, 2.25)]


def test_subtitle_ranges_give_the_blocks_of_the_whole_file(spark, tmp_path):
    import re

    blocks = [f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},500\n[latitude: {i % 80}.5] [longitude: {i}.25]" + ("\nmore" if i % 4 else "") for i in range(120)]
    whole = "﻿" + "".join(b + ("\n\n", "\n \t\n", "\n\n\n")[i % 3] for i, b in enumerate(blocks))
    (tmp_path / "a.srt").write_bytes(whole.replace("\n", "\r\n").encode())
    _, got = _in_ranges(spark, 256, lambda: SRC.srt_blocks(spark, str(tmp_path)))
    assert [r["value"] for r in got] == [b.strip("\n") for b in re.split(r"\n[ \t]*\n", whole[1:]) if b.strip()]
    assert SRC.read_srt(spark, str(tmp_path)).count() == 120


def patterns(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def test_texts_are_parsed_once(spark):
    """A filter on parsed values used to be worked out from copies of the patterns."""
    rows = spark.createDataFrame([("a", 1, '<trkpt lat="1" lon="2"><time>2024-01-01T00:00:00Z</time></trkpt>')], "session_id string, point_id long, value string")
    gpx = SRC.parse_gpx_elements(rows)
    assert patterns(gpx, "regexp_extract") == len(SRC.GPX_ATTRIBUTES) + len(SRC.GPX_VALUES) + 1
    assert [(r["lat"], r["lon"], r["utc_ms"]) for r in gpx.collect()] == [(1.0, 2.0, 1704067200000.0)]
    dump = SRC.parse_metadata_dump(rows.withColumn("value", F.lit('{"A:GPSLatitude":[1,2],"A:GPSLongitude":"3"}')))
    assert patterns(dump, "from_json") <= 2 and [(r["lat"], r["lon"]) for r in dump.collect()] == [(1.0, 3.0)]
    srt = SRC.parse_srt_blocks(rows.withColumn("value", F.lit("00:00:01,000 --> 00:00:02,000\nlat: 1.5 lon: 2.5")))
    assert patterns(srt, "regexp_extract_all") <= 3 and [(r["lat"], r["t"]) for r in srt.collect()] == [(1.5, 1.0)]


def test_gpx_text_passes_one_scan(spark, tmp_path):
    """Text between the marks of an element used to pass four scans."""
    (tmp_path / "a.gpx").write_text('<gpx><trkpt lat="1" lon="2"><ele>3</ele></trkpt></gpx>')
    plan = SRC.gpx_elements(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Union", 1)
    assert above.count("Window [") == 1 and below.count("Window [") >= 3


def test_collections_of_many_sessions_need_few_files(spark, tmp_path):
    """Each session used to be a folder of its own."""
    lines = spark.range(6_000).selectExpr("id % 2000 AS session_id", "id % 3 AS section", "id AS position", "concat(id % 3, ',', id, ';') AS text")
    X.write_line_table(lines, str(tmp_path / "t"), "session_id", ["section", "position"])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) < 20
    found = {r["session_id"]: r["value"] for r in SRC.read_line_table(spark, str(tmp_path / "t"), "session_id").collect()}
    want: dict = {}
    for section, i in sorted((i % 3, i) for i in range(6_000)):
        want[i % 2000] = want.get(i % 2000, "") + f"{section},{i};"
    assert found == want
