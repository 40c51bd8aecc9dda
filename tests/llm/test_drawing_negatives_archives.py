"""Drawing to a target, hard negatives and archives against plain computations over awkward rows."""

import gzip
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import archives, drawing, negatives

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdeÉß9"), RNG.integers(1, 6))) for _ in range(60)]


# --- drawing -------------------------------------------------------------------------------------


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


DRAW = [(i, prose(int(RNG.integers(0, 60)))) for i in range(300)] + [
    (300, None), (301, ""), (302, "  \x00\t!! "), (303, prose(20_000)), (304, "Él".upper() + "-A1_b\nÇ" * 30), (None, prose(30)), (None, prose(40)), (7, prose(50)), (7, DRAW0 := prose(50)), (7, DRAW0), (8, DRAW0),
]
TARGET = [prose(25), "a b c", None, ""]


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, longest):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_draw(rows, target, longest, buckets, least, percent, seed):
    held = [Counter(zlib.crc32(f.encode()) % buckets for t in side for f in plain_features(t, longest)) for side in ([t for _, t in rows], target)]
    s, t = (sum(h.values()) for h in held)
    gain = [math.floor(1000 * math.log((held[1][b] + 1) * (s + buckets) / ((held[0][b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        f = plain_features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        w = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        out.append([key, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text)) >= least])
    entitled = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(entitled[: percent * len(entitled) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(DRAW)], "frame_index long, rationale string, id int, score string").repartition(5)


@pytest.fixture(scope="module")
def wanted(spark):
    return spark.createDataFrame([(t,) for t in TARGET], "rationale string")


@pytest.mark.parametrize("longest,buckets,percent,sketch,chunk", [(1, 10_000, 10, 2_000, 4_096), (3, 500, 35, 10, 16), (1, 7, 100, 5, 16), (2, 50, 50, 3, 4_096)])
def test_drawn_assessments(texts, wanted, monkeypatch, longest, buckets, percent, sketch, chunk):
    monkeypatch.setattr(drawing, "CHUNK_ROWS", chunk)
    got = drawing.draw_rationales(texts, wanted, longest=longest, buckets=buckets, percent=percent, seed=5, sketch=sketch)
    assert got.columns == ["frame_index", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_draw(DRAW, TARGET, longest, buckets, 20, percent, 5)))


def test_a_bracket_that_misses_is_widened(spark):
    """Half the rows share one score, so that any sketch is off; the cutoff is the same for every width."""
    scored = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 10).otherwise(F.col("id")).cast("long").alias("score"))
    order = sorted(((r["id"], r["score"]) for r in scored.collect()), key=lambda r: (-r[1], r[0]))
    for place in (1, 2, 499, 500, 501, 750, 999, 1000):
        for sketch in (2, 50, 2_000):
            row = drawing.cutoff(scored, place, 1000, sketch)
            assert (row["id"], -row["less"]) == order[place - 1]


def test_nothing_to_draw(texts, wanted):
    empty = drawing.draw_rationales(texts.filter("false"), wanted)
    assert empty.collect() == []
    few = drawing.draw_rationales(texts.filter("frame_index BETWEEN 300 AND 302"), wanted.filter("false"))
    assert [(r["weight"], r["n_features"], r["rank"]) for r in few.collect()] == [(0, 0, None)] * 3


# --- hard negatives ------------------------------------------------------------------------------


def test_residues_give_exact_products():
    for dims, size in ((1, 2), (64, 300), (64, 1 << 20), (3000, 1 << 15), (5000, 3)):
        a, b = RNG.integers(-size, size + 1, (5, dims)), RNG.integers(-size, size + 1, (7, dims))
        bound = max((a * a).sum(1).max(), (b * b).sum(1).max())
        primes = negatives.moduli(dims, int(bound))
        assert (negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes) == a @ b.T).all()
        top = max(primes) // 2
        assert top * top * min(dims, negatives.WIDTH) <= 1 << 24 and math.prod(primes) > 2 * bound + 1


def vectors():
    rows = [(i, RNG.normal(0, 0.3, 6).round(2).tolist(), "abc"[i % 3]) for i in range(240)]
    hot = RNG.normal(0, 0.3, 6).round(2).tolist()
    rows += [(1000 + i, hot, "ab"[i % 2]) for i in range(130)]
    rows += [(None, hot, "a"), (5, rows[5][1], rows[5][2]), (40, rows[40][1], rows[40][2]), (40, rows[41][1], "b"), (2000, None, "a"), (2001, [1.0, None], "a"), (2002, [float("nan")], "a"), (2003, [float("inf"), 0.0], "b")]
    rows += [(2004, [0.5], "a"), (2005, [], "b"), (2020, [0.5, -0.5], "c"), (2040, [0.1] * 6, None), (2060, [1e30, 0.0], "a"), (2080, [0.0] * 6, "a"), (2100, [0.3] * 6, "alone")]
    return rows


def plain_negatives(rows, positives=5, negatives_=10, low=30, high=90):
    packed = []
    for key, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 1 << 56:
            packed.append((key, q + [0] * (6 - len(q)), label))
    out = []
    for i, (key, q, label) in enumerate(packed):
        if key is None or key % 20:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, r[1])), r[0] is None, r[0] or 0, r) for j, r in enumerate(packed) if j != i), key=lambda s: s[:3])
        same = [(-s[0], s[3][0]) for s in scored if s[3][2] == label][:positives]
        for score, positive in same:
            fits = [(-s[0], s[3][0]) for s in scored if s[3][2] != label and low * score <= -100 * s[0] <= high * score][:negatives_]
            out += [(key, positive, n + 1, f[1], score, f[0]) for n, f in enumerate(fits)]
    return out


@pytest.mark.parametrize("cell,anchors,rows", [(1 << 20, 2_048, 1_024), (1 << 10, 5, 16)])
def test_hard_negatives(spark, monkeypatch, cell, anchors, rows):
    for name, value in (("CELL_BYTES", cell), ("ANCHORS", anchors), ("ROWS", rows)):
        monkeypatch.setattr(negatives, name, value)
    table = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "image_id long, embedding array<float>, surface_type string, score int, uid string").repartition(6)
    got = negatives.mine_hard_negatives(df, F.col("image_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_negatives(table)))


def test_no_anchors_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0], "a")], "image_id long, embedding array<double>, surface_type string")
    for rows, anchors in ((df, F.lit(False)), (df, F.lit(True)), (df.filter("false"), F.lit(True))):
        assert negatives.mine_hard_negatives(rows, anchors).collect() == []


# --- archives ------------------------------------------------------------------------------------

FRAMES = [(i, f"https://h{i % 3}.org/ä b?{i}", f"<p>page {i % 17}</p>" * (i % 5)) for i in range(120)] + [
    (200, None, None), (201, "u", ""), (None, "n", "lost"), (None, None, "lost"), (5, "again", "<p>page 5</p>"), (300, "x\r\nWARC-Type: forged", "WARC/1.1\r\n\r\nbody\r\n\r\n"), (301, "long", "é" * 300_000),
] + [(400, "alike", "copy")] * 90


def plain_archive(rows, least=0):
    groups = defaultdict(list)
    for i, (key, uri, text) in enumerate(rows):
        groups[(text or "").encode()].append((key is not None, key or 0, uri is not None, uri or "", i))
    out = []
    for body, members in groups.items():
        first = max(members, key=lambda m: m[:4])
        for m in members:
            again = m is not first and len(body) >= least
            kept = str(first[1]) if first[0] else None
            out.append((str(m[1]) if m[0] else None, len(body), archives.digest32(body), "revisit" if again else "response", kept if again else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in FRAMES], "frame_index long, source_path string, tile_details string, shard string, copy int").repartition(7)


def digests(root):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).glob("*.warc.gz")}


@pytest.mark.parametrize("least,shard,roll", [(0, 16 << 20, 256 << 20), (10, 2_000, 3_000)])
def test_archive_round_trip(spark, frames, tmp_path, monkeypatch, least, shard, roll):
    monkeypatch.setattr(archives, "SHARD_BYTES", shard)
    monkeypatch.setattr(archives, "ROOT_BYTES", shard // 20)
    path = f"file://{tmp_path}/a"
    archives.write_archive(frames, path, least_revisit=least, roll_bytes=roll)
    got = archives.read_archive(spark, path)
    rows = got.collect()
    assert sorted(str((r["frame_index"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows) == plain_archive(FRAMES, least)
    names = {r["record_id"]: r for r in rows}
    assert len(names) == len(rows) and all(names[r["refers_to_record"]]["payload_digest"] == r["payload_digest"] for r in rows if r["record_type"] == "revisit")
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)
    assert archives.read_archive(spark, path, payloads=False).columns == got.columns[:-1]
    # Sorted within and across shards, small files, nothing left under a temporary name, and plain gzip can read it.
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    order = [int(m) if m else -1 for f in files for m in re.findall(rb"X-Record-Key: (\d+)", gzip.decompress(f.read_bytes()).replace(b"\r\nWARC-Type: response", b"\r\n"))]
    assert order == sorted(order) and not list((tmp_path / "a").glob(".frames*"))
    if shard == 2_000:
        assert len(files) > 3 and all(f.stat().st_size <= roll for f in files if b"X-Record-Key: 301" not in gzip.decompress(f.read_bytes()))
    # The same rows in other partitions give the same bytes.
    archives.write_archive(frames.repartition(2).orderBy(F.desc("source_path")), f"file://{tmp_path}/b", least_revisit=least, roll_bytes=roll)
    assert digests(tmp_path / "a") == digests(tmp_path / "b")
    with pytest.raises(FileExistsError):
        archives.write_archive(frames, path)


def test_damage_and_missing_manifest(spark, frames, tmp_path):
    path = f"file://{tmp_path}/c"
    archives.write_archive(frames.filter("frame_index < 20"), path)
    (file,) = (tmp_path / "c").glob("*.warc.gz")
    whole = file.read_bytes()
    for data in (whole[:-30], whole[:-1] + bytes([whole[-1] ^ 1]), whole + archives.member([("WARC-Type", "metadata")], b"x")):
        file.write_bytes(data)
        with pytest.raises(Exception, match="differs|cut off|damaged|Error"):
            archives.read_archive(spark, path).collect()
    (tmp_path / "d").mkdir()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        archives.read_archive(spark, f"file://{tmp_path}/d").collect()


def test_empty_archive(spark, frames, tmp_path):
    archives.write_archive(frames.filter("false"), f"file://{tmp_path}/e")
    assert archives.read_archive(spark, f"file://{tmp_path}/e").collect() == []
    assert not digests(tmp_path / "e") and json.dumps(sorted(p.name for p in (tmp_path / "e").iterdir() if not p.name.startswith("."))) == '["manifest.json"]'
