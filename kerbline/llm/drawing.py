"""Assessments drawn so that their words follow a target collection: importance weights and one exact global cutoff."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.operators import ordered
from kerbline.session import cut_lineage

#: Accuracy of the quantile sketch; the bracket starts this far on either side of the wanted quantile.
SKETCH = 2_000
#: Text that a task takes apart at once.
SLICE_BYTES = 4 << 20
#: Rows of one ordered chunk, until the number of chunks reaches its bound.
CHUNK_ROWS = 4_096
#: What each byte stands for: digits, letters in lower case and all bytes beyond ASCII are word bytes.
_BYTES = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs(texts: pa.Array, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the unsigned crc32 of each in text order, and where each text begins."""
    raw, at = tx.utf8(texts)
    spaced = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes().translate(_BYTES)))
    codes, at, distinct = tx.words(spaced)
    words = distinct.cast(pa.large_binary()).to_pylist()
    crcs = np.array([zlib.crc32(w) for w in words], np.int64)
    yield crcs[codes] if len(codes) else np.zeros(0, np.int64), at
    run = codes.astype(np.int64)
    for n in range(2, longest + 1):
        starts = tx.inside(at, n)
        grown, place = np.unique(run[starts] * max(len(words), 1) + codes[starts + n - 1], return_inverse=True)
        crcs = np.array([zlib.crc32(b" " + words[g % len(words)], int(crcs[g // len(words)])) for g in grown.tolist()], np.int64)
        run = np.full(len(codes), -1, np.int64)
        run[starts] = place
        yield crcs[place] if len(starts) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - n + 1, 0))])


def bucket_counts(records: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall into each bucket; every task adds its own up before the shuffle."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                for crcs, _ in runs(tx.plain(part.column("text")), longest):
                    held += np.bincount(crcs % buckets, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "c": pa.array(held[some], pa.int64())})

    out = np.zeros(buckets, np.int64)
    # One row per bucket, whatever the number of texts.
    for row in records.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[row["bucket"]] = row["c"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed shares, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(records: DataFrame, key: str, text: str, longest: int, gains: np.ndarray) -> DataFrame:
    """`id`, `n_words`, `n_features`, `weight` of every record, the weight looked up in the array of gains."""
    kind = records.schema[key].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                words = features = weight = 0
                for n, (crcs, at) in enumerate(runs(tx.plain(part.column("text")), longest), 1):
                    total = np.concatenate([[0], np.cumsum(gains[crcs % len(gains)])])
                    weight = weight + total[at[1:]] - total[at[:-1]]
                    features = features + np.diff(at)
                    words = np.diff(at) if n == 1 else words
                counts = {name: pa.array(v.astype(np.int64)) for name, v in (("n_words", words), ("n_features", features), ("weight", weight))}
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), **counts})

    return records.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: str, seed: int) -> F.Column:
    """Thousandths of a Gumbel variable that only the seed and the key decide, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


ORDER = ("less", "unnamed", "id")


def _in_order(scored: DataFrame) -> DataFrame:
    return scored.withColumn("less", -F.col("score")).withColumn("unnamed", F.col("id").isNull())


def _ranked(scored: DataFrame) -> DataFrame:
    """`rank` by score, best first, ties to the smaller id; cut into chunks of the order when there are many rows."""
    rows = _in_order(scored)
    return ordered.KeyProfile.of(rows, max_rows=CHUNK_ROWS).layout(rows, ORDER).scan(rows, rank=ordered.row_number())


def cutoff(scored: DataFrame, wanted: int, total: int, sketch: int = SKETCH):
    """The row (`less`, `unnamed`, `id`) at place `wanted` of the order.

    A quantile sketch brackets the place. Exact counts of the rows above and inside
    accept the bracket or widen the side that missed it, up to all rows. Only what
    is inside is then put in order.
    """
    q = 1 - wanted / total
    below = over = 2.0 / sketch
    while True:
        low, high = scored.agg(F.percentile_approx("score", F.array(F.lit(max(q - below, 0.0)), F.lit(min(q + over, 1.0))), sketch)).first()[0]
        up = F.lit(False) if q + over >= 1 else F.col("score") > high
        down = F.lit(False) if q - below <= 0 else F.col("score") < low
        above, under = scored.agg(F.count_if(up), F.count_if(down)).first()
        if above < wanted <= total - under:
            break
        if above >= wanted:
            over *= 4
        else:
            below *= 4
    inside = _ranked(scored.filter(~up & ~down))
    return inside.filter(F.col("rank") == wanted - above).select(*ORDER).first()


def draw_rationales(
    assessments: DataFrame, target: DataFrame, key: str = "frame_index", text: str = "rationale", target_text: str = "rationale",
    longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, sketch: int = SKETCH,
) -> DataFrame:
    """Draw `percent` of the assessments so that the words of their rationales follow those of `target`.

    A-Z becomes lower case; words are runs of digits, letters and characters beyond
    ASCII. Features are all runs of 1 to `longest` words, repeats counted, each in
    the bucket of its crc32. A bucket's gain compares its share in `target` with its
    share in all assessments; a rationale's `weight` adds the gains of its features,
    and its `score` adds a Gumbel number that follows from `seed` and `key`. Of the N
    assessments with at least `least_words` words, the floor(percent * N / 100) best
    scores are drawn, ties to the smaller `key`.

    Columns: `key`, `n_features`, `weight`, `score`, `rank` (null where not drawn), one
    row per assessment. A null or empty text has no words, weight 0, and is never drawn
    while `least_words` is above 0; a null key counts as an empty one and comes last
    among ties; rows that repeat are rows of their own, in any order among themselves;
    long texts are read whole; other columns are not read. An empty table gives no
    rows; with an empty target all its shares come from smoothing.
    """
    gains = bucket_gains(bucket_counts(assessments, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = cut_lineage(weighed(assessments, key, text, longest, gains).withColumn("score", F.col("weight") + gumbel("id", seed)))
    entitled = F.col("n_words") >= least_words
    total = scored.filter(entitled).count()
    wanted = percent * total // 100
    out = [F.col("id").alias(key), "n_features", "weight", "score", "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = cutoff(scored.filter(entitled), wanted, total, sketch)
    tie = (F.col("less") == last["less"]) & ((F.col("id").isNull() if last["unnamed"] else F.col("id") <= last["id"]) | F.lit(last["unnamed"]))
    drawn = entitled & ((F.col("less") < last["less"]) | F.coalesce(tie, F.lit(False)))
    rows = _in_order(scored).withColumn("drawn", drawn)
    ranks = _ranked(rows.filter("drawn").drop("less", "unnamed")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long")))
    return ranks.select(*out).unionAll(rows.filter("NOT drawn").withColumn("rank", F.lit(None).cast("long")).select(*out))
