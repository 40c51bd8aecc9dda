"""Hard negatives of tile embeddings: exact integer scores by residue matrices, and a window under each positive."""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

#: Anchors of one cell, and rows that one product takes.
ANCHORS, ROWS = 2_048, 1_024
#: Bytes of vectors of one cell; beyond ROOT_BYTES of input a cell grows with the square root.
CELL_BYTES, ROOT_BYTES = 1 << 20, 1 << 26
#: Components of one float32 product.
WIDTH = 1_024
#: Squared length from which scores might not fit a long after they are multiplied by a percentage.
LONGEST = 1 << 56
LEAST = -(1 << 62)


# --- residue arithmetic --------------------------------------------------------------------------


def moduli(width: int, bound: int) -> list[int]:
    """Primes whose float32 products of `width` centred residues are exact, enough for scores up to `bound` on either side."""
    top = 2 * isqrt((1 << 24) // max(1, min(width, WIDTH))) + 1
    sieve = np.ones(top + 1, bool)
    sieve[:2] = False
    for i in range(2, isqrt(top) + 1):
        sieve[i * i :: i] &= ~sieve[i]
    out: list[int] = []
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        if prod(out) > 2 * bound + 1:
            return out
    raise ValueError(f"scores up to {bound} need more primes below {top}")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    x = np.remainder(x, p)
    return np.where(x > p // 2, x - p, x)


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(vectors, p).astype(np.float32) for p in primes]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of `a` and `b`, put together from their residues.

    Each prime has one float32 product per WIDTH components. The residues become one
    number with digits in the mixed radix of the primes, every digit centred on zero,
    so that the sign comes out right.
    """
    out, unit = None, 1
    for p, x, y in zip(primes, a, b):
        total = np.zeros((len(x), len(y)), np.int64)
        for i in range(0, x.shape[1], WIDTH):
            total += (x[:, i : i + WIDTH] @ y[:, i : i + WIDTH].T).astype(np.int64)
        if out is None:
            out = centred(total, p)
        else:
            out += centred(np.remainder(total - out, p) * pow(unit, -1, p), p) * unit
        unit *= p
    return out


# --- rows as packed integers ---------------------------------------------------------------------


def _packed(embeddings: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """`id`, `label`, `asked`, `norm`, `parts` (little-endian 32-bit integers) of the rows that take part."""
    kind = embeddings.schema[key].dataType.simpleString()
    fields = f"id {kind}, label string, asked boolean, norm long, parts binary"

    def pack(batches):
        for batch in batches:
            lists = batch.column("v").cast(pa.large_list(pa.float64()))
            at = lists.offsets.to_numpy().astype(np.int64)
            x = np.floor(lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False) * float(scale))
            at = at - at[0]
            owner = np.repeat(np.arange(len(lists)), np.diff(at))
            with np.errstate(over="ignore", invalid="ignore"):
                rough = np.bincount(owner, weights=np.where(np.isfinite(x), x * x, np.inf), minlength=len(lists))
            good = rough < LONGEST
            whole = np.where(good[owner], x, 0).astype(np.int64) if len(x) else np.zeros(0, np.int64)
            square = np.concatenate([[0], np.cumsum(whole * whole)])
            parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at * 4), pa.py_buffer(whole.astype("<i4").tobytes())])
            made = {"id": batch.column("id"), "label": batch.column("label"), "asked": batch.column("asked"), "norm": pa.array(square[at[1:]] - square[at[:-1]]), "parts": parts.cast(pa.binary())}
            yield pa.RecordBatch.from_pydict(made).filter(pa.array(good))

    rows = embeddings.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"), F.col(vector).alias("v"))
    return rows.filter("label IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, fields)


def _matrix(parts: pa.Array, dims: int) -> np.ndarray:
    """One row of integers per vector, shorter ones filled up with zeros."""
    parts = parts.cast(pa.large_binary())
    lengths = pc.binary_length(parts).to_numpy(zero_copy_only=False) // 4
    values = np.frombuffer(b"".join(parts.to_pylist()), "<i4")
    out = np.zeros((len(parts), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


# --- the best rows of each slot in one cell ------------------------------------------------------


class Cell:
    """Anchors that meet a stream of rows in ascending id; keeps the first `keep` rows of every slot.

    A slot is an anchor with a range of scores. Without `windows` an anchor has one
    slot that takes any score of its own label, else one per positive, which takes
    scores of other labels between two shares of the positive's.
    """

    def __init__(self, anchors: pa.Table, dims: int, primes: list[int], keep: int, windows: tuple[int, int] | None):
        self.dims, self.primes, self.keep, self.same = dims, primes, keep, windows is None
        self.uid = anchors.column("uid").to_numpy()
        labels = anchors.column("label").combine_chunks().dictionary_encode()
        self.known, self.label = labels.dictionary, labels.indices.to_numpy(zero_copy_only=False)
        self.parts = residues(_matrix(anchors.column("parts").combine_chunks(), dims), primes)
        wide = 1
        low, high = np.full((len(self.uid), 1), LEAST), np.full((len(self.uid), 1), -LEAST)
        if windows:
            given = anchors.column("positives").to_pylist()
            wide = max(map(len, given), default=0)
            low, high = np.full((len(self.uid), wide), 1), np.zeros((len(self.uid), wide), np.int64)
            for i, p in enumerate(given):
                best = np.array(p, np.int64)
                low[i, : len(p)], high[i, : len(p)] = -(-windows[0] * best // 100), windows[1] * best // 100
        self.low, self.high, self.wide = low, high, wide
        self.floor = np.full((len(self.uid), wide), LEAST - 1)
        self.slot = self.value = self.place = np.zeros(0, np.int64)
        self.ids: list[pa.Array] = []
        self.seen = 0

    def meet(self, rows: pa.RecordBatch) -> None:
        """Later rows lose ties, so a full slot only takes higher scores."""
        label = pc.fill_null(pc.index_in(rows.column("label"), value_set=self.known), -1).to_numpy(zero_copy_only=False)
        s = scores(self.parts, residues(_matrix(rows.column("parts"), self.dims), self.primes), self.primes)
        fits = (self.label[:, None] == label) == self.same
        slots, values, places = [self.slot], [self.value], [self.place]
        for w in range(self.wide):
            a, r = np.nonzero(fits & (s <= self.high[:, w, None]) & (s >= self.low[:, w, None]) & (s > self.floor[:, w, None]))
            slots.append(a * self.wide + w)
            values.append(s[a, r])
            places.append(r + self.seen)
        self.ids.append(rows.column("id"))
        self.seen += rows.num_rows
        slot, value, place = map(np.concatenate, (slots, values, places))
        order = np.lexsort((place, -value, slot))
        slot, value, place = slot[order], value[order], place[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        stays = rank < self.keep
        full = rank == self.keep - 1
        self.floor.ravel()[slot[full]] = value[full]
        self.slot, self.value, self.place = slot[stays], value[stays], place[stays]

    def found(self) -> pa.RecordBatch:
        ids = pa.chunked_array(self.ids).take(pa.array(self.place)).combine_chunks()
        return pa.RecordBatch.from_pydict({"uid": pa.array(self.uid[self.slot // max(self.wide, 1)]), "slot": pa.array((self.slot % max(self.wide, 1)).astype(np.int32)), "score": pa.array(self.value), "id": ids})


def _best(anchors: DataFrame, rows: DataFrame, facts, keep: int, windows: tuple[int, int] | None) -> DataFrame:
    """(`uid`, `slot`, `score`, `id`, `rank`): the first `keep` rows of every slot over all rows.

    Anchors and rows are dealt into a grid of cells by number; a cell's anchors come
    before its rows, which stream past in ascending id. Each cell hands on `keep` rows
    of a slot, so the merge grows with slots times rows of the grid, not with pairs.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    dims, bytes_ = facts["dims"] or 0, facts["bytes"] or 0
    wide = max(1, min(-(-bytes_ // CELL_BYTES), isqrt(max(bytes_, ROOT_BYTES) * ROOT_BYTES) // CELL_BYTES))
    high = max(1, -(-facts["asked"] // ANCHORS))
    primes = moduli(dims, int(facts["norm"] or 0))
    tasks = min(wide * high, max(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    mine, place = F.pmod(F.xxhash64("uid"), F.lit(high)).cast("int"), F.pmod(F.xxhash64("uid"), F.lit(wide)).cast("int")
    left = anchors.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).select((mine * wide + F.col("place")).alias("cell"), F.lit(0).alias("side"), "uid", "id", "label", "parts", "positives")
    right = rows.withColumn("mine", F.explode(F.sequence(F.lit(0), F.lit(high - 1)))).select((F.col("mine") * wide + place).alias("cell"), F.lit(1).alias("side"), "uid", "id", "label", "parts", F.lit(None).cast("array<long>").alias("positives"))
    dealt = left.unionByName(right).repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "side", F.col("id").asc_nulls_last())

    def work(batches):
        now, held, cell = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(cells)]):
                if stop == start:
                    continue
                if cells[start] != now:
                    if cell:
                        yield cell.found()
                    now, held, cell = cells[start], [], None
                part = batch.slice(start, stop - start)
                if sides[start] == 0:
                    held.append(part)
                elif held:
                    cell = cell or Cell(pa.Table.from_batches(held), dims, primes, keep, windows)
                    for i in range(0, part.num_rows, ROWS):
                        cell.meet(part.slice(i, ROWS))
        if cell:
            yield cell.found()

    first = Window.partitionBy("uid", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return dealt.mapInArrow(work, f"uid long, slot int, score long, id {kind}").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= keep)


def mine_hard_negatives(
    embeddings: DataFrame, anchors: Column, key: str = "image_id", vector: str = "embedding", label: str = "surface_type",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """Rows of another label that come close to an anchor, but not as close as its positives.

    Components become floor(scale * x); a row's score is its integer inner product with
    the anchor, higher first, ties to the smaller `key`. An anchor's positives are its
    first `positives` other rows of the same label. For each of them the negatives are
    the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Scores come from float32 products of the vectors' residues modulo a few primes, put
    together exactly: the primes' product exceeds twice the largest squared length, which
    bounds every score. `anchors` is a condition on `embeddings`; anchors meet all rows.

    Columns: `anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`,
    `negative_score`. Rows with a null label, a null vector or a component that is null,
    not finite, or too large for 64-bit scores (squared length of 2^56) take no part; a
    shorter vector counts as filled up with zeros; a null key sorts last; rows that repeat
    are rows of their own, and so are repeated anchors; other columns are not read.
    An empty table gives no rows.
    """
    rows = cut_lineage(_packed(embeddings, anchors, key, vector, label, scale).withColumn("uid", F.monotonically_increasing_id()))
    length = F.octet_length("parts")
    facts = rows.agg(F.count_if("asked").alias("asked"), F.max("norm").alias("norm"), (F.max(length) / 4).cast("int").alias("dims"), F.sum(length).alias("bytes")).first()
    asked = rows.filter("asked")
    near = _best(asked.withColumn("positives", F.lit(None).cast("array<long>")), rows, facts, positives + 1, None)
    near = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))
    # The anchor itself is one of the rows; entries with its id and squared length look alike, so any one of them goes.
    own = F.array_position(F.transform("near", lambda e: (e["score"] == F.col("norm")) & e["id"].eqNullSafe(F.col("self"))), True)
    near = asked.select("uid", F.col("id").alias("self"), "norm", "label", "parts").join(near, "uid").withColumn("own", own)
    near = near.withColumn("near", F.slice(F.filter("near", lambda e, i: i + 1 != F.col("own")), 1, positives))
    near = cut_lineage(near.select("uid", F.col("self").alias("id"), "label", "parts", "near", F.transform("near", lambda e: e["score"]).alias("positives")))
    far = _best(near.drop("near"), rows, facts, negatives, (low, high))
    pairs = near.select("uid", F.col("id").alias("anchor_id"), F.posexplode("near").alias("slot", "p"))
    out = pairs.join(far.select("uid", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["uid", "slot"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
