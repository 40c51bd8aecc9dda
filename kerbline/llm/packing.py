"""Packing tokenized rationales into sequences by linear grouping and best fit."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.llm.tokens import Encoder
from kerbline.session import cut_lineage

#: Groupings tried: groups of equal cardinality, and s for lengths above capacity / s that count as large.
GROUPINGS = ((16, 3), (32, 3), (32, 2))
#: Rows of one length that one task ranks.
RANKED_ROWS = 1_000_000
#: Text that a task encodes at once; the tokenizer's own results take many times its bytes.
SLICE_BYTES = 2 << 20


def _pieces(batches, encoder, capacity: int, end_id: int, key: str, text: str):
    """Pieces of each batch's texts, encoded SLICE_BYTES at a time."""
    for batch in batches:
        for part in tx.slices(batch, text, SLICE_BYTES):
            ids, at = encoder.encode(tx.plain(part.column(text)))
            out = defaultdict(list)
            for i in range(part.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start : start + capacity]
                    for name, value in zip(("row", "piece", "start", "length", "crc"), (i, start // capacity, start, len(piece), zlib.crc32(piece.tobytes()))):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))], names=[key, "piece", "start", "length", "ids_crc32"])


def token_pieces(assessments: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """The token pieces of each rationale: `key`, piece, start, length, ids_crc32.

    A rationale's ids end with `end_id`; only longer ones are cut, each `capacity` ids.
    """

    @tx.lean
    def cut(batches):
        yield from _pieces(batches, Encoder.of(tokenizer), capacity, end_id, key, text)

    kind = assessments.schema[key].dataType.simpleString()
    return assessments.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Which pieces go where, worked out on the number of pieces of each length alone.

    A bin class is (first sequence, number of sequences, used); a placement gives the
    pieces lo <= rank < hi of one length consecutive sequences, at one offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int, groups: int, share: int):
        self.capacity, self.placed, self.bins, self.next = capacity, [], defaultdict(list), 0
        self.rank = dict.fromkeys(counts, 0)
        self.left = dict(sorted(counts.items(), reverse=True))
        self.free: list[int] = []
        self.configurations(groups, capacity // share)
        self.best_fit()

    @classmethod
    def best(cls, counts: dict[int, int], capacity: int) -> "Plan":
        """The grouping that needs the fewest sequences."""
        return min((cls(counts, capacity, *grouping) for grouping in GROUPINGS), key=lambda plan: plan.next)

    def open(self, n: int) -> tuple[int, int, int]:
        self.next += n
        return self.next - n, n, 0

    def put(self, length: int, bin_class: tuple[int, int, int]) -> tuple[int, int, int]:
        first, n, used = bin_class
        lo = self.rank[length]
        self.placed.append((length, lo, lo + n, first, used))
        self.rank[length] += n
        self.left[length] -= n
        return first, n, used + length

    def close(self, bin_class: tuple[int, int, int]) -> None:
        room = self.capacity - bin_class[2]
        if room:
            if not self.bins[room]:
                heapq.heappush(self.free, room)
            self.bins[room].append(bin_class)

    def configurations(self, n_groups: int, small: int) -> None:
        """Linear grouping: large lengths are rounded up to the largest of their group of equal cardinality."""
        large = [(n, c) for n, c in self.left.items() if n > small]
        total = sum(c for _, c in large)
        if not total:
            return
        size = -(-total // n_groups)
        groups: list[list[list[int]]] = [[]]
        room = size
        for n, c in large:
            while c:
                if not room:
                    groups.append([])
                    room = size
                take = min(c, room)
                groups[-1].append([n, take])
                c, room = c - take, room - take
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(c for _, c in g) for g in groups])
        for pattern, times in few_sizes(sizes, demand, self.capacity):
            # The actual pieces of each group take the rounded slots; runs of one length stay together.
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            while times:
                heads, need = [], defaultdict(int)
                for g in slots:
                    need[g] += 1
                n = min(times, *(groups[g][0][1] // k if groups[g][0][1] >= k else 1 for g, k in need.items()))
                bin_class = self.open(n)
                for g in slots:
                    run = groups[g][0]
                    if run[1] < n:
                        groups[g].pop(0)
                        run = groups[g][0]
                    heads.append(run)
                    run[1] -= n
                    bin_class = self.put(run[0], bin_class)
                    if not run[1]:
                        groups[g].pop(0)
                self.close(bin_class)
                times -= n

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence with room."""
        for length in self.left:
            while self.left[length]:
                room = self.fullest(length)
                want = self.left[length]
                if room is None:
                    each = self.capacity // length
                    bin_class = self.open(max(1, want // each))
                    each = min(each, want)
                else:
                    each = min(room // length, want)
                    first, n, used = self.bins[room].pop()
                    take = min(n, max(1, want // each))
                    if take < n:
                        self.bins[room].append((first + take, n - take, used))
                    bin_class = (first, take, used)
                for _ in range(each):
                    bin_class = self.put(length, bin_class)
                self.close(bin_class)

    def fullest(self, length: int) -> int | None:
        held = []
        found = None
        while self.free:
            room = self.free[0]
            if not self.bins[room]:
                heapq.heappop(self.free)
            elif room >= length:
                found = room
                break
            else:  # too small for this length; shorter ones may still fit
                held.append(heapq.heappop(self.free))
        for room in held:
            heapq.heappush(self.free, room)
        return found


def few_sizes(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations for a few sizes, from the linear relaxation by column generation.

    Multiples are rounded down, so at most one configuration per size is left to best fit.
    """
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = np.array(columns, float).T
    for _ in range(60 * k):
        x = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        last = np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            best[room], last[room] = best[room - 1], -1
            fit = np.flatnonzero(sizes <= room)
            if len(fit):
                value = best[room - sizes[fit]] + price[fit]
                top = int(np.argmax(value))
                if value[top] > best[room] + 1e-12:
                    best[room], last[room] = value[top], fit[top]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k, int), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = column
        basis[:, out] = column
    x = np.linalg.solve(basis, demand)
    chosen, rest = [], demand.copy()
    for column, times in zip(columns, np.maximum(x, 0)):
        times = min(int(times + 1e-6), *(rest[column > 0] // column[column > 0]))
        if times > 0:
            rest = rest - column * times
            chosen.append((column, int(times)))
    return chosen


def pack_sequences(assessments: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """Token pieces of the rationales with their place in sequences of at most `capacity` ids.

    Linear grouping: lengths above a third of `capacity` are rounded up to the largest of their
    group of equal cardinality, the few sizes left are covered by configurations from
    a linear programme, the actual pieces replace the rounded ones, and what is left
    goes where it fits best. All of that needs only the number of pieces per length
    (at most `capacity` numbers on the driver); each piece then finds its place by its
    rank among the pieces of its length.

    Columns: `key`, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    rationale is the single id `end_id`; rows with equal or null keys are packed one by
    one; an empty table gives no rows.
    """
    spark = assessments.sparkSession
    pieces = cut_lineage(token_pieces(assessments, tokenizer, capacity, end_id, key, text))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = Plan.best(counts, capacity)
    shares = max(1, -(-max(counts.values(), default=1) // RANKED_ROWS))
    shares = max(shares, min(64, sum(counts.values()) // 4096))
    dealt = pieces.select(F.struct("*").alias("p"), F.col("length").alias("l"), F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(shares)).alias("share"))
    before = dealt.groupBy("l", "share").count()
    before = before.select("l", "share", (F.sum("count").over(Window.partitionBy("l").orderBy("share")) - F.col("count")).alias("before"))
    order = Window.partitionBy("l", "share").orderBy(f"p.{key}", "p.piece", "p.ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(order) - 1).join(before, ["l", "share"]).select("p", "l", (F.col("own") + F.col("before")).alias("r"))
    # At most a few thousand rows: runs of one length per configuration slot or best-fit step.
    places = spark.createDataFrame(plan.placed, "pl long, lo long, hi long, first long, offset long")
    at = (F.col("l") == F.col("pl")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))
    return ranked.join(F.broadcast(places), at).select("p.*", (F.col("first") + F.col("r") - F.col("lo")).alias("sequence_id"), "offset")
