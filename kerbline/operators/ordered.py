"""Ordered computations that stay balanced when one group holds most of the rows.

A plain window gives every group to one task. Here the groups larger than one
task's share are cut into consecutive chunks of their sort key, each chunk is
scanned on its own, and a small per-chunk summary carries the running state from
one chunk to the next. Groups of ordinary size take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.session import MAX_ROWS_PER_TASK, cut_lineage, int_setting

# No chunk may exceed this share of all rows, so the split table has at most
# about twice as many entries and is safe to broadcast.
MAX_CHUNKS = 4096
SAMPLES_PER_CHUNK = 20


@dataclass(frozen=True)
class Op:
    kind: str
    value: Column | None = None


def row_number() -> Op:
    return Op("row_number")


def group_count() -> Op:
    return Op("group_count")


def group_sum(value: Column | str) -> Op:
    return Op("group_sum", _col(value))


def lag(value: Column | str) -> Op:
    return Op("lag", _col(value))


def lead(value: Column | str) -> Op:
    return Op("lead", _col(value))


def running_sum(value: Column | str) -> Op:
    return Op("running_sum", _col(value))


def running_max(value: Column | str) -> Op:
    return Op("running_max", _col(value))


def last_valid(value: Column | str) -> Op:
    """Latest non-null value at or before the row."""
    return Op("last_valid", _col(value))


def next_valid(value: Column | str) -> Op:
    """Earliest non-null value at or after the row."""
    return Op("next_valid", _col(value))


def group_first(value: Column | str) -> Op:
    """First non-null value of the whole group."""
    return Op("group_first", _col(value))


def group_max(value: Column | str) -> Op:
    """Largest value of the whole group."""
    return Op("group_max", _col(value))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class KeyProfile:
    """Which groups of `keys` are too large for one task, and how finely to cut them."""

    keys: tuple[str, ...]
    hot: tuple[Row, ...]
    chunk_rows: int

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str] = (), max_rows: int | None = None) -> KeyProfile:
        """One pre-aggregated pass over the key columns."""
        keys = tuple(keys)
        limit = max_rows or int_setting(df.sparkSession, MAX_ROWS_PER_TASK)
        if not keys:
            total = df.count()
            chunk = max(limit, total // MAX_CHUNKS + 1)
            hot = (Row(n=total),) if total > chunk else ()
            return KeyProfile(keys, hot, chunk)
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
        total, largest = top["total"] or 0, top["largest"] or 0
        chunk = max(limit, total // MAX_CHUNKS + 1)
        if largest <= chunk:
            return KeyProfile(keys, (), chunk)
        # At most total / chunk <= MAX_CHUNKS groups can be this large.
        return KeyProfile(keys, tuple(counts.where(F.col("n") > chunk).collect()), chunk)

    def layout(self, df: DataFrame, order: Sequence[str]) -> Layout:
        if not self.hot:
            return Layout(self, tuple(order), None)
        return Layout(self, tuple(order), self._split_table(df, tuple(order)))

    def _split_table(self, df: DataFrame, order: tuple[str, ...]) -> DataFrame:
        """Cut points per large group, picked from a sample of its sort keys."""
        spark = df.sparkSession
        by_key = {tuple(r[k] for k in self.keys): r["n"] for r in self.hot}
        hot_rows = df
        if self.keys:
            schema = T.StructType([df.schema[k] for k in self.keys])
            marks = spark.createDataFrame([tuple(k) for k in by_key], schema)
            hot_rows = _join_small(df, marks, self.keys, "left_semi")
        wanted = sum(-(-n // self.chunk_rows) for n in by_key.values()) * SAMPLES_PER_CHUNK
        fraction = min(1.0, wanted / sum(by_key.values()))
        picked = (
            hot_rows.select(*self.keys, F.struct(*order).alias("at"))
            .sample(withReplacement=False, fraction=fraction, seed=17)
            .orderBy(*self.keys, "at")
            .collect()
        )
        groups: dict[tuple, list[Row]] = {k: [] for k in by_key}
        for row in picked:
            groups[tuple(row[k] for k in self.keys)].append(row["at"])
        rows = []
        for key, samples in groups.items():
            pieces = -(-by_key[key] // self.chunk_rows)
            cuts = [samples[len(samples) * i // pieces] for i in range(1, pieces)] if samples else []
            rows.append((*key, sorted(set(cuts), key=samples.index) if cuts else []))
        at_type = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
        schema = T.StructType(
            [T.StructField(k, df.schema[k].dataType) for k in self.keys]
            + [T.StructField("_cuts", T.ArrayType(at_type))]
        )
        return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Layout:
    profile: KeyProfile
    order: tuple[str, ...]
    splits: DataFrame | None

    @property
    def keys(self) -> tuple[str, ...]:
        return self.profile.keys

    def chunk(self, df: DataFrame) -> DataFrame:
        """Adds `_chunk`: 0 for ordinary groups, else the chunk index by binary search."""
        if self.splits is None:
            return df.withColumn("_chunk", F.lit(0))
        at = F.struct(*self.order)
        return self._with_cuts(df).withColumn("_chunk", _chunk_index(at)).drop("_cuts")

    def _with_cuts(self, df: DataFrame) -> DataFrame:
        if self.keys:
            return _join_small(df, self.splits, self.keys, "left")
        one = self.splits.withColumn("_all", F.lit(0))
        return df.withColumn("_all", F.lit(0)).join(F.broadcast(one), "_all", "left").drop("_all")

    def trailing(self, df: DataFrame, width: int, **aggs: Column) -> DataFrame:
        """Aggregates over the rows whose (single, integer) order key lies in [key - width, key].

        Rows within `width` of a later chunk are copied into it, so each chunk is
        complete on its own.
        """
        (key,) = self.order

        def over(window: Window) -> list[Column]:
            frame = window.orderBy(key).rangeBetween(-width, Window.currentRow)
            return [agg.over(frame).alias(name) for name, agg in aggs.items()]

        parts = [F.col(k) for k in self.keys] or [F.lit(0)]
        if self.splits is None:
            return df.select("*", *over(Window.partitionBy(*parts)))
        rows = self._with_cuts(df).withColumn("_own", _chunk_index(F.struct(key)))
        last = _chunk_index(F.struct((F.col(key) + width).cast(df.schema[key].dataType).alias(key)))
        rows = rows.withColumn("_chunk", F.explode(F.sequence(F.col("_own"), last))).drop("_cuts")
        rows = rows.select("*", *over(Window.partitionBy(*parts, F.col("_chunk"))))
        return rows.where(F.col("_chunk") == F.col("_own")).drop("_chunk", "_own")

    def scan(self, df: DataFrame, **ops: Op) -> DataFrame:
        """`df` plus one column per op, computed in (keys, order)."""
        if self.splits is None:
            windows = self._windows()
            return df.select("*", *[_plain(op, *windows).alias(name) for name, op in ops.items()])
        return self._scan_chunks(df, ops)

    def _windows(self, *extra: str) -> tuple[Window, Window]:
        """In order, and backwards: a frame that ends with its partition is evaluated anew for each row, one that begins with it is not."""
        group = Window.partitionBy(*([F.col(c) for c in (*self.keys, *extra)] or [F.lit(0)]))
        return group.orderBy(*self.order), group.orderBy(*[F.col(c).desc_nulls_last() for c in self.order])

    def _scan_chunks(self, df: DataFrame, ops: dict[str, Op]) -> DataFrame:
        # The rows are read twice, for the summary and for the scan. Cutting the lineage here keeps
        # a chain of scans linear: without it every scan would run all earlier ones twice.
        rows = cut_lineage(self.chunk(df))
        at = F.struct(*self.order)
        names = list(ops)
        part = rows.groupBy(*self.keys, "_chunk").agg(
            *[_summary(ops[n], at).alias(f"_s_{n}") for n in names]
        )
        across = Window.partitionBy(*([F.col(k) for k in self.keys] or [F.lit(0)])).orderBy("_chunk")
        # One row per chunk: the window below runs over the summary, never over the data.
        carried = part.select(
            *self.keys, "_chunk", *[_carry(ops[n], F.col(f"_s_{n}"), across).alias(f"_c_{n}") for n in names]
        )
        if self.keys:
            marks = self.splits.select(*self.keys)
            carried = _join_small(carried, marks, self.keys, "left_semi")
        local = self._windows("_chunk")
        rows = rows.select("*", *[_local(op, *local).alias(f"_l_{n}") for n, op in ops.items()])
        joined = _join_small(rows, carried, (*self.keys, "_chunk"), "left")
        return joined.select(
            *[F.col(c) for c in df.columns],
            *[_combine(ops[n], F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in names],
        )


def _join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a table of bounded size; null keys match null keys."""
    renamed = small.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return df.join(F.broadcast(renamed), same, how).drop(*[f"_on_{k}" for k in keys])


def _chunk_index(at: Column) -> Column:
    """Number of cut points below `at`, by binary search over `_cuts`; 0 without cuts."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_CHUNKS.bit_length() + 1))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(F.get(F.col("_cuts"), pos + step - 1) < at, pos + step).otherwise(pos),
    )
    return F.when(F.col("_cuts").isNull(), 0).otherwise(found)


def _whole(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _upto(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _plain(op: Op, w: Window, back: Window) -> Column:
    match op.kind:
        case "row_number":
            return F.row_number().over(w).cast("long")
        case "group_count":
            return F.count(F.lit(1)).over(_whole(w))
        case "group_sum":
            return F.sum(op.value).over(_whole(w))
        case "lag":
            return F.lag(op.value).over(w)
        case "lead":
            return F.lead(op.value).over(w)
        case "running_sum":
            return F.sum(op.value).over(_upto(w))
        case "running_max":
            return F.max(op.value).over(_upto(w))
        case "last_valid":
            return F.last(op.value, ignorenulls=True).over(_upto(w))
        case "next_valid":
            return F.last(op.value, ignorenulls=True).over(_upto(back))
        case "group_first":
            return F.first(op.value, ignorenulls=True).over(_whole(w))
        case "group_max":
            return F.max(op.value).over(_whole(w))
    raise ValueError(f"unknown op {op.kind}")


def _local(op: Op, w: Window, back: Window) -> Column:
    # Lag and lead are wrapped so that "no neighbour here" differs from "neighbour is null".
    if op.kind in ("lag", "lead"):
        return _plain(Op(op.kind, F.struct(op.value.alias("v"))), w, back)
    return _plain(op, w, back)


def _summary(op: Op, at: Column) -> Column:
    match op.kind:
        case "row_number" | "group_count":
            return F.count(F.lit(1))
        case "lag":
            return F.max_by(F.struct(op.value.alias("v")), at)
        case "lead":
            return F.min_by(F.struct(op.value.alias("v")), at)
        case "running_sum" | "group_sum":
            return F.sum(op.value)
        case "running_max" | "group_max":
            return F.max(op.value)
        case "last_valid":
            return F.max_by(op.value, F.when(op.value.isNotNull(), at))
        case "next_valid" | "group_first":
            return F.min_by(op.value, F.when(op.value.isNotNull(), at))
    raise ValueError(f"unknown op {op.kind}")


def _carry(op: Op, part: Column, across: Window) -> Column:
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    match op.kind:
        case "row_number" | "running_sum":
            return F.sum(part).over(before)
        case "group_count" | "group_sum":
            return F.sum(part).over(_whole(across))
        case "lag":
            return F.lag(part).over(across)
        case "lead":
            return F.lead(part).over(across)
        case "running_max":
            return F.max(part).over(before)
        case "last_valid":
            return F.last(part, ignorenulls=True).over(before)
        case "next_valid":
            return F.first(part, ignorenulls=True).over(after)
        case "group_first":
            return F.first(part, ignorenulls=True).over(_whole(across))
        case "group_max":
            return F.max(part).over(_whole(across))
    raise ValueError(f"unknown op {op.kind}")


def _combine(op: Op, local: Column, carry: Column) -> Column:
    match op.kind:
        case "row_number":
            return local + F.coalesce(carry, F.lit(0))
        case "running_sum":
            return F.when(local.isNull() | carry.isNull(), F.coalesce(local, carry)).otherwise(local + carry)
        case "running_max":
            return F.greatest(local, carry)
        case "group_count" | "group_sum" | "group_first" | "group_max":
            return F.coalesce(carry, local)
        case "lag" | "lead":
            return F.coalesce(local, carry)["v"]
        case _:
            return F.coalesce(local, carry)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of the non-null values, one row per group.

    Equal values are counted first, so they are one row of the chunked scan, and a group
    of any size or with any number of ties is fine. The final aggregate only reads the
    values that hold the one or two target ranks.
    """
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    profile = profile or KeyProfile.of(counted, keys)
    ranked = profile.layout(counted, [value]).scan(counted, _upto=running_sum("_c"), _n=group_sum("_c"))
    picks = []
    for name, q in quantiles.items():
        target = (F.col("_n") - 1) * F.lit(float(q))
        low, frac = F.floor(target), target - F.floor(target)
        holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(F.ceil(target)), F.col(value)))
        picks.append((at_low + (at_high - at_low) * F.max(frac)).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset+limit of the table in ascending order.

    A table beyond one task's share is cut into chunks of its order whose rows are
    counted; chunks in front of the page are skipped whole, and only those that hold the
    page are cut again, until they fit one task. Rows alike in `order` stay together.
    """
    order, skip = list(order), offset
    while limit > 0:
        profile = KeyProfile.of(df)
        if not profile.hot:
            break
        chunked = profile.layout(df, order).chunk(df)
        counts = sorted((r["_chunk"], r["n"]) for r in chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect())
        held, before = [], 0
        for chunk, n in counts:
            if before < skip + limit and before + n > skip:
                held.append((chunk, before))
            before += n
        if len(held) == len(counts):
            break
        if not held:
            return df.limit(0)
        df = chunked.where(F.col("_chunk").between(held[0][0], held[-1][0])).drop("_chunk")
        skip -= held[0][1]
    return df.orderBy(*order).offset(skip).limit(limit)
