"""Counting huge numbers of small keys by exchanging packed sets between text blocks and key shards.

A block is a set of rows that one task reads whole. Each block sends every shard the
ascending keys that it holds there, packed, and gets back one bit per key. The number
of messages is the product of blocks and shards, so both grow with the square root of
the input once blocks reach `BLOCK_BYTES`.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx

#: Least text in a block.
BLOCK_BYTES = 10 << 20
#: Keys per message from which more blocks are worth their messages.
MESSAGE_KEYS = 200


def block_count(total_bytes: int, keys_per_byte: float) -> int:
    """Number of blocks, and of shards."""
    return max(1, min(-(-total_bytes // BLOCK_BYTES), int((total_bytes * keys_per_byte / MESSAGE_KEYS) ** 0.5)))


def in_blocks(records: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """`block`, id and text, dealt by key and text."""
    rows = records.select(F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("block"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition(n, "block")


@contextmanager
def stored_blocks(records: DataFrame, key: str, text: str, n: int):
    """`in_blocks` as a bucketed table, for work of several jobs: each reads its blocks without a shuffle."""
    spark, name = records.sparkSession, f"blocks_{uuid.uuid4().hex}"
    in_blocks(records, key, text, n).write.format("parquet").option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def ordered(block: pa.Table) -> tuple[pa.ChunkedArray, pa.Array]:
    """Ids and texts of a block in an order that does not depend on how its rows arrived."""
    texts = tx.plain(block.column("text"))
    digest = [xxhash.xxh3_64_intdigest(t.encode(), seed=xxhash.xxh3_64_intdigest(str(i).encode())) for i, t in zip(block.column("id").to_pylist(), texts.to_pylist())]
    order = pa.array(np.argsort(np.array(digest, np.uint64), kind="stable"))
    return block.column("id").take(order), texts.take(order)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit key, ascending with it."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def shard_cuts(ascending: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(shard_of(ascending, n), np.arange(n + 1))


MESSAGE = "shard int, block int, sets binary"
REPLY = "block int, stage int, shard int, bits binary"


def messages(block: int, shards: np.ndarray, sets: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array(np.full(len(shards), block), pa.int32()), "sets": pa.array(sets, pa.binary())})


def replies(table: pa.Table, stage: int, bits: list[np.ndarray]) -> pa.Table:
    n = table.num_rows
    return pa.table({"block": table.column("block").cast(pa.int32()), "stage": pa.array([stage] * n, pa.int32()), "shard": table.column("shard").cast(pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def bits_by_shard(answers: pa.Table, stage: int) -> dict[int, np.ndarray]:
    rows = zip(answers.column("stage").to_pylist(), answers.column("shard").to_pylist(), answers.column("bits").to_pylist())
    return {shard: np.unpackbits(np.frombuffer(b, np.uint8)) for s, shard, b in rows if s == stage}


def answer(cuts: np.ndarray, bits: dict[int, np.ndarray], first_shard: int = 0) -> np.ndarray:
    """The bits of all ascending keys of a block."""
    out = [bits[first_shard + s][: cuts[s + 1] - cuts[s]] for s in range(len(cuts) - 1) if cuts[s + 1] > cuts[s]]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


# --- exact counts of 96-bit keys -----------------------------------------------------------------


def unique_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in ascending order, which of them occur again, and the place of each input pair."""
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    group = np.cumsum(new) - 1
    place = np.empty(len(h), np.int64)
    place[order] = group
    return h[new], l[new], np.bincount(group, minlength=int(new.sum())) > 1, place


def pack_pairs(high: np.ndarray, low: np.ndarray, again: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    some = np.flatnonzero(np.diff(cuts))
    sets = []
    for s in some:
        part = slice(cuts[s], cuts[s + 1])
        head = tx.pack(high[part])
        sets.append(len(head).to_bytes(8, "little") + head + low[part].astype("<u4").tobytes() + np.packbits(again[part]).tobytes())
    return some, sets


def repeated_pairs(table: pa.Table, stage: int, speaks: bool = False) -> pa.Table:
    """For each block's keys of one shard, whether they occur again in any block.

    With `speaks`, a second bit per key: whether the block is the first that holds it.
    """
    table = table.take(pa.array(np.argsort(table.column("block").to_numpy(), kind="stable")))
    highs, lows, again = [], [], []
    for packed in table.column("sets").to_pylist():
        n = int.from_bytes(packed[:8], "little")
        high = tx.unpack(packed[8 : 8 + n])
        highs.append(high)
        lows.append(np.frombuffer(packed, "<u4", len(high), 8 + n))
        again.append(np.unpackbits(np.frombuffer(packed, np.uint8, offset=8 + n + 4 * len(high)))[: len(high)].astype(bool))
    high, low, own = np.concatenate(highs), np.concatenate(lows).astype(np.uint64), np.concatenate(again)
    _, _, several, place = unique_pairs(high, low)
    several = several | (np.bincount(place, weights=own, minlength=len(several)) > 0)
    cuts = np.cumsum([len(h) for h in highs])[:-1]
    bits = np.split(several[place], cuts)
    if speaks:
        first = np.zeros(len(place), bool)
        first[np.unique(place, return_index=True)[1]] = True
        bits = [np.concatenate(b) for b in zip(bits, np.split(first, cuts))]
    return replies(table, stage, bits)
