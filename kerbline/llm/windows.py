"""Removal of word windows that occur again, with a Count-min sketch before the exact grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import shards as sh
from kerbline.llm import text as tx

#: Cells of each sketch row per window, before rounding up to a power of two.
CELLS = 3
#: Windows per byte of text, from above for the size of the sketch.
WINDOWS_PER_BYTE = 0.2


class _Block:
    """Window hashes of a block and their cells in the two rows of the sketch."""

    def __init__(self, block: pa.Table, width: int, bits: int, n: int):
        self.ids, self.texts = sh.ordered(block)
        self.codes, self.at, self.distinct = tx.words(self.texts)
        h = (tx.word_hashes(self.distinct) if len(self.distinct) else np.zeros((0, 2), np.uint64))[self.codes]
        self.starts = tx.inside(self.at, width)
        self.hashes = [tx.rolling(h[:, i], width, tx.BASES[i])[self.starts] for i in (0, 1)]
        self.rows = []
        for hashed in self.hashes:
            # The cell number fills the upper bits, so shards hold neighbouring cells.
            cells, place, times = np.unique(hashed >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            self.rows.append((cells, place, times, np.searchsorted((cells * np.uint64(n)) >> np.uint64(bits), np.arange(n + 1))))

    def candidates(self, answers: pa.Table, n: int) -> np.ndarray:
        """Windows whose estimate is at least two in both rows."""
        bits = sh.bits_by_shard(answers, 1)
        hit = np.ones(len(self.starts), bool)
        for i, (_, place, _, cuts) in enumerate(self.rows):
            hit &= sh.answer(cuts, bits, i * n)[place] if len(place) else hit
        return np.flatnonzero(hit)


def _first_cell(shard: int, bits: int, n: int) -> int:
    return -(-(shard << bits) // n)


def drop_repeated_windows(assessments: DataFrame, window: int = 35, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """Remove each word of a rationale covered by a window of `window` words that starts anywhere else too.

    Words are runs of characters other than space and tab to carriage return.
    1. Every block of rows sketches its windows: cells of a Count-min sketch with two
       rows, of a size that follows the input. Cell ranges are merged where they
       belong, and each block learns which of its cells reach two. Estimates are
       never too low, so no repeated window is lost.
    2. Windows estimated repeated are grouped exactly by 96 hash bits of their words.
    3. Each block takes the words of repeated windows out, as judged on the input.

    Columns: `key`, n_words, n_removed, kept_text (kept words joined by one space),
    kept_sha256 (of kept_text in UTF-8). A null rationale has no words; rows with equal or null
    keys are rows of their own, so their windows repeat each other; an empty table gives
    no rows.
    """
    total = assessments.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = sh.block_count(total, WINDOWS_PER_BYTE)
    bits = max(16, int(total * WINDOWS_PER_BYTE * CELLS).bit_length())
    blocks = sh.in_blocks(assessments, key, text, n)
    kind = assessments.schema[key].dataType.simpleString()

    def sketch(block: pa.Table) -> pa.Table:
        own, at, sets = _Block(block, window, bits, n), [], []
        for i, (cells, _, times, cuts) in enumerate(own.rows):
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                packed = tx.pack(cells[part] - np.uint64(_first_cell(int(s), bits, n)))
                at.append(i * n + int(s))
                sets.append(len(packed).to_bytes(8, "little") + packed + np.packbits(times[part] > 1).tobytes())
        return sh.messages(block.column("block")[0].as_py(), np.array(at, np.int32), sets)

    def merge(table: pa.Table) -> pa.Table:
        parts, size = [], 0
        for packed in table.column("sets").to_pylist():
            k = int.from_bytes(packed[:8], "little")
            cells = tx.unpack(packed[8 : 8 + k])
            parts.append((cells, np.unpackbits(np.frombuffer(packed, np.uint8, offset=8 + k))[: len(cells)]))
            size = max(size, int(cells[-1]) + 1)
        estimate = np.zeros(size, np.uint8)
        for cells, more in parts:  # counts saturate: only whether they reach two matters
            estimate[cells] = np.minimum(estimate[cells] + 1 + more, 2)
        return sh.replies(table, 1, [estimate[cells] > 1 for cells, _ in parts])

    def exact(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return sh.messages(0, np.zeros(0, np.int32), [])
        own = _Block(block, window, bits, n)
        some = own.candidates(answers, n)
        high, low, again, _ = sh.unique_pairs(own.hashes[0][some], own.hashes[1][some] & np.uint64(0xFFFFFFFF))
        at, sets = sh.pack_pairs(high, low, again, sh.shard_cuts(high, n))
        return sh.messages(block.column("block")[0].as_py(), at, sets)

    def take_out(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(block, window, bits, n)
        some = own.candidates(answers, n)
        high, _, _, place = sh.unique_pairs(own.hashes[0][some], own.hashes[1][some] & np.uint64(0xFFFFFFFF))
        repeated = sh.answer(sh.shard_cuts(high, n), sh.bits_by_shard(answers, 2))
        gone = tx.covered(own.starts[some[repeated[place]]] if len(some) else np.zeros(0, np.int64), window, len(own.codes))
        sums = np.concatenate([[0], np.cumsum(gone)])
        before = np.concatenate([[0], np.cumsum(~gone)])[own.at]
        kept = pc.take(own.distinct, pa.array(own.codes[~gone]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), kept.cast(pa.string())), " ")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in joined.to_pylist()]
        return pa.table({key: own.ids, "n_words": pa.array(np.diff(own.at), pa.int64()), "n_removed": pa.array(sums[own.at[1:]] - sums[own.at[:-1]], pa.int64()), "kept_text": joined, "kept_sha256": digests})

    first = blocks.groupBy("block").applyInArrow(sketch, sh.MESSAGE).repartition(2 * n, "shard").groupBy("shard").applyInArrow(merge, sh.REPLY)
    second = blocks.groupBy("block").cogroup(first.repartition(n, "block").groupBy("block")).applyInArrow(exact, sh.MESSAGE)
    second = second.repartition(n, "shard").groupBy("shard").applyInArrow(lambda t: sh.repeated_pairs(t, 2), sh.REPLY)
    answers = first.unionAll(second).repartition(n, "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(take_out, f"`{key}` {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
