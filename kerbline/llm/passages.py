"""Removal of byte passages that occur again, by suffix order over a prefix-free parse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import shards as sh
from kerbline.llm import suffixes as sx
from kerbline.llm import text as tx

#: Text that is parsed at once.
SLICE_BYTES = 2 << 20
#: Pieces around one anchor phrase that are still sorted together; beyond, their windows are grouped by hash.
ANCHORED = 20_000
#: Phrases per byte of text, for the number of blocks.
PHRASES_PER_BYTE = 1 / sx.SPARSE
#: Shards of sorted pieces per block: a shard's arrays are many times its text.
SORTED_PER_BLOCK = 4


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal neighbours."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]]) - 1


class _Slice:
    """Phrases of a slice of a block's texts, and its candidate windows once repeated phrases are known.

    A phrase reaches from one trigger to the end of the next. A window that starts anywhere
    else too has only repeated phrases; its anchor is the one with the least hash.
    """

    def __init__(self, texts: pa.Array, length: int):
        self.raw, self.at = tx.utf8(texts)
        self.length = length
        self.parse = sx.Parse(self.raw, self.at)
        t, text = self.parse.triggers, self.parse.text
        self.inner = np.flatnonzero(text[1:] == text[:-1]) + 1 if len(t) else np.zeros(0, np.int64)
        self.phrases = self.parse.pairs(t[self.inner - 1], t[self.inner] + sx.TRIGGER)

    def cut(self, repeated: np.ndarray) -> None:
        """Candidate windows: `pieces` (first start, last start, anchor hash) and `loose` starts without a phrase."""
        t, n = self.parse.triggers, len(self.raw)
        single = np.zeros(len(t) + 1, np.int64)
        hashes = np.zeros(len(t), np.uint64)
        single[self.inner + 1] = ~repeated
        hashes[self.inner] = self.phrases[0]
        single = np.cumsum(single)
        starts = tx.inside(self.at, self.length)
        before = np.zeros(n + 1, np.int32)
        before[t + 1] = 1
        before = np.cumsum(before, dtype=np.int32)  # triggers that start before each place
        first = before[starts]
        final = before[np.minimum(starts + self.length - sx.TRIGGER + 1, n)] - 1
        none = final <= first
        self.loose = starts[none]
        good = ~none & (single[np.maximum(final, 0) + 1] == single[np.minimum(first + 1, len(t))])
        starts, first, final = starts[good], first[good].astype(np.int64), final[good].astype(np.int64)
        if not len(starts):
            self.pieces = np.zeros((2, 0), np.int64)
            self.anchors = np.zeros(0, np.uint64)
            return
        change = (first[1:] != first[:-1]) | (final[1:] != final[:-1]) | (starts[1:] != starts[:-1] + 1)
        a, b = _runs(np.concatenate([[0], np.cumsum(change)]))
        anchor = sx.Minimum(hashes).place(first[a] + 1, final[a])
        # Neighbouring runs around the same anchor are one piece.
        new = np.ones(len(a), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[a[1:]] != starts[b[:-1]] + 1)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(a)]]) - 1
        self.pieces = np.stack([starts[a[heads]], starts[b[tails]]])
        self.anchors = hashes[anchor[heads]]

    def piece_pairs(self):
        return self.parse.pairs(self.pieces[0], self.pieces[1] + self.length)

    def window_pairs(self, starts: np.ndarray):
        return self.parse.pairs(starts, starts + self.length)


class _Block:
    def __init__(self, block: pa.Table, length: int, n: int):
        self.ids, texts = sh.ordered(block)
        texts = texts if isinstance(texts, pa.Array) else texts.combine_chunks()
        self.n, self.length = n, length
        self.slices = [_Slice(s.column("t"), length) for s in tx.slices(pa.table({"t": texts}).combine_chunks().to_batches()[0], "t", SLICE_BYTES)] if len(texts) else []
        self.high, self.low, self.again, self.place = sh.unique_pairs(*self._all([s.phrases for s in self.slices]))

    @staticmethod
    def _all(pairs):
        return tuple(np.concatenate([np.zeros(0, np.uint64), *[p[i] for p in pairs]]) for i in (0, 1))

    def phrase_messages(self):
        return sh.pack_pairs(self.high, self.low, self.again, sh.shard_cuts(self.high, self.n))

    def cut(self, answers: pa.Table) -> None:
        """Candidate pieces of all slices, distinct ones, and their anchors."""
        repeated = sh.answer(sh.shard_cuts(self.high, self.n), sh.bits_by_shard(answers, 1))[self.place]
        for s, own in zip(self.slices, np.split(repeated, np.cumsum([len(s.inner) for s in self.slices])[:-1])):
            s.cut(own)
        self.p_high, self.p_low, self.p_again, self.p_place = sh.unique_pairs(*self._all([s.piece_pairs() for s in self.slices]))
        anchors = np.concatenate([np.zeros(0, np.uint64), *[s.anchors for s in self.slices]])
        self.p_first = np.zeros(len(self.p_high), np.int64)
        self.p_first[self.p_place[::-1]] = np.arange(len(self.p_place))[::-1]  # first piece of each kind
        self.anchor_of = anchors[self.p_first] if len(anchors) else anchors
        self.a_hash, self.a_place, self.a_count = np.unique(self.anchor_of, return_inverse=True, return_counts=True)

    def piece_messages(self):
        at, sets = sh.pack_pairs(self.p_high, self.p_low, self.p_again, sh.shard_cuts(self.p_high, self.n))
        cuts = sh.shard_cuts(self.a_hash, self.n)
        some = np.flatnonzero(np.diff(cuts))
        counts = []
        for s in some:
            part = slice(cuts[s], cuts[s + 1])
            head = tx.pack(self.a_hash[part])
            counts.append(len(head).to_bytes(8, "little") + head + self.a_count[part].astype("<u4").tobytes())
        return np.concatenate([at, self.n + some]).astype(np.int32), sets + counts

    def judge(self, answers: pa.Table) -> None:
        """Which pieces occur again, which this block speaks for, and which have too common an anchor."""
        cuts, bits = sh.shard_cuts(self.p_high, self.n), sh.bits_by_shard(answers, 2)
        self.p_again = sh.answer(cuts, bits)
        second = {s: b[cuts[s + 1] - cuts[s] :] for s, b in bits.items() if s < self.n}
        self.p_speaks = sh.answer(cuts, second)
        hot = sh.answer(sh.shard_cuts(self.a_hash, self.n), bits, self.n)
        self.p_hot = hot[self.a_place] if len(self.a_place) else np.zeros(0, bool)
        self.bounds = np.cumsum([0, *[s.pieces.shape[1] for s in self.slices]])

    def spoken(self):
        """Slice, piece and first place of the pieces that are sorted, by shard of their anchor."""
        some = np.flatnonzero(self.p_speaks & ~self.p_hot)
        shard = sh.shard_of(self.anchor_of[some], SORTED_PER_BLOCK * self.n).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        some, shard = some[order], shard[order]
        piece = self.p_first[some]
        which = np.searchsorted(self.bounds, piece, side="right") - 1
        return shard, which, piece - self.bounds[which]

    def lone_windows(self):
        """Starts, by slice, of windows that are grouped by hash: without a phrase, or with too common an anchor."""
        some = self.p_first[np.flatnonzero(self.p_speaks & self.p_hot)]
        out = []
        for i, s in enumerate(self.slices):
            own = s.pieces[:, some[(some >= self.bounds[i]) & (some < self.bounds[i + 1])] - self.bounds[i]]
            out.append(np.concatenate([s.loose, tx.ragged(own[0], own[1] - own[0] + 1)]))
        pairs = self._all([s.window_pairs(w) for s, w in zip(self.slices, out)])
        return out, sh.unique_pairs(*pairs)


def drop_repeated_passages(assessments: DataFrame, length: int = 400, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """Remove each byte of a rationale covered by a string of `length` bytes that starts anywhere else too.

    1. Rolling-hash triggers cut every text into phrases; phrases that occur once are
       told apart by exact counts, as no repeated string holds one.
    2. Strings that hold repeated phrases only form pieces around their anchor, the phrase
       with the least hash. Equal pieces count as repeated, and one speaks for all.
    3. Pieces meet by anchor. Each shard builds the suffix array of its dictionary of
       segments and that of its parse, and from both the order of its corpus; strings
       are repeated where neighbours share `length` bytes. Strings without a phrase, and
       those around an anchor with over ANCHORED pieces, are counted by 96 hash bits instead.
    4. Each block takes out the bytes of repeated strings, as judged on the input.

    Texts are UTF-8 bytes; strings never cross rationales. Columns: `key`, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_bytes, kept_sha256. A null rationale counts
    as empty; rows with equal or null keys are rows of their own, so their strings repeat
    each other; an empty table gives no rows.
    """
    total = assessments.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = sh.block_count(total, PHRASES_PER_BYTE)
    blocks = sh.in_blocks(assessments, key, text, n)
    kind = assessments.schema[key].dataType.simpleString()
    number = lambda block: block.column("block")[0].as_py()
    nothing = sh.messages(0, np.zeros(0, np.int32), [])

    def phrases(block: pa.Table) -> pa.Table:
        return sh.messages(number(block), *_Block(block, length, n).phrase_messages())

    def pieces(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return nothing
        own = _Block(block, length, n)
        own.cut(answers)
        return sh.messages(number(block), *own.piece_messages())

    def judge(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < n:
            return sh.repeated_pairs(table, 2, speaks=True)
        hashes, counts = [], []
        for packed in table.column("sets").to_pylist():
            k = int.from_bytes(packed[:8], "little")
            hashes.append(tx.unpack(packed[8 : 8 + k]))
            counts.append(np.frombuffer(packed, "<u4", offset=8 + k))
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        common = np.bincount(place, weights=np.concatenate(counts)) > ANCHORED
        return sh.replies(table, 2, np.split(common[place], np.cumsum([len(h) for h in hashes])[:-1]))

    def speak(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return nothing
        own = _Block(block, length, n)
        own.cut(answers)
        own.judge(answers)
        at, sets = [], []
        shard, which, piece = own.spoken()
        for lo, hi in zip(*_runs(shard)) if len(shard) else ():
            parts = [(own.slices[w], own.slices[w].pieces[:, p]) for w, p in zip(which[lo : hi + 1], piece[lo : hi + 1])]
            sizes = np.array([p[1] - p[0] + length for _, p in parts], "<u4")
            at.append(n + int(shard[lo]))
            sets.append(len(parts).to_bytes(8, "little") + sizes.tobytes() + pa.compress(b"".join(s.raw[p[0] : p[1] + length].tobytes() for s, p in parts), codec="zstd", asbytes=True))
        _, (high, low, again, _) = own.lone_windows()
        some, counted = sh.pack_pairs(high, low, again, sh.shard_cuts(high, n))
        return sh.messages(number(block), np.concatenate([some, np.array(at, np.int64)]).astype(np.int32), counted + sets)

    def sort(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < n:
            return sh.repeated_pairs(table, 3)
        sizes, raws = [], []
        for packed in table.column("sets").to_pylist():
            k = int.from_bytes(packed[:8], "little")
            sizes.append(np.frombuffer(packed, "<u4", k, 8).astype(np.int64))
            raws.append(pa.decompress(packed[8 + 4 * k :], int(sizes[-1].sum()), codec="zstd", asbytes=True))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        hit = sx.repeated_starts(np.frombuffer(b"".join(raws), np.uint8), at, length)
        return sh.replies(table, 3, np.split(hit, np.cumsum([int((s - length + 1).sum()) for s in sizes])[:-1]))

    def take_out(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(block, length, n)
        own.cut(answers)
        own.judge(answers)
        bits = sh.bits_by_shard(answers, 3)
        hits = [[np.zeros(0, np.int64)] for _ in own.slices]
        again = own.p_again[own.p_place] if len(own.p_place) else np.zeros(0, bool)
        for i, s in enumerate(own.slices):
            every = s.pieces[:, again[own.bounds[i] : own.bounds[i + 1]]]
            hits[i].append(tx.ragged(every[0], every[1] - every[0] + 1))
        shard, which, piece = own.spoken()
        for lo, hi in zip(*_runs(shard)) if len(shard) else ():
            found, done = bits[n + int(shard[lo])], 0
            for w, p in zip(which[lo : hi + 1], piece[lo : hi + 1]):
                a, b = own.slices[w].pieces[:, p]
                hits[w].append(a + np.flatnonzero(found[done : done + b - a + 1]))
                done += b - a + 1
        lone, (high, _, _, place) = own.lone_windows()
        repeated = sh.answer(sh.shard_cuts(high, n), bits)[place] if len(place) else np.zeros(0, bool)
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256")}
        for i, (s, r) in enumerate(zip(own.slices, np.split(repeated, np.cumsum([len(w) for w in lone])[:-1]))):
            gone = tx.covered(np.concatenate([*hits[i], lone[i][r]]), length, len(s.raw))
            for a, b in zip(s.at[:-1], s.at[1:]):
                cut = gone[a:b]
                kept = s.raw[a:b][~cut].tobytes()
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (cut[0] if len(cut) else 0))
                for c, v in zip(out, (b - a, int(cut.sum()), spans, kept, hashlib.sha256(kept).hexdigest())):
                    out[c].append(v)
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.table({key: own.ids, **{c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)}})

    counted = lambda t: sh.repeated_pairs(t, 1)
    per_block = lambda answers: blocks.groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block"))
    per_shard = lambda told, k, fn: told.repartition(k * n, "shard").groupBy("shard").applyInArrow(fn, sh.REPLY)
    one = per_shard(blocks.groupBy("block").applyInArrow(phrases, sh.MESSAGE), 1, counted)
    two = per_shard(per_block(one).applyInArrow(pieces, sh.MESSAGE), 2, judge)
    both = one.unionAll(two)
    three = per_shard(per_block(both).applyInArrow(speak, sh.MESSAGE), 1 + SORTED_PER_BLOCK, sort)
    return per_block(both.unionAll(three)).applyInArrow(take_out, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string")
