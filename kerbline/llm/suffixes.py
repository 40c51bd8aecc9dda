"""Suffix order of a text by prefix-free parsing, inside one task."""

from __future__ import annotations

import numpy as np

from kerbline.llm import text as tx

#: Bytes of a trigger, and one in how many places is one.
TRIGGER, SPARSE = 8, 48
_TABLES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Parse:
    """Triggers of texts in a row and content hashes of any of their stretches."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        n = len(raw)
        self.sums, self.back = [], []
        for i, base in enumerate(tx.BASES):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLES[i][raw] * tx.powers(base, n), out=sums[1:])
            self.sums.append(sums)
            self.back.append(tx.powers(pow(base, -1, 1 << 64), n + 1))
        starts = np.arange(max(n - TRIGGER + 1, 0))
        hit = starts[self.hashed(starts, starts + TRIGGER, 0) % np.uint64(SPARSE) == 0]
        # A trigger lies within one text.
        ends = at[np.searchsorted(at, hit, side="right")] if len(hit) else hit
        self.triggers = hit[hit + TRIGGER <= ends]
        self.text = np.searchsorted(at, self.triggers, side="right") - 1

    def hashed(self, starts: np.ndarray, stops: np.ndarray, i: int) -> np.ndarray:
        return tx.mix((self.sums[i][stops] - self.sums[i][starts]) * self.back[i][starts] + (stops - starts).astype(np.uint64))

    def pairs(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hashed(starts, stops, 0), self.hashed(starts, stops, 1) & np.uint64(0xFFFFFFFF)


class Minimum:
    """Leftmost place of the least value in any range."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels, width = values, [np.arange(len(values))], 1
        while 2 * width <= len(values):
            a, b = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[b] < values[a], b, a))
            width *= 2

    def place(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For ranges lo..hi, both included and not empty."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            a, b = self.levels[k][lo[own]], self.levels[k][hi[own] - (1 << int(k)) + 1]
            out[own] = np.where(self.values[b] < self.values[a], b, a)
        return out


def suffix_ranks(raw: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rank of every suffix raw[i:stop[i]] by prefix doubling; equal suffixes share a rank."""
    n = len(raw)
    padded = np.concatenate([raw.astype(np.int64) + 1, np.zeros(8, np.int64)])
    place = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + np.where(place + k < stop, padded[k : n + k], 0)
    rank, width = np.zeros(n, np.int64), 7

    def settle(some: np.ndarray, key: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """New ranks of `some`; returns those that still share theirs and go on."""
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        if before is not None:  # ranks grow from that of the group that is split
            old = before[order]
            group = np.ones(len(order), bool)
            group[1:] = old[1:] != old[:-1]
            first = old + first - np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        rank[some[order]] = first
        last = np.ones(len(order), bool)
        last[:-1] = new[1:]
        return some[order[~(new & last)]]

    left = settle(place, key, None)
    while len(left := left[stop[left] - left >= width]):
        far = left + width
        after = np.where(far < stop[left], rank[np.minimum(far, n - 1)] + 1, 0)
        left = settle(left, rank[left] * (n + 1) + after, rank[left])
        width *= 2
    return rank


def sequence_ranks(symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rank of every suffix of sequences of symbols, the shorter of two alike first."""
    place, rank, width = np.arange(len(symbols)), np.unique(symbols, return_inverse=True)[1], 1
    longest = int((stop - place).max()) if len(place) else 0
    while width < longest:
        far = place + width
        after = np.where(far < stop, rank[np.minimum(far, len(rank) - 1)] + 1, 0)
        new = np.unique(rank.astype(np.int64) * (len(rank) + 1) + after, return_inverse=True)[1]
        if new.max() == rank.max():
            break
        rank, width = new, 2 * width
    return rank


def common_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from a and from b on, up to `most`."""
    out, going = np.zeros(len(a), np.int64), np.arange(len(a))
    step = 16
    while len(going):
        view = np.arange(step)
        x, y = a[going] + out[going], b[going] + out[going]
        last = len(raw) - 1
        same = raw[np.minimum(x[:, None] + view, last)] == raw[np.minimum(y[:, None] + view, last)]
        run = np.where(same.all(1), step, same.argmin(1))
        out[going] = np.minimum(out[going] + run, most[going])
        going = going[(run == step) & (out[going] < most[going])]
    return out


def repeated_starts(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which windows of `length` bytes of the given pieces equal another; every window holds a trigger.

    The dictionary is the distinct segments between triggers, the parse is their
    sequence. A suffix of the text is a suffix of a segment followed by a suffix of the
    parse, and no segment suffix is the beginning of another, so sorting by
    (rank of the segment suffix, rank of the rest of the parse) is the order of the
    corpus. Windows are equal where neighbours in that order share `length` bytes.
    """
    parse = Parse(raw, at)
    # Segments: up to and with each trigger, then the rest of the piece.
    piece_end = at[parse.text + 1]
    last = np.ones(len(piece_end), bool)
    last[:-1] = parse.text[1:] != parse.text[:-1]
    stops = np.concatenate([parse.triggers + TRIGGER, piece_end[last]])
    begin_next = np.concatenate([parse.triggers + 1, piece_end[last]])
    order = np.lexsort((begin_next, np.concatenate([parse.text, parse.text[last]])))
    stops, begin_next, piece = stops[order], begin_next[order], np.concatenate([parse.text, parse.text[last]])[order]
    tail = np.concatenate([np.zeros(len(piece_end), bool), np.ones(last.sum(), bool)])[order]
    starts = np.concatenate([[0], begin_next[:-1]]).astype(np.int64)
    starts[np.concatenate([[True], tail[:-1]])] = at[piece[np.concatenate([[True], tail[:-1]])]]
    # Dictionary, its suffix array, and the ranks of whole segments.
    h, l = parse.pairs(starts, stops)
    _, distinct, entry = np.unique(np.stack([h, l | (tail.astype(np.uint64) << np.uint64(32))]), axis=1, return_index=True, return_inverse=True)
    sizes = stops[distinct] - starts[distinct]
    entry_end = np.cumsum(sizes)
    entry_at = entry_end - sizes
    ranks = suffix_ranks(raw[tx.ragged(starts[distinct], sizes)], np.repeat(entry_end, sizes))
    filled = sizes[entry] > 0
    symbol = np.where(filled, ranks[np.minimum(entry_at[entry], len(ranks) - 1)] + 1, 0)
    # Parse, its suffix array, and the common prefixes of neighbours there.
    ends_of = np.flatnonzero(tail) + 1
    parse_rank = sequence_ranks(symbol, np.repeat(ends_of, np.diff(np.concatenate([[0], ends_of]))))
    by_rank = np.argsort(parse_rank, kind="stable")
    stop_at = at[piece + 1]
    a, b = by_rank[:-1], by_rank[1:]
    shared = common_prefix(raw, starts[a], starts[b], np.minimum(np.minimum(stop_at[a] - starts[a], stop_at[b] - starts[b]), length))
    position = np.empty(len(by_rank), np.int64)
    position[by_rank] = np.arange(len(by_rank))
    lowest = Minimum(shared)
    # The order of the corpus.
    window = tx.inside(at, length)
    segment = np.searchsorted(stops - np.where(tail, 1, TRIGGER), window, side="left")
    alpha = ranks[entry_at[entry[segment]] + window - starts[segment]]
    long = stops[segment] - window
    rest = position[segment + 1]
    order = np.lexsort((rest, alpha))
    a, b = order[:-1], order[1:]
    lo, hi = rest[a], rest[b] - 1
    same = alpha[a] == alpha[b]
    equal = np.zeros(len(a), bool)
    equal[same] = long[a][same] + shared[lowest.place(lo[same], hi[same])] - (TRIGGER - 1) >= length
    out = np.zeros(len(window), bool)
    out[a[equal]] = True
    out[b[equal]] = True
    return out
