"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from kerbline.llm import text as tx

#: Distinct chunks whose ids a worker remembers.
CACHE = 400_000
#: Most chunks that are encoded as one text, and texts that are encoded at a time.
RUN, BATCH = 1_000, 1_000
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """A tokenizer whose ids of recurring chunks are remembered by the worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tok, self.known = path, Tokenizer.from_file(path), {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.tok.no_truncation()
        self.tok.no_padding()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def ids(self, text: str) -> np.ndarray:
        """Ids as the library itself gives them."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and how many each has.

        Runs of chunks that would be cut at the same places again are encoded as one text,
        and its ids dealt back to them by where they begin.
        """
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        loose = ~np.isin(at[:-1], tx.chunk_bounds(raw, at[[0, -1]]))
        loose[::RUN] = True
        first = np.append(np.flatnonzero(loose), len(pieces))
        # Where each chunk begins in code points.
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        whole, ids, counts = raw.tobytes(), [], []
        for i in range(0, len(first) - 1, BATCH):
            runs = first[i : i + BATCH + 1]
            encoded = self.tok.encode_batch([whole[at[a] : at[b]].decode() for a, b in zip(runs[:-1], runs[1:])], add_special_tokens=False)
            begin = [np.fromiter((o[0] for o in e.offsets), np.int64) + places[a] for e, a in zip(encoded, runs)]
            ids.extend(np.array(e.ids, np.uint32) for e in encoded)
            own = np.searchsorted(places[runs[0] : runs[-1] + 1], np.concatenate(begin), side="right") - 1
            counts.append(np.bincount(own, minlength=runs[-1] - runs[0]))
        return np.concatenate(ids), np.concatenate(counts)

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in a row, where each chunk's begin, and the place of each of `pieces` among the chunks."""
        raw = pieces.to_pylist()
        place = np.array([self.known.get(p, -1) for p in raw], np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.flat, self.begin, place
        ids, counts = self.fresh([raw[i] for i in new])
        place[new] = len(self.begin) - 1 + np.arange(len(new))
        flat, begin = np.concatenate([self.flat, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        if len(self.known) < CACHE:
            size = np.array([len(raw[i]) for i in new])
            keep = np.flatnonzero(size <= 64)[: CACHE - len(self.known)]
            self.known.update((raw[new[i]], len(self.begin) - 1 + j) for j, i in enumerate(keep))
            spans = np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, ids[tx.ragged(spans[keep], counts[keep])]])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts[keep])])
        return flat, begin, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        codes, at, pieces = tx.chunks(texts)
        flat, begin, place = self.distinct(pieces)
        where = place[codes]
        sizes = np.diff(begin)[where]
        return flat[tx.ragged(begin[:-1][where], sizes)], np.concatenate([[0], np.cumsum(sizes)])[at]
