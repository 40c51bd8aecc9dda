"""Arrow and numpy helpers for whole texts inside tasks: words, chunks, rolling hashes, packed integers."""

from __future__ import annotations

import ctypes
import inspect
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MASK = (1 << 64) - 1
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text that a helper works on at once.
SLICE_BYTES = 24 << 20


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(task):
    """The function of a task or of its groups, followed by `release`: a worker waits for later stages with what it has kept."""
    if inspect.isgeneratorfunction(task):

        @wraps(task)
        def run(batches):
            try:
                yield from task(batches)
            finally:
                release()

    elif task.__code__.co_argcount == 1:

        @wraps(task)
        def run(block):
            try:
                return task(block)
            finally:
                release()

    else:

        @wraps(task)
        def run(block, told):
            try:
                return task(block, told)
            finally:
                release()

    return run


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(batch, text: str, limit: int = SLICE_BYTES):
    """Parts of a record batch or table with about `limit` bytes of text each; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(plain(batch.column(text))).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: codes in text order, where each text begins, and the distinct words."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.values.slice(parts.offsets[0].as_py(), parts.offsets[-1].as_py() - parts.offsets[0].as_py())
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    full = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    at = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(full)])
    return codes[full], before[at - at[0]], coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """128 bits of each distinct word, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, distinct.cast(pa.large_binary()).to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each `width` consecutive values, by one running sum."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n - width + 1))


def inside(at: np.ndarray, width: int) -> np.ndarray:
    """First positions of all windows of `width` that stay within one text."""
    counts = np.maximum(np.diff(at) - width + 1, 0)
    return ragged(at[:-1], counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] steps, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of `starts`."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def pack(ascending: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed byte planes of their differences."""
    if not len(ascending):
        return b""
    step = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(ascending).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


# --- chunks that a byte-pair tokenizer encodes independently -------------------------------------


def chunk_bounds(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cut before a space or line end that follows a character which is surely not white space.

    Tokenizers whose pre-tokens hold white space only in front never join across
    such a place, so the chunks encode independently.
    """
    if not len(raw):
        return np.zeros(1, np.int64)
    spot = np.flatnonzero((raw[1:] == 32) | (raw[1:] == 10)) + 1
    before = raw[spot - 1]
    safe = (before > 32) & (before < 127)
    wide = np.flatnonzero(before >= 128)
    where = spot[wide]
    lead, second = np.zeros(len(where), np.uint8), np.zeros(len(where), np.uint8)
    for back in (2, 3, 4):
        byte = raw[np.maximum(where - back, 0)]
        new = (lead == 0) & (byte >= 0xC0)
        lead[new], second[new] = byte[new], raw[np.maximum(where - back + 1, 0)][new]
    # White space beyond ASCII begins with C2, E1, E2 or E3 80.
    safe[wide] = ((lead >= 0xC3) & (lead <= 0xDF)) | ((lead == 0xE3) & (second != 0x80)) | (lead >= 0xE4)
    cut = np.zeros(len(raw) + 1, bool)
    cut[spot[safe]] = cut[at] = True
    return np.flatnonzero(cut)


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Chunks in text order as codes, where each text begins, and the distinct chunks."""
    raw, at = utf8(texts)
    bounds = chunk_bounds(raw, at)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(bounds, at), coded.dictionary
