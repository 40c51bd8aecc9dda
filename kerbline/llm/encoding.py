"""Byte-pair encoding and decoding of whole rationales; long unsplit stretches by tree concatenation."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.llm.tokens import Encoder
from kerbline.session import cut_lineage

#: Characters from which an unsplit stretch is halved.
LEAF = 8_192
#: Tokens on each side of a join that are re-encoded first.
SIDE = 8


class Bytes:
    """The bytes of each id of a byte-level tokenizer."""

    def __init__(self, encoder: Encoder):
        vocab = encoder.tok.get_vocab(with_added_tokens=True)
        self.special = [t["content"] for t in json.loads(encoder.tok.to_str())["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # The printable stand-in of each byte, as byte-level vocabularies write it.
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        parts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            parts[i] = token.encode() if token in self.special else bytes(stand[c] for c in token)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        return self.flat[tx.ragged(self.begin[:-1][ids], self.size[ids])].tobytes()


_TABLES: dict[str, Bytes] = {}


def _bytes(encoder: Encoder) -> Bytes:
    if encoder.path not in _TABLES:
        _TABLES[encoder.path] = Bytes(encoder)
    return _TABLES[encoder.path]


def join(left: np.ndarray, right: np.ndarray, encoder: Encoder) -> np.ndarray:
    """Ids of two neighbouring pieces together.

    A window of tokens around the join is encoded anew and grows until its first
    tokens are the left piece's and its last tokens the right piece's: then every
    pair of neighbouring tokens is one that the tokenizer gives, and so is the whole.
    """
    table, side = _bytes(encoder), SIDE
    while True:
        a, b = max(0, len(left) - side), min(len(right), side)
        head, tail = table.of(left[a:]), table.of(right[:b])
        # A window begins and ends between characters.
        while a and head and 0x80 <= head[0] < 0xC0:
            a -= 1
            head = table.of(left[a : a + 1]) + head
        while b < len(right) and 0x80 <= (table.of(right[b : b + 1]) + b"\0")[0] < 0xC0:
            tail += table.of(right[b : b + 1])
            b += 1
        middle = encoder.ids((head + tail).decode())
        begins = a == 0 or np.array_equal(middle[:2], left[a : a + 2]) and len(left) - a >= 2
        ends = b == len(right) or np.array_equal(middle[-2:], right[b - 2 : b]) and b >= 2
        if begins and ends:
            return np.concatenate([left[:a], middle, right[b:]])
        side *= 2


def tree(pieces: list[np.ndarray], encoder: Encoder) -> np.ndarray:
    """Join neighbours, then neighbours of what came out, until one piece is left."""
    while len(pieces) > 1:
        pieces = [join(pieces[i], pieces[i + 1], encoder) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def halves(text: str, special: list[str], leaf: int) -> list[str]:
    """Leaves of a long stretch by halving; no cut falls into a special token."""
    if len(text) <= leaf:
        return [text]
    cut = len(text) // 2
    for token in special:
        at = text.find(token, max(0, cut - len(token) + 1))
        if 0 <= at < cut:
            cut = at + len(token)
    if cut >= len(text):
        return [text]
    return halves(text[:cut], special, leaf) + halves(text[cut:], special, leaf)


def _digests(ids: np.ndarray, table: Bytes) -> tuple[int, str, str]:
    ids = ids.astype("<u4")
    # What is not valid UTF-8 decodes to replacement characters.
    decoded = table.of(ids).decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _leaves(text: str, special: list[str], leaf: int):
    """(stretch, text) of all parts of a long text; stretch is 0 for what splits by itself."""
    raw = text.encode()
    bounds = tx.chunk_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    long = np.flatnonzero(np.diff(bounds) > leaf)
    done = 0
    for stretch, i in enumerate(long, 1):
        if bounds[i] > done:
            yield 0, raw[done : bounds[i]].decode()
        for part in halves(raw[bounds[i] : bounds[i + 1]].decode(), special, leaf):
            yield stretch, part
        done = bounds[i + 1]
    if done < len(raw):
        yield 0, raw[done:].decode()


DONE = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_rationales(assessments: DataFrame, tokenizer: str, leaf: int = LEAF, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """Encode each whole rationale and decode it again: `key`, n_tokens, ids_sha256, decoded_sha256.

    Ids are those of the tokenizers library without added special tokens, truncation
    or padding; `tokenizer` names a byte-level tokenizer file. Text is cut where white
    space follows other characters, as the tokenizer does itself, and each distinct
    piece is encoded once per task. An unsplit stretch longer than `leaf` is halved
    into leaves which all tasks encode in parallel; neighbouring ids are then joined
    in a tree by re-encoding growing windows (see `join`).

    A null rationale counts as empty (no ids). Rows with equal or null keys are encoded
    one by one; an empty table gives no rows.
    """
    kind = assessments.schema[key].dataType.simpleString()

    def route(batches):
        encoder = Encoder.of(tokenizer)
        table = _bytes(encoder)
        for batch in batches:
            for part in tx.slices(batch, text):
                texts = tx.plain(part.column(text))
                raw, at = tx.utf8(texts)
                bounds = tx.chunk_bounds(raw, at)
                far = bounds[:-1][np.diff(bounds) > leaf]
                long = set(np.searchsorted(at, far, side="right") - 1)
                short = pa.array([None if i in long else t for i, t in enumerate(texts.to_pylist())] if long else texts, pa.large_string())
                ids, begin = encoder.encode(tx.plain(short))
                out = []
                for i in range(part.num_rows):
                    if i not in long:
                        out.append((i, None, None, None, None, *_digests(ids[begin[i] : begin[i + 1]], table)))
                        continue
                    whole = texts[i].as_py()
                    digest = xxhash.xxh3_128_hexdigest(whole.encode())
                    out.append((i, digest, -1, None, None, None, None, None))
                    out.extend((i, digest, place, stretch, leaf_text, None, None, None) for place, (stretch, leaf_text) in enumerate(_leaves(whole, table.special, leaf)))
                cols = list(zip(*out))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=[key, "whole", "place", "stretch", "part", "n_tokens", "ids_sha256", "decoded_sha256"])

    def encode(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            ids = [encoder.ids(t).astype("<u4").tobytes() for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("whole"), batch.column("place"), batch.column("stretch"), pa.array(ids, pa.binary())], names=["whole", "place", "stretch", "ids"])

    def gather(table: pa.Table) -> pa.Table:
        encoder = Encoder.of(tokenizer)
        rows = sorted(zip(table.column("place").to_pylist(), table.column("stretch").to_pylist(), table.column("ids").to_pylist()))
        parts: list[tuple[int, list[np.ndarray]]] = []
        for _, stretch, ids in rows:
            ids = np.frombuffer(ids, "<u4").astype(np.uint32)
            if stretch and parts and parts[-1][0] == stretch:
                parts[-1][1].append(ids)
            else:
                parts.append((stretch, [ids]))
        n, a, b = _digests(np.concatenate([tree(p, encoder) for _, p in parts]), _bytes(encoder))
        return pa.table({"whole": table.column("whole").slice(0, 1).cast(pa.string()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})

    routed = cut_lineage(assessments.select(key, text).mapInArrow(route, f"`{key}` {kind}, whole string, place int, stretch int, part string, {DONE}"))
    short = routed.filter("whole IS NULL").select(key, "n_tokens", "ids_sha256", "decoded_sha256")
    # Equal long texts are encoded once.
    leaves = routed.filter("part IS NOT NULL").groupBy("whole", "place", "stretch").agg(F.first("part").alias("part"))
    encoded = leaves.repartition("whole", "place").mapInArrow(encode, "whole string, place int, stretch int, ids binary")
    long = encoded.groupBy("whole").applyInArrow(gather, f"whole string, {DONE}")
    return short.unionAll(routed.filter("place = -1").select(key, "whole").join(long, "whole").select(key, "n_tokens", "ids_sha256", "decoded_sha256"))
