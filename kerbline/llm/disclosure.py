"""Personal data in rationales, and terms that give it away by co-occurrence."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Words from a mention within which a term has the whole weight of its rationale.
CONTEXT = 6
#: Pseudo-count of documents that hold a term and the entity at its base rate, times the distance in CONTEXT beyond it.
PRIOR = 1.0
#: Bits that tell most terms without risk before the rest is joined; a multiple of 64.
BITS = 1 << 26
#: Text that a task takes apart at once, and words whose term a worker remembers.
SLICE_BYTES, REMEMBERED = 2 << 20, 1 << 17
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95

# Fixed patterns of the four kinds, in forms that never scan a run of characters twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_BLANK = " \t\n\x0b\x0c\r"
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, run.start(), run.end()) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def term(word: str) -> str:
    """A word as a term: lower case, without ASCII punctuation at its ends; '' if it has no letter or under 3 characters."""
    word = word.lower().strip(_EDGE)
    return word if len(word) > 2 and any(c.isalpha() for c in word) else ""


def _h64(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


@lru_cache(REMEMBERED)
def term_number(word: str) -> int:
    """Number of the word's term, 0 without one."""
    return _h64(t) if (t := term(word)) else 0


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spaces in the place of all mentions."""
    parts, done = [], 0
    for start, _, end in spans:
        if end > done:
            start = max(start, done)
            parts += [text[done:start], " " * (end - start)]
            done = end
    return "".join([*parts, text[done:]])


def edges(word: str, at: int) -> tuple[int, int]:
    """Where a word at place `at` begins and ends without ASCII punctuation at its ends."""
    return at + len(word) - len(word.lstrip(_EDGE)), at + len(word.rstrip(_EDGE))


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of every word outside all mentions, in text order; a word without a term has term 0."""
    return [(term_number(m[0]), *edges(m[0], m.start())) for m in _WORD.finditer(blanked(text, spans))]


def marked_words(text: str, spans: list[tuple[int, int, int]], bits: np.ndarray) -> list[tuple[int, int, int]]:
    """Those entries of `outside` whose bit is set, in any order: only the places of such words are looked up."""
    rest = blanked(text, spans)
    words = list(set(_WORD.findall(rest)))
    terms = np.array([term_number(w) for w in words], np.int64)
    out = []
    for i in np.flatnonzero(_set(bits, terms)):
        word, at = words[i], -1
        while (at := rest.find(word, at + 1)) >= 0:
            stop = at + len(word)
            if (at == 0 or rest[at - 1] in _BLANK) and (stop == len(rest) or rest[stop] in _BLANK):
                out.append((int(terms[i]), *edges(word, at)))
    return out


def together(text: str, spans: list[tuple[int, int, int]]):
    """For each entity of a text: its number, the distinct terms of the text, and the least words from each to a mention."""
    words = outside(text, spans)
    terms, back = np.unique(np.array([w[0] for w in words], np.int64), return_inverse=True)
    starts = np.array([w[1] for w in words], np.int64)
    mentions: dict[int, list] = {}
    for start, kind, end in spans:
        value = re.sub(r"[ ().-]", "", text[start:end]) if kind >= 2 else text[start:end].lower()
        mentions.setdefault(_h64(f"{KINDS[kind]}:{value}"), []).append(np.searchsorted(starts, start))
    at = np.arange(len(words))
    for entity, places in mentions.items():
        # The word at a mention's place is the first one after it.
        places = np.unique(places)
        after = np.searchsorted(places, at, side="right") - 1
        right = np.where(after >= 0, at - places[after] + 1, len(words) + 1)
        before = np.searchsorted(places, at, side="right")
        left = np.where(before < len(places), places[np.minimum(before, len(places) - 1)] - at, len(words) + 1)
        least = np.full(len(terms), len(words) + 1)
        np.minimum.at(least, back, np.minimum(left, right))
        yield entity, terms[terms != 0], least[terms != 0]


def _whole(value: str) -> str:
    return xxhash.xxh3_128_hexdigest(value.encode())


def _found(assessments: DataFrame, key: str, text: str) -> DataFrame:
    """Base spans of each rationale."""
    kind = assessments.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32())]))

    @tx.lean
    def find(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                rows = []
                for value in tx.plain(part.column(text)).to_pylist():
                    spans = base_spans(value)
                    named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
                    rows.append((*counts, hashlib.sha256(named.encode()).hexdigest(), _whole(value), [{"a": a, "k": k, "b": b} for a, k, b in spans]))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), span]
                names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "whole", "base"]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[key, *names])

    shape = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, whole string, base array<struct<a int, k int, b int>>"
    return cut_lineage(assessments.select(key, text).mapInArrow(find, f"`{key}` {kind}, {shape}"))


def _pairs(assessments: DataFrame, text: str) -> DataFrame:
    """(e, t, n, d): rationales that hold both an entity and a term, and the least distance; term 0 has all those of the entity."""

    @tx.lean
    def find(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                for value in tx.plain(part.column(text)).to_pylist():
                    for e, terms, least in together(value, spans) if (spans := base_spans(value)) else ():
                        t, d = np.append(terms, 0), np.append(least, 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), e), pa.int64()), pa.array(t, pa.int64()), pa.array(d, pa.int64())], names=["e", "t", "d"])

    return assessments.select(text).mapInArrow(find, "e long, t long, d long").groupBy("e", "t").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))


def _term_counts(assessments: DataFrame, text: str) -> DataFrame:
    """Number of rationales that hold each term."""

    @tx.lean
    def count(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                codes, at, distinct = tx.words(tx.plain(part.column(text)))
                names = np.array([term_number(w) for w in distinct.to_pylist()], np.int64)
                terms, back = np.unique(names, return_inverse=True)
                pair = np.repeat(np.arange(part.num_rows), np.diff(at)) * max(len(terms), 1) + (back[codes] if len(codes) else 0)
                n = np.bincount(np.unique(pair) % max(len(terms), 1), minlength=len(terms))
                some = (terms != 0) & (n[: len(terms)] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(n[: len(terms)][some])], names=["t", "n"])

    return assessments.select(text).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosing_terms(assessments: DataFrame, text: str) -> DataFrame:
    """(t, removed): terms that give away at least GENERALISE of some entity's information.

    With n rationales, the information of an entity is log(n / n_e), what a term
    tells about it is log(p * n / n_e), their ratio is the disclosure. p, the share of the
    term's rationales that hold the entity anywhere, is shrunk towards n_e / n by PRIOR rationales, so every
    entity is judged, and one that few rationales hold by a lower share. A term that
    never stands within CONTEXT words of a mention is shrunk more, by its least distance, so
    far ones need more rationales.
    """
    n = max(assessments.count(), 1)
    pairs = cut_lineage(_pairs(assessments, text))
    entities = pairs.filter("t = 0").select("e", F.col("n").alias("n_e"))
    told = pairs.filter("t <> 0").withColumnRenamed("n", "n_et").join(entities, "e").join(_term_counts(assessments, text), "t")
    base = F.col("n_e") / F.lit(float(n))
    prior = PRIOR * F.greatest(F.lit(1.0), F.col("d") / CONTEXT)
    share = F.log((F.col("n_et") + prior * base) / (F.col("n_t") + prior) / base) / -F.log(base)
    risky = told.filter(F.col("n_e") < n).withColumn("share", share).filter(F.col("share") >= GENERALISE)
    return cut_lineage(risky.groupBy("t").agg(F.max(F.col("share") >= REMOVE).alias("removed")))


def _bits(risky: DataFrame) -> np.ndarray:
    """A bit per term number modulo BITS; at most BITS / 64 rows, whatever the number of terms."""
    place = F.pmod("t", F.lit(BITS))
    got = risky.select((place / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(pmod(t, 64) AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy()
    return out


def _set(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    place = terms % BITS
    return (terms != 0) & ((bits[place // 64] >> (place % 64)) & 1 == 1)


def _marked(texts: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which texts hold a word that may be a risky term."""
    codes, at, distinct = tx.words(texts)
    names = np.array([term_number(w) for w in distinct.to_pylist()], np.int64)
    before = np.concatenate([[0], np.cumsum(_set(bits, names)[codes] if len(codes) else np.zeros(0, np.int64))])
    return before[at[1:]] > before[at[:-1]]


def _suspects(texts: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which texts hold personal data or a word that may be a risky term."""
    return np.array([m or bool(base_spans(t)) for m, t in zip(_marked(texts, bits).tolist(), texts.to_pylist())], bool)


def _judged(assessments: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """`_found` with the term spans that disclose an entity, anywhere in any text, as (start, removed, end); and `_bits`."""
    found = _found(assessments, key, text)
    risky = disclosing_terms(assessments, text)
    bits = _bits(risky)

    @tx.lean
    def find(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                texts = tx.plain(part.column(text))
                for value in texts.filter(pa.array(_marked(texts, bits))).to_pylist():
                    if hits := marked_words(value, base_spans(value), bits):
                        t, a, b = zip(*hits)
                        yield pa.RecordBatch.from_arrays([pa.array([_whole(value)] * len(t)), pa.array(t, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["whole", "t", "a", "b"])

    hits = assessments.select(text).mapInArrow(find, "whole string, t long, a int, b int").distinct().join(risky, "t")
    hits = hits.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("a", "removed", "b"))).alias("terms"))
    return found.join(hits, "whole", "left"), bits


def find_disclosures(assessments: DataFrame, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """Personal data of each rationale and the terms that give some of it away.

    Base kinds are e-mail, ip, card (Luhn) and phone. Each mention is a protected
    entity; the words of the rationales that mention it and the number of rationales that hold them, over the
    whole table, tell how much of an entity's information a term discloses. Terms
    over the thresholds become spans of kind `generalise` or `remove` wherever they stand, also
    in rationales that do not mention the entity.

    Columns: `key`, n_email, n_ip, n_card, n_phone, base_sha256 (of kind:start:end of base
    spans), spans (all of them, by start, then kind). A null rationale counts as empty;
    rows with equal or null keys are judged one by one; an empty table gives no rows.
    """
    judged, _ = _judged(assessments, key, text)
    kind = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["a"].alias("a"), s["k"].alias("k"), F.concat_ws(":", F.get(kind, s["k"]), s["a"], s["b"]).alias("s")))
    terms = F.transform("terms", lambda s: F.struct(s["a"].alias("a"), F.when(s["removed"], 5).otherwise(4).alias("k"), F.concat_ws(":", F.when(s["removed"], "remove").otherwise("generalise"), s["a"], s["b"]).alias("s")))
    every = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, terms)))
    return judged.select(key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform(every, lambda s: s["s"]), ",").alias("spans"))


def clean_text(text: str, base: list, terms: list) -> str:
    """The text with base spans and generalised terms replaced by their kind and removed terms left out."""
    spans = sorted([(a, -b, f"<{KINDS[k]}>") for a, k, b in base] + [(a, -b, "" if removed else "<term>") for a, removed, b in terms])
    out, done = [], 0
    for a, b, name in spans:
        if a >= done:  # of overlapping spans the first and longest names the place
            out += [text[done:a], name]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def sanitize(assessments: DataFrame, key: str = "frame_index", text: str = "rationale") -> DataFrame:
    """All assessments with their columns; personal data and disclosing terms in `text` replaced.

    Rationales without personal data and risky terms are passed through as they are.
    """
    judged, bits = _judged(assessments, key, text)
    spans = judged.filter("size(base) > 0 OR terms IS NOT NULL").groupBy("whole").agg(F.first("base").alias("base"), F.first("terms").alias("terms"))
    schema, at = assessments.schema, assessments.columns.index(text)

    @tx.lean
    def without(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                yield part.filter(pa.array(~_suspects(tx.plain(part.column(text)), bits)))

    @tx.lean
    def having(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                texts = tx.plain(part.column(text))
                found = [_whole(t) if s else None for t, s in zip(texts.to_pylist(), _suspects(texts, bits))]
                wide = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.to_struct_array()], names=["whole", "one"])
                yield wide.filter(pa.array([f is not None for f in found], pa.bool_()))

    @tx.lean
    def replace(batches):
        for batch in batches:
            rows, base, terms = batch.column("one"), batch.column("base").to_pylist(), batch.column("terms").to_pylist()
            fields = rows.flatten()
            texts = [clean_text(t, [tuple(x.values()) for x in (b or [])], [tuple(x.values()) for x in (m or [])]) if b or m else t for t, b, m in zip(fields[at].to_pylist(), base, terms)]
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, names=schema.names)

    dirty = assessments.mapInArrow(having, f"whole string, one {schema.simpleString()}").join(spans, "whole", "left").mapInArrow(replace, schema)
    return assessments.mapInArrow(without, schema).unionAll(dirty)
