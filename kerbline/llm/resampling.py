"""Quality selection of rationales by importance resampling with hashed n-gram models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.session import cut_lineage

#: Buckets of the two n-gram models.
BUCKETS = 1 << 18
#: Most reviewed assessments that the target model is fitted and calibrated on.
MAX_REVIEWED = 20_000
#: Pseudo-count of both models, in tokens of the target.
PRIOR = 5.0
#: Pseudo-count of the word models, in reviewed rationales.
WORD_PRIOR = 1.0
#: Share of accepted calibration rows whose worst word is bad enough to count as evidence.
SUSPECT = 0.05
#: Share of accepted calibration rows that may fall below either cut.
LOSS = 0.002
#: Score units of one unit of Gumbel noise.
TEMPERATURE = 0.002
#: Counts of a bucket: occurrences in all distinct texts and in accepted ones, reviewed and accepted holders of a word.
COUNTS = ("raw", "target", "known", "good")
#: Text that a task takes apart at once.
SLICE_BYTES = 4 << 20
#: Digests that a task remembers before texts are shuffled.
REMEMBERED = 1 << 20
#: Bits that tell which texts may occur again; they bound what is sent to the driver and to the tasks (8 MB).
REPEAT_BITS = 1 << 26
#: Bits in one row of Spark's bitmap functions.
BITMAP = 1 << 15
#: Score columns of a rationale.
SCORES = ("log_ratio", "word_excess", "weight", "sample_key")
#: Parts into which the range of sampling keys is cut in one pass.
CUTS = 4096


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and all word pairs, and where each text's begin."""
    codes, at, distinct = tx.words(pc.utf8_lower(texts))
    h = (tx.word_hashes(distinct)[:, 0] if len(distinct) else np.zeros(0, np.uint64))[codes]
    one = (tx.mix(h) % np.uint64(BUCKETS)).astype(np.int64)
    first = tx.inside(at, 2)
    two = (tx.mix(h[first] * np.uint64(tx.BASES[0]) + h[first + 1] * np.uint64(tx.BASES[1])) % np.uint64(BUCKETS)).astype(np.int64)
    return one, at, two, np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - 1, 0))])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _least(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least value of each text, 0 for one without words."""
    out, some = np.zeros(len(at) - 1), np.diff(at) > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, at[:-1][some])
    return out


def _holders(buckets: np.ndarray, at: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many of the chosen texts hold each bucket."""
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    chosen = texts[row]
    held = np.unique(row[chosen] * BUCKETS + buckets[chosen]) % BUCKETS
    return np.bincount(held, minlength=BUCKETS)


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """Each distinct text once, as `text`; a null counts as empty.

    A task sends a text on once, so one that most rows hold reaches its shard as often as there are tasks.
    """

    def once(most):
        def run(batches):
            seen: set[bytes] = set()
            for batch in batches:
                for part in tx.slices(batch, text, SLICE_BYTES):
                    texts = tx.plain(part.column(text))
                    new = np.zeros(len(texts), bool)
                    digests = [xxhash.xxh3_128_digest(t) for t in texts.cast(pa.large_binary()).to_pylist()]
                    for i, d in enumerate(digests):
                        if d not in seen:
                            new[i] = True
                            seen.add(d)
                    if most and len(seen) > most:
                        seen.clear()
                    chosen = pa.array(new)
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()).filter(chosen), texts.filter(chosen).cast(pa.string())], names=["digest", text])

        return run

    shape = f"digest binary, `{text}` string"
    return rows.select(text).mapInArrow(once(REMEMBERED), shape).repartition("digest").mapInArrow(once(0), shape).select(text)


def split_repeated(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text no other row has, the other rows), as `text`; a null counts as empty.

    A row is among the first only if no other text has its place in a sketch of REPEAT_BITS
    places, so a few texts that occur once are among the others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = rows.select(whole.alias(text), F.pmod(F.xxhash64(whole), F.lit(REPEAT_BITS)).alias("place"))
    # Places are numbered from 1, as the bitmap functions count.
    shared = placed.groupBy((F.col("place") + 1).alias("at")).count().filter(F.col("count") > 1)
    parts = shared.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    sketch = np.zeros(-(-REPEAT_BITS // BITMAP) * (BITMAP // 8), np.uint8)
    for r in parts.collect():  # at most REPEAT_BITS
        start = (r["part"] - 1) * (BITMAP // 8)
        sketch[start : start + BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(sketch)

    def chosen(again):
        def run(batches):
            for batch in batches:
                place = batch.column("place").to_numpy()
                bit = (shipped.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                yield batch.select([text]).filter(pa.array(bit == again))

        return placed.mapInArrow(run, f"`{text}` string")

    return chosen(0), chosen(1)


@dataclass
class RatioModel:
    """Log ratios of target and raw model of each bucket, and the lowest scores that count as target.

    weights are those of all n-grams, by how often they occur; word_weights those of
    words, by how many reviewed rationales hold them.
    """

    weights: np.ndarray
    word_weights: np.ndarray
    word_cut: float = -np.inf
    excess_cut: float = 0.0
    cut: float | None = None

    def worst(self, texts: pa.Array) -> np.ndarray:
        """Lowest word ratio of each text."""
        one, at, _, _ = ngrams(texts)
        return np.round(_least(self.word_weights[one], at), 9)

    def ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of n-grams, mean log ratio, and how far the distinct words below `word_cut` are
        below it together; without words both are 0."""
        one, at, two, at2 = ngrams(texts)
        n = np.diff(at) + np.diff(at2)
        mean = (_sums(self.weights[one], at) + _sums(self.weights[two], at2)) / np.maximum(n, 1)
        low = self.word_weights[one] < self.word_cut
        bad = np.unique(np.repeat(np.arange(len(n)), np.diff(at))[low] * BUCKETS + one[low])
        excess = np.bincount(bad // BUCKETS, self.word_weights[bad % BUCKETS] - self.word_cut, len(n)) if len(bad) else np.zeros(len(n))
        return n, np.round(mean, 9), np.round(excess, 9)

    def weight(self, mean: np.ndarray, excess: np.ndarray) -> np.ndarray:
        """Mean log ratio, lowered where the bad words weigh more than in accepted rationales."""
        return mean + np.minimum(0.0, excess - self.excess_cut)

    def keys(self, score: np.ndarray, names: list, texts: list[str]) -> np.ndarray:
        """Score plus Gumbel noise that depends on key and text only."""
        seed = np.array([xxhash.xxh3_64_intdigest(f"{name}\0{t}".encode()) for name, t in zip(names, texts)], np.uint64)
        u = ((seed >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
        return score - TEMPERATURE * np.log(-np.log(u))


def reviewed_sample(reviews: DataFrame, key: str, accepted: str, most: int = MAX_REVIEWED) -> DataFrame:
    """At most `most` reviewed keys in hash order: `key`, target (accepted), fit (half fit, half calibrate)."""
    once = reviews.filter(F.col(key).isNotNull() & F.col(accepted).isNotNull()).groupBy(key).agg(F.min(F.col(accepted).cast("int")).alias("target"))
    return once.orderBy(F.xxhash64(key), key).limit(most).select(key, "target", (F.xxhash64(key, F.lit(1)) % 2 == 0).alias("fit"))


def fit_ratio(assessments: DataFrame, reviews: DataFrame, key: str = "frame_index", text: str = "rationale", accepted: str = "accepted") -> RatioModel:
    """Fit the models: raw on all rationales, target on the accepted ones of the fitted half of the reviewed sample.

    Both count each distinct text once, so copies of a rationale do not score it down.
    The word models count holders in the fitted half of the reviewed sample, all of them as
    raw and the accepted ones as target, so a passage that many unreviewed rationales
    share is no evidence. Cuts are low percentiles (`SUSPECT`, `LOSS`) of the accepted rows
    of the other half, which nothing was fitted on.
    """
    sample = reviewed_sample(reviews, key, accepted)
    rows = assessments.select(key, text).join(F.broadcast(sample), key, "left")

    def occurrences(name):
        def count(batches):
            total = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for part in tx.slices(batch, text, SLICE_BYTES):
                    one, _, two, _ = ngrams(tx.plain(part.column(text)))
                    total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
            yield from counts_of(**{name: total})

        return count

    def holders(batches):
        known, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                one, at, _, _ = ngrams(tx.plain(part.column(text)))
                known += _holders(one, at, np.ones(part.num_rows, bool))
                good += _holders(one, at, pc.equal(part.column("target"), 1).to_numpy(zero_copy_only=False))
        yield from counts_of(known=known, good=good)

    def counts_of(**some):
        seen = np.flatnonzero(sum(some.values()))
        none = np.zeros(len(seen), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(some[c][seen] if c in some else none) for c in COUNTS]], names=["bucket", *COUNTS])

    shape = "bucket int, " + ", ".join(f"{c} long" for c in COUNTS)
    fitted = cut_lineage(rows.filter("fit").select(text, "target"))
    # Only texts that may occur again are shuffled, to count them once.
    alone, again = split_repeated(assessments, text)
    parts = [alone.mapInArrow(occurrences("raw"), shape), distinct_texts(again, text).mapInArrow(occurrences("raw"), shape), distinct_texts(fitted.filter("target = 1"), text).mapInArrow(occurrences("target"), shape), fitted.mapInArrow(holders, shape)]
    counted = reduce(DataFrame.unionAll, parts).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # One row per bucket: bounded by BUCKETS, whatever the number of rationales.
    got = counted.toPandas()
    counts = np.zeros((len(COUNTS), BUCKETS))
    counts[:, got["bucket"]] = got[list(COUNTS)].to_numpy().T
    raw, target, known, good = counts
    if not target.sum():
        return RatioModel(np.zeros(BUCKETS), np.zeros(BUCKETS))
    reviewed = fitted.agg(F.count(F.lit(1)), F.sum("target")).first()
    weights = np.log(target + PRIOR) - np.log(raw * (target.sum() / raw.sum()) + PRIOR)
    word_weights = np.log(good + WORD_PRIOR) - np.log(known * (reviewed[1] / reviewed[0]) + WORD_PRIOR)
    model = RatioModel(weights, word_weights)

    def calibrate(score):
        def run(batches):
            for batch in batches:
                for part in tx.slices(batch, text, SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in score(tx.plain(part.column(text)))], names=["x", "y"])

        return held.mapInArrow(run, "x double, y double")

    held = cut_lineage(rows.filter("target = 1 AND NOT fit").select(text))
    lowest = lambda df, x, share: df.agg(F.percentile(x, F.lit(share))).first()[0]
    word_cut = lowest(calibrate(lambda t: (model.worst(t),) * 2), F.col("x"), SUSPECT)
    if word_cut is not None:
        model.word_cut = word_cut
        scores = cut_lineage(calibrate(lambda t: model.ratios(t)[1:]))
        model.excess_cut = lowest(scores, F.col("y"), LOSS)
        model.cut = lowest(scores, F.col("x") + F.least(F.lit(0.0), F.col("y") - model.excess_cut), LOSS)
    return model


def _threshold(scored: DataFrame, k: int) -> float | None:
    """The k-th largest sampling key: the range is narrowed by counts until one task can sort the rest."""
    low, high = scored.agg(F.min("sample_key"), F.max("sample_key")).first()
    if low is None:
        return None
    while True:
        left = scored.filter(F.col("sample_key").between(low, high))
        width = (high - low) / CUTS
        if not width or left.count() <= 100_000:
            rows = left.orderBy(F.desc("sample_key")).limit(k).collect()
            return rows[-1]["sample_key"] if rows else None
        part = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(CUTS - 1)).alias("part")
        for row in left.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high")).orderBy(F.desc("part")).collect():
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]


def _scored(assessments: DataFrame, model: RatioModel, key: str, text: str) -> DataFrame:
    def score(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                texts = tx.plain(part.column(text))
                n, mean, excess = model.ratios(texts)
                weight = model.weight(mean, excess)
                keys = model.keys(weight, part.column(key).to_pylist(), texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), *map(pa.array, (mean, excess, weight, keys))], names=[key, "n_ngrams", *SCORES])

    kind = assessments.schema[key].dataType.simpleString()
    return cut_lineage(assessments.select(key, text).mapInArrow(score, f"`{key}` {kind}, n_ngrams long, " + ", ".join(f"{c} double" for c in SCORES)))


def _sample_threshold(scored: DataFrame, model: RatioModel) -> float:
    if model.cut is None:
        return float("-inf")
    k = scored.filter(F.col("weight") >= model.cut).count()
    found = _threshold(scored, k) if k else float("inf")
    return float("-inf") if found is None else found


def resample_quality(assessments: DataFrame, reviews: DataFrame, key: str = "frame_index", text: str = "rationale", accepted: str = "accepted") -> DataFrame:
    """Which rationales importance resampling keeps: `key`, n_ngrams, log_ratio, word_excess, weight, sample_key, kept.

    Two bag-of-n-grams models over hashed words and word pairs of the lower-cased text:
    raw is fitted on all rationales, each distinct text once, target on reviewed ones that were `accepted`
    (a bounded sample, MAX_REVIEWED). A rationale's weight is its mean log ratio
    (log_ratio). A few words that accepted rationales never hold hardly move a mean; so
    the shares of accepted and of all reviewed rationales that hold a word are compared
    too. Distinct words below the worst words of accepted rationales add up (word_excess), and
    what that sum is below its own cut lowers the weight. As many are sampled as reach the calibrated cut,
    by Gumbel top-k without replacement: the noise depends on key and text, so a rerun
    samples the same rows.

    `reviews` has `key` and `accepted`; rows with a null in either are left out and a key
    reviewed twice counts as accepted only if both were. Without reviews everything is
    kept. A null or wordless rationale scores 0. Rows with equal keys are judged one by
    one and rows with equal sampling keys share their fate; an empty table gives no rows.
    """
    model = fit_ratio(assessments, reviews, key, text, accepted)
    scored = _scored(assessments, model, key, text)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(_sample_threshold(scored, model)))


def keep_quality(assessments: DataFrame, reviews: DataFrame, key: str = "frame_index", text: str = "rationale", accepted: str = "accepted") -> DataFrame:
    """The assessments that `resample_quality` keeps, with all their columns."""
    model = fit_ratio(assessments, reviews, key, text, accepted)
    least = _sample_threshold(_scored(assessments, model, key, text), model)

    def keep(batches):
        for batch in batches:
            for part in tx.slices(batch, text, SLICE_BYTES):
                texts = tx.plain(part.column(text))
                keys = model.keys(model.weight(*model.ratios(texts)[1:]), part.column(key).to_pylist(), texts.to_pylist())
                yield part.filter(pa.array(keys >= least))

    return assessments.mapInArrow(keep, assessments.schema)
