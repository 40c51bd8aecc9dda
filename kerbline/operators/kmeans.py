"""k-means for many cluster counts and many starts in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: settings of the search ---
STARTS, MAX_ITER, TOLERANCE = 10, 300, 1e-4
# --- end of fixed values ---
#: Rounds of seeding; each draws twice as many candidates as a model has clusters.
ROUNDS = 2
#: Rows that a task compares with all centroids at once.
ROWS = 1_024
#: Numbers of a pass's sums that are merged as one row.
BLOCK = 8_192


@dataclass
class Model:
    """One start for one number of clusters."""

    k: int
    start: int
    centroids: np.ndarray
    inertia: float = np.inf
    settled: bool = False


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(1), 0.0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each row, the first of equals, and the squared distance to it.

    `distances` laid out by centroids and worked out in place, as a pass spends its time here.
    """
    d = centroids @ x.T
    d *= -2.0
    d += (x * x).sum(1)
    d += (centroids * centroids).sum(1)[:, None]
    np.maximum(d, 0.0, out=d)
    at = d.argmin(0)
    return at, d[at, np.arange(len(x))]


def _chance(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each row and salt, decided by the row's bytes."""
    h = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in x], np.uint64)
    mixed = h[:, None] ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _blocks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield matrix(batch.column("v").slice(i, ROWS))


def _list_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: v if isinstance(v, pa.Array) else pa.array(v) for n, v in columns.items()})


# --- seeding -------------------------------------------------------------------------------------


def _draw(rows: DataFrame, held: list[np.ndarray | None], wanted: list[int], salt: int) -> list[np.ndarray]:
    """For each model, rows drawn without replacement with chances in proportion to the squared distance to what it holds.

    Every row runs an exponential race whose rate is its distance; the first arrivals
    are the draw, so each task hands on at most `wanted` rows per model.
    """

    def race(batches):
        best = [(np.zeros(0), np.zeros((0, 0)))] * len(wanted)
        for x in _blocks(batches):
            chance = -np.log(_chance(x, salt * 100_003 + np.arange(len(wanted))))
            for m, n in enumerate(wanted):
                rate = 1.0 if held[m] is None else nearest(x, held[m])[1]
                with np.errstate(divide="ignore"):
                    time = chance[:, m] / rate
                first = np.flatnonzero(np.isfinite(time))
                first = first[np.argsort(time[first], kind="stable")[:n]]
                t, v = np.concatenate([best[m][0], time[first]]), np.concatenate([best[m][1].reshape(-1, x.shape[1]), x[first]])
                keep = np.argsort(t, kind="stable")[:n]
                best[m] = (t[keep], v[keep])
        for m, (t, v) in enumerate(best):
            if len(t):
                yield _list_rows(model=np.full(len(t), m, np.int32), n=np.full(len(t), wanted[m], np.int32), time=t, v=pa.array(list(v), pa.list_(pa.float64())))

    first = Window.partitionBy("model").orderBy("time", "v")
    drawn = rows.mapInArrow(race, "model int, n int, time double, v array<double>").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= F.col("n"))
    out: list[list] = [[] for _ in wanted]
    for r in drawn.orderBy("model", "rank").collect():  # at most the sum of `wanted`
        out[r["model"]].append(r["v"])
    return [np.array(v).reshape(len(v), len(v[0]) if v else 0) for v in out]


def _weights(rows: DataFrame, held: list[np.ndarray]) -> list[np.ndarray]:
    """How many rows lie nearest to each candidate."""

    def count(batches):
        n = [np.zeros(len(h), np.int64) for h in held]
        for x in _blocks(batches):
            for m, h in enumerate(held):
                n[m] += np.bincount(nearest(x, h)[0], minlength=len(h))
        for m, c in enumerate(n):
            yield _list_rows(model=np.full(len(c), m, np.int32), at=np.arange(len(c), dtype=np.int32), n=c)

    out = [np.zeros(len(h)) for h in held]
    for r in rows.mapInArrow(count, "model int, at int, n long").groupBy("model", "at").agg(F.sum("n").alias("n")).collect():
        out[r["model"]][r["at"]] = r["n"]
    return out


def _spread(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, far apart; fewer distinct ones are repeated."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    nearest = distances(points, points[chosen])[:, 0]
    while len(chosen) < k:
        share = weights * nearest
        if share.sum() <= 0:
            chosen.append(chosen[len(chosen) % len(set(chosen))])
            continue
        chosen.append(int(rng.choice(len(points), p=share / share.sum())))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def seeded(rows: DataFrame, counts: Sequence[int], starts: int, seed: int) -> list[Model]:
    """All models with their first centroids, from a few passes that serve every model."""
    models = [(k, s) for k in counts for s in range(starts)]
    held = _draw(rows, [None] * len(models), [1] * len(models), seed)
    for r in range(ROUNDS):
        more = _draw(rows, held, [2 * k for k, _ in models], seed + r + 1)
        held = [np.concatenate([h, m]) if len(m) else h for h, m in zip(held, more)]
    weights = _weights(rows, held)
    return [Model(k, s, _spread(h, w, k, np.random.default_rng((seed, k, s)))) for (k, s), h, w in zip(models, held, weights)]


# --- iterations ----------------------------------------------------------------------------------


def cluster_sums(rows: DataFrame, models: list[Model]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
    """Per model the rows and vector sums of its clusters and its inertia; tasks add up before the shuffle."""
    centroids = [m.centroids for m in models]

    def add(batches):
        n, total, spread = [np.zeros(len(c), np.int64) for c in centroids], [np.zeros_like(c) for c in centroids], np.zeros(len(centroids))
        for x in _blocks(batches):
            for m, c in enumerate(centroids):
                at, d = nearest(x, c)
                member = np.zeros((len(c), len(x)))
                member[at, np.arange(len(x))] = 1.0
                n[m] += np.bincount(at, minlength=len(c))
                total[m] += member @ x
                spread[m] += d.sum()
        flat = np.concatenate([np.concatenate([n[m], total[m].ravel(), spread[m : m + 1]]) for m in range(len(centroids))])
        parts = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        yield _list_rows(block=np.arange(len(parts), dtype=np.int32), part=pa.array(parts, pa.list_(pa.float64())))

    # A row per centroid instead would take seconds to merge, whatever the number of rows.
    merged = rows.mapInArrow(add, "block int, part array<double>").groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    flat = np.zeros(sum(len(c) + c.size + 1 for c in centroids))
    for r in merged.collect():  # the sums of all centroids
        flat[r["block"] * BLOCK : r["block"] * BLOCK + len(r["part"])] = r["part"]
    out, inertia, start = [], [], 0
    for c in centroids:
        n, v, spread = np.split(flat[start : start + len(c) + c.size + 1], [len(c), len(c) + c.size])
        out.append((np.rint(n), v.reshape(c.shape)))  # the summarizer adds up by means
        inertia.append(float(spread[0]))
        start += len(c) + c.size + 1
    return out, inertia


def fit(rows: DataFrame, counts: Sequence[int], starts: int = STARTS, max_iter: int = MAX_ITER, seed: int = 42) -> list[Model]:
    """Lloyd's iterations of every (number of clusters, start) together, on `v array<double>`.

    A model stops once its centroids move by at most TOLERANCE of the mean variance
    (squared), and leaves the later passes. A cluster without rows keeps its centroid. The
    rows alone decide the starts, so partitions only change the last digits of sums.
    """
    models = seeded(rows, counts, starts, seed)
    n, total, squares = rows.agg(F.count(F.lit(1)), Summarizer.sum(array_to_vector("v")), Summarizer.variance(array_to_vector("v"))).first()
    limit = TOLERANCE * float(np.mean(squares.toArray())) * (n - 1) / max(n, 1)
    for _ in range(max_iter):
        moving = [m for m in models if not m.settled]
        if not moving:
            break
        for m, (size, v) in zip(moving, cluster_sums(rows, moving)[0]):
            new = np.where(size[:, None] > 0, v / np.maximum(size, 1)[:, None], m.centroids)
            m.settled = float(((new - m.centroids) ** 2).sum()) <= limit
            m.centroids = new
    for m, inertia in zip(models, cluster_sums(rows, models)[1]):
        m.inertia = inertia
    return models


def settle(rows: DataFrame, model: Model) -> Model:
    """Lloyd's iterations without tolerance: afterwards each centroid is the mean of the rows nearest to it.

    The sum of squares falls with every row that changes its cluster, so no state comes
    back except through ties; a state met before ends the search.
    """
    met: set[bytes] = set()
    while (state := np.round(model.centroids, 10).tobytes()) not in met:
        met.add(state)
        [(size, v)], [model.inertia] = cluster_sums(rows, [model])
        model.centroids = np.where(size[:, None] > 0, v / np.maximum(size, 1)[:, None], model.centroids)
    return model


def best_starts(models: list[Model]) -> dict[int, Model]:
    """The start with the least inertia for each number of clusters, the first of equals."""
    out: dict[int, Model] = {}
    for m in models:
        if m.k not in out or m.inertia < out[m.k].inertia:
            out[m.k] = m
    return out


def silhouettes(rows: DataFrame, models: list[Model]) -> list[float]:
    """Exact mean cosine silhouette of each model in two passes: sums of unit vectors, then distances to them."""
    centroids = [m.centroids for m in models]

    def unit(x):
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length > 0, length, 1.0)

    def add(batches):
        n, total = [np.zeros(len(c), np.int64) for c in centroids], [np.zeros_like(c) for c in centroids]
        for x in _blocks(batches):
            u = unit(x)
            for m, c in enumerate(centroids):
                at = nearest(x, c)[0]
                n[m] += np.bincount(at, minlength=len(c))
                member = np.zeros((len(c), len(x)))
                member[at, np.arange(len(x))] = 1.0
                total[m] += member @ u
        for m, c in enumerate(centroids):
            yield _list_rows(model=np.full(len(c), m, np.int32), at=np.arange(len(c), dtype=np.int32), n=n[m], v=pa.array(list(total[m]), pa.list_(pa.float64())))

    merged = rows.mapInArrow(add, "model int, at int, n long, v array<double>").groupBy("model", "at")
    sums = [(np.zeros(len(c)), np.zeros_like(c)) for c in centroids]
    for r in merged.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect():
        sums[r["model"]][0][r["at"]], sums[r["model"]][1][r["at"]] = r["n"], r["v"]

    def score(batches):
        total, seen = np.zeros(len(centroids)), 0
        for x in _blocks(batches):
            u, seen = unit(x), seen + len(x)
            for m, c in enumerate(centroids):
                n, v = sums[m]
                at, here = nearest(x, c)[0], np.arange(len(x))
                dot = u @ v.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = np.where(n > 0, 1.0 - dot / n, np.inf)
                    own = (n[at] - dot[here, at]) / (n[at] - 1) + ((u * u).sum(1) - 1.0) / (n[at] - 1)
                mean[here, at] = np.inf
                other = mean.min(1)
                alone = (n[at] <= 1) | ~np.isfinite(other)
                total[m] += np.where(alone, 0.0, (other - own) / np.maximum(np.maximum(own, other), 1e-300)).sum()
        yield _list_rows(model=np.arange(len(centroids), dtype=np.int32), n=np.full(len(centroids), seen), total=total)

    mean = rows.mapInArrow(score, "model int, n long, total double").groupBy("model").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("s"))
    found = {r["model"]: r["s"] for r in mean.collect()}
    return [found[m] for m in range(len(models))]


def assigned(df: DataFrame, centroids: np.ndarray, name: str, vector: str = "embedding") -> DataFrame:
    """`df` plus the index of the nearest centroid, the first of equals."""
    shipped = df.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def place(vectors: pa.Array) -> pa.Array:
        at = [nearest(matrix(vectors.slice(i, ROWS)), shipped.value)[0] for i in range(0, len(vectors), ROWS)]
        return pa.array(np.concatenate(at) if at else [], pa.int32())

    return df.withColumn(name, place(F.col(vector)))
