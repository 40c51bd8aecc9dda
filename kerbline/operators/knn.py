"""Exact cosine top-k and the votes taken over it.

Neighbours come back as one array per query row, best first, so the votes are
column expressions on an array of k entries and need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions.vectors import l2_normalise
from kerbline.operators import kmeans
from kerbline.session import MAX_BROADCAST_BYTES, cut_lineage, int_setting
from kerbline.vocab import NON_ROAD_MAX_THRESHOLD, NON_ROAD_TARGET_PASS_RATE, VOTE_WEIGHT_FLOOR

# Similarities are compared at this many digits, so that two copies of a vector tie
# and the smaller reference id wins, whatever order the products were summed in.
SIM_DIGITS = 9
CELL_BUDGET = 4_000_000  # similarity cells held at once inside a task
CENTRE_BUDGET = 500_000  # rows times centres compared at once, in about ten arrays
BEST = "struct<sim: double, name: long>"
CENTROID_SLICE = 10_000  # centroids shipped to the tasks at once
BLOCK_ROWS = 8192  # rows per side of one unit in the partitioned plan
CENTRE_PASSES = 2  # passes that move the centres of reference cells
# Angles and similarities within these of a bound count as reaching it, as products are rounded.
ANGLE_SLACK, SIM_SLACK = 1e-6, 2e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64")
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return m / n


def _topk(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the k best references per query row.

    Every reference tied with the k-th best is kept until ids have broken the tie.
    """
    k = min(k, len(r))
    pos = np.empty((len(q), k), dtype=np.int64)
    sim = np.empty((len(q), k))
    step = max(1, CELL_BUDGET // max(1, len(r)))
    for a in range(0, len(q), step):
        s = np.round(q[a : a + step] @ r.T, SIM_DIGITS)
        kth = np.partition(s, len(r) - k, axis=1)[:, len(r) - k]
        for i, row in enumerate(s):
            near = np.flatnonzero(row >= kth[i])
            best = near[np.lexsort((ids[near], -row[near]))[:k]]
            pos[a + i], sim[a + i] = best, row[best]
    return pos, sim


def knn(
    query: DataFrame,
    reference: DataFrame,
    k: int = 10,
    *,
    vector: str = "embedding",
    r_id: str = "image_id",
    q_id: str = "image_id",
    payload: Sequence[str] = (),
    keep_vector: bool = False,
) -> DataFrame:
    """`query` plus `neighbours: array<struct<sim, ref, payload...>>`, best first.

    A reference side of checked size is shipped to the tasks once and the query
    side is not shuffled. A larger one is cut into cells of similar vectors, and a
    query only meets the cells that can hold one of its k nearest.
    """
    spark = query.sparkSession
    payload = list(payload)
    ref = reference.select(r_id, vector, *[c for c in payload if c != r_id])
    extra = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ref.columns if c != vector]
    size = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d"), F.sum(sum(extra, F.lit(0))).alias("rest")).first()
    out = query if keep_vector else query.drop(vector)
    names = ["sim", "ref", *payload]
    if (size["n"] or 0) * (size["d"] or 0) * 8 + (size["rest"] or 0) <= int_setting(spark, MAX_BROADCAST_BYTES):
        found = _knn_shipped(query, ref, out.columns, k, vector, r_id, payload)
    else:
        found = _knn_cells(query, ref, out.columns, k, vector, r_id, payload, size["n"], size["d"])
    zipped = F.arrays_zip(*[f"_n_{c}" for c in names])
    shaped = F.transform(zipped, lambda x: F.struct(*[x[f"_n_{c}"].alias(c) for c in names]))
    return found.select(*out.columns, shaped.alias("neighbours"))


def _list_fields(ref: DataFrame, r_id: str, payload: list[str]) -> list[T.StructField]:
    return [
        T.StructField("_n_sim", T.ArrayType(T.DoubleType())),
        T.StructField("_n_ref", T.ArrayType(ref.schema[r_id].dataType)),
        *[T.StructField(f"_n_{c}", T.ArrayType(ref.schema[c].dataType)) for c in payload],
    ]


def _knn_shipped(query, ref, keep, k, vector, r_id, payload) -> DataFrame:
    """Reference matrix in a broadcast variable; its size was checked by the caller."""
    spark = query.sparkSession
    local = ref.orderBy(r_id).toPandas()
    matrix = _unit(local[vector]) if len(local) else np.zeros((0, 1))
    shipped = spark.sparkContext.broadcast((matrix, {c: local[c].to_numpy() for c in [r_id, *payload]}))
    kept = list(keep)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, cols = shipped.value
        for batch in batches:
            if batch.empty or not len(r):
                continue
            pos, sim = _topk(_unit(batch[vector]), r, np.arange(len(r)), k)
            res = batch[kept].copy()
            res["_n_sim"] = list(sim)
            res["_n_ref"] = list(cols[r_id][pos])
            for c in payload:
                res[f"_n_{c}"] = list(cols[c][pos])
            yield res

    schema = T.StructType([query.schema[c] for c in kept] + _list_fields(ref, r_id, payload))
    return query.mapInPandas(score, schema)


# --- cells of a large reference side -------------------------------------------------------------


@dataclass
class Cells:
    """Centres of the reference cells, the angle that reaches every row of a cell, and how many rows it has.

    Rows without direction lie in a last cell of their own, which everything reaches.
    """

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def reach(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles of unit vectors to the centres, and the largest similarity that a row of each cell can have to them."""
        angle = np.concatenate([np.arccos(np.clip(unit @ self.centres.T, -1, 1)), np.zeros((len(unit), 1))], axis=1)
        best = np.cos(np.clip(angle - self.radius - ANGLE_SLACK, 0, np.pi))
        best[~unit.any(axis=1)] = 1.0
        return angle, np.where(self.rows > 0, best, -np.inf)


def _parts(batches: Iterator[pd.DataFrame], n_cells: int) -> Iterator[pd.DataFrame]:
    """The rows in parts whose comparison with all centres stays within CENTRE_BUDGET, however many cells there are."""
    step = max(1, CENTRE_BUDGET // max(1, n_cells))
    for batch in batches:
        for a in range(0, len(batch), step):
            yield batch.iloc[a : a + step]


def _home_cells(batches: Iterator[pd.DataFrame], cells: Cells, k: int, vector: str) -> Iterator[pd.DataFrame]:
    """Queries with the nearest cells that hold k rows, as `_home` and `_cells`."""
    for batch in _parts(batches, len(cells.rows)):
        angle, best = cells.reach(_unit(batch[vector]))
        order = np.argsort(np.where(np.isfinite(best), angle, np.inf), axis=1, kind="stable")
        held = np.cumsum(cells.rows[order], axis=1)
        count = (held < k).sum(axis=1) + 1
        # Copied, as a view would keep the order of all cells.
        home = [o[:n][cells.rows[o[:n]] > 0].astype("int32") for o, n in zip(order, count)]
        yield batch.assign(_kth=-2.0, _home=home, _cells=home)


def _other_cells(batches: Iterator[pd.DataFrame], cells: Cells, vector: str) -> Iterator[pd.DataFrame]:
    """Queries with the cells outside `_home` that can hold a row of at least similarity `_kth`, as `_cells`."""
    for batch in _parts(batches, len(cells.rows)):
        _, best = cells.reach(_unit(batch[vector]))
        found = [np.setdiff1d(np.flatnonzero(b >= t - SIM_SLACK), h) for b, t, h in zip(best, batch["_kth"].to_numpy(), batch["_home"])]
        yield batch.assign(_cells=[f.astype("int32") for f in found])


def _cells_of(ref: DataFrame, vector: str, n_ref: int, dim: int) -> tuple[DataFrame, Cells]:
    """The reference rows with their `_cell`, and the cells: as many as blocks of BLOCK_ROWS rows."""
    spark = ref.sparkSession
    limit = int_setting(spark, MAX_BROADCAST_BYTES) // (8 * max(dim, 1))
    h = F.xxhash64(vector)
    some = F.broadcast(ref.select(h.alias("_h")).distinct().orderBy("_h").limit(max(1, min(-(-n_ref // BLOCK_ROWS), limit))))
    picked = ref.withColumn("_h", h).join(some, "_h").select("_h", vector).dropDuplicates(["_h"]).orderBy("_h")
    centres = _unit(picked.toPandas()[vector])  # of checked size
    unit = ref.select(l2_normalise(F.col(vector)).cast("array<double>").alias("v"))
    for _ in range(CENTRE_PASSES):
        (size, total), = kmeans.cluster_sums(unit, [kmeans.Model(len(centres), 0, centres)])[0]
        length = np.linalg.norm(total, axis=1)
        centres = np.where((length > 0)[:, None], total / np.where(length > 0, length, 1.0)[:, None], centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches, len(centres)):
            x = _unit(batch[vector])
            near = np.clip(x @ centres.T, -1, 1)
            cell, some = near.argmax(axis=1), x.any(axis=1)
            yield batch.assign(_cell=np.where(some, cell, len(centres)).astype("int32"), _angle=np.where(some, np.arccos(near.max(axis=1)), np.pi))

    placed = cut_lineage(ref.mapInPandas(place, T.StructType([*ref.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])))
    rows, radius = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("a")).collect():
        rows[r["_cell"]], radius[r["_cell"]] = r["n"], r["a"]
    return placed.drop("_angle"), Cells(centres, radius, rows)


def _meet(asked: DataFrame, placed: DataFrame, cells: Cells, k: int, vector: str, r_id: str, payload: list[str]) -> DataFrame:
    """(`_row`, `_e`): of every cell in `_cells` the k best rows of at least similarity `_kth`.

    A cell meets its queries in units of at most about BLOCK_ROWS rows and queries.
    """
    spark = asked.sparkSession
    pairs = asked.select("_row", vector, "_kth", F.explode("_cells").alias("_cell"))
    visits = {r["_cell"]: r["n"] for r in pairs.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    units = [(c, -(-int(cells.rows[c]) // BLOCK_ROWS), -(-n // BLOCK_ROWS)) for c, n in visits.items()]
    sizes = F.broadcast(spark.createDataFrame(units, "_cell int, _subs int, _qbs int"))
    left = pairs.join(sizes, "_cell").select("_row", vector, "_kth", "_cell", F.pmod(F.xxhash64("_row"), F.col("_qbs")).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("_sub"))
    right = placed.join(sizes, "_cell").withColumn("_sub", F.pmod(F.xxhash64(r_id, vector), F.col("_subs")).cast("int"))
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in placed.columns if c != "_cell"], "_cell", "_sub", F.explode(F.sequence(F.lit(0), F.col("_qbs") - 1)).alias("_qb"))
    lists = _list_fields(placed, r_id, payload)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["_row", *[f.name for f in lists]]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        right = right.sort_values(f"_r_{r_id}")
        pos, sim = _topk(_unit(left[vector]), _unit(right[f"_r_{vector}"]), np.arange(len(right)), k)
        keep = [s >= t for s, t in zip(sim, left["_kth"].to_numpy())]
        res = left[["_row"]].copy()
        res["_n_sim"] = [s[m] for s, m in zip(sim, keep)]
        for c, values in (("ref", right[f"_r_{r_id}"].to_numpy()), *[(c, right[f"_r_{c}"].to_numpy()) for c in payload]):
            res[f"_n_{c}"] = [values[p[m]] for p, m in zip(pos, keep)]
        return res[cols]

    key = ["_cell", "_sub", "_qb"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, T.StructType([asked.schema["_row"], *lists]))
    names = [f.name for f in lists]
    entry = parts.select("_row", F.explode(F.arrays_zip(*names)).alias("_e"))
    return entry.select("_row", F.struct((-F.col("_e._n_sim")).alias("_neg"), F.col("_e._n_ref"), *[F.col(f"_e.{n}") for n in names if n != "_n_ref"]).alias("_e"))


def _top(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries per query, k at most from each unit."""
    return entries.groupBy("_row").agg(F.slice(F.sort_array(F.collect_list("_e")), 1, k).alias("_top"))


def _knn_cells(query, ref, keep, k, vector, r_id, payload, n_ref, dim, count_cells: str | None = None) -> DataFrame:
    """Exact neighbours from the reference cells that can hold them.

    A query first meets the nearest cells that hold k rows. Its k-th similarity there
    bounds the rest: by the triangle inequality on angles, no row of a cell is nearer
    than the angle to its centre less its radius, so cells beyond the bound are skipped.
    Query rows are told apart by a number of their own, as ids may repeat; it is stored
    with the rows, so that a rerun task meets the same one. With `count_cells` the
    number of cells that a query met is added under that name.
    """
    query = cut_lineage(query.withColumn("_row", F.monotonically_increasing_id()))
    placed, cells = _cells_of(ref, vector, n_ref, dim)
    fields = [query.schema["_row"], query.schema[vector]]
    schema = T.StructType([*fields, T.StructField("_kth", T.DoubleType()), T.StructField("_home", T.ArrayType(T.IntegerType())), T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _home_cells(batches, cells, k, vector)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _other_cells(batches, cells, vector)

    asked = cut_lineage(query.select("_row", vector).mapInPandas(near, schema))
    first = cut_lineage(_top(_meet(asked, placed, cells, k, vector, r_id, payload), k))
    kth = F.when(F.size("_top") >= k, -F.get("_top", F.lit(k - 1))["_neg"]).otherwise(-2.0)
    asked = cut_lineage(asked.drop("_kth").join(first.select("_row", kth.alias("_kth")), "_row").select(*[f.name for f in schema]).mapInPandas(rest, schema))
    second = _meet(asked, placed, cells, k, vector, r_id, payload)
    merged = _top(first.select("_row", F.explode("_top").alias("_e")).unionByName(second), k)
    if count_cells:
        merged = merged.join(asked.select("_row", (F.size("_home") + F.size("_cells")).alias(count_cells)), "_row")
    names = [f.name for f in _list_fields(ref, r_id, payload)]
    return query.join(merged, "_row").select(*keep, *[F.col(f"_top.{n}").alias(n) for n in names], *([count_cells] if count_cells else []))


def ranked(neighbours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per neighbour with its 1-based rank."""
    exploded = neighbours.select(*keys, F.posexplode("neighbours").alias("_p", "_n"))
    return exploded.select(*keys, (F.col("_p") + 1).alias("rank"), "_n.*")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean_similarity(neighbours: Column) -> Column:
    return _sum(F.transform(neighbours, lambda n: n["sim"])) / F.size(neighbours)


def similarity_shares(neighbours: Column, field: str) -> Column:
    """`array<struct<label, score>>` in order of first appearance; score = sum of max(sim, 0) + floor."""
    labels = F.array_distinct(F.transform(neighbours, lambda n: n[field]))
    return F.transform(
        labels,
        lambda lab: F.struct(
            lab.alias("label"),
            _sum(
                F.transform(
                    F.filter(neighbours, lambda n: n[field] == lab),
                    lambda n: F.greatest(n["sim"], F.lit(0.0)) + F.lit(VOTE_WEIGHT_FLOOR),
                )
            ).alias("score"),
        ),
    )


def _first_best(scored: Column) -> Column:
    """Entry with the largest score, the earliest on a tie."""
    top = F.array_max(F.transform(scored, lambda s: s["score"]))
    return F.element_at(F.filter(scored, lambda s: s["score"] == top), 1)


def similarity_vote(neighbours: Column, field: str) -> Column:
    return _first_best(similarity_shares(neighbours, field))["label"]


def vote_margin(neighbours: Column, field: str) -> Column:
    """`struct<label, margin, scores>`: normalised top share minus the second."""
    scored = similarity_shares(neighbours, field)
    total = F.greatest(_sum(F.transform(scored, lambda s: s["score"])), F.lit(1e-12))
    shares = F.transform(scored, lambda s: F.struct(s["label"].alias("label"), (s["score"] / total).alias("score")))
    ordered = F.sort_array(F.transform(shares, lambda s: s["score"]), asc=False)
    margin = F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))
    return F.struct(_first_best(shares)["label"].alias("label"), margin.alias("margin"), shares.alias("scores"))


def distance_vote(neighbours: Column, field: str) -> Column:
    """Weight 1 / cosine distance; exact copies take all the weight; ties go to the smallest label."""
    def distance(n: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - n["sim"])

    copies = F.exists(neighbours, lambda n: distance(n) == 0)

    def weight(n: Column) -> Column:
        exact = F.when(distance(n) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(copies, exact).otherwise(F.lit(1.0) / distance(n))

    labels = F.array_sort(F.array_distinct(F.transform(neighbours, lambda n: n[field])))
    scored = F.transform(
        labels,
        lambda lab: F.struct(
            lab.alias("label"),
            _sum(F.transform(F.filter(neighbours, lambda n: n[field] == lab), weight)).alias("score"),
        ),
    )
    return _first_best(scored)["label"]


def grade_tiles(neighbours: DataFrame, threshold: float | Column = NON_ROAD_MAX_THRESHOLD) -> DataFrame:
    """Similarity vote for quality and surface, with confidence and the non-road flag."""
    n = F.col("neighbours")
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        neighbours.withColumn("predicted_quality", similarity_vote(n, "quality"))
        .withColumn("predicted_surface", similarity_vote(n, "surface_type"))
        .withColumn("confidence", mean_similarity(n))
        .withColumn("non_road", F.col("confidence") < cut)
        .withColumn("nearest_neighbor", F.element_at(n, 1)["ref"])
        .withColumn("nearest_similarity", F.element_at(n, 1)["sim"])
    )


def pseudo_label_accepted(
    mean_cosine: Column,
    surface_margin: Column,
    quality_margin: Column,
    min_cosine: float = 0.80,
    min_surface: float = 0.10,
    min_quality: float = 0.08,
) -> Column:
    return (mean_cosine >= min_cosine) & (surface_margin >= min_surface) & (quality_margin >= min_quality)


def nearest_centroid(df: DataFrame, centroids: DataFrame, *, vector: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """Adds `kmeans_cluster`, the first centroid with the largest inner product.

    Centroids are shipped in slices of bounded size, each improving on the best so far.
    """
    spark = df.sparkSession
    rows = centroids.select(cluster, vector).orderBy(cluster).toLocalIterator()
    out = df.withColumn("_best", F.lit(None).cast(BEST))
    for some in batched(rows, CENTROID_SLICE):
        shipped = spark.sparkContext.broadcast((np.array([r[vector] for r in some], dtype="float64"), np.array([r[cluster] for r in some], dtype="int64")))
        out = out.withColumn("_best", _better_centroid(shipped)(vector, "_best"))
    return out.withColumn("kmeans_cluster", F.col("_best.name")).drop("_best")


def _better_centroid(shipped):
    @F.pandas_udf(BEST)
    def assign(vectors: pd.Series, best: pd.DataFrame) -> pd.DataFrame:
        matrix, names = shipped.value
        sim = np.round(_unit(vectors) @ matrix.T, SIM_DIGITS)
        at = np.argmax(sim, axis=1)
        top = sim[np.arange(len(at)), at]
        before = best["sim"].to_numpy(dtype="float64", na_value=-np.inf)
        old = before >= top  # the earlier slice holds the smaller names
        name = np.where(old, best["name"].fillna(0).to_numpy(dtype="int64"), names[at])
        return pd.DataFrame({"sim": np.where(old, before, top), "name": name})

    return assign


def calibrated_threshold(mean_cosine: DataFrame, value: str = "mean_cosine") -> DataFrame:
    """One row `threshold`: the allowed-failure order statistic of the values, capped.

    The failure count uses the same double expression as the published rule, where
    1 - 0.95 is slightly more than 0.05.
    """
    from kerbline.operators.ordered import KeyProfile, group_count, row_number

    rows = mean_cosine.select(value)
    scanned = KeyProfile.of(rows).layout(rows, [value]).scan(rows, _rn=row_number(), _n=group_count())
    allowed = F.greatest(F.lit(0), F.ceil(F.lit(1.0 - NON_ROAD_TARGET_PASS_RATE) * F.col("_n")) - 1)
    picked = scanned.where(F.col("_rn") - 1 == allowed).agg(F.min(value).alias("_v"))
    cap = F.lit(NON_ROAD_MAX_THRESHOLD)
    return picked.select(F.coalesce(F.least(cap, F.col("_v")), cap).alias("threshold"))
