"""Manifest building: statistics, unions, splits, balanced and stratified selection.

Random choices become the order of an md5 hash, so membership is reproducible on
any engine; the per-stratum counts follow the published rules exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.operators.ordered import KeyProfile, group_count, row_number
from kerbline.session import cut_lineage


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def label_totals(df: DataFrame, labels: str = "labels", names: Sequence[str] = tuple(vocab.LABEL_VOCAB)) -> DataFrame:
    """Rows carrying each label, zero-filled, in one pass."""
    one = df.agg(*[F.count_if(F.array_contains(labels, n)).alias(f"_{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"_{i}").alias("rows")) for i, n in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in `order`; combines map-side, so a key of many copies is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def union_manifests(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Parts by name; of rows with the same key the one from the earliest part stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, keys, ["_part", *order]).drop("_part")


def append_new(existing: DataFrame, incoming: DataFrame, key: str = "image_path") -> DataFrame:
    """Existing rows plus incoming ones whose key is not there yet."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def augmented_manifest(base: DataFrame, pseudo: DataFrame) -> DataFrame:
    cols = ["image_path", "source_dataset", "surface_type", "quality", "split"]
    return base.select(*cols).unionByName(pseudo.select(*cols))


def composite_codes(df: DataFrame, order: str, label: Column | None = None) -> DataFrame:
    """Adds `composite` and its integer code by first appearance."""
    name = label if label is not None else F.concat_ws("__q", "surface_type", F.col("quality").cast("string"))
    rows = df.withColumn("composite", name)
    firsts = rows.groupBy("composite").agg(F.min(order).alias("_first"))
    coded = KeyProfile.of(firsts).layout(firsts, ["_first"]).scan(firsts, _rn=row_number())
    codes = coded.select("composite", (F.col("_rn") - 1).alias("code"))
    return rows.join(codes, "composite")


def _hash_order(df: DataFrame, id_column: str) -> DataFrame:
    return df.withColumn("_h", F.md5(F.col(id_column).cast("string")))


def split_bounds(n: Column) -> tuple[Column, Column]:
    """End ranks of train and val for a stratum of n rows."""
    train = F.greatest(F.lit(1), F.rint(0.70 * n).cast("bigint"))
    val = F.greatest(F.lit(1), F.rint(0.15 * n).cast("bigint"))
    tight = train + val >= n
    t = F.when(tight, F.greatest(F.lit(1), n - 2)).otherwise(train)
    v = t + F.when(tight, F.lit(1)).otherwise(val)
    return F.when(n <= 2, F.lit(1)).otherwise(t), F.when(n == 1, F.lit(1)).when(n == 2, F.lit(2)).otherwise(v)


def stratified_split(df: DataFrame, strata: Sequence[str], id_column: str = "image_path") -> DataFrame:
    """70/15/15 per stratum in hash order, with the small-stratum rules."""
    rows = _hash_order(df, id_column)
    s = KeyProfile.of(df, strata).layout(rows, ["_h", id_column]).scan(rows, _rn=row_number(), _n=group_count())
    train, val = split_bounds(F.col("_n"))
    split = F.when(F.col("_rn") <= train, "train").when(F.col("_rn") <= val, "val").otherwise("test")
    return s.withColumn("split", split).drop("_h", "_rn", "_n")


def proportional_quotas(groups: DataFrame, keys: Sequence[str], target: Column, count: str = "n") -> DataFrame:
    """Adds `quota`: `target` rows shared out by group size, the rest by largest fraction.

    `groups` has one row per stratum; `target` may use `_total`, the sum of all sizes.
    """
    total = groups.agg(F.sum(count).alias("_total")).withColumn("_k", F.lit(1))
    g = groups.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    share = F.col(count) / F.col("_total").cast("double") * target.cast("double")
    g = g.withColumn("_target", target.cast("bigint")).withColumn("_floor", F.floor(share)).withColumn("_neg", F.floor(share) - share)
    given = g.agg(F.sum("_floor").alias("_given")).withColumn("_k", F.lit(1))
    g = g.withColumn("_k", F.lit(1)).join(F.broadcast(given), "_k").drop("_k")
    s = KeyProfile.of(g).layout(g, ["_neg", *keys]).scan(g, _rn=row_number())
    extra = F.when(F.col("_rn") <= F.col("_target") - F.col("_given"), 1).otherwise(0)
    quota = F.least(F.col("_floor") + extra, F.col(count))
    return s.withColumn("quota", quota.cast("bigint")).drop("_rn", "_neg", "_floor", "_given", "_target", "_total")


def _take_quota(df: DataFrame, strata: Sequence[str], target: Column, id_column: str) -> DataFrame:
    """Adds `_chosen` for the quota of each stratum, in hash order."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    quotas = proportional_quotas(sizes, strata, target).select(*strata, "quota")
    rows = _hash_order(df, id_column)
    s = KeyProfile.of(df, strata).layout(rows, ["_h", id_column]).scan(rows, _rn=row_number())
    return s.join(quotas, list(strata)).withColumn("_chosen", F.col("_rn") <= F.col("quota")).drop("_h", "_rn", "quota")


def holdout_split(df: DataFrame, strata: Sequence[str] = ("surface_type", "quality"), flag: str | None = "train", id_column: str = "image_path") -> DataFrame:
    """Train rows by flag, the rest halved; 70/15/15 without a flag or without a holdout.

    The halves are stratified when every holdout stratum has two rows.
    """
    strata = list(strata)
    if flag is not None:
        is_train = F.coalesce(F.lower(F.col(flag).cast("string")).isin("true", "1", "yes"), F.lit(False))
        marked = df.withColumn("_train", is_train)
        held = marked.where(~F.col("_train")).drop("_train", flag)
        smallest = held.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"), F.sum("n").alias("n")).first()
        if smallest["n"]:
            train = marked.where("_train").drop("_train", flag).withColumn("split", F.lit("train"))
            keys = strata if smallest["m"] >= 2 else ["_one"]
            base = held if smallest["m"] >= 2 else held.withColumn("_one", F.lit(1))
            halves = _take_quota(base, keys, F.floor(F.col("_total") * 0.5), id_column)
            halves = halves.withColumn("split", F.when(F.col("_chosen"), "val").otherwise("test")).drop("_chosen", "_one")
            return train.unionByName(halves)
        df = df.drop(flag)
    first = _take_quota(df, strata, F.floor(F.col("_total") * 0.70), id_column)
    train = first.where("_chosen").drop("_chosen").withColumn("split", F.lit("train"))
    rest = first.where(~F.col("_chosen")).drop("_chosen")
    halves = _take_quota(rest, strata, F.floor(F.col("_total") * 0.5), id_column)
    return train.unionByName(halves.withColumn("split", F.when(F.col("_chosen"), "val").otherwise("test")).drop("_chosen"))


def select_for_embedding(df: DataFrame, none_cap: int, strata: Sequence[str] = ("source_dataset", "domain", "split"), id_column: str = "image_path") -> DataFrame:
    """All rows with a defect label plus a proportional sample of the pure-`none` rows.

    Quotas share `none_cap` out over the strata by largest remainder. Rows without a value
    in one of the strata have no quota; where quotas leave the sample short, it is filled
    up from all `none` rows not taken yet, in hash order.
    """
    positive = F.arrays_overlap("labels", F.array(*map(F.lit, vocab.DEFECT_LABELS)))
    pure_none = F.coalesce((F.size(F.array_distinct("labels")) == 1) & F.array_contains("labels", "none"), F.lit(False))
    hits = df.where(positive).withColumn("selected_reason", F.lit("defect_positive"))
    known = reduce(and_, [F.col(c).isNotNull() for c in strata])
    pool = df.where(pure_none)
    taken = cut_lineage(_take_quota(pool.where(known), strata, F.lit(none_cap), id_column))
    rest = taken.where("NOT _chosen").drop("_chosen").unionByName(pool.where(~known))
    none = taken.where("_chosen").drop("_chosen")
    short = none_cap - none.count()
    if short > 0:
        spare = _hash_order(rest, id_column)
        spare = KeyProfile.of(spare).layout(spare, ["_h", id_column]).scan(spare, _rn=row_number())
        none = none.unionByName(spare.where(F.col("_rn") <= short).select(*none.columns))
    return hits.unionByName(none.select(*df.columns).withColumn("selected_reason", F.lit("pure_none_subset")))


def cap_per_class(df: DataFrame, label: str, max_rows: int, id_column: str = "image_path") -> DataFrame:
    """At most max_rows // 2 rows per class in hash order, once the table exceeds max_rows."""
    rows = _hash_order(df, id_column)
    s = KeyProfile.of(df, [label]).layout(rows, ["_h", id_column]).scan(rows, _rn=row_number())
    total = df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_k", F.lit(1))
    s = s.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    return s.where((F.col("_total") <= max_rows) | (F.col("_rn") <= max_rows // 2)).drop("_h", "_rn", "_total")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Best `cap` rows per group; the rank filter runs before the shuffle as well as after it."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= cap)


def round_robin(ranked: DataFrame, group: str, limit: int, rank: str = "rank_in_group") -> DataFrame:
    """One row per group and round, groups in name order, until `limit`."""
    return ranked.orderBy(rank, group).limit(limit)
