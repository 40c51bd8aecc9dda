import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import knn
from kerbline.operators import ordered as O
from kerbline.operators.clusters import silhouette
from kerbline.operators.motion import trailing_variance


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}"
        value = None if rng.random() < 0.3 else rng.randrange(1000)
        data.append((key, rng.randrange(500), i, value))
    return spark.createDataFrame(data, "key string, t int, id int, v int").repartition(7).cache()


def ops():
    return dict(
        rn=O.row_number(), n=O.group_count(), prev=O.lag("v"), nxt=O.lead("v"), total=O.running_sum("v"),
        top=O.running_max("v"), last=O.last_valid("v"), fore=O.next_valid("v"), first=O.group_first("v"), most=O.group_max("v"),
    )


@pytest.mark.parametrize("keys", [("key",), ()])
def test_chunked_scan_equals_plain_window(rows, keys):
    order = ["t", "id"]
    plain = O.KeyProfile.of(rows, keys, max_rows=10**9).layout(rows, order)
    assert plain.splits is None
    cut = O.KeyProfile.of(rows, keys, max_rows=40).layout(rows, order)
    assert cut.splits is not None
    sizes = cut.chunk(rows).groupBy(*keys, "_chunk").count().agg(F.max("count")).first()[0]
    assert sizes < 200
    a = sorted(map(tuple, plain.scan(rows, **ops()).collect()), key=lambda r: r[2])
    b = sorted(map(tuple, cut.scan(rows, **ops()).collect()), key=lambda r: r[2])
    assert a == b


def test_exact_quantiles_both_ways(rows):
    want = {r["key"]: (r["p01"], r["med"]) for r in rows.groupBy("key").agg(
        F.percentile("v", 0.01).alias("p01"), F.percentile("v", 0.5).alias("med")).collect()}
    for limit in (10**9, 40):
        profile = O.KeyProfile.of(rows, ["key"], max_rows=limit)
        got = O.exact_quantiles(rows, ["key"], "v", {"p01": 0.01, "med": 0.5}, profile)
        for r in got.collect():
            assert (r["p01"], r["med"]) == pytest.approx(want[r["key"]])


def test_page_matches_slice(rows):
    ids = [r["id"] for r in rows.orderBy("t", "id").collect()]
    for offset in (0, 40, len(ids) - 5):
        assert [r["id"] for r in O.page(rows, ["t", "id"], offset, 10).collect()] == ids[offset : offset + 10]


def test_trailing_window_across_chunks(rows):
    keyed = rows.withColumn("k", (F.col("t") * 1000 + F.col("id") % 1000).cast("long"))
    aggs = dict(n=F.count("id"), s=F.sum("v"))
    plain = O.KeyProfile.of(keyed, ["key"], max_rows=10**9).layout(keyed, ["k"]).trailing(keyed, 7000, **aggs)
    cut = O.KeyProfile.of(keyed, ["key"], max_rows=40).layout(keyed, ["k"])
    assert cut.splits is not None
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.trailing(keyed, 7000, **aggs).collect()))


@pytest.fixture()
def small_tasks(spark):
    spark.conf.set("kerbline.maxRowsPerTask", "100")
    yield
    spark.conf.unset("kerbline.maxRowsPerTask")


def test_quantiles_of_tied_values_and_null_keys(spark, small_tasks):
    rows = [(None if i % 3 else "a", 7.0 if i % 4 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "session_id string, v double")
    got = {r["session_id"]: r for r in O.exact_quantiles(df, ["session_id"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.93}).collect()}
    for key in (None, "a"):
        values = [v for k, v in rows if k == key]
        for name, q in (("q1", 0.1), ("q5", 0.5), ("q9", 0.93)):
            assert got[key][name] == pytest.approx(np.quantile(values, q))


def test_null_keys_are_cut_into_chunks(spark, small_tasks):
    df = spark.range(1500).select(F.when(F.col("id") < 1400, F.lit(None)).otherwise(F.lit("b")).cast("string").alias("k"), "id")
    layout = O.KeyProfile.of(df, ["k"]).layout(df, ["id"])
    assert layout.chunk(df).groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 400
    got = layout.scan(df, s=O.running_sum("id"))
    assert all(r["s"] == (sum(range(r["id"] + 1)) if r["k"] is None else sum(range(1400, r["id"] + 1))) for r in got.collect())


def test_many_samples_in_one_millisecond(spark):
    rows = [("s", 0, i, float(i), 0.0, 0.0) for i in range(1500)] + [("s", 901, 1500 + i, float(i), 0.0, 0.0) for i in range(10)]
    imu = spark.createDataFrame(rows, "session_id string, utc_ms long, seq long, ax double, ay double, az double")
    last = trailing_variance(imu).where("seq = 1509").first()
    assert last["variance"] == pytest.approx(np.var(range(10), ddof=1))


def test_block_neighbours_keep_repeated_query_ids(spark):
    rng = np.random.default_rng(3)
    refs = [(i, f"p{i}", rng.normal(size=8).tolist()) for i in range(300)]
    asked = [(i % 40, i, rng.normal(size=8).tolist()) for i in range(160)]
    q = spark.createDataFrame(asked, "image_id long, n int, embedding array<double>")
    r = spark.createDataFrame(refs, "image_id long, path string, embedding array<double>")
    rows = lambda: sorted((x["n"], x["image_id"], [tuple(y) for y in x["neighbours"]]) for x in knn.knn(q, r, 5, payload=["path"]).collect())
    whole = rows()
    spark.conf.set("kerbline.maxBroadcastBytes", "1000")
    try:
        assert len(whole) == 160 and rows() == whole
    finally:
        spark.conf.unset("kerbline.maxBroadcastBytes")


def test_centroids_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    c = [(i, rng.normal(size=6).tolist()) for i in range(25)]
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(50)], "image_id long, embedding array<double>")
    centroids = spark.createDataFrame([*c, (30, c[3][1])], "cluster long, embedding array<double>")
    one = {r["image_id"]: r["kmeans_cluster"] for r in knn.nearest_centroid(df, centroids).collect()}
    monkeypatch.setattr(knn, "CENTROID_SLICE", 7)
    assert {r["image_id"]: r["kmeans_cluster"] for r in knn.nearest_centroid(df, centroids).collect()} == one


def test_silhouette_with_labels_in_slices(spark):
    rng = np.random.default_rng(6)
    rows = [(f"l{i % 9}" if i else "alone", rng.normal(size=5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "label string, embedding array<double>")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, far = np.array([r[0] for r in rows]), 1 - x @ x.T
    want = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        a, b = far[i, same].mean() if same.any() else 0, min(far[i, labels == o].mean() for o in set(labels) - {own})
        want.append((b - a) / max(a, b) if same.any() else 0.0)
    whole = silhouette(df, "label").first()[0]
    spark.conf.set("kerbline.maxBroadcastBytes", "120")
    try:
        assert whole == pytest.approx(np.mean(want)) and silhouette(df, "label").first()[0] == pytest.approx(whole)
    finally:
        spark.conf.unset("kerbline.maxBroadcastBytes")


def test_deep_pages_skip_whole_chunks(spark, rows, monkeypatch):
    """Every page of a cut table, across chunks, beyond the end, and where one value fills several chunks."""
    spark.conf.set("kerbline.maxRowsPerTask", "25")
    try:
        ids = [r["id"] for r in rows.orderBy("t", "id").collect()]
        for offset, limit in ((0, 10), (33, 40), (len(ids) // 2, 7), (len(ids) - 5, 10), (len(ids), 10), (5, 0), (0, len(ids))):
            assert [r["id"] for r in O.page(rows, ["t", "id"], offset, limit).collect()] == ids[offset : offset + limit]
        alike = rows.withColumn("same", F.lit(1))
        assert O.page(alike, ["same"], 100, 20).count() == min(20, max(0, len(ids) - 100))
    finally:
        spark.conf.unset("kerbline.maxRowsPerTask")


def test_next_valid_is_linear_in_the_group(spark):
    """A frame that ends with its partition would take minutes here."""
    df = spark.range(60_000).withColumn("v", F.when(F.col("id") % 20_000 == 19_999, F.col("id")))
    layout = O.KeyProfile.of(df).layout(df, ["id"])
    got = layout.scan(df, n=O.next_valid("v")).agg(F.sum("n"), F.count("n")).first()
    assert tuple(got) == (20_000 * (19_999 + 39_999 + 59_999), 60_000)
