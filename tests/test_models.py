"""k-means in shared passes, and head training, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import clusters, heads, kmeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)[:, :6] * 4 + 1
    x = np.concatenate([c + rng.normal(0, 0.1, (30, 6)) for c in centres])
    x = np.concatenate([x, x[:20]])  # copies
    split = np.where(np.arange(len(x)) % 4 == 3, "val", "train")
    rows = [(i, str(s), v.tolist(), i % 7) for i, (s, v) in enumerate(zip(split, x))]
    return x, split, spark.createDataFrame(rows, "image_id long, split string, embedding array<double>, v int")


def plain_lloyd(x, centroids, limit):
    while True:
        at = kmeans.distances(x, centroids).argmin(1)
        new = np.array([x[at == i].mean(0) if (at == i).any() else c for i, c in enumerate(centroids)])
        moved, centroids = ((new - centroids) ** 2).sum(), new
        if moved <= limit:
            return centroids


def plain_silhouette(x, at):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    out = []
    for i in range(len(x)):
        own = (at == at[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][at == c].mean() for c in set(at) - {at[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_search_finds_the_blobs_and_scores_every_count(blobs):
    x, split, df = blobs
    out, centroids, scores = clusters.kmeans_search(df, F.col("split") == "train", (2, 5, 6, 9), starts=4)
    rows = {r["image_id"]: r["kmeans_cluster"] for r in out.collect()}
    at = np.array([rows[i] for i in range(len(x))])
    assert list(scores) == [2, 5, 6, 9] and max(scores, key=scores.get) == 6 == centroids.count()
    assert all(len(set(at[i * 30 : i * 30 + 30])) == 1 for i in range(6)) and len(set(at)) == 6
    train = split == "train"
    assert scores[6] == pytest.approx(plain_silhouette(x[train], at[train]), abs=1e-9)
    assert out.columns == [*df.columns, "kmeans_cluster"]


def test_all_starts_move_as_each_would_alone_and_partitions_do_not_matter(blobs):
    x, _, df = blobs
    rows = df.select(F.col("embedding").alias("v"))
    seeds = kmeans.seeded(rows, (3, 7), 3, 5)
    again = kmeans.seeded(rows.repartition(5), (3, 7), 3, 5)
    assert all(np.array_equal(a.centroids, b.centroids) for a, b in zip(seeds, again))
    limit = kmeans.TOLERANCE * x.var(0).mean()
    fitted = kmeans.fit(rows, (3, 7), 3, seed=5)
    assert [(m.k, m.start) for m in fitted] == [(k, s) for k in (3, 7) for s in range(3)]
    for first, m in zip(seeds, fitted):
        alone = plain_lloyd(x, first.centroids, limit)
        np.testing.assert_allclose(m.centroids, alone, atol=1e-9)
        assert m.inertia == pytest.approx(kmeans.distances(x, alone).min(1).sum())
    best = kmeans.best_starts(fitted)
    assert all(best[m.k].inertia <= m.inertia for m in fitted)
    equal = [kmeans.Model(2, s, np.zeros((2, 1)), 1.0) for s in range(2)]
    assert kmeans.best_starts(equal)[2].start == 0


def test_few_or_equal_rows(spark, blobs):
    df = spark.createDataFrame([(i, "train", [1.0, 2.0]) for i in range(12)], "image_id long, split string, embedding array<double>")
    out, centroids, _ = clusters.kmeans_search(df, F.col("split") == "train", (2, 30), starts=2)
    assert {r["kmeans_cluster"] for r in out.collect()} == {0} and centroids.count() == 2
    with pytest.raises(ValueError, match="train rows"):
        clusters.kmeans_search(df, F.col("split") == "none", (2,))
    assert [clusters.first_best(s) for s in ({5: 0.1, 8: 0.3, 10: 0.3}, {5: 0.3, 8: 0.1})] == [8, 5]
    assert clusters.survey_clusters(blobs[2], starts=2).agg(F.count_distinct("cluster")).first()[0] == 10


@pytest.fixture(scope="module")
def crossed(spark):
    """Labels that no linear head can tell: the product of two signs; and one that follows a single sign."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (900, 2))
    y = np.stack([(x[:, 0] * x[:, 1] > 0), (x[:, 0] > 0)], 1).astype(int)
    split = np.where(np.arange(900) % 3 == 2, "val", "train")
    return spark.createDataFrame([(i, str(s), v.tolist(), *map(int, t)) for i, (s, v, t) in enumerate(zip(split, x, y))], "image_id int, split string, embedding array<float>, y_a int, y_b int")


def test_step_follows_the_slope():
    rng = np.random.default_rng(3)
    x, y, positive = rng.normal(size=(20, 4)), (rng.random((20, 2)) > 0.7).astype(float), np.array([2.0, 0.5])
    state = heads.fresh(4, 8, 2, 1)
    base = state.weights.copy()

    def loss(weights):
        return heads.step(heads.State(state.shape, weights.copy(), state.first * 0, state.second * 0), x, y, positive, 1e-3, 0.0, 0.0, rng)

    eps, slope = 1e-6, np.zeros_like(base)
    for i in range(len(base)):
        up, down = base.copy(), base.copy()
        up[i], down[i] = up[i] + eps, down[i] - eps
        slope[i] = (loss(up) - loss(down)) / (2 * eps)
    heads.step(state, x, y, positive, 1e-3, 0.0, 0.0, rng)
    np.testing.assert_allclose(state.first, 0.1 * slope, atol=1e-7)


@pytest.mark.parametrize("rows_per_task", [10_000, 200])
def test_hidden_layer_learns_what_is_not_linear(crossed, monkeypatch, rows_per_task):
    monkeypatch.setattr(heads, "ROWS_PER_TASK", rows_per_task)
    scored, trained = heads.train_heads(crossed, ["a", "b"], F.col("split") == "train", F.col("split") == "val", hidden=32, epochs=12, batch=16, rate=1e-2, dropout=0.0, patience=12)
    aps = [h["val_macro_ap"] for h in trained.history]
    assert max(aps) > 0.95 and trained.best_epoch == aps.index(max(aps)) + 1
    assert scored.count() == 900 and scored.columns[-2:] == ["p_a", "p_b"]
    hits = scored.where("split = 'val'").select(*[F.avg(((F.col(f"p_{x}") >= trained.thresholds[x]).cast("int") == F.col(f"y_{x}")).cast("int")) for x in "ab"]).first()
    assert min(hits) > 0.9


def test_training_ends_without_progress(crossed):
    _, trained = heads.train_heads(crossed, ["a", "b"], F.col("split") == "train", F.col("split") == "val", hidden=4, epochs=9, rate=0.0, patience=2)
    assert trained.best_epoch == 1 and len(trained.history) == 3
    with pytest.raises(ValueError, match="validation"):
        heads.train_heads(crossed, ["a"], F.col("split") == "train", F.lit(False))


def test_survey_clusters_leave_no_row_nearer_to_another_mean(spark):
    x = np.random.default_rng(3).normal(0, 1, (3000, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, embedding array<float>").repartition(3)
    rows = clusters.survey_clusters(df, starts=1).select("embedding", "cluster").collect()
    v, at = np.array([r["embedding"] for r in rows], float), np.array([r["cluster"] for r in rows])
    means = np.array([v[at == c].mean(0) for c in range(12)])
    d = kmeans.distances(v, means)
    assert (d[np.arange(len(v)), at] <= d.min(1) + 1e-9).all()


def test_sums_of_a_pass_are_merged_in_few_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 50))
    models = [kmeans.Model(k, 0, rng.normal(size=(k, 50))) for k in (3, 200)]  # more numbers than one block holds
    models[1].centroids[7] = models[1].centroids[3]  # of equals the first
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    sums, inertia = kmeans.cluster_sums(rows, models)
    for m, (n, total), spread in zip(models, sums, inertia):
        d = kmeans.distances(x, m.centroids)
        at = d.argmin(1)
        assert n.tolist() == np.bincount(at, minlength=m.k).tolist()
        assert total == pytest.approx(np.array([x[at == i].sum(0) for i in range(m.k)]), abs=1e-9)
        assert spread == pytest.approx(d.min(1).sum())
    assert -(-sum(m.k * 51 + 1 for m in models) // kmeans.BLOCK) == 2
