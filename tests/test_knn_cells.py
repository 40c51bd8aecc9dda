"""Pruned neighbours against all pairs."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators import knn as K


def plain(q, r, ids, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    s = np.round(unit(q) @ unit(r).T, K.SIM_DIGITS)
    return [[(int(ids[j]), float(row[j])) for j in sorted(range(len(r)), key=lambda j: (-row[j], ids[j]))[:k]] for row in s]


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    r = np.concatenate([c + rng.normal(0, 0.05, (40, 8)) for c in centres])
    r = np.concatenate([r, np.repeat(r[:1], 150, axis=0), np.zeros((3, 8)), r[5:8] * 3])  # copies, no direction, other lengths
    q = np.concatenate([centres, rng.normal(size=(20, 8)), r[:4], np.zeros((2, 8))])
    ids = rng.permutation(len(r))
    ref = spark.createDataFrame([(int(i), v.tolist(), f"s{i % 3}") for i, v in zip(ids, r)], "image_id long, embedding array<double>, surface_type string")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "image_id long, embedding array<double>")
    return q, r, ids, query, ref


@pytest.mark.parametrize("k", [1, 10, 60, 2000])
def test_cells_give_the_neighbours_of_all_pairs(spark, sides, monkeypatch, k):
    q, r, ids, query, ref = sides
    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    spark.conf.set("kerbline.maxBroadcastBytes", "4000")
    try:
        rows = K.knn(query, ref, k, payload=["surface_type"]).orderBy("image_id").collect()
    finally:
        spark.conf.unset("kerbline.maxBroadcastBytes")
    want = plain(q, r, ids, min(k, len(r)))
    assert [[(n["ref"], n["sim"]) for n in row["neighbours"]] for row in rows] == [[(i, pytest.approx(s, abs=2e-9)) for i, s in w] for w in want]
    assert all(n["surface_type"] == f"s{n['ref'] % 3}" for row in rows for n in row["neighbours"])


def test_most_cells_are_skipped(sides, monkeypatch):
    _, r, _, query, ref = sides
    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    out = K._knn_cells(query.where("image_id < 12"), ref.where(F.col("image_id") >= 0), ["image_id"], 10, "embedding", "image_id", [], len(r), 8, count_cells="cells_read")
    read = [row["cells_read"] for row in out.collect()]
    assert len(read) == 12 and np.mean(read) < 0.5 * (-(-len(r) // 32))


def test_memory_for_choosing_cells_does_not_grow_with_their_number():
    rng = np.random.default_rng(2)
    peaks = []
    for n in (100, 2000):
        centres = rng.normal(size=(n, 8))
        cells = K.Cells(centres / np.linalg.norm(centres, axis=1, keepdims=True), np.full(n + 1, 0.01), np.full(n + 1, 4))
        asked = pd.DataFrame({"_row": range(4000), "embedding": list(rng.normal(size=(4000, 8)))})
        tracemalloc.start()
        rows = 0
        for part in K._home_cells([asked], cells, 10, "embedding"):
            (rest,) = K._other_cells([part.assign(_kth=0.9)], cells, "embedding")
            assert all(not set(h) & set(c) for h, c in zip(rest["_home"], rest["_cells"]))
            rows += len(rest)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert rows == 4000
    assert max(peaks) < 100  # 4,000 rows by 2,000 centres are 64 MB in each array
