"""Every stage of the corpus pipeline against a plain computation on what its predecessor kept."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from kerbline.llm import disclosure, resampling
from kerbline.llm.queries import assessments, reviews

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Rows before the first stage and after each, as the run writes and reads them."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        tables.append(docs)
    return tables


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(chain):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    for df in chain[:-1]:
        assert df.columns == chain[0].columns and df.count() > 0


def test_quality_keeps_what_the_operator_keeps(spark, chain):
    before, after = by_id(chain[0]), by_id(chain[1])
    judged = resampling.resample_quality(assessments(chain[0]), reviews(spark, SF))
    assert set(after) == {r["frame_index"] for r in judged.collect() if r["kept"]} and all(after[i] == before[i] for i in after)


def test_one_of_equal_texts_stays(chain):
    before, after = by_id(chain[1]), by_id(chain[2])
    groups = defaultdict(list)
    for i, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), i))
    assert set(after) == {min(g)[1] for g in groups.values()} and all(after[i] == before[i] for i in after)


def test_one_of_similar_texts_stays(chain):
    before, after = by_id(chain[2]), by_id(chain[3])
    sets = {}
    for i, r in before.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert set(after) == {i for i in ids if find(i) == i} and all(after[i] == before[i] for i in after)


def test_personal_data_is_gone_and_every_document_stays(chain):
    before, after = by_id(chain[3]), by_id(chain[4])
    assert set(after) == set(before)
    dirty = [i for i, r in before.items() if disclosure.base_spans(r["text"] or "")]
    assert dirty and all(after[i]["text"] != before[i]["text"] for i in dirty)
    for i in dirty:
        values = {before[i]["text"][a:b] for a, _, b in disclosure.base_spans(before[i]["text"])}
        assert not any(v in after[i]["text"] for v in values)


def test_packing_holds_every_document_once(chain):
    docs, pieces = by_id(chain[4]), chain[5].collect()
    of, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append((p["piece"], p["start"], p["length"]))
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(of) == set(docs)
    for parts in of.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at)
            at += length
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_an_empty_table_goes_through(spark, chain):
    docs = chain[0].filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
