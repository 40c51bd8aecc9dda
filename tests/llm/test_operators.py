"""Every operator against a plain computation over a small table with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.llm import components, disclosure, encoding, exact, packing, passages, queries, resampling, search, similar, suffixes, tokens, windows, wrappers
from kerbline.llm import text as tx
from kerbline.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdeé"), RNG.integers(1, 8))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


BASE, SHARED = prose(120), prose(60)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " "), (4, BASE.replace(" ", "\n", 3)), (5, BASE + " tail end"), (6, prose(40) + " " + SHARED + " " + prose(30)),
    (7, prose(10) + "\t" + SHARED), (8, None), (9, ""), (9, ""), (None, prose(20)), (None, SHARED), (10, "one two"), (11, "ONE two"), (12, "x" * 3000),
    (13, "ab" * 1500), (14, prose(3000)), (15, " \n\t "), (16, SHARED + " " + SHARED), (17, "Call +44 20 7946 0958 or mail joe.q@example.org, 10.0.0.255, 4111 1111 1111 1111"),
    (18, "a <|endoftext|> b"), (18, "another under the same key"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, "extra", i) for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "frame_index long, rationale string, block string, id int")


@pytest.fixture(scope="module")
def empty(table):
    return table.filter("false")


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def expected(rows):
    return sorted(map(str, rows))


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_repeated_windows(spark, table, empty):
    width = 12
    words = [WORD.findall(t or "") for _, t in TEXTS]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    want = []
    for (key, _), w in zip(TEXTS, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        want.append([key, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))])
    got = windows.drop_repeated_windows(table, window=width)
    assert sorted(str(list(r)) for r in got.drop("kept_text").collect()) == expected(want)
    assert windows.drop_repeated_windows(empty).count() == 0


@pytest.mark.parametrize("common", [20_000, 0])
def test_repeated_passages(spark, table, empty, monkeypatch, common):
    monkeypatch.setattr(passages, "ANCHORED", common)
    length = 100
    raw = [(t or "").encode() for _, t in TEXTS]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    want = []
    for (key, _), t in zip(TEXTS, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append([key, len(t), sum(gone), spans, sha(bytes(x for x, g in zip(t, gone) if not g))])
    got = passages.drop_repeated_passages(table, length=length)
    assert sorted(str(list(r)) for r in got.drop("kept_bytes").collect()) == expected(want)
    assert passages.drop_repeated_passages(empty).count() == 0


def test_suffix_order_finds_equal_windows():
    base = RNG.integers(97, 102, 3000).astype(np.uint8).tobytes()
    pieces = [base[i : i + n] for i, n in zip(RNG.integers(0, 2000, 40), RNG.integers(400, 700, 40))]
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    seen = Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
    got = suffixes.repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), at, 400)
    assert got.tolist() == [seen[p[i : i + 400]] > 1 for p in pieces for i in range(len(p) - 399)]


def test_personal_data(spark, table, empty):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(text):
        out = []
        for k, pattern in enumerate(kinds):
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and disclosure.luhn(d), 9 <= len(d) <= 15][k]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    for _ in range(3000):
        text = "".join(RNG.choice(["a", "1", "4111111111111111", "@", ".", "-", " ", "+", "(", "é", "b.c", "255", "x@y.z", "+44 20 ", "7", "\n"], RNG.integers(0, 20)))
        assert disclosure.base_spans(text) == plain(text)
    got = {r["frame_index"]: r for r in disclosure.find_disclosures(table).collect()}
    assert [got[17][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[8]["spans"] == "" and got[8]["base_sha256"] == sha("")
    assert disclosure.find_disclosures(table).count() == len(TEXTS) and disclosure.find_disclosures(empty).count() == 0
    clean = disclosure.sanitize(table)
    assert clean.columns == table.columns and clean.count() == len(TEXTS)
    assert clean.filter("frame_index = 17").first()["rationale"] == "Call <phone> or mail <email>, <ip>, <card>"


def test_disclosing_terms(spark):
    told = [(i, f"write to quarryman at boss@example.org about job {i}") for i in range(5)]
    rest = [(100 + i, f"write to someone about job {i}") for i in range(200)]
    df = spark.createDataFrame(told + rest, "frame_index long, rationale string")
    got = {r["frame_index"]: r["spans"] for r in disclosure.find_disclosures(df).collect()}
    assert "remove:9:18" in got[0] and "email:22:38" in got[0] and "write" not in told[0][1][9:18]
    assert all(not got[k] for k, _ in rest)


def test_terms_beside_an_entity_of_one_document(spark):
    rows = [(0, "write to quarryman at boss@example.org about job")] + [(1 + i, f"write to someone at home about job {i}") for i in range(400)]
    got = {r["frame_index"]: r["spans"] for r in disclosure.find_disclosures(spark.createDataFrame(rows, "frame_index long, rationale string")).collect()}
    assert got[0] == "generalise:9:18,email:22:38" and not any(got[i] for i in range(1, 401))


def test_disclosing_terms_anywhere(spark):
    far = " ".join(f"filler{j}" for j in range(9))
    rows = [(i, f"mail boss@example.org {far} and then quarryman {i}") for i in range(40)] + [(40, "here the quarryman alone")]
    rows += [(100 + i, f"mail then and {far} here the alone {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "frame_index long, rationale string")
    got = {r["frame_index"]: r["spans"] for r in disclosure.find_disclosures(df).collect()}
    at = rows[0][1].index("quarryman")
    assert f"{at}:{at + 9}" in got[0] and got[40].endswith(":9:18") and not any(got[100 + i] for i in range(4000))
    clean = {r["frame_index"]: r["rationale"] for r in disclosure.sanitize(df).collect()}
    assert "quarryman" not in clean[40] + clean[0] and clean[100] == rows[41][1] and len(clean) == len(rows)


def test_near_duplicates(spark, table, empty):
    sets = []
    for _, t in TEXTS:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(TEXTS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(TEXTS)):
        groups[find(i)].append(TEXTS[i][0])
    least = {i: min((k for k in g if k is not None), default=None) for i, g in groups.items()}
    want = [[k, len(s), least[find(i)]] for i, ((k, _), s) in enumerate(zip(TEXTS, sets))]
    got = similar.near_duplicates(table)
    assert sorted(str(list(r)) for r in got.collect()) == expected(want)
    assert similar.near_duplicates(empty).count() == 0
    kept = similar.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert kept.filter("frame_index IN (2, 3, 4, 5)").count() == 0 and kept.filter("frame_index = 1").count() == 1


def test_encoding(spark, table, empty):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    encoder = Encoder.of(path)
    want = []
    for key, t in TEXTS:
        ids = encoder.tok.encode(t or "", add_special_tokens=False).ids
        want.append([key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(encoder.tok.decode(ids, skip_special_tokens=False))])
    got = encoding.encode_rationales(table, path, leaf=64)
    assert sorted(str(list(r)) for r in got.collect()) == expected(want)
    assert encoding.encode_rationales(empty, path).count() == 0


def test_tree_concatenation():
    encoder = Encoder.of(queries.tokenizer_file("byte_bpe_50k.json"))
    parts = ["a", "the", "é", "中", "'s", "'ll", "'", "!!", "12", "<|endoftext|>", "<|endof", "ing", "tion", " ", "\n", "𝒳"]
    for _ in range(1500):
        text = "".join(RNG.choice(parts, RNG.integers(5, 90)))
        leaves = encoding.halves(text, ["<|endoftext|>"], int(RNG.integers(2, 12)))
        assert "".join(leaves) == text
        assert encoding.tree([encoder.ids(x) for x in leaves], encoder).tolist() == encoder.ids(text).tolist()


def test_packing(spark, table, empty):
    path = queries.tokenizer_file("word_bpe_49k.json")
    encoder = Encoder.of(path)
    rows = packing.pack_sequences(table, path, capacity=64).collect()
    want = []
    for key, t in TEXTS:
        ids = np.array(encoder.tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(key, i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for i, s in enumerate(range(0, len(ids), 64))]
    assert sorted(str(tuple(r)[:5]) for r in rows) == expected(want)
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used[r["sequence_id"]] == r["offset"]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64 and len(used) <= 1.05 * sum(used.values()) / 64 + 1
    assert packing.pack_sequences(empty, path).count() == 0


def test_packing_plan_covers_every_rank():
    lengths = np.minimum(2048, RNG.lognormal(6.3, 1.0, 20_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.Plan.best(counts, 2048)
    used, ranks = np.zeros(plan.next, int), defaultdict(list)
    for length, lo, hi, first, offset in sorted(plan.placed, key=lambda p: p[4]):
        assert (used[first : first + hi - lo] == offset).all()
        used[first : first + hi - lo] += length
        ranks[length] += range(lo, hi)
    assert used.max() <= 2048 and all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    assert plan.next <= 1.01 * lengths.sum() / 2048 + 1


def test_exact_duplicates(spark, table, empty):
    normal = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS]
    groups = defaultdict(list)
    for (key, t), n in zip(TEXTS, normal):
        groups[n].append((-len(t or ""), key is None, key or 0, key))
    want, done = [], set()
    for (key, t), n in zip(TEXTS, normal):
        best = min(groups[n])
        kept = (-len(t or ""), key) == (best[0], best[3]) and n not in done
        if kept:
            done.add(n)
        want.append([key, best[3], len(groups[n]), kept, sha(n)])
    got = exact.exact_duplicates(table)
    assert sorted(str(list(r)) for r in got.collect()) == expected(want)
    assert exact.exact_duplicates(empty).count() == 0
    kept = exact.drop_exact_duplicates(table)
    assert kept.columns == table.columns and kept.count() == len(groups)


def test_quality(spark, empty):
    good = [(i, prose(60)) for i in range(200)]
    bad = [(1000 + i, " | ".join(w + "%%%" for w in prose(60).split())) for i in range(60)]
    df = spark.createDataFrame([*good, *bad, (5000, None), (None, prose(30))], "frame_index long, rationale string").withColumn("kept", df_lit())
    reviews = spark.createDataFrame([(k, True) for k, _ in good[:150]] + [(k, False) for k, _ in bad[:30]] + [(None, True), (3, None)], "frame_index long, accepted boolean")
    got = {r["frame_index"]: r["kept"] for r in resampling.resample_quality(df, reviews).collect()}
    assert sum(got[k] for k, _ in good) >= 190 and not any(got[k] for k, _ in bad) and 5000 in got
    again = resampling.keep_quality(df, reviews)
    assert again.columns == df.columns and {r["frame_index"] for r in again.collect()} == {k for k, v in got.items() if v}
    assert all(r["kept"] for r in resampling.resample_quality(df, reviews.filter("false")).collect())
    assert resampling.resample_quality(df.filter("false"), reviews).count() == 0


def test_quality_sees_a_few_bad_words(spark):
    rude = {i for i in range(600) if i % 7 == 0}
    shared = " ".join(f"notice{j}" for j in range(12))  # in many rationales, none of them reviewed
    rows = []
    for i in range(600):
        words = prose(120).split()
        if i in rude:
            words[5 + i % 100] = "grot" + "ab"[i % 2]
        elif i >= 400 and i % 3 == 0:
            words[50:50] = shared.split()
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "frame_index long, rationale string")
    reviews = spark.createDataFrame([(i, i not in rude) for i in range(400)], "frame_index long, accepted boolean")
    got = {r["frame_index"]: r for r in resampling.resample_quality(df, reviews).collect()}
    assert not any(got[i]["kept"] for i in rude)
    plain = [i for i in got if i not in rude and "notice1" not in rows[i][1]]
    assert sum(got[i]["kept"] for i in plain) >= 0.98 * len(plain)
    # word_excess by plain counting
    fit = {r["frame_index"]: r["target"] for r in resampling.reviewed_sample(reviews, "frame_index", "accepted").filter("fit").collect()}
    sets = {i: set(t.split()) for i, t in rows}
    rate = sum(fit.values()) / len(fit)

    def ratio(w):
        holders = [i for i in fit if w in sets[i]]
        return np.log(sum(fit[i] for i in holders) + 1) - np.log(len(holders) * rate + 1)

    model = resampling.fit_ratio(df, reviews)
    held = [i for i in range(400) if i not in rude and i not in fit]
    assert model.word_cut == pytest.approx(np.quantile([min(map(ratio, sets[i])) for i in held], resampling.SUSPECT), abs=1e-6)
    for i in (7, 14, 3, 402):
        assert got[i]["word_excess"] == pytest.approx(sum(min(0, ratio(w) - model.word_cut) for w in sets[i]), abs=1e-6)


def test_quality_keeps_a_clean_text_with_many_copies(spark):
    rows = [(i, prose(60)) for i in range(300)]
    rare = " ".join(f"clean{j}" for j in range(12))  # words that no reviewed rationale holds
    copied = prose(48) + " " + rare
    rows += [(1000 + i, copied) for i in range(150)]
    rows += [(2000 + i, " | ".join(w + "%%%" for w in prose(60).split())) for i in range(40)]
    reviews = spark.createDataFrame([(i, True) for i in range(200)] + [(2000 + i, False) for i in range(20)], "frame_index long, accepted boolean")

    def scores(some):
        got = resampling.resample_quality(spark.createDataFrame(some, "frame_index long, rationale string"), reviews).collect()
        return {r["frame_index"]: r["log_ratio"] for r in got}

    many, one = scores(rows), scores([r for r in rows if not 1000 < r[0] < 2000])
    assert many[1000] == one[1000] and many[5] == one[5]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_texts_that_occur_once_are_not_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(resampling, "REPEAT_BITS", bits)
    texts = [prose(5 + i % 7) + f" w{i}" for i in range(300)] + ["copy one", "Copy one"] * 20 + [None, "", "copy two", "copy two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "frame_index long, rationale string").repartition(6)
    alone, again = ([r["rationale"] for r in part.collect()] for part in resampling.split_repeated(df, "rationale"))
    texts = [t or "" for t in texts]
    assert sorted(alone + again) == sorted(texts)
    assert all(texts.count(t) == 1 for t in alone)
    if bits > 64:
        assert sorted(again) == sorted(t for t in texts if texts.count(t) > 1)


def test_packing_encodes_a_few_megabytes_at_once():
    import pyarrow as pa

    class Letters:
        most = 0

        def encode(self, texts):
            raw, at = texts.to_pylist(), [0]
            Letters.most = max(Letters.most, sum(map(len, raw)))
            for t in raw:
                at.append(at[-1] + len(t) // 1000)
            return np.arange(at[-1], dtype=np.uint32), np.array(at)

    texts = ["a" * 500_000] * 30 + [None, "b" * 9_000_000]
    batch = pa.RecordBatch.from_pydict({"frame_index": list(range(32)), "rationale": texts})
    rows = [r for part in packing._pieces([batch], Letters(), 2048, 0, "frame_index", "rationale") for r in part.to_pylist()]
    assert Letters.most == 9_000_000  # one text is never cut
    lengths = {i: sum(r["length"] for r in rows if r["frame_index"] == i) for i in range(32)}
    assert lengths == {i: len(t or "") // 1000 + 1 for i, t in enumerate(texts)}
    Letters.most = 0
    assert len(list(packing._pieces([batch.slice(0, 31)], Letters(), 2048, 0, "frame_index", "rationale"))) >= 4 and Letters.most <= 4 << 20


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")


def test_threshold_is_the_kth_largest(spark, monkeypatch):
    values = RNG.normal(size=5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "sample_key double")
    for k in (1, 77, 5000):
        assert resampling._threshold(df, k) == sorted(values)[-k]


@pytest.mark.parametrize("size", [24 << 20, 200])
def test_search(spark, table, empty, monkeypatch, size):
    monkeypatch.setattr(tx, "SLICE_BYTES", size)
    monkeypatch.setattr(tx.slices, "__defaults__", (size,))
    asked = spark.createDataFrame([(1, SHARED), (2, None), (3, "one one two " + VOCABULARY[3])], "query_id long, query string")
    docs = [Counter(WORD.findall((t or "").lower())) for _, t in TEXTS]
    mean = sum(map(Counter.total, docs)) / len(docs)
    want = []
    for q, text in ((1, SHARED), (3, "one one two " + VOCABULARY[3])):
        scores = []
        for (key, _), d in zip(TEXTS, docs):
            s = 0.0
            for t, n in Counter(text.lower().split()).items():
                df = sum(t in x for x in docs)
                s += n * np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * d.total() / mean))
            if s > 0:
                scores.append((-round(s, 6), key is None, key or 0))
        want += [(q, i + 1, s[0]) for i, s in enumerate(sorted(scores)[:5])]
    got = search.search_rationales(table, asked, k=5).collect()
    assert sorted((r["query_id"], r["rank"], -round(r["score"], 6)) for r in got) == want
    assert search.search_rationales(empty, asked).count() == 0 and search.search_rationales(table, asked.filter("false")).count() == 0


def test_search_asks_whole_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows = [(i, prose(int(RNG.integers(5, 200)))) for i in range(239)] + [(240, prose(30)), (241, "rare word"), (None, "rare word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = [Counter(t.lower().split()) for _, t in rows]
    frequency, mean = Counter(w for d in docs for w in d), sum(map(Counter.total, docs)) / len(docs)
    want = []
    for (q, _), asked in zip(rows, docs):
        if q is not None and q % 20 == 0:
            scores = []
            for (key, _), d in zip(rows, docs):
                s = sum(m * np.log(1 + (len(docs) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / mean)) for w, m in asked.items())
                scores.append((-s, key is None, key or 0))
            want += [(q, i + 1, s[2]) for i, s in enumerate(sorted(s for s in scores if s[0])[:10])]
    got = queries.QUERIES["op8_topk_search"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(want)


def test_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(tx, "release", lambda: calls.append(1))

    def rows(batches):
        yield from batches

    assert list(tx.lean(rows)(iter([1, 2]))) == [1, 2] and len(calls) == 1
    next(partial := tx.lean(rows)(iter([1, 2])))
    partial.close()
    assert len(calls) == 2
    assert tx.lean(lambda block: block + 1)(1) == 2 and tx.lean(lambda block, told: block + told)(1, 2) == 3 and len(calls) == 4


def test_search_of_a_block_reads_shared_words_at_once(monkeypatch):
    monkeypatch.setattr(search, "SHARED", 2)
    texts = [f"all {'common ' * (i % 3)}w{i % 7} w{i % 4}" for i in range(60)] + ["all common w1", "all common w1"]
    asked = ["all common w1", "all all w2 w9", "common", "nowhere", ""]
    shard = search.Shard(search.packed_shard(pa.array(range(62, 0, -1)), pa.array(texts, pa.large_string())), 4.0)
    words = [sorted(Counter(t.split()).items()) for t in asked]
    place = {w: i for i, w in enumerate(shard.terms.to_pylist())}
    bounds = np.cumsum([0, *map(len, words)])
    term, weight = np.array([place.get(w, -1) for q in words for w, _ in q]), np.array([n / (1 + i) for q in words for i, (_, n) in enumerate(q)])
    for q, (score, doc) in zip(words, shard.top(bounds, term, weight, 5), strict=True):
        want = []
        for i, t in enumerate(texts):
            d = Counter(t.split())
            s = sum(n / (1 + j) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / 4.0)) for j, (w, n) in enumerate(q))
            want += [(-round(s, 9), 62 - i, i)] if s else []
        assert list(zip(-score, doc)) == [(s, i) for s, _, i in sorted(want)[:5]]


@pytest.mark.parametrize("settings", [{}, {"TILE": 4, "QUERY_TILE": 2}, {"TILE": 4, "FEW": 0, "ENTRIES": 1}, {"TILE": 8, "FEW": 0, "ENTRY": 0, "KINDS": 2}, {"FEW": 1, "ENTRY": 10**9, "QUERY_TILE": 3}])
def test_search_keeps_the_best_from_shard_to_shard(monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    prose = lambda n, words: " ".join(rng.choice(VOCABULARY[words], n))
    texts = [prose(int(rng.integers(1, 40)), slice(0, 40) if i % 2 else slice(200, 240)) for i in range(44)] + ["", "abc " * 30] + [prose(9, slice(0, 40))] * 6
    keys = pa.array([None if i % 17 == 3 else 100 - i for i in range(len(texts))], pa.int64())
    asked = [*texts[:9], texts[-1], "", "nowhere"]
    docs = [Counter(t.split()) for t in texts]
    frequency, mean = Counter(w for d in docs for w in d), sum(map(Counter.total, docs)) / len(docs)
    ids = pa.array(range(len(asked)), pa.int64())
    message = search.packed_queries(ids, ids, pa.array(asked, pa.large_string()))
    known = [w for w in search.unpacked(message)["terms"].to_pylist() if w in frequency]
    block, k = search.Block(message, pa.array(known, pa.string()), np.array([frequency[w] for w in known], np.int64), len(texts)), 5
    for start in range(0, len(texts), 13):
        block.meet(search.Shard(search.packed_shard(keys.slice(start, 13), pa.array(texts[start : start + 13], pa.large_string())), mean), k)
        assert len(block.row) <= k * len(asked)
    got = sorted(zip(block.ids.take(pa.array(block.row)).to_pylist(), -block.score, [key is None for key in block.key.to_pylist()], [key or 0 for key in block.key.to_pylist()]))
    want = []
    for q, text in enumerate(asked):
        scores = []
        for key, d in zip(keys.to_pylist(), docs):
            s = sum(m * np.log(1 + (len(docs) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / mean)) for w, m in sorted(Counter(text.split()).items()) if w in d)
            scores += [(q, -round(s, 9), key is None, key or 0)] if s else []
        want += sorted(scores)[:k]
    assert [(q, round(s, 7), *key) for q, s, *key in got] == [(q, round(s, 7), *key) for q, s, *key in want]


def test_search_leaves_out_what_cannot_reach_the_floor(monkeypatch):
    message = search.packed_queries(pa.array([1, 2]), pa.array([1, 2]), pa.array(["red green blue", "blue grey"], pa.large_string()))
    known = search.unpacked(message)["terms"]
    block, scored = search.Block(message, known, np.array([2] * len(known)), 20), []
    monkeypatch.setattr(search.Shard, "by_document", lambda self, docs, full=search.Shard.by_document: scored.append(len(docs)) or full(self, docs))
    for texts in (["red green blue"] * 3 + ["blue grey"] * 3, ["red pink"] * 6, ["one two"] * 6):
        block.meet(search.Shard(search.packed_shard(pa.array(range(6)), pa.array(texts, pa.large_string())), 3.0), 3)
    assert scored == [6, 0, 0] and block.row.tolist() == [0, 0, 0, 1, 1, 1]


def test_pages(spark):
    def page(i, body, tail=""):
        return f"<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><a href=/>menu {i}</a></nav><div class='ad'>buy {i}</div><div class=c>{body}<div id='comments'>reply {i}</div></div><footer>&copy; {i}</footer>{tail}"

    rows = [(i, "http://h.example/a" + str(i), page(i, f"<h1>Head {i}</h1><p>first &amp;  {i}\n line<p><b>second {i}", "</body></html>" * (i % 2))) for i in range(6)]
    rows += [(10, "http://one.example/", "<article><p>alone &lt;</article><aside>x</aside>"), (11, None, "plain text"), (12, "http://h.example/z", None), (12, "http://h.example/z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(list)
    for r in wrappers.extract_main_text(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["Head 3\nfirst & 3 line\nsecond 3"]
    assert got[10] == ["alone <"] and got[11] == ["plain text"] and got[12] == ["", ""]
    assert wrappers.extract_main_text(df.filter("false")).count() == 0


def test_tree_matching_keeps_order():
    tree = lambda html: wrappers.grown(wrappers.skeleton(wrappers.parse(html)))[4][0]
    a, b = tree("<div><p></p><ul><li></li></ul><p></p></div>"), tree("<div><p></p><p></p><table></table></div>")
    assert wrappers.match_trees(a, b)[0] == 3


def plain_match(a, b):
    """The textbook recurrence without any shortcut."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[4]) + 1) for _ in range(len(a[4]) + 1)]
    for i, x in enumerate(a[4]):
        for j, y in enumerate(b[4]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(x, y))
    return 1 + best[-1][-1]


def test_tree_matching_against_the_plain_recurrence():
    def page(depth):
        return "".join(f"<{t}>{page(depth - 1)}</{t}>" for t in RNG.choice(["div", "span", "section"], RNG.integers(0, 4))) if depth else "x"

    for _ in range(40):
        a, b = (wrappers.grown(wrappers.skeleton(wrappers.parse(page(4)))) for _ in range(2))
        size, pairs = wrappers.match_trees(a, b)
        assert size == plain_match(a, b) == len(pairs) and all(x[0] == y[0] for x, y in pairs)


def test_pages_of_5000_levels(spark):
    deep = lambda i: "<html><body>" + "<div>" * 5000 + f"<p>words of page {i}" + "</div>" * 5000 + "</body></html>"
    rows = [(i, f"http://deep.example/{i}", deep(i)) for i in range(3)] + [(7, "http://deep.example/7", "<html><body><div><p>short</div></body></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in wrappers.extract_main_text(df).collect()) == [(i, f"words of page {i}") for i in range(3)] + [(7, "short")]


def test_components_of_large_row_numbers(spark):
    """The sum of the row numbers of these links is beyond 64 bits; each chain of four is one component."""
    n = 500_000
    at = lambda c: (F.col("id") * 4 + c + (1 << 62)).alias("x")
    links = None
    for i in range(3):
        part = spark.range(n).select(at(i).alias("a"), at(i + 1).alias("b"))
        links = part if links is None else links.unionAll(part)
    out = components.components(links, "a", "b")
    assert out.count() == 4 * n and out.filter(F.col("root") != F.col("node") - F.pmod(F.col("node"), F.lit(4))).isEmpty()


def test_packed_numbers():
    values = np.unique(RNG.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (tx.unpack(tx.pack(values)) == values).all() and not len(tx.unpack(tx.pack(values[:0])))
    codes, at, distinct = tx.words(pa.array(["a  b c\td", "", " "], pa.large_string()))
    assert [distinct[c].as_py() for c in codes] == ["a", "b c", "d"] and at.tolist() == [0, 3, 3, 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("cache", [0, 50, 400_000])
def test_encoder_deals_ids_of_joined_chunks_back(monkeypatch, name, cache):
    """Ids equal the library's, whatever is remembered and however chunks are run together."""
    monkeypatch.setattr(tokens, "CACHE", cache)
    monkeypatch.setattr(tokens, "RUN", 7)
    monkeypatch.setattr(tokens, "BATCH", 3)
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "　", "é", "́", "'s", "<|endoftext|>", "|>", "7", "!!", "\U0001f600", "中", "İ", "\x00", "word "]
    texts = ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600))]
    encoder = tokens.Encoder(queries.tokenizer_file(name))
    for own in (texts, texts[::-1], []):
        ids, at = encoder.encode(tx.plain(pa.array(own, pa.large_string())))
        want = [encoder.tok.encode(t, add_special_tokens=False).ids for t in own]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
