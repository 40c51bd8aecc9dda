"""One query per operator over the given tables; documents take the place of assessment rationales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import archives, disclosure, drawing, encoding, exact, negatives, packing, passages, resampling, search, similar, windows, wrappers
from kerbline.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def assessments(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "frame_index", "text": "rationale"})


def documents(out: DataFrame) -> DataFrame:
    return out.withColumnsRenamed({"frame_index": "doc_id", "rationale": "text"})


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("frame_index"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"))


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessments(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(windows.drop_repeated_windows(_given(spark, sf_dir)).drop("kept_text"))


@_query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(passages.drop_repeated_passages(_given(spark, sf_dir)).drop("kept_bytes"))


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(disclosure.find_disclosures(_given(spark, sf_dir)))


@_query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(similar.near_duplicates(_given(spark, sf_dir)))


@_query
def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(encoding.encode_rationales(_given(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")))


@_query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(packing.pack_sequences(_given(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))


@_query
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a doc_id divisible by 20, whole texts as queries, searched in all documents."""
    docs = _given(spark, sf_dir)
    asked = docs.filter(F.col("frame_index") % 20 == 0).select(F.col("frame_index").alias("query_id"), F.col("rationale").alias("query"))
    return documents(search.search_rationales(docs, asked))


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(resampling.resample_quality(_given(spark, sf_dir), reviews(spark, sf_dir)))


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(exact.exact_duplicates(_given(spark, sf_dir)))


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the place of frames: address as source, html as details; the archive is read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = work_path(spark, "archive")
    archives.write_archive(pages.withColumnsRenamed({"page_id": "frame_index", "url": "source_path", "html": "tile_details"}), path, kind="text/html; charset=utf-8")
    records = archives.read_archive(spark, path, payloads=False)
    return records.select(F.col("frame_index").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@_query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("rationale"))
    return documents(drawing.draw_rationales(_given(spark, sf_dir), target))


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; the labels of every seventh are shifted by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnsRenamed({"vec_id": "image_id"})
    shifted = F.when(F.col("image_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(vectors.withColumn("surface_type", shifted), F.col("image_id") % 100 == 0)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

ORACLE["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), s AS (
  SELECT t, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN s USING (t)
"""

ORACLE["op11_warc"] = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY body) AS last_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
"""

ORACLE["op12_target_resampling"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelled AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
), bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS b
  FROM spelled, crc
), held AS (
  SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN bucket USING (w) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM held
), weights AS (
  SELECT id AS doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM words JOIN bucket USING (w) JOIN gains USING (b) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

ORACLE["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v AS a JOIN v AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
