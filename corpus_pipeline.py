"""A training corpus from `documents` in five stages, each written and read again by the next.

Part of the training-data operators (`kerbline.llm`): every stage is one of them, with the
documents in the place of assessments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import disclosure, exact, packing, resampling, similar
from kerbline.llm.queries import assessments, documents, reviews, tokenizer_file
from kerbline.session import work_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return documents(resampling.keep_quality(assessments(docs), reviews(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return documents(exact.drop_exact_duplicates(assessments(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts."""
    return documents(similar.drop_near_duplicates(assessments(docs)))


def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced in their text."""
    return documents(disclosure.sanitize(assessments(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 2048 tokens."""
    return documents(packing.pack_sequences(assessments(docs), tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", clean_personal_data),
    ("best-fit packing", pack),
]

#: Tokenizers and fitted models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
