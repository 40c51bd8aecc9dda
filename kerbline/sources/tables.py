"""Table hand-over between stages: Parquet, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("surface_type", T.StringType()),
        T.StructField("quality", T.ByteType()),
        T.StructField("split", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reader chosen by suffix; text formats want a schema so nothing is inferred from the data."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    if path.endswith((".jsonl", ".json")):
        return reader.json(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith((".jsonl", ".json")):
        writer.json(path)
    else:
        writer.parquet(path)
