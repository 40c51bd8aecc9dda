"""Survey frames as a stream: stateless confirmation and problem rules per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators import rules


def survey_rows(frames: DataFrame) -> DataFrame:
    return rules.flag_problems(rules.confirm_crack(frames))


def read_frames(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_survey(frames: DataFrame, out: str, checkpoint: str, heavy: Sequence[str] = ()) -> StreamingQuery:
    """Appends `samples` and `problems`; only problems keep the `heavy` columns.

    Each batch owns one folder that is overwritten on a retry, so a replayed batch
    leaves no duplicate rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        light = batch.drop(*heavy)
        light.write.mode("overwrite").parquet(f"{out}/samples/batch={batch_id}")
        batch.where("is_problem").write.mode("overwrite").parquet(f"{out}/problems/batch={batch_id}")
        batch.unpersist()

    return (
        survey_rows(frames)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay(df: DataFrame, path: str, by: str, key: str, slices: int = 3) -> None:
    """Writes the table as consecutive slices of `by`, one after the other, for a file stream.

    Within a slice a key stays in one file, so its rows arrive in slice order.
    """
    cuts = df.approxQuantile(by, [i / slices for i in range(1, slices)], 0.01)
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.where(F.col(by) > low)
        if high is not None:
            part = part.where(F.col(by) <= high)
        part.repartition(key).write.mode("append").parquet(path)
