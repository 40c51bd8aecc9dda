"""Session settings, checkpointing and size checks shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Sizes above which an operator leaves its small-side plan. Both can be set per session.
MAX_ROWS_PER_TASK = ("kerbline.maxRowsPerTask", 2_000_000)
MAX_BROADCAST_BYTES = ("kerbline.maxBroadcastBytes", 64 * 1024 * 1024)


def build_session(app: str = "kerbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `master` stays unset on a cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Recording a call site per column expression costs seconds on plans with thousands of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def int_setting(spark: SparkSession, setting: tuple[str, int]) -> int:
    key, default = setting
    return int(spark.conf.get(key, str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    A machine-local folder is made only when nothing is set and the master is
    local, i.e. in tests.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="kerbline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
