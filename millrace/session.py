"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def build_session(master: str | None = None, app: str = "millrace", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` wins over the defaults."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` decides. Only a local-mode session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a driver-local path would be lost on the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the result outlives lost executors and fixes non-deterministic partition numbers."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a fresh table in the shared folder: for results that several reads start from."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, up_to_bytes: int = SMALL_BYTES) -> bool:
    """Whether the planner's size estimate stays below ``up_to_bytes``."""
    return estimated_bytes(df) <= up_to_bytes


def spread(df: DataFrame, up_to_bytes: int = SMALL_BYTES) -> DataFrame:
    """Give a small table as many partitions as there are cores, for work that is heavy per row.

    A table in one small file would otherwise be one task. The planner's size estimate is checked first: above
    ``up_to_bytes`` the scan has plenty of splits of its own and nothing is shuffled.
    """
    if not is_small(df, up_to_bytes):
        return df
    parts = df.sparkSession.sparkContext.defaultParallelism
    # By row number, not round robin: the same rows go to the same task on a retry without sorting every partition first.
    return df.withColumn("_at", F.monotonically_increasing_id()).repartition(parts, "_at").drop("_at")


@contextmanager
def reread(df: DataFrame, up_to_bytes: int = SMALL_BYTES) -> Iterator[DataFrame]:
    """For work in several passes: a small table is spread and kept while the block runs, a large one is scanned again."""
    if not is_small(df, up_to_bytes):
        yield df
        return
    kept = spread(df, up_to_bytes).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a local table. Only for results whose size is set by a schema, such as one row per column."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
