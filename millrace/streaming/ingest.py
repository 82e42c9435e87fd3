"""Event ingest as streams: redelivery, validation, attribution, export, retention.

Every run names its checkpoint folder; given the same one again it continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.events import checked_events, first_installs, with_owner
from millrace.session import new_path

Result = TypeVar("Result")
#: Slices of event time in which a backlog is replayed, unless the caller names another number.
SLICES = 4


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream.

    ``per_batch`` bounds the bytes of a micro-batch. Files come in the order in which they were written, so use a bound only
    where that is also the order of event time, or where no watermark is set; a backlog goes through ``replayed``.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", str(per_batch))
    return reader.parquet(folder)


def replayed(backlog: DataFrame, time: str, run: Callable[[DataFrame, str], Result], slices: int = SLICES) -> Result:
    """Feed a backlog of any order to a stream, oldest event first; the result of the last ``run``.

    A watermark takes what follows newer events for late, and the files of a backlog follow each other in any order. So the
    backlog is written by slices of event time, and each slice, once it is in the watched folder, is one micro-batch of
    ``run(stream, checkpoint)``, which processes all that is there and returns. No event of a slice is older than the slices before it, so
    none is late, whatever their number; choose it so that the cluster can hold the state of one slice. Events of equal time
    share a slice; those without a time are in the first. A replay that broke off starts anew.
    """
    spark = backlog.sparkSession
    staged, folder, checkpoint = (new_path(spark, n) for n in ("replay-slices", "replay-feed", "replay-state"))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    shares = [i / slices for i in range(1, slices)]
    ends = backlog.agg(F.percentile_approx(at, shares, 10_000).alias("e")).first()["e"] if shares else None
    number = sum((F.coalesce(at > end, F.lit(False)).cast("int") for end in ends or []), F.lit(0))
    sliced = backlog.withColumn("_slice", number)
    sliced.write.partitionBy("_slice").parquet(staged)
    kept = spark.read.schema(sliced.schema).parquet(staged)
    for i in range(slices):
        kept.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(folder)
        result = run(file_stream(spark, folder, "*.parquet", backlog.schema), checkpoint)
    return result


def run_available(stream: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything now available into parquet files and return what the files hold."""
    spark = stream.sparkSession
    checkpoint = checkpoint or new_path(spark, "stream-state")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append"
) -> None:
    """Hand every micro-batch to ``handle``; a batch can come twice, so ``handle`` must overwrite by batch number."""
    spark = stream.sparkSession
    checkpoint = checkpoint or new_path(spark, "stream-state")
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()


def without_redeliveries(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """One copy of every event; keys are remembered for ``within`` of event time, so state stays bounded."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def validated(stream: DataFrame, rules: dict[str, Column], good: str, bad: str, checkpoint: str | None = None) -> None:
    """Split valid and rejected records to two folders, one sub-folder per batch."""
    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("rejected is null").drop("rejected").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("rejected is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    run_batches(checked_events(stream, rules), handle, checkpoint)


def attributed_batches(stream: DataFrame, path: str, batch: str = "batch_id", checkpoint: str | None = None) -> DataFrame:
    """All records so far with the install id of their upload, whichever micro-batches the upload spans.

    A micro-batch writes its records and, per upload, the first install record it holds. The firsts are combined when the
    result is read, so an install record that arrives last still names the owner of the records before it.
    """
    def handle(df: DataFrame, n: int) -> None:
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{path}/records/part={n}")
        first_installs(df, batch).write.mode("overwrite").parquet(f"{path}/firsts/part={n}")
        df.unpersist()

    run_batches(stream, handle, checkpoint)
    read = stream.sparkSession.read
    firsts = read.parquet(f"{path}/firsts").groupBy(batch).agg(F.min("_first").alias("_first"))
    return with_owner(read.parquet(f"{path}/records").drop("part"), firsts, batch)


def upserted_cells(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str | None = None) -> DataFrame:
    """Changed aggregate cells per batch; the newest batch wins when read back."""
    spark = stream.sparkSession
    run_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, "update")
    cells = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return cells.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def purge_days(spark: SparkSession, path: str, keep_from: str, target: str) -> DataFrame:
    """Retention on a day-partitioned table: whole day folders are left out, so only kept days are read and written."""
    kept = spark.read.parquet(path).where(F.col("day") >= keep_from)
    kept.write.mode("overwrite").partitionBy("day").parquet(target)
    return spark.read.parquet(target)
