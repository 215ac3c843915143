"""Replication of a change log by Structured Streaming: ordered, idempotent, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def replicate(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 64, available_now: bool = True) -> StreamingQuery:
    """Copy the log at source to target, each sequence once.

    A batch is one folder named by its number and overwritten if the batch is
    repeated after a failure; the stream's checkpoint keeps what was read.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["sequence"]).sortWithinPartitions("sequence").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def replica(spark: SparkSession, target: str) -> DataFrame:
    """What arrived so far, each sequence once."""
    return spark.read.parquet(target).drop("batch").dropDuplicates(["sequence"])


def replica_state(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest entry of each record in the replica."""
    rows = replica(spark, target)
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "sequence").alias("r"))
    return newest.select(key, *[f"r.{c}" for c in rest])


def guarded(stream: DataFrame, key: str, stamp: str, delay: str = "1 hour") -> DataFrame:
    """Replay guard over a stream: the first of each key within the watermark."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def materialise(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """A background writer: each batch transformed and appended, once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
