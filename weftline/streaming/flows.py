"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.sinks import append_new


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def resumed_append(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append rows by key exactly once: offsets are checkpointed, and a repeated batch finds its keys there."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, path, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; state is dropped once the watermark passes, so it stays bounded."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, event_time: str, by: list[str], aggs: list[Column], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling windows with late rows up to ``delay``."""
    if stream.schema[event_time].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    out = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *by, *[c for c in out.columns if c not in ("window", *by)])


def gated(stream: DataFrame, reasons: Column) -> DataFrame:
    """The rows with their reasons and ok, for a sink partitioned by ok."""
    return stream.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available now, as a table; for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class Heartbeat(StreamingQueryListener):
    """Keeps each batch's number, rows and rate."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
