"""Polling jobs as Structured Streaming: file arrival, de-duplicated events, windows, due work in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving_files(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 10, archive: str | None = None) -> DataFrame:
    """Files as they arrive, oldest first, so many a batch; read ones are moved to the archive where there is one."""
    r = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(path)


def arriving_rows(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event time with a zone, which watermarks ask for."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def once_each(events: DataFrame, id_col: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Events delivered several times, once: by id within the watermark."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time; rows later than the watermark are left out."""
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    g = _timed(events, ts).withWatermark(ts, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = _timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that has arrived, in micro-batches, then stop: what a scheduler calls at its cadence."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only table of the stream; a batch that is repeated writes the same files."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def incremental(spark: SparkSession, path: str, schema: StructType, id_col: str, key_map: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Replication of arriving rows: each micro-batch, less the keys already mapped, goes to apply."""

    def each(batch: DataFrame, n: int) -> None:
        apply(batch.join(key_map, id_col, "left_anti"), n)

    run_available(arriving_rows(spark, path, schema), each, checkpoint)
