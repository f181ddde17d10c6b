"""Append-only files as streams: resumed runs, progress, ledgers; and windows over events as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_growing(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def once_per_key(stream: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key; state is kept for ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, at: str, late: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` in event-time windows, tumbling or sliding."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Runs of a key's events with no longer gap, on a table or a stream."""
    g = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_each(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes each micro-batch under its own number, so a repeated batch replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        (change(df) if change else df).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream: DataFrame, *keys: str) -> DataFrame:
    """Records and errors so far of a growing table of runs, by some keys; for an output in complete mode."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), F.count_if(failed).alias("errors"), F.max("finished_at").alias("last"))


def follow(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps a progress in memory under a name, whole after every batch."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_each(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Keeps a table up to date with a stream: after each batch a new version of it, ``merge`` of the last one (None at first) and the batch.

    Versions are numbered by the batch, so a repeated batch starts from the same one and replaces its own.
    """
    spark = stream.sparkSession

    def put(df: DataFrame, epoch: int) -> None:
        last = spark.read.parquet(f"{path}/v={epoch - 1}") if epoch else None
        merge(last, df).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
