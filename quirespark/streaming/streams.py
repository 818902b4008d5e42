"""Incremental forms: deduplication, versions, ledgers and retention over streams of events.

The batch engine has no late data; here an event later than the watermark is dropped. State grows with what is open within
the watermark, or within the time that ``versions`` keeps an idle key, only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The Parquet file or folder of a table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet" if _is_folder(spark, f"{folder}/{name}.parquet") else f"{folder}/{name}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], length: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """window_start and by: how many events fall in each tumbling window; ``delay`` None keeps the stream's own watermark."""
    timed = stream if delay is None else stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    counted = timed.groupBy(F.window(at, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def versions(stream: DataFrame, key: str, at: str, delay: str = "1 hour", keep_hours: int = 24 * 30) -> DataFrame:
    """key, since_us, version, last_us after each batch of events: how many events of a key there were since ``since_us``.

    A key without an event for ``keep_hours`` behind the watermark is forgotten; if it comes back it counts anew, under a new
    ``since_us``, so that the sum of a key's counts is all its events. Null keys and times count for nothing.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, n, last = state.get if state.exists else (None, 0, 0)
        for batch in batches:
            us = batch["at_us"]
            since = int(us.min()) if since is None else since
            n, last = n + len(batch), max(last, int(us.max()))
        state.update((since, n, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000 + 1)
        yield pd.DataFrame({key: [name[0]], "since_us": [since], "version": [n], "last_us": [last]})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    own = timed.select(key, at, F.unix_micros(at).alias("at_us"))
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since_us long, version long, last_us long", "since long, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def new_rows_only(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds keys which ``target`` (a Parquet folder) does not hold yet and leaves the others as they are;
    a batch that is delivered again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if _exists(spark, target):
            rows = rows.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(target)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> None:
    """All that is there now, through ``write`` or appended to the Parquet folder ``target``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    started = (writer.foreachBatch(write) if write else writer.format("parquet").option("path", target)).start()
    started.awaitTermination()
