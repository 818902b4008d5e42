"""Streams run to their end over the events table, read back as tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.sources.tables import shared_folder
from quirespark.streaming import streams


def _places(spark: SparkSession) -> tuple[str, str]:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


def stream_first_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type, each once in the stream."""
    out, state = _places(spark)
    streams.run_once(streams.deduplicated(streams.event_stream(spark, folder), ["event_id"], "ts"), out, state)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


FIRST_SQL = "select event_type, count(distinct event_id) n from events group by 1"


def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and day, counted in the stream: the last count of each window that a batch gave."""
    out, state = _places(spark)
    counts = streams.windowed_counts(streams.event_stream(spark, folder), "ts", ["event_type"], "1 day")
    streams.run_once(counts, out, state, "update", lambda b, n: b.write.mode("append").parquet(out))
    return spark.read.parquet(out).groupBy(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type").agg(F.max("n").alias("n"))


COUNTS_SQL = "select date_trunc('day', ts)::timestamp as day, event_type, count(*) n from events where ts is not null group by 1, 2"


def stream_versions(spark: SparkSession, folder: str) -> DataFrame:
    """How many events each user had, and the last one's time, from a state that forgets idle users."""
    out, state = _places(spark)
    found = streams.versions(streams.event_stream(spark, folder), "user_id", "ts")
    streams.run_once(found, out, state, "update", lambda b, n: b.write.mode("append").parquet(out))
    spells = spark.read.parquet(out).groupBy("user_id", "since_us").agg(F.max("version").alias("version"), F.max("last_us").alias("last_us"))
    return spells.groupBy("user_id").agg(F.sum("version").alias("version"), F.max("last_us").alias("last_us"))


VERSIONS_SQL = "select user_id, count(*) as version, max(epoch_us(ts)) last_us from events where user_id is not null group by 1"


def stream_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Users by the type of event that they were first written with: the stream is run twice, the second run adds nothing."""
    out, state = _places(spark)
    stream = streams.event_stream(spark, folder).select("user_id", "event_type").where("event_type = 'purchase'")
    for run in range(2):
        streams.run_once(stream, out, f"{state}-{run}", write=streams.new_rows_only(out, ["user_id"]))
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


NEW_SQL = "select distinct user_id, event_type, cast(1 as bigint) n from events where event_type = 'purchase'"

QUERIES = {f.__name__: f for f in (stream_first_events, stream_window_counts, stream_versions, stream_new_rows)}
SQL = {"stream_first_events": FIRST_SQL, "stream_window_counts": COUNTS_SQL, "stream_versions": VERSIONS_SQL, "stream_new_rows": NEW_SQL}
