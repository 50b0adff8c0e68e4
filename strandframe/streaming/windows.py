"""Event windows for batch and stream alike: ``ts, user_id, event_type, value``.

On a stream, a watermark bounds the state and decides what is late; on a batch it has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandframe.plans.session import shared_dir


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events under a watermark; times without a zone are read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``window_start, event_type, n, total`` of windows of one width."""
    return sliding(events, width, width, late)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """``window_start, event_type, n, total`` of overlapping windows."""
    d = timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, session_start, session_end, n`` of runs of a user's events without a longer gap."""
    d = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(stream: DataFrame, name: str, path: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there as Parquet and stops; the checkpoint in the shared folder lets the next run go on."""
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{name}").format("parquet").start(path)
    q.awaitTermination()
    return q
