"""Landed notices as a stream: replays change nothing, newer content supersedes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.serving import latest

NOTICES = "notice_id string, url string, raw_html string, fetched_at timestamp"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The stream of notices that land in a folder as JSON lines."""
    return spark.readStream.schema(NOTICES).json(path)


def snapshots(notices: DataFrame) -> DataFrame:
    """One snapshot per notice and content; identical content seen again brings nothing.

    State grows with the distinct contents, as the evidence itself does: notices have no
    lateness bound, an old one simply joins the next build.
    """
    digest = F.sha2("raw_html", 256)
    named = notices.withColumn("content_hash", digest).withColumn("snapshot_id", F.concat(F.lit("notice-"), F.substring(digest, 1, 20)))
    return named.dropDuplicates(["notice_id", "content_hash"])


def run(notices: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append snapshots to target/snapshots as Parquet and stop when all that has landed is read."""
    return snapshots(notices).writeStream.format("parquet").option("path", f"{target}/snapshots").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest snapshot of each notice."""
    return latest(spark.read.parquet(f"{target}/snapshots"), ["notice_id"], ["fetched_at", "snapshot_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time, with a bound on lateness."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
