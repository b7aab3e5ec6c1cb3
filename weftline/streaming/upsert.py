"""Notices as a stream into a table: the latest snapshot and the counters of each notice are keyed state.

A content seen before changes nothing but the counters; content that is newer supersedes, content that is older is kept as a
snapshot of its own and does not. What changes of a notice in a micro-batch is one row, and
the rows are merged into a bucketed table, each batch once, whatever is restarted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.operators.upsert import BucketedTable

#: times are microseconds in the state, as a state store gives datetimes back with another zone
NOTICE = "notice_id string, snapshot_id string, content_hash string, raw_html string, fetched_at long, change string, version long, seen long, first_seen long, last_seen long"
EARLIEST = -(2**63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64


def _time(micros: int | None) -> int:
    return EARLIEST if micros is None else micros


class LatestNotice(StatefulProcessor):
    """Per notice: its latest snapshot, how many contents and sightings it had, and the contents themselves by hash.

    With retain_ms a content that was not seen for so long is forgotten, so it would count as new; without, state
    grows with the distinct contents."""

    def __init__(self, retain_ms: int | None = None) -> None:
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "snapshot_id string, content_hash string, fetched_at long, version long, seen long, first_seen long, last_seen long")
        self.contents = handle.getMapState("contents", "content_hash string", "fetched_at long", self.retain_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.latest.get() if self.latest.exists() else None
        snapshot, digest, at, version, seen, first, last = held if held else (None, None, None, 0, 0, None, None)
        change, body = "seen_again", None
        for row in sorted(rows, key=lambda r: (_time(r.fetched_at), r.content_hash)):
            seen += 1
            if row.fetched_at is not None:
                first = row.fetched_at if first is None else min(first, row.fetched_at)
                last = row.fetched_at if last is None else max(last, row.fetched_at)
            known = self.contents.containsKey((row.content_hash,))
            if not known or self.retain_ms is not None:
                self.contents.updateValue((row.content_hash,), (row.fetched_at,))
            if known:
                continue
            version += 1
            if snapshot is None or (_time(row.fetched_at), row.snapshot_id) > (_time(at), snapshot):
                change = "new" if snapshot is None or change == "new" else "superseded"
                snapshot, digest, at, body = row.snapshot_id, row.content_hash, row.fetched_at, row.raw_html
            elif change == "seen_again":
                change = "older_content"
        self.latest.update((snapshot, digest, at, version, seen, first, last))
        yield Row(notice_id=key[0], snapshot_id=snapshot, content_hash=digest, raw_html=body, fetched_at=at, change=change, version=version, seen=seen, first_seen=first, last_seen=last)

    def close(self) -> None:
        pass


def changes(notices: DataFrame, retain_ms: int | None = None) -> DataFrame:
    """The stream of changed notices of notices(notice_id, raw_html, fetched_at); raw_html is null unless the latest content changed. Null ids are left out."""
    digest = F.sha2(F.coalesce("raw_html", F.lit("")), 256)
    named = notices.filter("notice_id is not null").select("notice_id", "raw_html", F.unix_micros("fetched_at").alias("fetched_at"), digest.alias("content_hash"), F.concat(F.lit("notice-"), F.substring(digest, 1, 20)).alias("snapshot_id"))
    found = named.groupBy("notice_id").transformWithState(LatestNotice(retain_ms), NOTICE, "Update", "ProcessingTime" if retain_ms else "None")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("fetched_at", "first_seen", "last_seen")})


STORED = "notice_id string, snapshot_id string, content_hash string, raw_html string, fetched_at timestamp, version long, seen long, first_seen timestamp, last_seen timestamp"


def notice_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BucketedTable:
    """The latest state of each notice. `version` and `seen` only grow, so they order the writes."""
    return BucketedTable(root, spark, STORED, ["notice_id"], ["version", "seen"], buckets=buckets)


def run(notices: DataFrame, root: str, checkpoint: str, retain_ms: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge all that has landed into the table below root and stop; started again with its checkpoint it goes on."""
    spark = notices.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            table = notice_table(spark, root, buckets)
            same = batch.filter("raw_html is null").select("notice_id")
            body = table.lookup(same).select("notice_id", F.col("raw_html").alias("__held"))
            whole = batch.join(body, "notice_id", "left").withColumn("raw_html", F.coalesce("raw_html", "__held"))
            table.upsert(whole.select(*table.columns), checkpoint, number)
        finally:
            batch.unpersist()

    return changes(notices, retain_ms).writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
