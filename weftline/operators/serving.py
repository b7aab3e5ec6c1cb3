"""Reads of the serving surface, and the rules behind its state rows."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CONFIG, GOVERNORATES, RETAIN_EVENT_DAYS, RETAIN_JOB_DAYS, RETENTION_BATCH, ModelConfig
from weftline.operators.ranks import running
from weftline.runtime import materialize

#: fixed values
EVENT_TYPES = ("job_started", "page_started", "page_completed", "notice_imported", "job_failed")
MOST_ROWS = 500


def equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters for the arguments that are given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def clamp(limit: int, most: int = MOST_ROWS) -> int:
    return min(max(limit, 1), most)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def before(df: DataFrame, last: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """The rows that follow `last` (one row) in descending order of time and key."""
    joined = df.crossJoin(F.broadcast(last.select(F.col(time).alias("__t"), F.col(key).alias("__k"))))  # one row
    rest = joined.filter((F.col(time) < F.col("__t")) | ((F.col(time) == F.col("__t")) & (F.col(key) < F.col("__k"))))
    return page(rest.drop("__t", "__k"), [F.desc(time), F.desc(key)], limit)


def encode_cursor(time: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([time, key]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        time, key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError) as e:
        raise ValueError("invalid cursor") from e
    return time, key


def governorates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GOVERNORATES)], "g int, name string, lat double, lng double")


def marker_radius(total: Column) -> Column:
    return 5 + F.least(total, F.lit(20)) * F.lit(1.1)


def marker_opacity(stability: Column) -> Column:
    return F.lit(0.25) + F.lit(0.65) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), stability))


def age_hours(then: Column, now: Column) -> Column:
    """Hours between two times, never below 0; null if there was no earlier time."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(then.isNotNull(), F.greatest(F.lit(0), micros(now) - micros(then)) / 3.6e9)


def lock_outcomes(jobs: DataFrame, minutes: int) -> DataFrame:
    """What each job would be told by a lock that the job of its type before it holds for some minutes."""
    own = Window.partitionBy("job_type").orderBy("started_at", "id")
    end = F.lag(F.col("started_at") + F.expr(f"interval {minutes} minutes")).over(own)
    outcome = F.when(end.isNull(), "acquired").when(end < F.col("started_at"), "taken_over").otherwise("refused")
    return jobs.select("id", "job_type", outcome.alias("outcome"))


def retained(jobs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and events that stay: finished jobs and events go once older than their days; rows on the boundary stay."""
    job_now, event_now = jobs.agg(F.max("started_at").alias("__now")), events.agg(F.max("occurred_at").alias("__now"))
    old = (F.col("started_at") < F.col("__now") - F.expr(f"interval {RETAIN_JOB_DAYS} days")) & F.col("status").isin("completed", "failed")
    kept = events.crossJoin(event_now).filter(F.col("occurred_at") >= F.col("__now") - F.expr(f"interval {RETAIN_EVENT_DAYS} days"))
    return jobs.crossJoin(job_now).filter(~old).drop("__now"), kept.drop("__now")  # single rows


def deletion_batches(expired: DataFrame, time: str, key: str, size: int = RETENTION_BATCH) -> DataFrame:
    """expired with `batch`, from 0, of `size` rows at most, oldest first."""
    return running(expired, [F.col(time).asc_nulls_first(), F.col(key)]).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def clean(batches: DataFrame, delete: Callable[[DataFrame], None]) -> tuple[int, str | None]:
    """Delete the batches one after the other: (batches deleted, why it stopped). The job that cleans up does not fail with
    it; what is left is found expired again by the next one. Batches are not collected, only their count is."""
    batches = materialize(batches, "expired", ("batch",))
    last = batches.agg(F.max("batch")).first()[0]
    for number in range(0 if last is None else last + 1):
        try:
            delete(batches.filter(F.col("batch") == number).drop("batch"))
        except Exception as e:  # whatever the caller's store raises
            return number, f"{type(e).__name__}: {e}"
    return 0 if last is None else last + 1, None


def data_floor(notices: Column, localities: Column, config: ModelConfig = CONFIG) -> Column:
    """How far the evidence is from what a first model needs."""
    met = (notices >= config.min_total_notices) & (localities >= config.min_localities)
    return F.struct(
        notices.alias("notices_so_far"), F.lit(config.min_total_notices).alias("notices_needed"), localities.alias("localities_so_far"), F.lit(config.min_localities).alias("localities_needed"), met.alias("data_floor_met")
    )


def timelines(events: DataFrame) -> DataFrame:
    """(job_id, events, timeline) of the known event types."""
    known = events.filter(F.col("event_type").isin(*EVENT_TYPES))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "id", "event_type"))), lambda x: x["event_type"])
    return known.groupBy("job_id").agg(F.count("*").alias("events"), F.array_join(ordered, ">").alias("timeline"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in the given order; an upsert where the last write wins."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__x"))
    return best.select(*keys, *[f"__x.{c}" for c in (*order, *rest)])


def insert_absent(present: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return present.unionByName(rows.join(present.select(*keys), keys, "left_anti"))


def missing_version(parses: DataFrame, version: str) -> DataFrame:
    """Snapshots without a parse of the version, with the parse to start from."""
    best = parses.groupBy("snapshot_id").agg(F.max(F.struct("parsed_at", "parse_id")).alias("x"), F.max(F.col("parser_version") == version).alias("there"))
    return best.filter("not there").select("snapshot_id", F.col("x.parse_id").alias("source_parse"))


def unknown(refs: DataFrame, known: DataFrame) -> DataFrame:
    return refs.distinct().join(known, refs.columns, "left_anti")
