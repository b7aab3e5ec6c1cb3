"""Readiness metrics, signals, gates and activation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CONFIG, ModelConfig
from weftline.functions.text import TITLE_MARKER, iso_date
from weftline.operators.serving import age_hours


def metrics(parses: DataFrame, obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row; every part is one aggregation of one row."""
    used = pairs.agg(F.countDistinct("notice_id").alias("valid_notices"), F.countDistinct("outage_date").alias("distinct_outage_dates"))
    names = obs.agg(F.countDistinct("canonical_name").alias("unique_localities"))
    repeated = pairs.groupBy("locality_a", "locality_b").agg(F.countDistinct("outage_date").alias("dd")).agg(F.count_if(F.col("dd") >= CONFIG.min_edge_distinct_dates).alias("repeated_pairs"))
    active = parses.join(obs.select("notice_id").distinct(), "notice_id", "left_semi")
    ok = active.agg(F.coalesce(F.avg(F.when(F.col("parse_status") == "ok", 1.0).otherwise(0.0)), F.lit(0.0)).alias("active_ok_ratio"))
    share = pairs.groupBy("notice_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("largest_notice_pair_share"))
    return used.crossJoin(names).crossJoin(repeated).crossJoin(ok).crossJoin(share)


def needs(config: ModelConfig = CONFIG) -> list[tuple[str, str, float]]:
    return [
        ("valid_notices", ">=", config.min_valid_notices), ("distinct_outage_dates", ">=", config.min_distinct_dates), ("unique_localities", ">=", config.min_localities),
        ("repeated_pairs", ">=", config.min_repeated_pairs), ("active_ok_ratio", ">=", config.min_active_ok_ratio), ("largest_notice_pair_share", "<=", config.max_largest_notice_share),
    ]


def operational_metrics(jobs: DataFrame, parses: DataFrame, now: DataFrame, config: ModelConfig = CONFIG) -> DataFrame:
    """One row: hours since the last completed scrape, and the share of ok parses among the latest attempts
    of the window. now(now, today): the time of asking on the jobs' and on the parses' clock."""
    since = jobs.filter((F.col("job_type") == "scrape") & (F.col("status") == "completed")).agg(F.max("finished_at").alias("t"))
    age = since.crossJoin(now).select(age_hours(F.col("t"), F.col("now")).alias("scrape_freshness"))  # single rows
    recent = parses.crossJoin(F.broadcast(now)).filter(F.to_date("parsed_at") >= F.date_sub("today", config.recent_parse_window_days))  # one row
    last = recent.groupBy("snapshot_id").agg(F.max_by("parse_status", F.struct("parsed_at", "parse_id")).alias("status"))
    ratio = last.agg(F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)).alias("recent_parse_success_ratio"))
    return ratio.crossJoin(age)


def operational_needs(config: ModelConfig = CONFIG) -> list[tuple[str, str, float]]:
    return [("recent_parse_success_ratio", ">=", config.min_recent_parse_ratio), ("scrape_freshness", "<=", config.max_scrape_age_hours)]


def report(quality: DataFrame, operations: DataFrame) -> DataFrame:
    """All eight signals with their section; a section is ready if all of its signals pass."""
    both = signals(quality).withColumn("section", F.lit("model_quality")).unionByName(signals(operations, operational_needs()).withColumn("section", F.lit("operational_health")))
    return both.withColumn("ready", F.bool_and("passed").over(Window.partitionBy("section")))  # eight rows


def decided(found: DataFrame) -> DataFrame:
    """One row: the decision on publication from report()."""
    flag = lambda section: F.coalesce(F.bool_and(F.when(F.col("section") == section, F.col("passed"))), F.lit(False))
    row = found.agg(flag("model_quality").alias("model_quality"), flag("operational_health").alias("operational_health"))
    decision, reason = publication(F.col("model_quality"), F.col("operational_health"))
    return row.select("*", decision.alias("decision"), reason.alias("reason"))


def signal(key: str, current: Column, operator: str, required: float) -> Column:
    current = current.cast("double")
    passed = current >= required if operator == ">=" else current <= required
    return F.struct(F.lit(key).alias("key"), current.alias("current"), F.lit(operator).alias("operator"), F.lit(float(required)).alias("required"), F.coalesce(passed, F.lit(False)).alias("passed"))


def signals(row: DataFrame, wanted: list[tuple[str, str, float]] | None = None) -> DataFrame:
    return row.select(F.inline(F.array(*[signal(k, F.col(k), op, r) for k, op, r in wanted or needs()])))


def gates(found: DataFrame) -> DataFrame:
    end = F.when(F.col("passed"), "_pass").when(F.col("current").isNull(), "_not_measured").when(F.col("operator") == "<=", "_above_maximum").otherwise("_below_minimum")
    return found.select("key", F.when(F.col("passed"), "pass").otherwise("fail").alias("status"), "current", "required", F.concat("key", end).alias("reason"))


def publication(quality: Column, operations: Column) -> tuple[Column, Column]:
    """(decision, reason) of two readiness flags."""
    decision = F.when(~quality, "blocked").when(~operations, "experimental").otherwise("published")
    reason = F.when(~quality, "model_gates_failed").when(~operations, "operational_gates_failed").otherwise("all_gates_pass")
    return decision, reason


def activation_guards(parses: DataFrame, obs: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The four guards of a run's activation and the first that refuses."""
    row = edges.agg((F.count_if(F.col("dd") >= CONFIG.min_edge_distinct_dates) > 0).alias("run_completed"))
    row = row.crossJoin(obs.agg((F.count("*") > 0).alias("build_active"))).crossJoin(pairs.agg((F.countDistinct("outage_date") > 1).alias("validation_completed")))
    row = row.crossJoin(signals(metrics(parses, obs, pairs)).agg(F.bool_and("passed").alias("published")))  # single rows
    return row.withColumn("refusal", F.when(~F.col("run_completed"), "run_not_completed").when(~F.col("build_active"), "build_not_active").when(~F.col("validation_completed"), "validation_not_completed").when(~F.col("published"), "not_published"))


def _per_notice(parses: DataFrame, localities: DataFrame) -> DataFrame:
    counts = localities.groupBy("notice_id").agg(F.countDistinct("canonical_name").alias("n"), F.count("subregion_name").alias("headed"))
    return parses.join(counts, "notice_id", "left").na.fill(0, ["n", "headed"])


def activation_eligible(parses: DataFrame, localities: DataFrame) -> DataFrame:
    """A parse may become active if it is ok, or has warnings and two localities at least."""
    ok = (F.col("parse_status") == "ok") | ((F.col("parse_status") == "warning") & (F.col("n") >= 2))
    return _per_notice(parses, localities).select("notice_id", "parse_status", F.col("n").alias("localities"), ok.alias("eligible"))


def parse_warnings(notices: DataFrame, localities: DataFrame) -> DataFrame:
    """(notice_id, warnings) of notices(notice_id, raw_date, title): what a parser has to say of each, in its order."""
    headless = F.col("scope_ordinal").isNotNull() & (F.trim(F.coalesce("subregion_name", F.lit(""))) == "")
    counts = localities.groupBy("notice_id").agg(F.count("*").alias("n"), F.count_if(headless).alias("headless"))
    rows = notices.join(counts, "notice_id", "left").na.fill(0, ["n", "headless"])
    undated = F.coalesce(F.col("raw_date") == "", F.lit(True))
    found = F.array(
        F.when(undated, "missing_notice_date"), F.when(~undated & iso_date(F.col("raw_date")).isNull(), "invalid_notice_date"),
        F.when(~F.coalesce(F.contains("title", F.lit(TITLE_MARKER)), F.lit(False)), "unmatched_notice_title"), F.when(F.col("headless") > 0, "missing_subregion_header"), F.when(F.col("n") == 0, "empty_locality_list"),
    )
    return rows.select("notice_id", F.array_compact(found).alias("warnings"))
