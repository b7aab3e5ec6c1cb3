"""What happens to parses, runs and builds over time: rollback, reparse, rebuild, import, pilots.

Changes come as frames and go as frames; a caller writes them. What is to be made
current goes through VersionedTable, so that a refused or failed step leaves what was
current before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CONFIG
from weftline.operators.state import VersionedTable


def rollback(states: DataFrame, parses: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(rollback_id, notice_id, parse_id) judged against states(notice_id, active_parse) and
    parses(parse_id, notice_id, parse_status): (rollback_id, notice_id, from_parse, to_parse, refusal).

    The parse that was active is read in the same step that decides. Rows without a
    refusal are the audit rows and the new active parses.
    """
    target = parses.select("parse_id", F.col("notice_id").alias("owner"), "parse_status")
    found = requests.join(states, "notice_id", "left").join(target, "parse_id", "left")
    refusal = (
        F.when(F.col("owner").isNull() | (F.col("owner") != F.col("notice_id")), "parse_of_another_notice")
        .when(F.col("parse_status") == "failed", "failed_parse").when(F.col("active_parse").isNull(), "no_state")
    )
    return found.select("rollback_id", "notice_id", F.when(refusal.isNull(), F.col("active_parse")).alias("from_parse"), F.col("parse_id").alias("to_parse"), refusal.alias("refusal"))


def rolled_back(states: DataFrame, audit: DataFrame) -> DataFrame:
    """states after the rollbacks without a refusal; of several of a notice the greatest id counts."""
    done = audit.filter("refusal is null").groupBy("notice_id").agg(F.max_by("to_parse", "rollback_id").alias("to_parse"))
    return states.join(done, "notice_id", "left").select("notice_id", F.coalesce("to_parse", "active_parse").alias("active_parse"))


def completed_runs(runs: DataFrame) -> DataFrame:
    """The last completed run of each day, build and algorithm: where there is one, none is to be started."""
    keys = [F.to_date("started_at").alias("day"), "build_id", "algorithm"]
    best = runs.filter("status = 'completed'").groupBy(*keys).agg(F.max(F.struct("finished_at", "id")).alias("x"))
    return best.select("day", "build_id", "algorithm", F.col("x.id").alias("id"))


def recluster(table: VersionedTable, build: str, run: str, cluster: Callable[[], DataFrame], *guards: Callable[[], str | None]) -> str:
    """Write and activate a run's clusters unless that run is there already; the run's name holds day, build and algorithm."""
    name = f"{run}@{build}"
    if table.completed(name):
        return "present"
    table.write(cluster(), name)
    table.activate(name, *guards)
    return "activated"


def pinned(builds: DataFrame, activations: DataFrame) -> DataFrame:
    """builds(build_id, created_at) with the canonical build that was active when each was created (null: none).

    An as-of join: both in order of time, the last activation carried forward. Times are
    dealt into days; each day starts with the last activation before it.
    """
    both = builds.select(F.col("created_at").alias("t"), F.lit(1).alias("kind"), "build_id", F.lit(None).cast("long").alias("canonical"))
    both = both.unionByName(activations.select(F.col("activated_at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("build_id"), F.col("canonical_id").alias("canonical")))
    both = both.withColumn("day", F.to_date("t"))
    own = Window.partitionBy("day").orderBy("t", "kind", "canonical").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.last("canonical", ignorenulls=True).over(own))
    daily = both.groupBy("day").agg(F.max_by("canonical", F.when(F.col("kind") == 0, F.struct("t", "canonical"))).alias("end"))
    carried = daily.select("day", F.last("end", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))  # one row per day
    return inside.filter("kind = 1").join(carried, "day").select("build_id", F.coalesce("inside", "start").alias("canonical_id"))


def changed_evidence(before: DataFrame, now: DataFrame) -> DataFrame:
    """notice_id of states(notice_id, active_parse) that are new, gone or point to another parse."""
    both = before.select("notice_id", F.col("active_parse").alias("old")).join(now.select("notice_id", F.col("active_parse").alias("new")), "notice_id", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("notice_id")


def rebuild(table: VersionedTable, build: str, make: Callable[[], DataFrame], *checks: Callable[[], str | None], apply: bool = False) -> str:
    """Write and activate a build, or, without apply, tell what is active."""
    if not apply:
        return f"dry run: active build {table.active() or 'none'}"
    table.write(make(), build)
    table.activate(build, *checks)
    return f"activated {build}"


def rebuild_if_changed(changed: DataFrame, table: VersionedTable, build: str, make: Callable[[], DataFrame], *checks: Callable[[], str | None]) -> str | None:
    """rebuild(), unless no evidence has changed."""
    return None if changed.isEmpty() else rebuild(table, build, make, *checks, apply=True)


def reparses(parses: DataFrame, parser: str, normalization: str) -> DataFrame:
    """(snapshot_id, source_parse, parse_id) of the parses that bring snapshots without one of the current
    versions up to them, each from the snapshot's latest parse. Nothing is written: this is the dry run."""
    best = parses.groupBy("snapshot_id").agg(F.max(F.struct("parsed_at", "parse_id")).alias("x"), F.max(F.col("parser_version") == parser).alias("there"))
    identity = F.sha2(F.concat_ws("\0", "snapshot_id", F.lit(parser), F.lit(normalization)), 256)
    return best.filter("not there").select("snapshot_id", F.col("x.parse_id").alias("source_parse"), identity.alias("parse_id"))


def apply_reparses(parses: DataFrame, fresh: DataFrame, parser: str, now: str) -> DataFrame:
    """parses with the rows of reparses() appended, each with its source's other columns."""
    new = fresh.withColumnRenamed("parse_id", "__new").join(parses.drop("snapshot_id"), F.col("source_parse") == F.col("parse_id"))
    new = new.withColumns({"parse_id": F.col("__new"), "parser_version": F.lit(parser), "parsed_at": F.lit(now)})
    return parses.unionByName(new.select(*parses.columns))


def staged_import(table: VersionedTable, build: str, accepted: DataFrame, governorate: Column, known: DataFrame, apply: bool = False) -> str:
    """Import accepted rows as a build. An unknown governorate is an error before anything is
    written; an import without rows fails; either way what was current stays. known(key)."""
    missing = sorted(r[0] or "" for r in unresolved(accepted, governorate, known).select("key").distinct().limit(20).collect())
    if missing:
        raise ValueError(f"unknown governorates: {', '.join(missing)}")
    if accepted.isEmpty():
        return "failed: no rows"
    return rebuild(table, build, lambda: accepted, apply=apply)


def unresolved(accepted: DataFrame, governorate: Column, known: DataFrame) -> DataFrame:
    """The rows whose governorate is none of known(key)."""
    return accepted.withColumn("key", governorate).join(known.select("key").distinct(), "key", "left_anti")


def candidate_status(rows: Column, dates: Column, geography: Column, registered: Column, least_dates: int = CONFIG.min_edge_distinct_dates) -> Column:
    """experimental only if there are candidates, accepted geography, a registered source and enough dates; none of it has a default."""
    enough = (rows > 0) & geography & registered & (dates >= least_dates)
    return F.when(F.coalesce(enough, F.lit(False)), "experimental").otherwise("insufficient_evidence")


def pilot_tables(runs: DataFrame, scores: DataFrame, radius_km: float, scoring: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(run rows, score rows) to store for runs(run_id, cluster_id, rows, dates, geography, registered):
    every run with the radius it used, scores(run_id, ...) only of experimental ones."""
    judged = runs.select("run_id", "cluster_id", candidate_status(*map(F.col, ("rows", "dates", "geography", "registered"))).alias("status"))
    judged = judged.withColumns({"radius_km": F.lit(radius_km), "scoring_version": F.lit(scoring), "completed_at": F.lit(now)})
    return judged, scores.join(judged.filter("status = 'experimental'").select("run_id"), "run_id", "left_semi")
