"""Queries over changes: rollbacks, reparses, runs, pins, imports, and the rules of what comes in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import contracts, lifecycle
from weftline.plans.registry import query
from weftline.sources.views import Views

_PARSES = "(select *, case when parser_version = '2' then 'failed' else parse_status end as state from fx_parse_versions)"
_ASKED = "(select concat('r', cast(notice_id as varchar)) as rollback_id, notice_id, case when notice_id % 3 = 1 then concat('p', cast(notice_id as varchar), '-99') else min(parse_id) end as parse_id from fx_parse_versions group by notice_id)"
_AUDIT = f"select rollback_id, notice_id, case when refusal is null then active_parse end as from_parse, parse_id as to_parse, refusal from (select r.*, s.active_parse, case when p.notice_id is null or p.notice_id <> r.notice_id then 'parse_of_another_notice' when p.state = 'failed' then 'failed_parse' when s.active_parse is null then 'no_state' end as refusal from {_ASKED} r left join fx_states s on s.notice_id = r.notice_id left join {_PARSES} p on p.parse_id = r.parse_id)"


def _audit(v: Views) -> DataFrame:
    """Each notice asks for its first parse, a third of them for one that is not theirs."""
    notice = F.col("notice_id")
    asked = v.parse_versions.groupBy("notice_id").agg(F.min("parse_id").alias("own"))
    asked = asked.select(F.concat(F.lit("r"), notice.cast("string")).alias("rollback_id"), "notice_id", F.when(notice % 3 == 1, F.concat(F.lit("p"), notice.cast("string"), F.lit("-99"))).otherwise(F.col("own")).alias("parse_id"))
    parses = v.parse_versions.withColumn("parse_status", F.when(F.col("parser_version") == "2", "failed").otherwise(F.col("parse_status")))
    return lifecycle.rollback(v.states, parses, asked)


@query("q_rollback_audit", _AUDIT)
def rollback_audit(v: Views) -> DataFrame:
    return _audit(v)


@query("q_rollback_states", f"select s.notice_id, coalesce(a.to_parse, s.active_parse) as active_parse from fx_states s left join (select notice_id, to_parse from ({_AUDIT}) where refusal is null) a on a.notice_id = s.notice_id")
def rollback_states(v: Views) -> DataFrame:
    return lifecycle.rolled_back(v.states, _audit(v))


@query("q_run_exists", "select day, build_id, algorithm, id from (select cast(started_at as date) as day, id % 3 as build_id, job_type as algorithm, id, row_number() over (partition by cast(started_at as date), id % 3, job_type order by finished_at desc, id desc) as i from fx_jobs where status = 'completed') where i = 1")
def run_exists(v: Views) -> DataFrame:
    return lifecycle.completed_runs(v.jobs.withColumns({"build_id": F.col("id") % 3, "algorithm": F.col("job_type")}))


@query("q_canonical_pin", "select b.id as build_id, a.canonical_id from (select * from fx_jobs where job_type = 'backfill') b asof left join (select occurred_at, max(id) as canonical_id from fx_job_events where event_type = 'page_completed' group by occurred_at) a on b.started_at >= a.occurred_at")
def canonical_pin(v: Views) -> DataFrame:
    builds = v.jobs.filter("job_type = 'backfill'").select(F.col("id").alias("build_id"), F.col("started_at").alias("created_at"))
    return lifecycle.pinned(builds, v.job_events.filter("event_type = 'page_completed'").select(F.col("id").alias("canonical_id"), F.col("occurred_at").alias("activated_at")))


@query("q_changed_evidence", "select notice_id from fx_states full join (select notice_id, max(struct_pack(a := parsed_at, p := parse_id)).p as old from fx_parse_versions where parser_version <> '3' group by notice_id) using (notice_id) where active_parse is distinct from old")
def changed_evidence(v: Views) -> DataFrame:
    before = v.parse_versions.filter("parser_version <> '3'").groupBy("notice_id").agg(F.max_by("parse_id", F.struct("parsed_at", "parse_id")).alias("active_parse"))
    return lifecycle.changed_evidence(before, v.states)


@query("q_reparse_plan", "select snapshot_id, max(struct_pack(a := parsed_at, p := parse_id)).p as source_parse, sha256(concat(snapshot_id, chr(0), '3', chr(0), '2')) as parse_id from fx_parse_versions group by snapshot_id having count(*) filter (parser_version = '3') = 0")
def reparse_plan(v: Views) -> DataFrame:
    return lifecycle.reparses(v.parse_versions, "3", "2")


@query("q_reparse_applied", "with old as (select * from fx_parse_versions), src as (select snapshot_id, max(struct_pack(a := parsed_at, p := parse_id)).p as source_parse from old group by snapshot_id having count(*) filter (parser_version = '3') = 0) select parser_version, parse_status, count(*) as n from (select parser_version, parse_status from old union all select '3', parse_status from old join src on source_parse = parse_id) group by parser_version, parse_status")
def reparse_applied(v: Views) -> DataFrame:
    fresh = lifecycle.reparses(v.parse_versions, "3", "2")
    return lifecycle.apply_reparses(v.parse_versions, fresh, "3", "2030-01-01").groupBy("parser_version", "parse_status").agg(F.count("*").alias("n"))


@query("q_import_unresolved", "select unit_id, governorate from fx_units where governorate not in (select distinct governorate from fx_locality_xy where k % 3 <> 0)")
def import_unresolved(v: Views) -> DataFrame:
    known = v.places.filter("k % 3 <> 0").select(F.col("governorate").alias("key"))
    return lifecycle.unresolved(v.units, F.col("governorate"), known).select("unit_id", "governorate")


_NAMES = tuple(f"GOV_{i}" for i in range(21))
_KNOWN = ", ".join(f"'{n}'" for n in _NAMES)


@query("q_report_validation", f"select id, case when utility not in ('electricity', 'water') then 'unknown_utility' when status not in ('active', 'restored') then 'unknown_status' when governorate not in ({_KNOWN}) then 'unknown_governorate' when status = 'restored' and id % 8 = 0 then 'restored_without_end' end as reason from fx_reports")
def report_validation(v: Views) -> DataFrame:
    reports = v.reports.withColumn("ended_at", F.when(F.col("id") % 8 != 0, F.col("created_at")))
    return contracts.validate_report(reports, _NAMES).select("id", "reason")


@query("q_source_validation", "select n_nationkey as k, case when not regexp_full_match(source_id, '[a-z0-9][a-z0-9_-]*') then 'source_id_pattern' when publication_class = 'public' and license_id is null then 'public_without_license' end as reason from (select n_nationkey, case when n_nationkey % 5 = 0 then n_name else lower(replace(n_name, ' ', '_')) end as source_id, case when n_nationkey % 2 = 0 then 'public' else 'private_research' end as publication_class, case when n_nationkey % 3 <> 0 then 'cc-by-4.0' end as license_id from nation)")
def source_validation(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    rows = v.raw("nation").select(
        k.alias("k"), F.when(k % 5 == 0, F.col("n_name")).otherwise(F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("source_id"), F.col("n_name").alias("title"), F.lit("owner").alias("owner"),
        F.when(k % 2 == 0, "public").otherwise("private_research").alias("publication_class"), F.when(k % 3 != 0, "cc-by-4.0").alias("license_id"), F.lit("monthly").alias("refresh_policy"),
    )
    return contracts.validate_sources(rows).select("k", "reason")


@query("q_request_ids", "select seq, case when regexp_full_match(x, '[A-Za-z0-9._:-]{1,128}') then x end as request_id from (select seq, case when seq % 5 = 0 then concat(route, cast(seq as varchar)) when seq % 7 = 0 then repeat('a', 120 + cast(seq % 20 as int)) else concat('req.', cast(seq as varchar), ':', cast(status as varchar)) end as x from fx_requests)")
def request_ids(v: Views) -> DataFrame:
    seq = F.col("seq")
    made = F.when(seq % 5 == 0, F.concat("route", seq.cast("string"))).when(seq % 7 == 0, F.repeat(F.lit("a"), (120 + seq % 20).cast("int"))).otherwise(F.concat(F.lit("req."), seq.cast("string"), F.lit(":"), F.col("status").cast("string")))
    return v.requests.select("seq", contracts.request_id(made).alias("request_id"))


@query("q_state_transitions", "select id, case when id % 11 = 0 then 'frozen_while_active' when not (id % 7 <> 0 and status in ('completed', 'failed')) then 'transition_not_allowed' end as reason from fx_jobs")
def state_transitions(v: Views) -> DataFrame:
    changes = v.jobs.select("id", F.when(F.col("id") % 7 == 0, "completed").otherwise("building").alias("before"), F.col("status").alias("after"), (F.col("id") % 11 == 0).alias("active"))
    return contracts.transitions(changes).select("id", "reason")


@query("q_orphans", "select l_orderkey as notice_id, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by l_orderkey")
def orphans(v: Views) -> DataFrame:
    parents = v.raw("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("notice_id"))
    return contracts.orphans(v.raw("lineitem").select(F.col("l_orderkey").alias("notice_id")), parents, "notice_id").groupBy("notice_id").agg(F.count("*").alias("n"))
