"""Queries of the serving surface: reports, notices, jobs, requests, versions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import GOVERNORATES, RETAIN_EVENT_DAYS, RETAIN_JOB_DAYS, RETENTION_BATCH
from weftline.operators import contracts, readiness, serving
from weftline.plans.registry import query
from weftline.sources.views import Views


@query("q_reports_filtered", "select id, utility, status, governorate, created_at from fx_reports where utility = 'water' and status = 'active'")
def reports_filtered(v: Views) -> DataFrame:
    return serving.equals(v.reports, utility="water", status="active", governorate=None)


@query("q_reports_page", "select id, utility, status, created_at from fx_reports where governorate = 'GOV_3' order by created_at desc, id desc limit 50 offset 10")
def reports_page(v: Views) -> DataFrame:
    return serving.page(serving.equals(v.reports, governorate="GOV_3"), [F.desc("created_at"), F.desc("id")], 50, 10).select("id", "utility", "status", "created_at")


@query("q_official_list", "select notice_id, raw_date from (select notice_id, strftime(cast(outage_date as date), '%d/%m/%Y') as raw_date from fx_parses where parse_status = 'ok') order by raw_date desc nulls last, notice_id desc limit 100")
def official_list(v: Views) -> DataFrame:
    """The order is that of the raw dd/MM/yyyy text, not of the calendar."""
    rows = serving.equals(v.parses, parse_status="ok").select("notice_id", F.date_format(F.to_date("outage_date"), "dd/MM/yyyy").alias("raw_date"))
    return serving.page(rows, [F.desc_nulls_last("raw_date"), F.desc("notice_id")], 100)


@query("q_public_projection", "select id, job_type, status, cast(started_at as varchar) as started_at from fx_jobs")
def public_projection(v: Views) -> DataFrame:
    return v.jobs.select("id", "job_type", "status", F.col("started_at").cast("string").alias("started_at"))


@query("q_stats_by_gov", "select governorate, utility, count(*) as n from fx_reports where status = 'active' group by governorate, utility")
def stats_by_gov(v: Views) -> DataFrame:
    return serving.equals(v.reports, status="active").groupBy("governorate", "utility").agg(F.count("*").alias("n"))


@query("q_stats_pivot", "select governorate, count(*) filter (utility = 'electricity') as electricity, count(*) filter (utility = 'water') as water from fx_reports where status = 'active' group by governorate")
def stats_pivot(v: Views) -> DataFrame:
    return serving.equals(v.reports, status="active").groupBy("governorate").agg(*[F.count_if(F.col("utility") == u).alias(u) for u in ("electricity", "water")])


@query("q_overall_stats", "select count(*) as total, count(*) filter (status = 'active') as active, count(*) filter (status = 'active' and utility = 'electricity') as electricity, count(*) filter (status = 'active' and utility = 'water') as water from fx_reports")
def overall_stats(v: Views) -> DataFrame:
    on = F.col("status") == "active"
    return v.reports.agg(F.count("*").alias("total"), F.count_if(on).alias("active"), *[F.count_if(on & (F.col("utility") == u)).alias(u) for u in ("electricity", "water")])


_GOV = " union all ".join(f"select {i} as g, '{n}' as name, {la}::double as lat, {lo}::double as lng" for i, (n, la, lo) in enumerate(GOVERNORATES))


@query("q_governorate_map", f"with g as ({_GOV}) select name, lat, lng, count(id) as reports from g left join fx_reports r on r.governorate = concat('GOV_', cast(g as varchar)) group by name, lat, lng")
def governorate_map(v: Views) -> DataFrame:
    gov = serving.governorates(v.spark).withColumn("governorate", F.concat(F.lit("GOV_"), F.col("g").cast("string")))
    return gov.join(v.reports.groupBy("governorate").agg(F.count("*").alias("reports")), "governorate", "left").select("name", "lat", "lng", F.coalesce("reports", F.lit(0)).cast("long").alias("reports"))


@query("q_map_markers", "select governorate, n, round(5 + least(n, 20) * 1.1::double, 6) as radius, round(0.25::double + 0.65::double * greatest(0, least(1, n::double / t)), 6) as opacity from (select governorate, count(*) filter (status = 'active') as n, count(*) as t from fx_reports group by governorate)")
def map_markers(v: Views) -> DataFrame:
    rows = v.reports.groupBy("governorate").agg(F.count_if(F.col("status") == "active").alias("n"), F.count("*").alias("t"))
    return rows.select("governorate", "n", F.round(serving.marker_radius(F.col("n")), 6).alias("radius"), F.round(serving.marker_opacity(F.col("n") / F.col("t")), 6).alias("opacity"))


@query("q_latest_run", "select id, job_type, substr(cast(started_at as varchar), 1, 10) as day from (select *, row_number() over (partition by job_type order by started_at desc, id desc) as i from fx_jobs where status = 'completed') where i = 1")
def latest_run(v: Views) -> DataFrame:
    best = v.jobs.filter("status = 'completed'").groupBy("job_type").agg(F.max(F.struct("started_at", "id")).alias("x"))
    return best.select("x.id", "job_type", F.substring(F.col("x.started_at").cast("string"), 1, 10).alias("day"))


@query("q_keyset_jobs", "with k as (select started_at, id from fx_jobs order by started_at desc, id desc limit 1 offset 500) select j.id, j.job_type, j.status from fx_jobs j, k where j.started_at < k.started_at or j.started_at = k.started_at and j.id < k.id order by j.started_at desc, j.id desc limit 51")
def keyset_jobs(v: Views) -> DataFrame:
    last = serving.page(v.jobs, [F.desc("started_at"), F.desc("id")], 1, 500).select("started_at", "id")
    return serving.before(v.jobs, last, "started_at", "id", 51).select("id", "job_type", "status")


@query("q_keyset_events", "with k as (select occurred_at, id from fx_job_events order by occurred_at desc, id desc limit 1 offset 300) select e.id, e.job_id, e.event_type from fx_job_events e, k where e.occurred_at < k.occurred_at or e.occurred_at = k.occurred_at and e.id < k.id order by e.occurred_at desc, e.id desc limit 101")
def keyset_events(v: Views) -> DataFrame:
    last = serving.page(v.job_events, [F.desc("occurred_at"), F.desc("id")], 1, 300).select("occurred_at", "id")
    return serving.before(v.job_events, last, "occurred_at", "id", 101).select("id", "job_id", "event_type")


@query("q_latency_percentiles", "select route, count(*) as n, quantile_disc(duration_ms, 0.5) as p50, quantile_disc(duration_ms, 0.95) as p95 from fx_requests group by route")
def latency_percentiles(v: Views) -> DataFrame:
    return v.requests.groupBy("route").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by duration_ms)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by duration_ms)").alias("p95"))


@query("q_status_classes", "select count(*) filter (status between 200 and 299) as ok, count(*) filter (status between 400 and 499) as client_errors, count(*) filter (status >= 500) as server_errors from fx_requests")
def status_classes(v: Views) -> DataFrame:
    s = F.col("status")
    return v.requests.agg(F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(400, 499)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"))


@query("q_top_routes", "select route, count(*) as n from fx_requests group by route order by n desc, min(seq) limit 10")
def top_routes(v: Views) -> DataFrame:
    return v.requests.groupBy("route").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(10).select("route", "n")


@query("q_recent_ring", "select seq, route, status, duration_ms from fx_requests order by ts desc, seq desc limit 1000")
def recent_ring(v: Views) -> DataFrame:
    return serving.page(v.requests, [F.desc("ts"), F.desc("seq")], 1000).select("seq", "route", "status", "duration_ms")


@query("q_scrape_age", "select job_type, round(greatest(0, epoch_us(n) - epoch_us(t)) / 3.6e9, 6) as age_hours, greatest(0, epoch_us(n) - epoch_us(t)) / 3.6e9 <= 48 as fresh from (select job_type, max(finished_at) filter (status = 'completed') as t, (select max(started_at) from fx_jobs) as n from fx_jobs group by job_type)")
def scrape_age(v: Views) -> DataFrame:
    now = v.jobs.agg(F.max("started_at").alias("now"))
    rows = v.jobs.groupBy("job_type").agg(F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("t")).crossJoin(now)  # one row
    age = serving.age_hours(F.col("t"), F.col("now"))
    return rows.select("job_type", F.round(age, 6).alias("age_hours"), F.coalesce(age <= 48, F.lit(False)).alias("fresh"))


@query("q_publication", "select job_type, case when not q then 'blocked' when not o then 'experimental' else 'published' end as decision, case when not q then 'model_gates_failed' when not o then 'operational_gates_failed' else 'all_gates_pass' end as reason from (select job_type, avg(case when status = 'completed' then 1.0::double else 0.0::double end) >= 0.8 as q, count(*) filter (status = 'running') = 0 as o from fx_jobs group by job_type)")
def publication(v: Views) -> DataFrame:
    rows = v.jobs.groupBy("job_type").agg((F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)) >= 0.8).alias("q"), (F.count_if(F.col("status") == "running") == 0).alias("o"))
    decision, reason = readiness.publication(F.col("q"), F.col("o"))
    return rows.select("job_type", decision.alias("decision"), reason.alias("reason"))


@query("q_lock_takeover", "select id, job_type, case when prev is null then 'acquired' when prev_end < started_at then 'taken_over' else 'refused' end as outcome from (select *, lag(id) over w as prev, lag(started_at + interval 15 minute) over w as prev_end from fx_jobs window w as (partition by job_type order by started_at, id))")
def lock_takeover(v: Views) -> DataFrame:
    return serving.lock_outcomes(v.jobs, minutes=15)


@query("q_retention", f"select 'jobs' as kind, count(*) as kept from fx_jobs where not (started_at < (select max(started_at) from fx_jobs) - interval {RETAIN_JOB_DAYS} day and status in ('completed', 'failed')) union all select 'events', count(*) from fx_job_events where occurred_at >= (select max(occurred_at) from fx_job_events) - interval {RETAIN_EVENT_DAYS} day")
def retention(v: Views) -> DataFrame:
    jobs, events = serving.retained(v.jobs, v.job_events)
    return jobs.agg(F.count("*").alias("kept")).select(F.lit("jobs").alias("kind"), "kept").unionByName(events.agg(F.count("*").alias("kept")).select(F.lit("events").alias("kind"), "kept"))


@query("q_retention_batches", f"select batch, count(*) as rows, min(id) as first_id from (select id, (row_number() over (order by occurred_at, id) - 1) // {RETENTION_BATCH} as batch from fx_job_events where occurred_at < (select max(occurred_at) from fx_job_events) - interval 10 day) group by batch")
def retention_batches(v: Views) -> DataFrame:
    """Batches in which events of more than ten days would go, oldest first."""
    now = v.job_events.agg(F.max("occurred_at").alias("now"))
    old = v.job_events.crossJoin(now).filter(F.col("occurred_at") < F.col("now") - F.expr("interval 10 days")).drop("now")  # one row
    return serving.deletion_batches(old, "occurred_at", "id").groupBy("batch").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


@query("q_data_floor", "select (select count(distinct notice_id) from fx_obs) as notices_so_far, 30 as notices_needed, (select count(*) from fx_marg) as localities_so_far, 10 as localities_needed, (select count(distinct notice_id) from fx_obs) >= 30 and (select count(*) from fx_marg) >= 10 as data_floor_met")
def data_floor(v: Views) -> DataFrame:
    one = v.observations.agg(F.countDistinct("notice_id").alias("n"), F.countDistinct("canonical_name").alias("l"))
    return one.select(serving.data_floor(F.col("n"), F.col("l")).alias("x")).select("x.*")


@query("q_artifact_changes", "with b as (select l_orderkey as source_id, cast(l_linenumber as varchar) as path, sha256(max(l_comment)) as sha256, count(*) as size_bytes from (select l_orderkey, l_linenumber, concat(l_returnflag, l_shipdate) as l_comment from lineitem) group by 1, 2) select source_id, path, case when source_id % 7 = 0 then 'artifact_removed' when source_id % 11 = 0 then 'checksum_changed' else 'size_changed' end as reason from b where source_id % 7 = 0 or source_id % 11 = 0 or source_id % 13 = 0")
def artifact_changes(v: Views) -> DataFrame:
    """Registered artifacts of which some were removed, rewritten or cut since."""
    lines = v.raw("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").cast("string").alias("path"), F.concat("l_returnflag", F.col("l_shipdate").cast("string")).alias("body"))
    before = lines.groupBy("source_id", "path").agg(F.sha2(F.max("body"), 256).alias("sha256"), F.count("*").alias("size_bytes"))
    s = F.col("source_id")
    now = before.filter(s % 7 != 0).withColumns({"sha256": F.when(s % 11 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")), "size_bytes": F.when(s % 13 == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes"))})
    return contracts.artifact_changes(before, now)


@query("q_job_timeline", "select job_id, count(*) as events, string_agg(event_type, '>' order by occurred_at, id) as timeline from fx_job_events where event_type in ('job_started', 'page_started', 'page_completed', 'notice_imported', 'job_failed') group by job_id")
def job_timeline(v: Views) -> DataFrame:
    return serving.timelines(v.job_events)


@query("q_outcome_counts", "select job_id, count(*) filter (event_type = 'notice_imported') as imported, count(*) filter (event_type = 'job_failed') as failed, count(*) as all_events from fx_job_events group by job_id")
def outcome_counts(v: Views) -> DataFrame:
    return v.job_events.groupBy("job_id").agg(F.count_if(F.col("event_type") == "notice_imported").alias("imported"), F.count_if(F.col("event_type") == "job_failed").alias("failed"), F.count("*").alias("all_events"))


@query("q_content_dedup", "select distinct notice_id, snapshot_id from fx_snapshots")
def content_dedup(v: Views) -> DataFrame:
    return v.snapshots.select("notice_id", "snapshot_id").distinct()


@query("q_snapshot_ids", "select notice_id, concat(cast(notice_id as varchar), '-', substr(sha256(raw_html), 1, 20)) as snapshot_id, min(seq) as first_seq from fx_snapshots group by notice_id, raw_html")
def snapshot_ids(v: Views) -> DataFrame:
    rows = v.snapshots.groupBy("notice_id", "raw_html").agg(F.min("seq").alias("first_seq"))
    return rows.select("notice_id", F.concat(F.col("notice_id").cast("string"), F.lit("-"), F.substring(F.sha2("raw_html", 256), 1, 20)).alias("snapshot_id"), "first_seq")


@query("q_identity_hash", "select notice_id, snapshot_id, sha256(concat(snapshot_id, chr(0), '3', chr(0), '1')) as parse_id from (select distinct notice_id, snapshot_id from fx_snapshots)")
def identity_hash(v: Views) -> DataFrame:
    rows = v.snapshots.select("notice_id", "snapshot_id").distinct()
    return rows.select("notice_id", "snapshot_id", F.sha2(F.concat_ws("\0", "snapshot_id", F.lit("3"), F.lit("1")), 256).alias("parse_id"))


@query("q_upsert_latest", "select notice_id, max(struct_pack(f := fetched_at, s := seq, i := snapshot_id)).i as snapshot_id from fx_snapshots group by notice_id")
def upsert_latest(v: Views) -> DataFrame:
    return serving.latest(v.snapshots, ["notice_id"], ["fetched_at", "seq", "snapshot_id"]).select("notice_id", "snapshot_id")


@query("q_insert_absent", "select distinct notice_id, snapshot_id from fx_snapshots where seq <= 3 union select distinct notice_id, snapshot_id from fx_snapshots s where seq > 3 and not exists (select 1 from fx_snapshots o where o.seq <= 3 and o.notice_id = s.notice_id and o.snapshot_id = s.snapshot_id)")
def insert_absent(v: Views) -> DataFrame:
    keys = ["notice_id", "snapshot_id"]
    return serving.insert_absent(v.snapshots.filter("seq <= 3").select(*keys).distinct(), v.snapshots.filter("seq > 3").select(*keys).distinct(), keys)


@query("q_missing_reparse", "select snapshot_id, max(struct_pack(a := parsed_at, p := parse_id)).p as source_parse from fx_parse_versions group by snapshot_id having count(*) filter (parser_version = '3') = 0")
def missing_reparse(v: Views) -> DataFrame:
    return serving.missing_version(v.parse_versions, "3")


@query("q_stale_parse_count", "select count(*) as stale from (select snapshot_id, max(struct_pack(a := parsed_at, p := parse_id, v := parser_version)).v as version from fx_parse_versions group by snapshot_id) where version <> '3'")
def stale_parse_count(v: Views) -> DataFrame:
    return serving.latest(v.parse_versions, ["snapshot_id"], ["parsed_at", "parse_id"]).agg(F.count_if(F.col("parser_version") != "3").alias("stale"))


@query("q_recent_parse_success", "select count(*) as snapshots, round(avg(case when parse_status = 'ok' then 1.0::double else 0.0::double end), 8) as ratio from (select *, row_number() over (partition by snapshot_id order by parsed_at desc, parse_id desc) as i from fx_parse_versions where cast(parsed_at as date) >= (select max(cast(parsed_at as date)) from fx_parse_versions) - interval 30 day) where i = 1")
def recent_parse_success(v: Views) -> DataFrame:
    """The window is applied before the latest attempt is picked."""
    top = v.parse_versions.agg(F.max("parsed_at").alias("top"))
    recent = v.parse_versions.crossJoin(top).filter(F.to_date("parsed_at") >= F.date_sub(F.to_date("top"), 30))  # one row
    own = Window.partitionBy("snapshot_id").orderBy(F.desc("parsed_at"), F.desc("parse_id"))
    last = recent.withColumn("i", F.row_number().over(own)).filter("i = 1")
    return last.agg(F.count("*").alias("snapshots"), F.round(F.avg(F.when(F.col("parse_status") == "ok", 1.0).otherwise(0.0)), 8).alias("ratio"))


@query("q_json_props", "select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, count(distinct json_extract_string(props, '$.k')) as kinds from events group by event_type")
def json_props(v: Views) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return v.raw("events").groupBy("event_type").agg(F.sum(k).alias("total"), F.countDistinct(k).alias("kinds"))


@query("q_unknown_refs", "select distinct l_partkey as part from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 2)")
def unknown_refs(v: Views) -> DataFrame:
    return serving.unknown(v.raw("lineitem").select(F.col("l_partkey").alias("part")), v.raw("part").filter("p_size > 2").select(F.col("p_partkey").alias("part")))
