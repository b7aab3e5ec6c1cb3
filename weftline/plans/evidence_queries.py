"""Queries over the evidence build: pinning, pairs, edges, validation inputs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as tx
from weftline.operators import delta
from weftline.operators import evidence as ev
from weftline.operators import readiness, validation
from weftline.plans import sqlviews
from weftline.plans.registry import query
from weftline.sources.views import Views


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("q_weighted_edges", "select locality_a, locality_b, notice_count, dd as distinct_dates, round(ppmi, 8) as ppmi, round(weight, 8) as weight from fx_w where dd >= 2 and weight > 0")
def weighted_edges(v: Views) -> DataFrame:
    return rounded(ev.gated(v.weighted), "ppmi", "weight").select("locality_a", "locality_b", "notice_count", F.col("dd").alias("distinct_dates"), "ppmi", "weight")


@query("q_incremental_edges", "select locality_a, locality_b, notice_count, dd, round(ppmi, 8) as ppmi, round(weight, 8) as weight from fx_w")
def incremental_edges(v: Views) -> DataFrame:
    """Today's edges, from an earlier build that lacked some notices and some lines of others, and the changes since."""
    key = F.col("notice_id") % 20
    earlier = ev.observations(v.localities.filter((key != 1) & ~((key == 0) & (F.col("line") == 1))))
    paired = lambda obs: (obs, ev.pair_observations(obs, v.parses, v.context))
    changed = lambda obs: obs.filter(key.isin(0, 1))
    before, held = changed(earlier), delta.sums(*paired(earlier))
    own = delta.together(held, delta.sums(*paired(before), sign=-1), delta.sums(*paired(changed(v.observations))))
    return rounded(delta.weighted(own), "ppmi", "weight").select("locality_a", "locality_b", "notice_count", "dd", "ppmi", "weight")


@query("q_unweighted_edges", f"select locality_a, locality_b, round(weight, 8) as weight from ({sqlviews.weighted('fx_edges', 'fx_marg', 'fx_n', True)}) where dd >= 2 and weight > 0")
def unweighted_edges(v: Views) -> DataFrame:
    plain = ev.weighted_edges(v.edges, v.marginals, ev.notice_total(v.observations), plain=True)
    return rounded(ev.gated(plain), "weight").select("locality_a", "locality_b", "weight")


@query("q_ppmi_edges", "select locality_a, locality_b, notice_count, ma.n as n_a, mb.n as n_b, n_total, round(ln((notice_count::double / n_total) / ((ma.n::double / n_total) * (mb.n::double / n_total))), 8) as pmi from fx_edges join fx_marg ma on ma.locality = locality_a join fx_marg mb on mb.locality = locality_b cross join fx_n")
def ppmi_edges(v: Views) -> DataFrame:
    joined = ev.with_marginals(v.edges, v.marginals, ev.notice_total(v.observations))
    return rounded(joined.withColumn("pmi", ev.pmi()), "pmi").select("locality_a", "locality_b", "notice_count", "n_a", "n_b", "n_total", "pmi")


@query("q_ppmi_v1", "select locality_a, locality_b, round(p, 8) as ppmi from (select locality_a, locality_b, ln((notice_count::double / n_total) / ((ma.n::double / n_total) * (mb.n::double / n_total))) as p from fx_edges join fx_marg ma on ma.locality = locality_a join fx_marg mb on mb.locality = locality_b cross join fx_n) where p > 0")
def ppmi_v1(v: Views) -> DataFrame:
    joined = ev.with_marginals(v.edges, v.marginals, ev.notice_total(v.observations)).withColumn("ppmi", ev.pmi()).filter("ppmi > 0")
    return rounded(joined, "ppmi").select("locality_a", "locality_b", "ppmi")


@query("q_pin_parses", "select notice_id, outage_date, parse_status from fx_parses where notice_id in (select notice_id from fx_localities)")
def pin_parses(v: Views) -> DataFrame:
    return v.parses.join(v.localities.select("notice_id").distinct(), "notice_id", "left_semi")


@query("q_locality_observations", "select notice_id, scope_kind, scope_ord, scope_name, canonical_name from fx_obs")
def locality_observations(v: Views) -> DataFrame:
    return ev.observations(v.localities).select("notice_id", "scope_kind", "scope_ord", "scope_name", "canonical_name")


@query("q_pair_observations", "select notice_id, scope_kind, scope_ord, outage_date, locality_a, locality_b, parse_c, scope_c, canon_c, temporal_c, geo_c from fx_pairs")
def pair_observations(v: Views) -> DataFrame:
    return v.pairs.drop("scope_name")


@query("q_confidence_case", "select notice_id, locality_a, locality_b, scope_ord, parse_c, scope_c from fx_pairs")
def confidence_case(v: Views) -> DataFrame:
    return v.pairs.select("notice_id", "locality_a", "locality_b", "scope_ord", "parse_c", "scope_c")


@query("q_geo_confidence", "select locality_a, locality_b, geo_c, count(*) as n from fx_pairs group by locality_a, locality_b, geo_c")
def geo_confidence(v: Views) -> DataFrame:
    return v.pairs.groupBy("locality_a", "locality_b", "geo_c").agg(F.count("*").alias("n"))


@query("q_marginals", "select locality, n from fx_marg")
def marginals(v: Views) -> DataFrame:
    return ev.marginals(ev.observations(v.localities))


@query("q_cooccurrences", "select locality_a, locality_b, count(distinct notice_id) as notice_count, count(distinct outage_date) as dd, min(outage_date) as first_date, max(outage_date) as last_date from fx_pairs group by locality_a, locality_b")
def cooccurrences(v: Views) -> DataFrame:
    return ev.cooccurrences(v.pairs)


@query("q_edge_inputs", "select locality_a, locality_b, notice_count, dd, round(pc, 8) as pc, round(sc, 8) as sc, round(cc, 8) as cc, round(gc, 8) as gc from fx_edges")
def edge_inputs(v: Views) -> DataFrame:
    return rounded(v.edges, "pc", "sc", "cc", "gc")


@query("q_build_counts", "select (select count(distinct notice_id) from fx_obs) as notices, (select count(*) from fx_marg) as localities, (select count(*) from fx_edges) as pairs")
def build_counts(v: Views) -> DataFrame:
    one = v.observations.agg(F.countDistinct("notice_id").alias("notices"), F.countDistinct("canonical_name").alias("localities"))
    return one.crossJoin(v.pairs.select("locality_a", "locality_b").distinct().agg(F.count("*").alias("pairs")))  # two single rows


_EARLY = "(select outage_date from (select outage_date, row_number() over (order by outage_date) as i, count(*) over () as n from (select distinct outage_date from fx_pairs where outage_date is not null)) where i <= least(greatest(floor(n * 0.8), 1), n - 1))"


@query("q_temporal_split", "select outage_date, case when i <= least(greatest(floor(n * 0.8), 1), n - 1) then 'train' else 'holdout' end as part from (select outage_date, row_number() over (order by outage_date) as i, count(*) over () as n from (select distinct outage_date from fx_pairs where outage_date is not null))")
def temporal_split(v: Views) -> DataFrame:
    return validation.temporal_split(v.settled_pairs.select("outage_date"))


@query("q_restrict_dates", f"select locality_a, locality_b, notice_count, dd from ({sqlviews.edges('(select * from fx_pairs where outage_date in ' + _EARLY + ')')})")
def restrict_dates(v: Views) -> DataFrame:
    dates = validation.temporal_split(v.settled_pairs.select("outage_date")).filter("part = 'train'")
    return ev.edge_inputs(ev.restricted(v.settled_pairs, dates)).select("locality_a", "locality_b", "notice_count", "dd")


@query("q_holdout_pairs", f"select distinct locality_a, locality_b from fx_pairs where outage_date is not null and outage_date not in {_EARLY}")
def holdout_pairs(v: Views) -> DataFrame:
    dates = validation.temporal_split(v.settled_pairs.select("outage_date")).filter("part = 'holdout'")
    return ev.restricted(v.settled_pairs, dates).select("locality_a", "locality_b").distinct()


_LARGEST = "(select notice_id from fx_pairs group by notice_id order by count(*) desc, notice_id limit 1)"


@query("q_largest_notice", "select notice_id, count(*) as n from fx_pairs group by notice_id order by n desc, notice_id limit 1")
def largest_notice(v: Views) -> DataFrame:
    return validation.largest_notice(v.pairs)


@query("q_largest_share", "select max(n)::double / sum(n) as share from (select count(*) as n from fx_pairs group by notice_id)")
def largest_share(v: Views) -> DataFrame:
    return v.pairs.groupBy("notice_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("share"))


_WITHOUT = {n: f"(select * from {n} where notice_id <> {_LARGEST})" for n in ("fx_pairs", "fx_obs")}
_ABLATED = sqlviews.weighted(f"({sqlviews.edges(_WITHOUT['fx_pairs'])})", f"(select canonical_name as locality, count(distinct notice_id) as n from {_WITHOUT['fx_obs']} group by canonical_name)", f"(select count(distinct notice_id) as n_total from {_WITHOUT['fx_obs']})")


@query("q_exclude_notice", f"select locality_a, locality_b, notice_count, dd from ({sqlviews.edges(_WITHOUT['fx_pairs'])})")
def exclude_notice(v: Views) -> DataFrame:
    return ev.edge_inputs(validation.without_largest(v.settled_pairs, v.settled_pairs)).select("locality_a", "locality_b", "notice_count", "dd")


@query(
    "q_ablation_edges",
    f"select 'raw' as variant, locality_a, locality_b, round(weight, 8) as weight from ({sqlviews.weighted('fx_edges', 'fx_marg', 'fx_n', True)}) where dd >= 2 and weight > 0"
    " union all select 'min_dates_plus_one', locality_a, locality_b, round(weight, 8) from fx_w where dd >= 3 and weight > 0"
    f" union all select 'largest_notice_removed', locality_a, locality_b, round(weight, 8) from ({_ABLATED}) where dd >= 2 and weight > 0",
)
def ablation_edges(v: Views) -> DataFrame:
    out = None
    for name, (edges, _) in validation.ablations(v.observations, v.pairs).items():
        own = rounded(edges, "weight").select(F.lit(name).alias("variant"), "locality_a", "locality_b", "weight")
        out = own if out is None else out.unionByName(own)
    return out


@query("q_inconsistent_pairs", "select locality_a, locality_b from fx_edges join fx_marg ma on ma.locality = locality_a join fx_marg mb on mb.locality = locality_b cross join fx_n where notice_count > least(ma.n, mb.n) or greatest(ma.n, mb.n) > n_total or notice_count <= 0 or locality_a >= locality_b")
def inconsistent_pairs(v: Views) -> DataFrame:
    return ev.inconsistencies(v.edges, v.marginals, ev.notice_total(v.observations)).select("locality_a", "locality_b")


@query("q_node_diagnostics", "select m.locality, count(*) filter (dd < 2) as gated_pairs, count(*) filter (dd >= 2 and weight <= 0) as unweighted_pairs from fx_marg m left join (select locality_a as locality, dd, weight from fx_w union all select locality_b, dd, weight from fx_w) e on e.locality = m.locality group by m.locality")
def node_diagnostics(v: Views) -> DataFrame:
    return ev.node_diagnostics(v.weighted, v.marginals)


@query("q_graph_nodes", "select locality from fx_marg union select locality_a from fx_w union select locality_b from fx_w")
def graph_nodes(v: Views) -> DataFrame:
    ends = v.edges.select(F.explode(F.array("locality_a", "locality_b")).alias("locality"))
    return ends.unionByName(v.marginals.select("locality")).distinct()


@query("q_edge_evidence", "select locality_a, locality_b, notice_id, outage_date, scopes from (select locality_a, locality_b, notice_id, outage_date, string_agg(distinct coalesce(scope_name, ''), '|' order by coalesce(scope_name, '')) as scopes from fx_pairs where locality_a = (select locality_a from fx_edges order by notice_count desc, locality_a, locality_b limit 1) and locality_b = (select locality_b from fx_edges order by notice_count desc, locality_a, locality_b limit 1) group by locality_a, locality_b, notice_id, outage_date)")
def edge_evidence(v: Views) -> DataFrame:
    top = v.edges.orderBy(F.desc("notice_count"), "locality_a", "locality_b").limit(1).select("locality_a", "locality_b")
    return validation.edge_evidence(v.pairs, top)


@query("q_independent_dates", "select count(distinct outage_date) as dates from fx_pairs where locality_a in (select locality from fx_marg order by n desc, locality limit 10) and locality_b in (select locality from fx_marg order by n desc, locality limit 10)")
def independent_dates(v: Views) -> DataFrame:
    names = v.marginals.orderBy(F.desc("n"), "locality").limit(10).select("locality")
    return validation.independent_dates(v.pairs, names)


@query("q_edge_text_filter", "select e.locality_a, e.locality_b, round(weight, 8) as weight, round(max(weight) over (), 8) as max_weight from fx_w e where dd >= 2 and weight > 0 and (contains(lower(locality_a), '#1') or contains(lower(locality_b), '#1'))")
def edge_text_filter(v: Views) -> DataFrame:
    found = ev.gated(v.weighted).filter(F.lower("locality_a").contains("#1") | F.lower("locality_b").contains("#1"))
    top = found.agg(F.max("weight").alias("max_weight"))
    return rounded(found.crossJoin(top), "weight", "max_weight").select("locality_a", "locality_b", "weight", "max_weight")  # one row


@query("q_legacy_pair_counts", "select locality_a, locality_b, count(*) as n, max(outage_date) as last_seen from fx_pairs group by locality_a, locality_b")
def legacy_pair_counts(v: Views) -> DataFrame:
    return v.pairs.groupBy("locality_a", "locality_b").agg(F.count("*").alias("n"), F.max("outage_date").alias("last_seen"))


@query("q_constraint_violations", "select 'notice_count_positive' as rule, count(*) filter (notice_count <= 0) as rows from fx_edges union all select 'confidence_in_range', count(*) filter (pc < 0 or pc > 1 or sc < 0 or sc > 1) from fx_edges union all select 'ends_in_order', count(*) filter (locality_a >= locality_b) from fx_edges union all select 'dates_within_notices', count(*) filter (dd > notice_count) from fx_edges")
def constraint_violations(v: Views) -> DataFrame:
    rules = {"notice_count_positive": F.col("notice_count") <= 0, "confidence_in_range": ~F.col("pc").between(0, 1) | ~F.col("sc").between(0, 1), "ends_in_order": F.col("locality_a") >= F.col("locality_b"), "dates_within_notices": F.col("dd") > F.col("notice_count")}
    return validation.violations(v.edges, rules)


_METRICS = "select (select count(distinct notice_id) from fx_pairs) as valid_notices, (select count(distinct outage_date) from fx_pairs) as distinct_outage_dates, (select count(*) from fx_marg) as unique_localities, (select count(*) from fx_edges where dd >= 2) as repeated_pairs, (select coalesce(avg(case when parse_status = 'ok' then 1.0::double else 0.0::double end), 0) from fx_parses where notice_id in (select notice_id from fx_obs)) as active_ok_ratio, (select coalesce(max(n)::double / sum(n), 0) from (select count(*) as n from fx_pairs group by notice_id)) as largest_notice_pair_share"
_NEEDS = (("valid_notices", ">=", 30), ("distinct_outage_dates", ">=", 15), ("unique_localities", ">=", 10), ("repeated_pairs", ">=", 20), ("active_ok_ratio", ">=", 0.8), ("largest_notice_pair_share", "<=", 0.2))
_SIGNALS = " union all ".join(f"select '{k}' as key, {k}::double as current, {r}::double as required, {k} {op} {r} as passed from m" for k, op, r in _NEEDS)


@query("q_readiness_metrics", f"select valid_notices, distinct_outage_dates, unique_localities, repeated_pairs, round(active_ok_ratio, 8) as active_ok_ratio, round(largest_notice_pair_share, 8) as largest_notice_pair_share from ({_METRICS})")
def readiness_metrics(v: Views) -> DataFrame:
    return rounded(readiness.metrics(v.parses, v.observations, v.settled_pairs), "active_ok_ratio", "largest_notice_pair_share")


@query("q_readiness_signals", f"with m as ({_METRICS}) select key, round(current, 8) as current, required, passed from ({_SIGNALS})")
def readiness_signals(v: Views) -> DataFrame:
    return rounded(readiness.signals(readiness.metrics(v.parses, v.observations, v.settled_pairs)), "current").select("key", "current", "required", "passed")


@query("q_quality_gates", f"with m as ({_METRICS}), s as ({_SIGNALS}) select key, case when passed then 'pass' else 'fail' end as status, concat(key, case when passed then '_pass' when current is null then '_not_measured' when key = 'largest_notice_pair_share' then '_above_maximum' else '_below_minimum' end) as reason from s")
def quality_gates(v: Views) -> DataFrame:
    return readiness.gates(readiness.signals(readiness.metrics(v.parses, v.observations, v.settled_pairs))).select("key", "status", "reason")


_OPERATIONS = "select (select avg(case when parse_status = 'ok' then 1.0::double else 0.0::double end) from (select *, row_number() over (partition by snapshot_id order by parsed_at desc, parse_id desc) as i from fx_parse_versions where cast(parsed_at as date) >= (select max(cast(parsed_at as date)) from fx_parse_versions) - interval 30 day) where i = 1) as recent_parse_success_ratio, (select greatest(0, epoch_us((select max(started_at) from fx_jobs)) - epoch_us(max(finished_at))) / 3.6e9 from fx_jobs where job_type = 'scrape' and status = 'completed') as scrape_freshness"
_OPERATED = " union all ".join(f"select '{k}' as key, {k}::double as current, {r}::double as required, coalesce({k} {op} {r}, false) as passed from o" for k, op, r in (("recent_parse_success_ratio", ">=", 0.8), ("scrape_freshness", "<=", 48)))
_REPORT = f"with m as ({_METRICS}), o as ({_OPERATIONS}), r as (select 'model_quality' as section, * from ({_SIGNALS}) union all select 'operational_health', * from ({_OPERATED}))"


def _report(v: Views) -> DataFrame:
    now = v.jobs.agg(F.max("started_at").alias("now")).crossJoin(v.parse_versions.agg(F.to_date(F.max("parsed_at")).alias("today")))  # single rows
    return readiness.report(readiness.metrics(v.parses, v.observations, v.settled_pairs), readiness.operational_metrics(v.jobs, v.parse_versions, now))


@query("q_readiness_report", f"{_REPORT} select section, key, round(current, 6) as current, required, passed, bool_and(passed) over (partition by section) as ready from r")
def readiness_report(v: Views) -> DataFrame:
    return rounded(_report(v), "current", places=6).select("section", "key", "current", "required", "passed", "ready")


@query("q_publication_decision", f"{_REPORT}, s as (select bool_and(passed) filter (section = 'model_quality') as model_quality, bool_and(passed) filter (section = 'operational_health') as operational_health from r) select *, case when not model_quality then 'blocked' when not operational_health then 'experimental' else 'published' end as decision, case when not model_quality then 'model_gates_failed' when not operational_health then 'operational_gates_failed' else 'all_gates_pass' end as reason from s")
def publication_decision(v: Views) -> DataFrame:
    return readiness.decided(_report(v))


_SEEN = f"(select distinct canonical_name as locality, cast(substr(canonical_name, 7) as int) % 2 as cluster from fx_obs where notice_id in (select notice_id from fx_pairs where outage_date in {_EARLY}))"


@query("q_holdout_recall", f"select count(*) as scorable, count(*) filter (a.cluster = b.cluster) as hits, round(count(*) filter (a.cluster = b.cluster) / count(*)::double, 8) as recall from (select distinct locality_a, locality_b from fx_pairs where outage_date is not null and outage_date not in {_EARLY}) h join {_SEEN} a on a.locality = locality_a join {_SEEN} b on b.locality = locality_b")
def holdout_recall(v: Views) -> DataFrame:
    """Recall of a partition that the oracle can state too: localities of training dates by the parity of their number."""
    parts = validation.temporal_split(v.settled_pairs.select("outage_date"))
    early, late = (ev.restricted(v.settled_pairs, parts.filter(F.col("part") == p)) for p in ("train", "holdout"))
    seen = v.observations.join(early.select("notice_id").distinct(), "notice_id", "left_semi").select(F.col("canonical_name").alias("locality")).distinct()
    partition = seen.withColumn("cluster", F.substring("locality", 7, 9).cast("int") % 2)
    return rounded(validation.holdout_recall(partition, late.select("locality_a", "locality_b").distinct()), "recall")


@query("q_validation_report")
def validation_report(v: Views) -> DataFrame:
    return validation.validation_report(v.observations, v.settled_pairs, v.parses, "build-1")


@query("q_activation_guards", f"with m as ({_METRICS}), s as ({_SIGNALS}), g as (select (select count(*) from fx_edges where dd >= 2) > 0 as run_completed, (select count(*) from fx_obs) > 0 as build_active, (select count(distinct outage_date) from fx_pairs) > 1 as validation_completed, (select bool_and(passed) from s) as published) select *, case when not run_completed then 'run_not_completed' when not build_active then 'build_not_active' when not validation_completed then 'validation_not_completed' when not published then 'not_published' end as refusal from g")
def activation_guards(v: Views) -> DataFrame:
    return readiness.activation_guards(v.parses, v.observations, v.settled_pairs, ev.edge_inputs(v.settled_pairs))


def _components(name: str, edges: str, nodes: str) -> str:
    """CTEs that end in name(locality, cluster): localities and the least of those they are linked to.

    On the given tables each community is all of a component, so SQL can follow the links; communities inside one
    are held to a plain version in tests/test_community.py."""
    return (
        f"{name}_l as (select locality_a as u, locality_b as v from ({edges}) union select locality_b, locality_a from ({edges})), "
        f"{name}_r(u, v) as (select locality, locality from ({nodes}) union select r.u, l.v from {name}_r r join {name}_l l on l.u = r.v), {name} as (select u as locality, min(v) as cluster from {name}_r group by u)"
    )


_GATED = "select locality_a, locality_b, weight from {} where dd >= 2 and weight > 0"
_TRAINED = f"(select * from fx_obs where notice_id in (select notice_id from fx_pairs where outage_date in {_EARLY}))"
_TRAINED_MARG = f"(select canonical_name as locality, count(distinct notice_id) as n from {_TRAINED} group by canonical_name)"
_TRAINED_W = sqlviews.weighted(f"({sqlviews.edges('(select * from fx_pairs where outage_date in ' + _EARLY + ')')})", _TRAINED_MARG, f"(select count(distinct notice_id) as n_total from {_TRAINED})")
_READINGS = ", ".join([
    f"full_w as materialized ({_GATED.format('fx_w')})", _components("whole", "select * from full_w", "select locality from fx_marg"),
    _components("plain", _GATED.format(f"({sqlviews.weighted('fx_edges', 'fx_marg', 'fx_n', True)})"), "select locality from fx_marg"), _components("fewer", "select locality_a, locality_b from fx_w where dd >= 3 and weight > 0", "select locality from fx_marg"),
    f"less_w as materialized ({_GATED.format(f'({_ABLATED})')})", _components("less", "select * from less_w", f"select distinct canonical_name as locality from {_WITHOUT['fx_obs']}"),
    f"trained_w as materialized ({_GATED.format(f'({_TRAINED_W})')})", _components("trained", "select * from trained_w", f"select distinct canonical_name as locality from {_TRAINED}"),
    f"held as (select distinct locality_a, locality_b from fx_pairs where outage_date is not null and outage_date not in {_EARLY})",
    "ends as (select c.cluster, sum(weight) as d from (select locality_a as locality, weight from full_w union all select locality_b, weight from full_w) join whole c using (locality) group by c.cluster)",
])
_AGREE = "(select round(avg(case when (a.cluster = b.cluster) = (x.cluster = y.cluster) then 1.0::double else 0.0::double end), 8) from whole a join whole b on a.locality < b.locality join {0} x on x.locality = a.locality join {0} y on y.locality = b.locality)"


@query(
    "q_cluster_readings",
    f"with recursive {_READINGS} select (select count(distinct cluster) from whole) as clusters, (select round(sum(case when a.cluster = b.cluster then weight else 0 end) / sum(weight) - (select sum(d * d) from ends) / (4 * sum(weight) * sum(weight)), 8) from full_w join whole a on a.locality = locality_a join whole b on b.locality = locality_b) as modularity, "
    "(select round(count(*) filter (a.cluster = b.cluster) / count(*)::double, 8) from held join trained a on a.locality = locality_a join trained b on b.locality = locality_b) as held_out_edge_recall, "
    f"{_AGREE.format('plain')} as raw_cooccurrence_baseline, {_AGREE.format('less')} as largest_notice_removed_agreement, {_AGREE.format('fewer')} as config_sensitivity_agreement",
)
def cluster_readings(v: Views) -> DataFrame:
    found = validation.cluster_readings(v.observations, v.settled_pairs)
    return rounded(found, *[c for c in found.columns if c != "clusters"])


@query("q_planted_inconsistencies", "select locality_a, locality_b, planted from (select case when k = 3 then locality_b else locality_a end as locality_a, case when k = 3 then locality_a else locality_b end as locality_b, case k when 0 then n_total + 1 when 1 then 0 else notice_count end as planted, n_total from (select *, cast(substr(locality_a, 7) as int) % 5 as k from fx_edges cross join fx_n)) left join fx_marg ma on ma.locality = locality_a left join fx_marg mb on mb.locality = locality_b where planted > least(ma.n, mb.n) or planted <= 0 or locality_a >= locality_b")
def planted_inconsistencies(v: Views) -> DataFrame:
    """Edges some of which were given too many notices, none, or their ends the wrong way round."""
    k = F.substring("locality_a", 7, 9).cast("int") % 5
    total = ev.notice_total(v.observations)
    edges = v.edges.withColumn("k", k).crossJoin(total.withColumnRenamed("n_total", "top"))  # one row
    turned = edges.select(F.when(F.col("k") == 3, F.col("locality_b")).otherwise(F.col("locality_a")).alias("locality_a"), F.when(F.col("k") == 3, F.col("locality_a")).otherwise(F.col("locality_b")).alias("locality_b"), F.when(F.col("k") == 0, F.col("top") + 1).when(F.col("k") == 1, 0).otherwise(F.col("notice_count")).alias("notice_count"))
    return ev.inconsistencies(turned, v.marginals, total).select("locality_a", "locality_b", F.col("notice_count").alias("planted"))


@query("q_clusters", f"with recursive {_components('whole', _GATED.format('fx_w'), 'select locality from fx_marg')} select locality, dense_rank() over (order by cluster) - 1 as cluster_id from whole")
def clusters(v: Views) -> DataFrame:
    from weftline.operators.community import clusters_of

    return clusters_of(ev.gated(v.weighted), v.marginals.select("locality"))


@query("q_bootstrap")
def bootstrap(v: Views) -> DataFrame:
    return validation.bootstrap(v.observations, v.settled_pairs, v.parses)


_PER_NOTICE = "select p.notice_id, parse_status, outage_date, count(distinct canonical_name) as n, count(subregion_name) as headed from fx_parses p left join fx_localities l on l.notice_id = p.notice_id group by p.notice_id, parse_status, outage_date"


@query("q_activation_eligible", f"select notice_id, parse_status, n as localities, parse_status = 'ok' or parse_status = 'warning' and n >= 2 as eligible from ({_PER_NOTICE})")
def activation_eligible(v: Views) -> DataFrame:
    return readiness.activation_eligible(v.parses, v.localities)


_READ = f"select p.notice_id, raw_date, title, count(l.notice_id) as n, count(l.notice_id) filter (scope_ordinal is not null and coalesce(trim(subregion_name), '') = '') as headless from fx_notices p left join fx_localities l on l.notice_id = p.notice_id group by p.notice_id, raw_date, title"
_WARNINGS = f"concat_ws(',', case when coalesce(raw_date, '') = '' then 'missing_notice_date' end, case when raw_date <> '' and try_strptime(raw_date, '%d/%m/%Y') is null then 'invalid_notice_date' end, case when not contains(title, '{tx.TITLE_MARKER}') then 'unmatched_notice_title' end, case when headless > 0 then 'missing_subregion_header' end, case when n = 0 then 'empty_locality_list' end)"


@query("q_parse_status", f"select notice_id, warnings, case when warnings = '' then 'ok' else 'warning' end as status from (select notice_id, {_WARNINGS} as warnings from ({_READ}))")
def parse_status(v: Views) -> DataFrame:
    return readiness.parse_warnings(v.notices, v.localities).select("notice_id", F.array_join("warnings", ",").alias("warnings"), F.when(F.size("warnings") == 0, "ok").otherwise("warning").alias("status"))


@query("q_warning_set", f"select w as warning, count(*) as n from (select unnest(string_split({_WARNINGS}, ',')) as w from ({_READ})) where w <> '' group by w")
def warning_set(v: Views) -> DataFrame:
    return readiness.parse_warnings(v.notices, v.localities).select(F.explode(F.array_distinct("warnings")).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query("q_scope_ordinals", "select notice_id, line, subregion_name, case when bool_and(subregion_name is null) over (partition by notice_id) then null else cast(sum(step) over (partition by notice_id order by line, canonical_name, rn rows unbounded preceding) as bigint) end as ordinal from (select *, case when lag(coalesce(subregion_name, '')) over (partition by notice_id order by line, canonical_name, rn) <> coalesce(subregion_name, '') then 1 else 0 end as step from (select *, row_number() over (partition by notice_id, line, canonical_name order by subregion_name) as rn from fx_localities))")
def scope_ordinals(v: Views) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("notice_id", "line", "canonical_name").orderBy("subregion_name"))
    return validation.scope_ordinals(v.localities.withColumn("rn", rn), ["line", "canonical_name", "rn"]).select("notice_id", "line", "subregion_name", "ordinal")


@query("q_duplicate_keys", "select notice_id, canonical_name, line from (select *, row_number() over (partition by notice_id, canonical_name order by line) as i from (select distinct notice_id, canonical_name, line from fx_localities)) where i > 1")
def duplicate_keys(v: Views) -> DataFrame:
    seen = F.row_number().over(Window.partitionBy("notice_id", "canonical_name").orderBy("line"))
    return v.localities.select("notice_id", "canonical_name", "line").distinct().withColumn("i", seen).filter("i > 1").drop("i")
