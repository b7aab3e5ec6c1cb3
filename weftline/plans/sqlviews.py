"""The same views as SQL for the oracle. A query's views are put before it."""

from __future__ import annotations

import re

VIEWS = {
    "fx_parses": "select o_orderkey as notice_id, case when o_orderkey % 50 = 0 then null else cast(cast(o_orderdate as date) as varchar) end as outage_date, case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'warning' else 'ok' end as parse_status from orders",
    "fx_notices": "select o_orderkey as notice_id, case when o_orderkey % 50 = 0 then null when o_orderkey % 37 = 0 then '31/02/2026' else strftime(o_orderdate, '%d/%m/%Y') end as raw_date, concat(case when o_orderkey % 29 = 0 then 'avis' else 'إشعار بانقطاع الكهرباء' end, ' - ', o_orderpriority) as title from orders",
    "fx_localities": "select l_orderkey as notice_id, concat('Brand#', cast((cast(substr(p_brand, 7) as int) - 1) // 5 * 5 + l_orderkey % 5 + 1 as varchar)) as canonical_name, case when l_orderkey % 7 = 0 then null else l_linenumber % 2 end as scope_ordinal, case when l_orderkey % 11 = 0 then null else l_returnflag end as subregion_name, l_linenumber as line from lineitem join part on l_partkey = p_partkey",
    "fx_obs": "select notice_id, case when scope_ordinal is null then 'notice_fallback' else 'subregion' end as scope_kind, coalesce(scope_ordinal, 0) as scope_ord, min(nullif(trim(coalesce(subregion_name, '')), '')) as scope_name, canonical_name from fx_localities group by all",
    "fx_ctx": "select locality, case when b % 7 = 0 then null else concat('unit-', cast(b % 10 as varchar)) end as service_unit_id, case when b % 3 = 0 then cast(1.0 as double) else cast(0.7 as double) end as spatial_confidence from (select distinct canonical_name as locality, cast(substr(canonical_name, 7) as int) as b from fx_localities)",
    "fx_pairs": "select a.notice_id, p.outage_date, a.scope_kind, a.scope_ord, a.scope_name, a.canonical_name as locality_a, b.canonical_name as locality_b, case when p.parse_status = 'ok' then cast(1.0 as double) else cast(0.7 as double) end as parse_c, case when a.scope_kind = 'subregion' then cast(1.0 as double) else cast(0.35 as double) end as scope_c, cast(1.0 as double) as canon_c, case when p.outage_date is null then null else cast(1.0 as double) end as temporal_c, case when ca.service_unit_id is null or cb.service_unit_id is null then null when ca.service_unit_id = cb.service_unit_id then least(ca.spatial_confidence, cb.spatial_confidence) else cast(0.0 as double) end as geo_c from fx_obs a join fx_obs b on a.notice_id = b.notice_id and a.scope_kind = b.scope_kind and a.scope_ord = b.scope_ord and a.canonical_name < b.canonical_name join fx_parses p on p.notice_id = a.notice_id left join fx_ctx ca on ca.locality = a.canonical_name left join fx_ctx cb on cb.locality = b.canonical_name",
    "fx_marg": "select canonical_name as locality, count(distinct notice_id) as n from fx_obs group by canonical_name",
    "fx_n": "select count(distinct notice_id) as n_total from fx_obs",
    "fx_edges": "{edges:fx_pairs}",
    "fx_w": "{weighted:fx_edges,fx_marg,fx_n}",
    "fx_hist": "select distinct cast(cast(ts as date) as varchar) as run_date, concat('u', cast(user_id as varchar)) as locality, cast((user_id // 10 + case when user_id % 7 = 0 then extract(day from ts) else 0 end) % 5 as int) as cluster_id from events",
    "fx_reports": "select event_id as id, case when event_type in ('click', 'view', 'error') then 'electricity' else 'water' end as utility, case when event_id % 4 = 0 then 'restored' else 'active' end as status, concat('GOV_', cast(user_id % 24 as varchar)) as governorate, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events",
    "fx_jobs": "select event_id as id, case when event_type in ('click', 'view') then 'scrape' else 'backfill' end as job_type, case when event_id % 9 = 0 then 'failed' when event_id % 10 = 1 then 'running' else 'completed' end as status, ts as started_at, case when event_id % 10 = 1 and event_id % 9 <> 0 then null else ts + interval 5 minute end as finished_at from events",
    "fx_job_events": "select event_id as id, event_id - event_id % 5 as job_id, ts as occurred_at, case event_type when 'error' then 'job_failed' when 'click' then 'page_started' when 'view' then 'page_completed' when 'signup' then 'job_started' else 'notice_imported' end as event_type from events",
    "fx_requests": "select event_id as seq, concat('/api/r', cast(user_id % 13 as varchar)) as route, case when event_id % 17 = 0 then 500 when event_id % 11 = 0 then 404 when event_id % 7 = 0 then 302 else 200 end as status, value as duration_ms, ts from events",
    "fx_snapshots": "select l_orderkey as notice_id, concat(cast(l_orderkey as varchar), '-', substr(sha256(concat(l_returnflag, l_linestatus)), 1, 20)) as snapshot_id, concat(l_returnflag, l_linestatus) as raw_html, l_shipdate as fetched_at, l_linenumber as seq from lineitem",
    "fx_parse_versions": "select l_orderkey as notice_id, concat('s', cast(l_orderkey as varchar)) as snapshot_id, concat('p', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as parse_id, cast(1 + l_linenumber % 3 as varchar) as parser_version, max(cast(cast(l_shipdate as date) as varchar)) as parsed_at, case when min(l_returnflag) = 'A' then 'ok' else 'warning' end as parse_status from lineitem group by l_orderkey, l_linenumber",
    "fx_states": "select notice_id, max(struct_pack(a := parsed_at, p := parse_id)).p as active_parse from fx_parse_versions group by notice_id",
    "fx_locality_xy": "select s_name as locality, s_suppkey as k, 34.2::double + (s_suppkey * 37 % 105) / 100::double as lat, 9.95::double + (s_suppkey * 53 % 145) / 100::double as lng, concat('GOV_', cast(s_nationkey as varchar)) as governorate, case when s_suppkey % 6 = 0 then null else concat('unit-', cast(s_nationkey as varchar)) end as service_unit_id, case when s_suppkey % 8 = 0 then 0.0::double when s_suppkey % 3 = 0 then 0.7::double else 1.0::double end as spatial_confidence from supplier",
    "fx_units": "select c_custkey as unit_id, concat('GOV_', cast(c_nationkey as varchar)) as governorate, case when c_custkey % 10 = 0 then null else 30 + (c_custkey * 29 % 900) / 100::double end as lat, case when c_custkey % 10 = 0 then null else 6.5::double + (c_custkey * 31 % 600) / 100::double end as lng from customer",
    "fx_assets": "select concat('node/', cast(p_partkey as varchar)) as asset_id, 34.1::double + (p_partkey * 41 % 125) / 100::double as lat, 9.85::double + (p_partkey * 59 % 165) / 100::double as lng, case when p_size % 4 = 0 then null else cast(p_size * 1000 as varchar) end as voltage, p_partkey as node_ref from part",
    "fx_lines": "select concat('way/', cast(p_partkey as varchar)) as edge_id, p_partkey as ref1, case when p_partkey % 5 = 0 then p_partkey else p_partkey + 1 end as ref2 from part",
}


def edges(pairs: str) -> str:
    return f"select locality_a, locality_b, count(*) as notice_count, count(distinct outage_date) as dd, avg(pc) as pc, avg(sc) as sc, avg(cc) as cc, avg(gc) as gc from (select locality_a, locality_b, notice_id, outage_date, avg(parse_c) as pc, avg(scope_c) as sc, avg(canon_c) as cc, avg(geo_c) as gc from {pairs} group by locality_a, locality_b, notice_id, outage_date) group by locality_a, locality_b"


def weighted(edges_: str, marg: str, total: str, plain: bool = False) -> str:
    factors, bonus = ("1.0::double", "1") if plain else ("pc * sc * cc", "(1 + 0.15::double * coalesce(gc, 0))")
    return f"select locality_a, locality_b, notice_count, dd, ppmi, ppmi * {factors} * least(1.0::double, dd / 3::double) * {bonus} as weight, n_total from (select e.*, n_total, greatest(0.0::double, ln((e.notice_count::double / n_total) / ((ma.n::double / n_total) * (mb.n::double / n_total)))) as ppmi from {edges_} e join {marg} ma on ma.locality = locality_a join {marg} mb on mb.locality = locality_b cross join {total})"


def with_views(query: str) -> str:
    """The query after a WITH clause of the views that it names, directly or through others."""

    def body(name: str) -> str:
        text = VIEWS[name]
        if m := re.fullmatch(r"\{(\w+):(.*)\}", text):
            return {"edges": edges, "weighted": weighted}[m[1]](*m[2].split(","))
        return text

    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in order:
                need(body(name))
                order.append(name)

    need(query)
    if not order:
        return query
    views = ", ".join(f"{n} as materialized ({body(n)})" for n in order)
    return f"with recursive {views}, {query.lstrip()[15:]}" if query.lstrip().startswith("with recursive ") else f"with {views}, {query.lstrip()[5:]}" if query.lstrip().startswith("with ") else f"with {views} {query}"
