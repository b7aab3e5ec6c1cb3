"""Queries over the cluster history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import identity, validation
from weftline.operators.ranks import running
from weftline.plans.registry import query
from weftline.sources.views import Views

_D = "d as (select run_date, row_number() over (order by run_date desc) as i from (select distinct run_date from fx_hist))"
_DAYS = f"{_D}, cur as (select locality, cluster_id from fx_hist where run_date = (select run_date from d where i = 1)), prev as (select locality, cluster_id from fx_hist where run_date = (select run_date from d where i = 2))"
_OVER = f"{_DAYS}, o as (select c.cluster_id as new_id, p.cluster_id as old_id, count(*) as shared from cur c join prev p using (locality) group by 1, 2), cs as (select cluster_id, count(*) as n from cur group by 1), ps as (select cluster_id, count(*) as n from prev group by 1), ov as (select new_id, old_id, shared, cs.n + ps.n - shared as either, shared::double / (cs.n + ps.n - shared) as similarity from o join cs on cs.cluster_id = new_id join ps on ps.cluster_id = old_id)"


@query("q_cluster_overlap", f"with {_OVER} select new_id, old_id, shared, either, round(similarity, 8) as similarity, (shared * 1000000000) // either as weight from ov")
def cluster_overlap(v: Views) -> DataFrame:
    found = identity.overlaps(identity.day(v.history), identity.day(v.history, 1))
    return found.withColumn("similarity", F.round("similarity", 8))


@query("q_memberships", f"with {_DAYS} select cluster_id, string_agg(locality, ',' order by locality) as members, count(*) as n from cur group by cluster_id")
def memberships(v: Views) -> DataFrame:
    return identity.memberships(identity.day(v.history))


@query("q_history_days", "select count(distinct run_date) as days from fx_hist")
def history_days(v: Views) -> DataFrame:
    return v.history.agg(F.countDistinct("run_date").alias("days"))


@query("q_lookback_dates", f"with {_D} select run_date from d where i between 2 and 8")
def lookback_dates(v: Views) -> DataFrame:
    return identity.lookback_dates(v.history)


_STABILITY = f"{_DAYS}, past as (select h.* from fx_hist h join d on d.run_date = h.run_date where i between 2 and 8), b as (select run_date, cluster_id, count(*) as n from past group by 1, 2), s as (select c.cluster_id as i, p.run_date, p.cluster_id as j, count(*) as n from cur c join past p using (locality) group by 1, 2, 3), x as (select s.i, s.run_date, s.j, coalesce((s.n - 1)::double / nullif(cs.n + b.n - 2 - (s.n - 1), 0), 0) as x from s join (select cluster_id, count(*) as n from cur group by 1) cs on cs.cluster_id = s.i join b on b.run_date = s.run_date and b.cluster_id = s.j), st as (select c.locality, c.cluster_id, coalesce(sum(x.x), 0) / (select count(*) from d where i between 2 and 8) as stability from cur c left join past p on p.locality = c.locality left join x on x.i = c.cluster_id and x.run_date = p.run_date and x.j = p.cluster_id group by c.locality, c.cluster_id)"


@query("q_stability", f"with {_STABILITY} select locality, round(stability, 8) as stability from st")
def stability(v: Views) -> DataFrame:
    return identity.stability(v.history).select("locality", F.round("stability", 8).alias("stability"))


def _carded(v: Views) -> DataFrame:
    return identity.day(v.history).join(identity.stability(v.history), "locality")


@query("q_cluster_cards", f"with {_STABILITY} select cluster_id, count(*) as n, round(avg(stability), 6) as stability from st group by cluster_id")
def cluster_cards(v: Views) -> DataFrame:
    return _carded(v).groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("stability"), 6).alias("stability"))


@query("q_model_status", f"with {_STABILITY} select count(distinct cluster_id) as clusters, count(*) as localities, round(avg(stability), 3) as mean_stability from st")
def model_status(v: Views) -> DataFrame:
    return _carded(v).agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("localities"), F.round(F.avg("stability"), 3).alias("mean_stability"))


@query("q_rand_index", f"with {_DAYS}, m as (select c.locality, c.cluster_id as i, p.cluster_id as j from cur c join prev p using (locality)) select round(avg(case when (a.i = b.i) = (a.j = b.j) then 1.0::double else 0.0::double end), 8) as agreement from m a join m b on a.locality < b.locality")
def rand_index(v: Views) -> DataFrame:
    part = lambda df: df.select(F.col("locality").alias("member"), F.col("cluster_id").alias("cluster"))
    return validation.rand_index(part(identity.day(v.history)), part(identity.day(v.history, 1))).select(F.round("agreement", 8).alias("agreement"))


@query("q_lineage", f"with {_OVER}, e as (select *, similarity >= 0.5 as eligible, count(*) filter (similarity >= 0.5) over (partition by new_id) as of_new, count(*) filter (similarity >= 0.5) over (partition by old_id) as of_old from ov) select new_id, old_id, round(similarity, 8) as similarity, case when new_id = old_id and eligible then 'inherited' when not eligible then 'related' when of_new > 1 then 'merged' when of_old > 1 then 'split' else 'related' end as role from e")
def lineage(v: Views) -> DataFrame:
    new, old = identity.day(v.history), identity.day(v.history, 1)
    own = identity.overlaps(new, old).filter("similarity >= 0.5 and new_id = old_id").select("new_id", "old_id")
    return identity.lineage(new, old, own).withColumn("similarity", F.round("similarity", 8))


# two eligible partners of a cluster are its halves, so groups are stars and a pair is matched if it comes first on both sides
_MATCHED = f"{_OVER}, w as (select *, (shared * 1000000000) // either as weight from ov where similarity >= 0.5), mm as (select new_id, old_id from (select *, row_number() over (partition by new_id order by weight desc, old_id) as i, row_number() over (partition by old_id order by weight desc, new_id) as j from w) where i = 1 and j = 1)"


@query("q_id_matching", f"with {_MATCHED}, top as (select max(cluster_id) as top from fx_hist) select new_id, old_id as stable_id from mm union all select cluster_id, top + row_number() over (order by cluster_id) from (select distinct cluster_id from cur where cluster_id not in (select new_id from mm)) cross join top")
def id_matching(v: Views) -> DataFrame:
    new, old = identity.day(v.history), identity.day(v.history, 1)
    return identity.match_ids(new, old, 1 + (v.history.agg(F.max("cluster_id")).first()[0] or 0))


@query("q_allocate_ids", f"with {_DAYS} select cluster_id, (select max(cluster_id) from fx_hist) + row_number() over (order by cluster_id) as allocated from (select distinct cluster_id from cur)")
def allocate_ids(v: Views) -> DataFrame:
    top = v.history.agg(F.max("cluster_id").alias("top"))
    new = running(identity.day(v.history).select("cluster_id").distinct(), [F.col("cluster_id")]).crossJoin(top)  # one row
    return new.select("cluster_id", (F.col("top") + F.col("rank")).cast("long").alias("allocated"))


@query("q_cluster_points", f"with {_DAYS}, p as (select 'u' || cast(k as varchar) as locality, lat, lng from fx_locality_xy) select c.locality, c.cluster_id, round(lat, 6) as lat, round(lng, 6) as lng from cur c join p using (locality)")
def cluster_points(v: Views) -> DataFrame:
    spots = v.places.select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("locality"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
    return identity.day(v.history).join(spots, "locality", "left").filter("lat is not null and lng is not null").select("locality", "cluster_id", "lat", "lng")


@query("q_edge_cluster_label", f"with {_DAYS}, m as (select 'Brand#' || substr(locality, 2) as locality, cluster_id from cur) select e.locality_a, e.locality_b, case when a.cluster_id = b.cluster_id then concat('#', cast(a.cluster_id as varchar)) else '—' end as label from fx_edges e left join m a on a.locality = e.locality_a left join m b on b.locality = e.locality_b")
def edge_cluster_label(v: Views) -> DataFrame:
    own = identity.day(v.history).select(F.concat(F.lit("Brand#"), F.expr("substr(locality, 2)")).alias("locality"), "cluster_id")
    edges = v.edges.select("locality_a", "locality_b")
    for s in "ab":
        edges = edges.join(own.select(F.col("locality").alias(f"locality_{s}"), F.col("cluster_id").alias(f"c_{s}")), f"locality_{s}", "left")
    return edges.select("locality_a", "locality_b", F.when(F.col("c_a") == F.col("c_b"), F.concat(F.lit("#"), F.col("c_a").cast("string"))).otherwise("—").alias("label"))
