"""Queries over places, assets and the power topology."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import CANDIDATE_WEIGHTS, PILOT_BOX
from weftline.operators import spatial as sp
from weftline.operators.lifecycle import candidate_status
from weftline.plans.registry import query
from weftline.sources.fetch import misses
from weftline.sources.views import Views

_KM = "2 * 6371.0088::double * asin(least(1.0::double, sqrt(pow(sin((radians(l.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(l.lat)) * pow(sin((radians(l.lng) - radians(a.lng)) / 2), 2))))"
_NEAR = f"select a.asset_id, a.voltage, l.locality, l.service_unit_id, l.spatial_confidence, {_KM} as km from fx_assets a join fx_locality_xy l on abs(a.lat - l.lat) < 0.08 where {_KM} <= 8"
_REACH = "refs as (select asset_id as e, node_ref as n from fx_assets union select edge_id, ref1 from fx_lines union select edge_id, ref2 from fx_lines), link as (select distinct a.e as u, b.e as v from refs a join refs b using (n)), reach(u, v) as (select e, e from refs union select r.u, l.v from reach r join link l on l.u = r.v), comp as (select u as element, min(v) as root from reach group by u)"
_FEAT = f"{_REACH}, near as ({_NEAR}), acc as (select count(*) as total from fx_locality_xy where spatial_confidence > 0), nearok as (select * from near where spatial_confidence > 0), wired as (select distinct root from comp join fx_lines on edge_id = element), rc as (select root, count(distinct locality) as reach from nearok join comp on element = asset_id group by root), pu as (select asset_id, service_unit_id, count(*) as k from nearok group by 1, 2), own as (select asset_id, sum(k) as n, max(k) filter (service_unit_id is not null) as top, coalesce(sum(k) filter (service_unit_id is not null), 0) as known from pu group by 1), dist as (select asset_id, sum(km) as km from nearok group by 1), feat as (select * from (select own.asset_id, n::double / total as outage_fit, case when w.root is not null then reach::double / total else 0.0::double end as topology_consistency, coalesce(top, 0)::double / n as service_prior, greatest(0.0::double, 1 - km / n / 8) as distance_score, 1.0::double as temporal_support, ((a.voltage is not null)::int + (w.root is not null)::int + (known = n)::int) / 3::double as completeness from own join dist using (asset_id) join fx_assets a using (asset_id) join comp c on c.element = own.asset_id left join wired w on w.root = c.root left join rc on rc.root = c.root cross join acc) where (topology_consistency > 0 or service_prior > 0) and completeness >= 0.5)"
_NAMES = list(CANDIDATE_WEIGHTS)


def _score(weights: dict[str, float]) -> str:
    return "round(" + " + ".join(f"{k} * {w!r}::double" for k, w in weights.items()) + ", 9)"


@query("q_bbox_nodes", f"select asset_id, round(lat, 6) as lat, round(lng, 6) as lng from fx_assets where lat between {PILOT_BOX[0]}::double and {PILOT_BOX[2]}::double and lng between {PILOT_BOX[1]}::double and {PILOT_BOX[3]}::double")
def bbox_nodes(v: Views) -> DataFrame:
    return v.assets.filter(sp.in_box(F.col("lat"), F.col("lng"))).select("asset_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_BOXES = [("north", 34.8, 9.0, 36.0, 12.0), ("middle", 34.5, 9.0, 34.9, 12.0), ("south", 33.0, 9.0, 34.4, 12.0)]
_BOX_SQL = " union all ".join(f"select '{n}' as area_id, {a}::double as y1, {b}::double as x1, {c}::double as y2, {d}::double as x2" for n, a, b, c, d in _BOXES)


@query("q_point_in_bbox", f"with b as ({_BOX_SQL}) select asset_id as locality, case when count(area_id) = 1 then min(area_id) end as area_id, count(area_id) > 1 as ambiguous from fx_assets left join b on lat between y1 and y2 and lng between x1 and x2 group by asset_id")
def point_in_bbox(v: Views) -> DataFrame:
    rings = [(n, [[[b, a], [d, a], [d, c], [b, c], [b, a]]]) for n, a, b, c, d in _BOXES]
    areas = v.spark.createDataFrame(rings, "area_id string, rings array<array<array<double>>>")
    return sp.containing_area(v.assets.select(F.col("asset_id").alias("locality"), "lat", "lng"), areas).select("locality", "area_id", "ambiguous")


#: a comb with two notches and a square hole, in hundredths of a degree from its corner
_COMB = [[(0, 0), (60, 0), (60, 50), (45, 50), (45, 20), (35, 30), (25, 50), (10, 50), (10, 25), (0, 40)], [(15, 5), (30, 5), (30, 15), (15, 15)]]
_CORNER = "34.1::double + (n_nationkey * 17 % 90) / 100", "9.85::double + (n_nationkey * 29 % 120) / 100"


def _combs(v: Views) -> DataFrame:
    """One polygon for each nation; some reach into each other."""
    k = F.col("n_nationkey")
    south, west = 34.1 + (k * 17 % 90) / 100, 9.85 + (k * 29 % 120) / 100
    rings = F.array(*[F.array(*[F.array(west + F.lit(x) / 100, south + F.lit(y) / 100) for x, y in ring]) for ring in _COMB])
    return v.raw("nation").select(F.concat(F.lit("area-"), k.cast("string")).alias("area_id"), rings.alias("rings"))


_SIDES = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for ring in _COMB for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))
_HELD = f"""side as (select concat('area-', cast(n_nationkey as varchar)) as area_id, {_CORNER[1]}::double + a / 100::double as x1, {_CORNER[0]}::double + b / 100::double as y1, {_CORNER[1]}::double + c / 100::double as x2, {_CORNER[0]}::double + d / 100::double as y2 from nation cross join (values {_SIDES}) s(a, b, c, d)),
held as (select asset_id, area_id from (select asset_id, area_id, bool_or((lng - x1) * (y2 - y1) = (lat - y1) * (x2 - x1) and lng between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)) as edge,
  count(*) filter ((y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) as crossed from fx_assets cross join side group by asset_id, area_id) where edge or crossed % 2 = 1)"""


@query("q_points_in_polygons", f"with {_HELD} select a.asset_id as locality, case when count(area_id) = 1 then min(area_id) end as area_id, count(area_id) > 1 as ambiguous from fx_assets a left join held h on h.asset_id = a.asset_id group by a.asset_id")
def points_in_polygons(v: Views) -> DataFrame:
    """Assets in areas that are not convex and have holes; many lie on a boundary."""
    return sp.containing_area(v.assets.select(F.col("asset_id").alias("locality"), "lat", "lng"), _combs(v)).select("locality", "area_id", "ambiguous")


@query("q_area_counts", f"with {_HELD} select area_id, count(*) as assets from held group by area_id")
def area_counts(v: Views) -> DataFrame:
    spots = v.assets.select("asset_id", "lat", "lng")
    return spots.join(sp.held(spots, _combs(v)), ["lng", "lat"]).groupBy("area_id").agg(F.count("*").alias("assets"))


@query("q_nearest_unit", "select locality, unit_id from (select locality, unit_id, row_number() over (partition by locality order by sqrt(pow(l.lat - u.lat, 2) + pow(l.lng - u.lng, 2)), unit_id) as i from fx_locality_xy l join fx_units u on u.governorate = l.governorate where u.lat is not null) where i = 1")
def nearest_unit(v: Views) -> DataFrame:
    return sp.nearest_within(v.places, v.units, "governorate", "unit_id", "locality").select("locality", "unit_id")


@query("q_range_join_haversine", f"select asset_id, locality, round(km, 6) as km from ({_NEAR})")
def range_join(v: Views) -> DataFrame:
    return sp.within_radius(v.assets, v.places, digits=6).select("asset_id", F.col("p_locality").alias("locality"), "km")


@query("q_service_purity", f"select asset_id, max(k) filter (service_unit_id is not null)::double / sum(k) as purity from (select asset_id, service_unit_id, count(*) as k from ({_NEAR}) group by 1, 2) group by asset_id")
def service_purity(v: Views) -> DataFrame:
    return sp.purity(v.assets, v.places)


@query("q_element_union", "select element, count(*) as refs from (select asset_id as element, node_ref from fx_assets union select edge_id, ref1 from fx_lines union select edge_id, ref2 from fx_lines) group by element")
def element_union(v: Views) -> DataFrame:
    return sp.element_refs(v.assets, v.lines).groupBy("element").agg(F.count("*").alias("refs"))


@query("q_connected_components", f"with recursive {_REACH} select element, dense_rank() over (order by root) - 1 as component from comp")
def components(v: Views) -> DataFrame:
    return sp.numbered(sp.topology_components(v.assets, v.lines))


@query("q_component_reach", f"with recursive {_REACH} select root, count(distinct locality) as reach from ({_NEAR}) join comp on element = asset_id group by root")
def component_reach(v: Views) -> DataFrame:
    return sp.reach(v.assets, sp.topology_components(v.assets, v.lines), v.places, sp.near_spots(v.assets, v.places))


@query("q_way_centroid", "select edge_id, round(avg(lat), 8) as lat, round(avg(lng), 8) as lng, count(*) as nodes from (select edge_id, ref1 as r from fx_lines union select edge_id, ref2 from fx_lines) join fx_assets on node_ref = r where lat between 34.20::double and 35.25::double and lng between 9.95::double and 11.40::double group by edge_id")
def way_centroid(v: Views) -> DataFrame:
    nodes = v.assets.filter(sp.in_box(F.col("lat"), F.col("lng"))).select(F.col("node_ref").alias("r"), "lat", "lng")
    refs = v.lines.select("edge_id", F.explode(F.array_distinct(F.array("ref1", "ref2"))).alias("r"))
    return refs.join(nodes, "r").groupBy("edge_id").agg(F.round(F.avg("lat"), 8).alias("lat"), F.round(F.avg("lng"), 8).alias("lng"), F.count("*").alias("nodes"))


def _features(v: Views) -> DataFrame:
    return sp.candidate_features(v.assets, v.lines, v.places, independent_dates=5)


@query("q_candidate_features", f"with recursive {_FEAT} select asset_id, {', '.join(f'round({k}, 8) as {k}' for k in _NAMES)} from feat")
def candidate_features(v: Views) -> DataFrame:
    return _features(v).select("asset_id", *[F.round(k, 8).alias(k) for k in _NAMES])


@query("q_candidate_rank", f"with recursive {_FEAT} select asset_id, score, row_number() over (order by score desc, asset_id) as rank from (select asset_id, {_score(CANDIDATE_WEIGHTS)} as score from feat)")
def candidate_rank(v: Views) -> DataFrame:
    return sp.ranked(_features(v)).select("asset_id", "score", "rank")


@query("q_rank_sensitivity", f"with recursive {_FEAT}, s as ({' union all '.join(f'select {i} as p, asset_id, {_score(w)} as score from feat' for i, (_, w) in enumerate(sp.perturbations()))}) select asset_id, min(rank) as best_rank, max(rank) as worst_rank from (select asset_id, row_number() over (partition by p order by score desc, asset_id) as rank from s) group by asset_id")
def rank_sensitivity(v: Views) -> DataFrame:
    return sp.rank_sensitivity(_features(v))


@query("q_unit_quarantine", "select unit_id, 'coordinates_out_of_bounds' as reason from fx_units where lat is not null and not (lat between 30 and 38 and lng between 7 and 12)")
def unit_quarantine(v: Views) -> DataFrame:
    return sp.unit_quarantine(v.units).filter("reason is not null").select("unit_id", "reason")


@query("q_quarantine_tally", "select case when lat is null then 'without_coordinates' when lat between 30 and 38 and lng between 7 and 12 then 'accepted' else 'coordinates_out_of_bounds' end as reason, count(*) as n from fx_units group by 1")
def quarantine_tally(v: Views) -> DataFrame:
    reason = F.coalesce("reason", F.when(F.col("lat").isNull(), "without_coordinates").otherwise("accepted"))
    return sp.unit_quarantine(v.units).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_GATES = f"{_REACH}, near as ({_NEAR}), d as (select governorate, count(distinct substr(created_at, 1, 10)) as dates from fx_reports group by governorate), n as (select governorate, count(distinct asset_id) as candidates from near join fx_locality_xy using (locality) group by governorate), g as (select governorate, bool_or(spatial_confidence > 0) as geography from fx_locality_xy group by governorate)"


@query("q_candidate_gates", f"with recursive {_GATES} select governorate, coalesce(candidates, 0) as candidates, coalesce(dates, 0) as dates, geography, case when coalesce(candidates, 0) > 0 and geography and coalesce(dates, 0) >= 2 then 'experimental' else 'insufficient_evidence' end as status from g left join n using (governorate) left join d using (governorate)")
def candidate_gates(v: Views) -> DataFrame:
    rows = sp.candidates_by(v.assets, v.places, "governorate")
    dates = v.reports.groupBy("governorate").agg(F.countDistinct(F.substring("created_at", 1, 10)).alias("dates"))
    found = v.places.groupBy("governorate").agg(F.bool_or(F.col("spatial_confidence") > 0).alias("geography")).join(rows, "governorate", "left").join(dates, "governorate", "left").na.fill(0, ["candidates", "dates"])
    return found.withColumn("status", candidate_status(F.col("candidates"), F.col("dates"), F.col("geography"), F.lit(True)))


_REGISTERED = "reg as (select governorate, count(*) as units from fx_units where lat between 30 and 38 and lng between 7 and 12 group by governorate)"


@query("q_registered_gates", f"with recursive {_GATES}, {_REGISTERED} select governorate, coalesce(units, 0) as units, case when coalesce(candidates, 0) > 0 and geography and coalesce(dates, 0) >= 2 and coalesce(units, 0) > (select avg(units) from reg) then 'experimental' else 'insufficient_evidence' end as status from g left join n using (governorate) left join d using (governorate) left join reg using (governorate)")
def registered_gates(v: Views) -> DataFrame:
    """Gates of governorates of which some have no registered source: those with fewer accepted units than the mean."""
    rows = sp.candidates_by(v.assets, v.places, "governorate")
    dates = v.reports.groupBy("governorate").agg(F.countDistinct(F.substring("created_at", 1, 10)).alias("dates"))
    accepted = sp.unit_quarantine(v.units).filter("reason is null and lat is not null").groupBy("governorate").agg(F.count("*").alias("units"))
    found = v.places.groupBy("governorate").agg(F.bool_or(F.col("spatial_confidence") > 0).alias("geography"))
    for df in (rows, dates, accepted):
        found = found.join(df, "governorate", "left")
    found = found.na.fill(0, ["candidates", "dates", "units"]).crossJoin(accepted.agg(F.avg("units").alias("mean")))  # one row
    return found.select("governorate", "units", candidate_status(F.col("candidates"), F.col("dates"), F.col("geography"), F.col("units") > F.col("mean")).alias("status"))


@query("q_pending_geocode", "select locality from fx_locality_xy where not (k % 2 = 0 and spatial_confidence > 0)")
def pending_geocode(v: Views) -> DataFrame:
    """Localities that the cache of found positions does not hold; what was looked up in vain is not in it."""
    cache = v.places.filter("k % 2 = 0 and spatial_confidence > 0").select("locality")
    return v.places.select("locality").join(cache, "locality", "left_anti")


@query("q_geocode_misses", "select distinct s_name as name from lineitem join supplier on s_suppkey = l_suppkey where s_name not in (select s_name from supplier join lineitem on l_suppkey = s_suppkey where l_orderkey % 400 = 0)")
def geocode_misses(v: Views) -> DataFrame:
    """Names that lines mention and the cache, filled by earlier lookups for a few of the lines, does not hold."""
    named = v.raw("lineitem").join(v.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return misses(named.select(F.col("s_name").alias("name")), named.filter("l_orderkey % 400 = 0").select(F.col("s_name").alias("name")).distinct())
