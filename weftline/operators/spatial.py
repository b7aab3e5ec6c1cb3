"""Distances, range and nearest joins, points in polygons, and the power topology."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CANDIDATE_RADIUS_KM, CANDIDATE_WEIGHTS, CONFIG, COUNTRY_LATITUDES, COUNTRY_LONGITUDES, EARTH_RADIUS_KM, MIN_CANDIDATE_COMPLETENESS, PERTURBATION_FACTORS, PILOT_BOX
from weftline.operators.components import connected_components
from weftline.operators.ranks import running
from weftline.runtime import materialize

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180


def haversine_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lng_a, lng_b)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = PILOT_BOX) -> Column:
    return lat.between(box[0], box[2]) & lng.between(box[1], box[3])


def near_spots(assets: DataFrame, places: DataFrame, radius_km: float = CANDIDATE_RADIUS_KM) -> DataFrame:
    """(lat, lng, p_lat, p_lng, km): pairs of distinct positions within the radius (inclusive), by a join on grid cells and an exact filter.

    Cells are a radius high and, at the highest latitude served, a radius wide; a place
    is put into its own and the eight cells around it, so each pair meets once.
    """
    high = radius_km / KM_PER_DEGREE * 1.0001
    wide = high / math.cos(math.radians(max(abs(x) for x in COUNTRY_LATITUDES)))
    cell = lambda lat, lng: (F.floor(F.col(lat) / high).alias("cy"), F.floor(F.col(lng) / wide).alias("cx"))
    around = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    spread = _spots(places).select("*", *cell("lat", "lng"), F.explode(around).alias("step"))
    right = spread.select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), (F.col("cy") + F.col("step.y")).alias("cy"), (F.col("cx") + F.col("step.x")).alias("cx"))
    joined = _spots(assets).select("*", *cell("lat", "lng")).join(right, ["cy", "cx"])
    far = joined.select("lat", "lng", "p_lat", "p_lng", haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")).alias("km"))
    return far.filter(F.col("km") <= radius_km)


def _spots(rows: DataFrame) -> DataFrame:
    return rows.select("lat", "lng").filter("lat is not null and lng is not null").distinct()


def _p(places: DataFrame) -> DataFrame:
    return places.select(*[F.col(c).alias(f"p_{c}") for c in places.columns])


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in as many parts as a shuffle has, where few bytes would be a part or two and a join makes much of them."""
    return rows.repartition(_parts(rows))


_PART_ROWS = 1 << 21  # the assets of a position are parted where it has more pairs


def within_radius(assets: DataFrame, places: DataFrame, radius_km: float = CANDIDATE_RADIUS_KM, digits: int | None = None) -> DataFrame:
    """Pairs of rows within the radius (inclusive): pairs of positions, the places that stand there, then the assets.

    Distances are rounded to digits before rows are joined. Both sides are dealt by the position of the asset and a part of it:
    bytes tell nothing of the pairs that a position makes, so their number sets its parts, and no table is broadcast for its few bytes."""
    spots = near_spots(assets, places, radius_km)
    spots = materialize(spots if digits is None else spots.withColumn("km", F.round("km", digits)), "spots")
    here, there = assets.groupBy("lat", "lng").agg(F.count("*").alias("a")), places.groupBy(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).agg(F.count("*").alias("b"))
    pairs = spots.join(there, ["p_lat", "p_lng"]).groupBy("lat", "lng").agg(F.sum("b").alias("b")).join(here, ["lat", "lng"])
    parts = pairs.select("lat", "lng", F.least("a", F.ceil(F.col("a") * F.col("b") / _PART_ROWS)).cast("int").alias("__parts"), F.monotonically_increasing_id().alias("__at"))
    parts = materialize(parts, "parts")  # positions get numbers: rows dealt by fractions would be dealt again to be joined by them
    by = ["__at", "__part"]
    left = assets.join(parts, ["lat", "lng"]).withColumn("__part", F.pmod(F.xxhash64(*assets.columns), F.col("__parts")).cast("int")).drop("__parts")
    right = spots.join(parts, ["lat", "lng"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", "lat", "lng")
    right = _dealt(right).join(_p(places), ["p_lat", "p_lng"])
    joined = left.repartition(_parts(assets), *by).hint("merge").join(right.repartition(_parts(assets), *by).hint("merge"), by)
    return joined.select(*assets.columns, *[f"p_{c}" for c in places.columns], "km")


def alike(members: DataFrame, key: str, of: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, like), (like, *of, n)) of members(key, *of): keys with the same rows, as often, are alike and are called by the least of them.

    Rows are told by their number and two sums of 64-bit hashes, so a key with many rows needs no list of them."""
    counted = materialize(members.filter(F.col(key).isNotNull()).groupBy(key, *of).agg(F.count("*").alias("n")), "members")
    sums = [F.sum(F.xxhash64(*c).cast("decimal(38,0)")).alias(a) for a, c in (("ha", [*of, "n"]), ("hb", ["n", *reversed(of), F.lit(7)]))]
    digests = counted.groupBy(key).agg(F.count("*").alias("rows"), *sums)
    by = ["ha", "hb", "rows"]  # sorted by what tells most of them apart
    named = materialize(digests.join(digests.groupBy(*by).agg(F.min(key).alias("like")), by).select(key, "like"), "alike")
    return named, counted.join(named.filter(F.col(key) == F.col("like")), key).select("like", *of, "n")


def near_units(sites: DataFrame, spots: DataFrame, places: DataFrame) -> DataFrame:
    """(like, service_unit_id, k, km): number and summed distance of the places near, of sites(like, lat, lng, n) and pairs of positions."""
    there = _p(places.groupBy("lat", "lng", "service_unit_id").agg(F.count("*").alias("m")))
    weight = F.col("n") * F.col("p_m")
    pairs = _dealt(sites).join(spots, ["lat", "lng"]).join(there, ["p_lat", "p_lng"])
    return pairs.groupBy("like", F.col("p_service_unit_id").alias("service_unit_id")).agg(F.sum(weight).alias("k"), F.sum(weight * F.col("km")).alias("km"))


def near_shares(by_unit: DataFrame) -> DataFrame:
    """(like, n, top, known, km): places near, those of the unit with most, those with a unit."""
    own = F.when(F.col("service_unit_id").isNotNull(), F.col("k"))
    return by_unit.groupBy("like").agg(F.sum("k").alias("n"), F.max(own).alias("top"), F.sum(F.coalesce(own, F.lit(0))).alias("known"), F.sum("km").alias("km"))


def purity(assets: DataFrame, places: DataFrame, radius_km: float = CANDIDATE_RADIUS_KM) -> DataFrame:
    """(asset_id, purity): the share that the unit with most places has among the places near an asset."""
    named, sites = alike(assets.filter("lat is not null and lng is not null"), "asset_id", ["lat", "lng"])
    shares = near_shares(near_units(sites, near_spots(assets, places, radius_km), places))
    return named.join(shares.select("like", (F.col("top") / F.col("n")).alias("purity")), "like").select("asset_id", "purity")


def reach(assets: DataFrame, parts: DataFrame, places: DataFrame, spots: DataFrame) -> DataFrame:
    """(root, reach): the distinct localities near the assets of each component.

    Components with assets at the same positions are counted once, and localities at the same positions together."""
    at = assets.filter("lat is not null and lng is not null").select(F.col("asset_id").alias("element"), "lat", "lng")
    roots, sites = alike(parts.join(at, "element").select("root", "lat", "lng").distinct(), "root", ["lat", "lng"])
    names, stand = alike(places.filter("lat is not null and lng is not null").select("locality", "lat", "lng").distinct(), "locality", ["lat", "lng"])
    stand = stand.select(F.col("like").alias("names"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    met = _dealt(sites).join(spots, ["lat", "lng"]).select("like", "p_lat", "p_lng").distinct().join(stand, ["p_lat", "p_lng"]).select("like", "names").distinct()
    size = names.groupBy(F.col("like").alias("names")).agg(F.count("*").alias("size"))
    return roots.join(met.join(size, "names").groupBy("like").agg(F.sum("size").alias("reach")), "like").select("root", "reach")


def candidates_by(assets: DataFrame, places: DataFrame, key: str, radius_km: float = CANDIDATE_RADIUS_KM) -> DataFrame:
    """(key, candidates): the distinct assets near a locality, by a column of the places of that name."""
    named, sites = alike(assets.filter("lat is not null and lng is not null"), "asset_id", ["lat", "lng"])
    at = places.select("locality", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct().join(places.select("locality", key).distinct(), "locality").select("p_lat", "p_lng", key).distinct()
    met = sites.join(near_spots(assets, places, radius_km), ["lat", "lng"]).select("like", "p_lat", "p_lng").distinct().join(at, ["p_lat", "p_lng"]).select("like", key).distinct()
    size = named.groupBy("like").agg(F.count("*").alias("size"))
    return met.join(size, "like").groupBy(key).agg(F.sum("size").alias("candidates"))


_DEPTH, _FEW_SITES = 8, 64  # a step cuts a cell in 8 by 8; a cell of so few sites is not cut again


def _cell(c: str, low: float, size: float) -> Column:
    """The finest cell of a coordinate; three bits fewer give the cell around it one level up."""
    return F.least(F.greatest(F.floor((F.col(c) - low) / size * 8**_DEPTH), F.lit(0)), F.lit(8**_DEPTH - 1)).cast("int")


def _settled(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def nearest_within(points: DataFrame, targets: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(name, order, d): for each name of points the nearest target of its key, by degrees; the first in order of ties.

    Distances are those between distinct places. Places descend a tree of the targets' cells, 64 to a cell, and keep the cells whose
    box may hold the nearest one: those no farther than the farthest corner of some box. What is left is compared
    exactly. Points without coordinates come last among those of their name, and get the first target in order."""
    there = targets.filter(_settled("lat") & _settled("lng")).groupBy(key, F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng")).agg(F.min(order).alias(order))
    there = materialize(there, "sites")
    box = there.agg(F.min("t_lat"), F.min("t_lng"), F.max("t_lat"), F.max("t_lng")).first()
    south, west, north, east = (0.0 if x is None else x for x in box)
    there = there.withColumns({"cy": _cell("t_lat", south, north - south or 1.0), "cx": _cell("t_lng", west, east - west or 1.0)})
    spots = points.filter(_settled("lat") & _settled("lng")).select(key, "lat", "lng").distinct()
    open_ = materialize(spots, "spots").withColumns({"by": F.lit(0), "bx": F.lit(0)})  # the cell that holds all

    def up(level: int) -> list[Column]:
        return [F.shiftright(c, 3 * (_DEPTH - level)).alias(b) for c, b in (("cy", "by"), ("cx", "bx"))]

    for level in range(1, _DEPTH + 1):
        cells = there.groupBy(key, *up(level)).agg(F.min("t_lat").alias("y1"), F.max("t_lat").alias("y2"), F.min("t_lng").alias("x1"), F.max("t_lng").alias("x2"), F.count("*").alias("n"))
        inner = cells.select(key, F.shiftright("by", 3).alias("by"), F.shiftright("bx", 3).alias("bx"), F.col("by").alias("iy"), F.col("bx").alias("ix"), "y1", "y2", "x1", "x2")
        near = lambda c, a, b: F.pow(F.greatest(F.col(a) - F.col(c), F.col(c) - F.col(b), F.lit(0.0)), F.lit(2.0))
        far = lambda c, a, b: F.pow(F.greatest(F.abs(F.col(a) - F.col(c)), F.abs(F.col(c) - F.col(b))), F.lit(2.0))
        met = open_.join(inner, [key, "by", "bx"]).select(key, "lat", "lng", F.col("iy").alias("by"), F.col("ix").alias("bx"), (near("lat", "y1", "y2") + near("lng", "x1", "x2")).alias("low"), (far("lat", "y1", "y2") + far("lng", "x1", "x2")).alias("high"))
        kept = met.withColumn("high", F.min("high").over(Window.partitionBy(key, "lat", "lng"))).filter(F.col("low") <= F.col("high") * (1 + 1e-9))
        open_ = materialize(kept.select(key, "lat", "lng", "by", "bx"), "cells")
        if (cells.agg(F.max("n")).first()[0] or 0) <= _FEW_SITES:
            break
    degrees = F.sqrt(F.pow(F.col("lat") - F.col("t_lat"), F.lit(2.0)) + F.pow(F.col("lng") - F.col("t_lng"), F.lit(2.0)))
    best = lambda d: F.struct(d.isNull().alias("lost"), d.alias("d"), F.col(order).isNull().alias("unnamed"), F.col(order).alias("first"))
    tried = open_.join(there.select(key, *up(level), "t_lat", "t_lng", order), [key, "by", "bx"]).groupBy(key, "lat", "lng").agg(F.min(best(degrees)).alias("x"))
    found = points.select(name, key, "lat", "lng").join(tried, [key, "lat", "lng"]).select(name, "x")
    lost = points.filter(~(_settled("lat") & _settled("lng"))).select(name, key).join(there.groupBy(key).agg(F.min(order).alias(order)), key).select(name, best(F.lit(None).cast("double")).alias("x"))
    return found.unionByName(lost).groupBy(name).agg(F.min("x").alias("x")).select(name, F.col("x.first").alias(order), "x.d")


def banded_edges(areas: DataFrame, per_band: int = 8, most_bands: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(boxes, edges) of areas(area_id, rings), rings as lists of (lng, lat), the first a shell, the others holes.

    A box is cut into bands of latitude, the more the more edges it has; an edge stands in each band that it
    touches, so a point meets the edges of its own band only, and each of them once. Rings are
    closed if they are not. Ids are unique; areas of fewer than three points hold nothing."""
    ring = areas.select("area_id", F.explode("rings").alias("ring"))
    following = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    sides = ring.select("area_id", F.explode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("e"))
    xy = lambda end, i: F.get(F.col(f"e.{end}"), F.lit(i))
    sides = sides.select("area_id", xy("p", 0).alias("x1"), xy("p", 1).alias("y1"), xy("q", 0).alias("x2"), xy("q", 1).alias("y2"))
    ends = [F.min("x1").alias("west"), F.max("x1").alias("east"), F.min("y1").alias("south"), F.max("y1").alias("north")]
    bands = F.least(F.greatest(F.ceil(F.col("n") / per_band), F.lit(1)), F.lit(most_bands)).cast("int")
    boxes = sides.groupBy("area_id").agg(*ends, F.count("*").alias("n")).filter("n > 2").withColumn("bands", bands).drop("n")
    spread = sides.join(boxes.select("area_id", "south", "north", "bands"), "area_id")
    spread = spread.withColumn("band", F.explode(F.sequence(_band(F.least("y1", "y2")), _band(F.greatest("y1", "y2")))))
    return boxes, spread.select("area_id", "band", "x1", "y1", "x2", "y2")


def _band(lat: Column) -> Column:
    """The band of a latitude inside a box; it never falls as the latitude rises."""
    own = F.floor(F.try_divide((lat - F.col("south")) * F.col("bands"), F.col("north") - F.col("south")))
    return F.least(F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)), F.col("bands") - 1).cast("int")


def held(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(lng, lat, area_id) of the distinct places of points and the areas that hold them; a boundary counts, of holes too.

    Boxes are dealt to whole-degree cells, so that only boxes near a point are tried; then the edges of the point's band are
    joined by area and band. A point is on an edge, or inside where an odd number of edges lies to its east."""
    boxes, edges = banded_edges(areas)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")))
    dealt = boxes.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    spots = points.select("lng", "lat").filter("lng is not null and lat is not null").distinct()
    near = spots.withColumns({"cx": F.floor("lng").cast("int"), "cy": F.floor("lat").cast("int")}).join(dealt, ["cx", "cy"])
    near = near.filter(F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    met = near.select("lng", "lat", "area_id", _band(F.col("lat")).alias("band")).join(edges, ["area_id", "band"])
    x, y, x1, y1, x2, y2 = map(F.col, ("lng", "lat", "x1", "y1", "x2", "y2"))
    on = ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    crossed = ((y1 > y) != (y2 > y)) & (x < F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1)
    found = met.groupBy("lng", "lat", "area_id").agg(F.bool_or(on).alias("on"), F.count_if(crossed).alias("crossed"))
    return found.filter(F.col("on") | (F.col("crossed") % 2 == 1)).select("lng", "lat", "area_id")


def containing_area(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(point columns, area_id, ambiguous): the only area that holds a point, null if none or several do, or a coordinate is missing."""
    found = held(points, areas).groupBy("lng", "lat").agg(F.min("area_id").alias("area"), F.count("*").alias("n"))
    return points.join(found, ["lng", "lat"], "left").select(*points.columns, F.when(F.col("n") == 1, F.col("area")).alias("area_id"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def unit_quarantine(units: DataFrame) -> DataFrame:
    """units with a reason where the coordinates are out of the country; incomplete ones become null."""
    lat, lng = F.col("lat"), F.col("lng")
    out = ~(lat.between(*COUNTRY_LATITUDES) & lng.between(*COUNTRY_LONGITUDES))
    return units.withColumn("reason", F.when(lat.isNull() | lng.isNull(), F.lit(None)).when(out, "coordinates_out_of_bounds"))


def element_refs(assets: DataFrame, lines: DataFrame) -> DataFrame:
    """(element, node) of assets and lines together."""
    own = assets.select(F.col("asset_id").alias("element"), F.col("node_ref").alias("node"))
    return own.unionByName(lines.select(F.col("edge_id").alias("element"), F.explode(F.array("ref1", "ref2")).alias("node"))).distinct()


def topology_components(assets: DataFrame, lines: DataFrame) -> DataFrame:
    """(element, root): elements that share a node, followed to components; the root is the least element.

    Components are those of nodes, so elements at one node make no links of their own: a line links its two nodes, an
    element of several rows the least nodes of each. An element then stands in the component of its least node;
    one without a name or a node is its own root."""
    rows = assets.select(F.col("asset_id").alias("element"), F.col("node_ref").alias("v")).unionByName(lines.select(F.col("edge_id").alias("element"), F.least("ref1", "ref2").alias("v")))
    own = materialize(rows.groupBy("element").agg(F.min("v").alias("least"), F.max("v").alias("most")), "elements")
    links = lines.filter("edge_id is not null").select(F.col("ref1").alias("u"), F.col("ref2").alias("v"))
    several = own.filter("element is not null and least <> most").select("element", "least")
    if not several.isEmpty():
        links = links.unionByName(rows.join(several, "element").select(F.col("v").alias("u"), F.col("least").alias("v")))
    found = connected_components(links)
    placed = own.join(found, F.col("least") == F.col("node"), "left").select("element", F.when(F.col("element").isNotNull(), F.coalesce("component", "least")).alias("part"))
    roots = placed.filter("part is not null").groupBy("part").agg(F.min("element").alias("root"))
    return placed.join(roots, "part", "left").select("element", F.coalesce("root", "element").alias("root"))


def numbered(components: DataFrame) -> DataFrame:
    """Components numbered by their least member."""
    order = running(components.select("root").distinct(), [F.col("root")]).select("root", (F.col("rank") - 1).alias("component"))
    return components.join(order, "root").select("element", "component")


def candidate_features(assets: DataFrame, lines: DataFrame, places: DataFrame, independent_dates: int, radius_km: float = CANDIDATE_RADIUS_KM) -> DataFrame:
    """Features of the assets near some accepted locality that have a signal and are complete enough."""
    accepted = places.filter("spatial_confidence > 0")
    spots = materialize(near_spots(assets, accepted, radius_km), "spots")  # both are read several times below
    parts = materialize(topology_components(assets, lines), "components")
    wired = parts.join(lines.select(F.col("edge_id").alias("element")), "element", "left_semi").select("root").distinct().withColumn("connected", F.lit(True))
    home = parts.select(F.col("element").alias("asset_id"), "root").join(wired, "root", "left")
    named, sites = alike(assets.filter("lat is not null and lng is not null"), "asset_id", ["lat", "lng"])
    own = named.join(near_shares(near_units(sites, spots, accepted)), "like").drop("like")
    total = accepted.agg(F.count("*").alias("total"))
    rows = own.join(assets.select("asset_id", "voltage"), "asset_id").join(home, "asset_id").join(reach(assets, parts, accepted, spots), "root", "left").crossJoin(total)  # one row
    connected, yes = F.coalesce("connected", F.lit(False)), lambda c: c.cast("int")
    out = rows.select(
        "asset_id", (F.col("n") / F.col("total")).alias("outage_fit"), F.when(connected, F.col("reach") / F.col("total")).otherwise(0.0).alias("topology_consistency"), (F.coalesce("top", F.lit(0)) / F.col("n")).alias("service_prior"),
        F.greatest(F.lit(0.0), 1 - F.col("km") / F.col("n") / radius_km).alias("distance_score"), F.lit(min(1.0, independent_dates / CONFIG.recurrence_saturation_dates)).alias("temporal_support"),
        ((yes(F.col("voltage").isNotNull()) + yes(connected) + yes(F.col("known") == F.col("n"))) / 3).alias("completeness"),
    )
    return out.filter(((F.col("topology_consistency") > 0) | (F.col("service_prior") > 0)) & (F.col("completeness") >= MIN_CANDIDATE_COMPLETENESS))


def perturbations(weights: dict[str, float] = CANDIDATE_WEIGHTS) -> list[tuple[str, dict[str, float]]]:
    """The weights themselves, and each weight times each factor with all brought back to sum one."""
    out = [("baseline", dict(weights))]
    for name in weights:
        for factor in PERTURBATION_FACTORS:
            own = {**weights, name: weights[name] * factor}
            out.append((f"{name}x{factor}", {k: x / sum(own.values()) for k, x in own.items()}))
    return out


def score(weights: dict[str, float] = CANDIDATE_WEIGHTS) -> Column:
    first, *rest = (F.col(k) * F.lit(w) for k, w in weights.items())
    for term in rest:
        first = first + term
    return first


def ranked(features: DataFrame) -> DataFrame:
    """features with score and rank, by (-score, asset_id)."""
    scored = materialize(features.withColumn("score", F.round(score(), 9)), "scored")  # dealing to ranges reads it twice
    return running(scored, [F.desc("score"), F.col("asset_id")])


def rank_sensitivity(features: DataFrame) -> DataFrame:
    """(asset_id, best_rank, worst_rank) over all perturbations of the weights."""
    scores = F.array(*[F.struct(F.lit(i).alias("p"), F.round(score(w), 9).alias("score")) for i, (_, w) in enumerate(perturbations())])
    scored = materialize(features.select("asset_id", scores.alias("scores")), "scored")  # dealing to ranges reads it twice
    every = running(scored.select("asset_id", F.inline("scores")), [F.desc("score"), F.col("asset_id")], group=["p"])
    return every.groupBy("asset_id").agg(F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"))
