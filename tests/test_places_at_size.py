"""Queries over places on tables with many rows at one spot and names that come again, and against plain counts."""

import math
import random

import pytest

from weftline.operators import components
from weftline.operators import spatial as sp
from weftline.plans import catalogue

from test_oracles import rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A few rows of each table, three times with shifted keys and the same names."""
    import duckdb

    path, con = tmp_path_factory.mktemp("again"), duckdb.connect()
    again = "cross join range(3) c(i)"
    for name, sql in {
        "supplier": f"select s + i * 150 as s_suppkey, concat('S', s) as s_name, (s * 7 % 25)::int as s_nationkey from range(150) r(s) {again}",
        "customer": f"select c_ + i * 2700 as c_custkey, (c_ * 11 % 25)::int as c_nationkey from range(2700) r(c_) {again}",
        "part": f"select p + i * 8250 as p_partkey, (p % 50 + 1)::int as p_size from range(400) r(p) {again}",
        "events": "select e as event_id, timestamp '2026-01-01' + interval (e) hour as ts, e * 7 % 100 as user_id, case when e % 3 = 0 then 'click' else 'purchase' end as event_type, e::double as value from range(300) r(e)",
    }.items():
        con.execute(f"copy ({sql}) to '{path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{path}/{name}.parquet')")
    return path, con


def same_as_sql(spark, folder, name):
    path, con = folder
    df, told = catalogue.QUERIES[name](spark, str(path)), con.sql(catalogue.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())


def test_nearest_unit_of_names_that_come_again(spark, folder):
    same_as_sql(spark, folder, "q_nearest_unit")


@pytest.mark.parametrize("spread", [1.0, 1e-6])
def test_nearest_equals_brute_force(spark, spread):
    rng = random.Random(5)
    near = lambda: (round(34 + rng.random() * spread, 9), round(10 + rng.random() * spread, 9))
    # half of the targets within a millionth of a degree, others on a coarse grid with ties, one without a position
    targets = [(i, "g" if i % 3 else "h", *near()) for i in range(600)] + [(600 + i, "g", 33.0 + i % 5, 9.0 + i % 4) for i in range(60)] + [(-1, "g", None, None)]
    points = [(f"p{i}", "gh"[i % 2], *near()) for i in range(80)] + [(f"p{i}", "g", 33.5 + i % 5, 9.5 + i % 3) for i in range(40, 120)]
    points += [("far", "g", -80.0, 170.0), ("lost", "h", None, 1.0), ("p1", "g", None, None), ("alone", "k", 34.0, 10.0)]
    expected = {}
    for name, key, lat, lng in points:
        for i, k, y, x in targets:
            if k == key and y is not None:
                d = math.inf if lat is None or lng is None else math.sqrt((lat - y) ** 2 + (lng - x) ** 2)
                expected[name] = min(expected.get(name, (math.inf, math.inf)), (d, i))
    got = sp.nearest_within(spark.createDataFrame(points, "p string, g string, lat double, lng double"), spark.createDataFrame(targets, "id long, g string, lat double, lng double"), "g", "id", "p")
    assert {r.p: (math.inf if r.d is None else r.d, r.id) for r in got.collect()} == expected


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, g string, lat double, lng double")
    points = spark.createDataFrame([("p", "g", 1.0, 1.0)], "p string, g string, lat double, lng double")
    assert sp.nearest_within(points, none, "g", "id", "p").collect() == []


@pytest.mark.parametrize("name", ["q_service_purity", "q_candidate_gates", "q_registered_gates", "q_component_reach", "q_candidate_features", "q_candidate_rank", "q_rank_sensitivity", "q_range_join_haversine"])
def test_rows_at_the_same_spots(spark, folder, name):
    same_as_sql(spark, folder, name)


def test_pairs_are_of_positions(spark):
    """As many rows at the same two positions as there may be, one pair is compared."""
    assets = spark.createDataFrame([(f"a{i}", 34.0, 10.0) for i in range(200)], "asset_id string, lat double, lng double")
    places = spark.createDataFrame([(f"p{i}", 34.01, 10.0, "u" if i % 4 else None) for i in range(200)], "locality string, lat double, lng double, service_unit_id string")
    assert sp.near_spots(assets, places).count() == 1
    assert sp.within_radius(assets, places).count() == 40_000
    assert {r.purity for r in sp.purity(assets, places).collect()} == {0.75} and sp.purity(assets, places).count() == 200


def test_alike(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 3.0, 4.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("d", 1.0, 2.0), ("d", 1.0, 2.0), ("e", 2.0, 1.0), (None, 1.0, 2.0)]
    named, held = sp.alike(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x", "y"])
    assert {r.k: r.like for r in named.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert sorted(map(tuple, held.collect())) == [("a", 1.0, 2.0, 1), ("a", 3.0, 4.0, 1), ("c", 1.0, 2.0, 1), ("d", 1.0, 2.0, 2), ("e", 2.0, 1.0, 1)]


def test_an_asset_of_several_positions(spark):
    """Its places count as often as it stands near them; a locality of several positions counts once."""
    assets = spark.createDataFrame([("a", 34.0, 10.0), ("a", 34.0, 10.0), ("a", 34.5, 10.0), ("b", 34.5, 10.0), ("c", None, 10.0)], "asset_id string, lat double, lng double")
    places = spark.createDataFrame([("p", 34.0, 10.0, "u", "g"), ("p", 34.5, 10.0, "v", "h"), ("q", 34.5, 10.0, None, "g")], "locality string, lat double, lng double, service_unit_id string, gov string")
    assert {r.asset_id: r.purity for r in sp.purity(assets, places).collect()} == {"a": 0.5, "b": 0.5}
    parts = spark.createDataFrame([("a", "r"), ("b", "s"), ("c", "t")], "element string, root string")
    assert {r.root: r.reach for r in sp.reach(assets, parts, places, sp.near_spots(assets, places)).collect()} == {"r": 2, "s": 2}
    assert {r.gov: r.candidates for r in sp.candidates_by(assets, places, "gov").collect()} == {"g": 2, "h": 2}


def test_links_are_of_nodes(spark, monkeypatch):
    """As many elements at a node as there may be, they make no links; a line makes one."""
    made = []
    monkeypatch.setattr(sp, "connected_components", lambda edges, **k: made.append(edges.filter("u <> v").count()) or components.connected_components(edges, **k))
    assets = spark.createDataFrame([(f"a{i}", i % 2) for i in range(300)], "asset_id string, node_ref long")
    lines = spark.createDataFrame([("l", 0, 7), ("loop", 1, 1)], "edge_id string, ref1 long, ref2 long")
    got = {r.element: r.root for r in sp.topology_components(assets, lines).collect()}
    assert made == [1] and len(got) == 302
    assert {x for e, x in got.items() if e == "l" or e[0] == "a" and int(e[1:]) % 2 == 0} == {"a0"} and {x for e, x in got.items() if e == "loop" or e[0] == "a" and int(e[1:]) % 2} == {"a1"}


def test_components_equal_brute_force(spark):
    """Elements of several rows, names of assets that lines have too, missing names and nodes."""
    rng = random.Random(8)
    node = lambda: None if rng.random() < 0.1 else rng.randrange(150)
    name = lambda kind: None if rng.random() < 0.05 else f"{rng.choice([kind, 'both'])}{rng.randrange(60)}"
    assets, lines = [(name("a"), node()) for _ in range(40)], [(name("l"), node(), node()) for _ in range(40)]
    refs = assets + [(e, x) for e, *ends in lines for x in ends]
    root = {e: e for e, _ in refs if e}
    for _ in root:  # as often as the longest chain may need
        least = {}
        for e, x in refs:
            if e and x is not None:
                least[x] = min(least.get(x, root[e]), root[e])
        for e, x in refs:
            if e and x is not None:
                root[e] = min(root[e], least[x])
    got = sp.topology_components(spark.createDataFrame(assets, "asset_id string, node_ref long"), spark.createDataFrame(lines, "edge_id string, ref1 long, ref2 long")).collect()
    assert len(got) == len(root) + 1 and {r.element: r.root for r in got} == root | {None: None}
    assert 3 < len(set(root.values())) < len(root) - 10


def test_rows_of_a_range_join_are_only_joined(spark, folder):
    """Distances come and are rounded once for each pair of positions, not for each row."""
    df = catalogue.QUERIES["q_range_join_haversine"](spark, str(folder[0]))
    assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_position_are_parted(spark, monkeypatch):
    monkeypatch.setattr(sp, "_PART_ROWS", 500)
    assets = [(f"a{i}", 34.0, 10.0) for i in range(100)] + [("b", 34.5, 10.0), ("c", None, 10.0), ("d", 33.0, 9.0)]
    places = [(f"p{i}", 34.01, 10.0) for i in range(100)] + [("q", 34.5, 10.0), ("r", 34.5, 10.0), ("s", 34.0, None)]
    got = sp.within_radius(spark.createDataFrame(assets, "asset_id string, lat double, lng double"), spark.createDataFrame(places, "locality string, lat double, lng double"), digits=2)
    told = [(r.asset_id, r.p_locality, r.km) for r in got.collect()]
    assert sorted(told) == sorted([(f"a{i}", f"p{j}", 1.11) for i in range(100) for j in range(100)] + [("b", "q", 0.0), ("b", "r", 0.0)])
    held = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(held) > 2 and max(held) < 8000
