import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import spatial as sp
from weftline.sources import loaders
from weftline.streaming import ingest


def test_token_sort_ratio():
    assert math.isclose(tx.token_sort_ratio("Argoub Bou", "Argob Bou"), 200 * 9 / 19)
    assert tx.token_sort_ratio("b a", "a b") == 100
    assert tx.common_length("", "abc") == 0


def test_zones_of_cells_and_items():
    table = "<table><tr><td>جهة صفاقس<br>- A<br>B</td><td> </td><td>C</td></tr></table>"
    assert tx.zones(table) == [(0, "جهة صفاقس", 0, "A"), (0, "جهة صفاقس", 1, "B"), (1, None, 0, "C")]
    assert tx.zones("<table><td>جهة صفاقس</td></table><ul><li>x</li><li> </li></ul>") == [(None, None, 0, "x")]
    assert tx.zones(None) == []


def test_columns(spark):
    row = spark.createDataFrame([("إشعار بانقطاع الكهرباء - صفاقس - 08:30 12/07/2026", "  EL  Kef ", "31/02/2026", "http://x/a/b/")], "t string, g string, d string, u string")
    r = row.select(tx.title_parts(F.col("t")).alias("p"), tx.governorate_key(F.col("g")).alias("g"), tx.iso_date(F.col("d")).alias("d"), tx.slug(F.col("u")).alias("s"), tx.composed(F.lit("é")).alias("c")).first()
    assert tuple(r.p) == ("صفاقس", "08:30", "12/07/2026") and r.g == "le kef" and r.d is None and r.s == "b" and r.c == "é"


def test_range_join_equals_brute_force(spark):
    assets = [(f"a{i}", 34.0 + i * 0.013 % 1, 10.0 + i * 0.029 % 1) for i in range(60)]
    places = [(f"p{i}", 34.0 + i * 0.017 % 1, 10.0 + i * 0.031 % 1) for i in range(60)]

    def km(a, b):
        x = [math.radians(v) for v in (a[1], a[2], b[1], b[2])]
        h = math.sin((x[2] - x[0]) / 2) ** 2 + math.cos(x[0]) * math.cos(x[2]) * math.sin((x[3] - x[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    found = sp.within_radius(spark.createDataFrame(assets, "asset_id string, lat double, lng double"), spark.createDataFrame(places, "locality string, lat double, lng double"), 12.0)
    assert sorted((r.asset_id, r.p_locality) for r in found.collect()) == sorted((a[0], b[0]) for a in assets for b in places if km(a, b) <= 12)


def test_polygons_hold_their_boundary(spark):
    areas = spark.createDataFrame([("sq", [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]), ("right", [[[1.0, 0.0], [3.0, 0.0], [3.0, 2.0], [1.0, 2.0]]])], "area_id string, rings array<array<array<double>>>")
    points = spark.createDataFrame([("edge", 0.0, 1.0), ("in", 1.0, 0.5), ("both", 1.0, 1.5), ("out", 5.0, 5.0)], "locality string, lat double, lng double")
    found = {r.locality: (r.area_id, r.ambiguous) for r in sp.containing_area(points, areas).collect()}
    assert found == {"edge": (None, True), "in": ("sq", False), "both": (None, True), "out": (None, False)}


def test_polygons_equal_a_walk_around_them(spark):
    rng = random.Random(8)
    areas = {}
    for k in range(9):  # many sides, holes, a ring that is closed and one that is not
        x, y = rng.randint(0, 30) / 10, rng.randint(0, 30) / 10
        turn = sorted(rng.random() * 6.283 for _ in range(rng.randint(3, 70)))
        shell = [[round(x + math.cos(t) * rng.choice([0.5, 1.0, 1.3]), 1), round(y + math.sin(t) * rng.choice([0.5, 1.0, 1.3]), 1)] for t in turn]
        hole = [[x - 0.2, y - 0.2], [x + 0.2, y - 0.2], [x + 0.2, y + 0.2], [x - 0.2, y + 0.2]]
        areas[f"a{k}"] = [shell + shell[:1] if k % 2 else shell, hole][: 1 + k % 3]
    areas["flat"] = [[[0.0, 1.0], [2.0, 1.0], [1.0, 1.0]]]
    areas["none"] = [[[0.0, 0.0]]]
    points = [(f"p{i}", i % 61 / 10 - 1, i // 61 / 10 - 1) for i in range(61 * 61)] + [("twice", 0.5, 0.5), ("twice", 0.5, 0.5), ("nowhere", None, 1.0)]

    def inside(rings, x, y):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    df = spark.createDataFrame(list(areas.items()), "area_id string, rings array<array<array<double>>>")
    got = sorted(repr(tuple(r)) for r in sp.containing_area(spark.createDataFrame(points, "locality string, lat double, lng double"), df).collect())
    expected = []
    for name, lat, lng in points:
        found = [] if lat is None else [k for k, r in areas.items() if sum(map(len, r)) > 2 and inside(r, lng, lat)]
        expected.append(repr((name, lat, lng, found[0] if len(found) == 1 else None, len(found) > 1)))
    assert got == sorted(expected)


def test_perturbations():
    all_ = sp.perturbations()
    assert len(all_) == 13 and all(math.isclose(sum(w.values()), 1) for _, w in all_)


def test_geojson_reasons_in_order(spark, tmp_path):
    ring = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    one = lambda adm, ar, g=ring: {"type": "Feature", "properties": {"adm_id": adm, "deleg_na_1": ar, "deleg_name": "x", "gov_name_f": "Sfax"}, "geometry": {"type": "Polygon", "coordinates": g}}
    path = tmp_path / "d.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [one("1", "ا"), one("1", "ب"), one("2", ""), one("", "ا"), one("3", "ا", [[[0, 0], [1, 1]]])]}))
    good, bad = loaders.delegations(spark, str(path))
    assert [r.adm_id for r in good.collect()] == ["1"]
    assert sorted(r.reason for r in bad.collect()) == ["duplicate_adm_id", "invalid_geometry", "missing_adm_id", "missing_arabic_name"]


def test_service_units(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("﻿Region,Gouvernorat,Type,District,Lat,Lon\nR, Sfax ,T,D,34.7,10.7\nR,Sfax,T,D,34.7,\nR,Sfax,T,D,50,10\n", encoding="utf-8")
    good, bad = loaders.service_units(spark, str(path))
    assert sorted((r.governorate, r.lat) for r in good.collect() if r.lat) == [("Sfax", 34.7)] and good.count() == 2 and bad.count() == 1


def test_topology(spark):
    node = lambda i, lat, lon, **tags: ("node", i, lat, lon, None, None, tags)
    way = lambda i, nodes, **tags: ("way", i, None, None, nodes, None, tags)
    rel = lambda i, members, **tags: ("relation", i, None, None, None, members, tags)
    rows = [
        node(1, 34.5, 10.0, power="pole"), node(2, 34.6, 10.2), node(900, 50.0, 10.0, power="pole"), way(10, [1, 2], power="line"), way(11, [2, 900], power="substation"), way(30, [900], power="line"),
        rel(100, [("way", 10, "")], type="site"), rel(200, [("way", 10, "")], type="route"), rel(300, [("relation", 100, "")], type="site"), rel(400, [("node", 900, "")], type="site"),
    ]
    t = loaders.topology(spark.createDataFrame(rows, loaders.ELEMENTS))
    assert sorted(r.asset_id for r in t["assets"].collect()) == ["node/1", "way/11"]
    assert t["assets"].filter("asset_id = 'way/11'").first().node_refs == [2, 900]
    assert [r.edge_id for r in t["edges"].collect()] == ["way/10"]
    assert {r.element_id: r.reason for r in t["quarantined"].collect()} == {"relation/200": "unsupported_relation_type", "relation/300": "nested_relation", "relation/400": "no_resolvable_members"}


def test_artifacts(tmp_path):
    (tmp_path / "f").write_bytes(b"x")
    check = lambda *a: loaders.verify_artifact(str(tmp_path), *a)
    assert check("f", None, 1) is None and check("../f", None, 1) == "path_outside_root" and check("g", None, None) == "missing" and check("f", None, 2) == "size_mismatch" and check("f", "00", 1) == "checksum_mismatch"


@pytest.mark.parametrize("again", [1, 2])
def test_replayed_notices_change_nothing(spark, tmp_path, again):
    land = tmp_path / "in"
    land.mkdir()
    row = {"notice_id": "n", "url": "u", "raw_html": "<a>", "fetched_at": "2026-01-01T00:00:00Z"}
    for k in range(again + 1):
        (land / f"{k}.json").write_text(json.dumps(row) + "\n" + json.dumps({**row, "raw_html": "<b>", "fetched_at": "2026-01-02T00:00:00Z"}))
        ingest.run(ingest.landed(spark, str(land)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/snapshots")).count() == 2
    assert ingest.current(spark, str(tmp_path / "out")).first().raw_html == "<b>"
