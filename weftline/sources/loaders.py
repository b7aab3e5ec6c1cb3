"""Landed files as frames: pages, boundaries, service units, topology elements, manifests.

Rows that break a rule are set apart with the first reason that applies, not dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import PILOT_BOX
from weftline.functions.text import zones_column
from weftline.operators.spatial import in_box, unit_quarantine

#: fixed values: kinds of power elements
ASSET_NODES = ("substation", "transformer", "pole", "tower")
LINES = ("line", "minor_line", "cable")
AREA_ASSETS = ("substation", "transformer")
RELATIONS = ("site", "multipolygon")


def reasons(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out


def notice_listing(pages: DataFrame, marker: str, link: str = r"/fr/news/") -> DataFrame:
    """(page_id, url) of the first link after each panel title that holds the marker."""
    panels = pages.select("page_id", F.explode(F.split("html", r'class="[^"]*\bpanel\b[^"]*"')).alias("panel")).filter(F.contains("panel", F.lit(marker)))
    return panels.select("page_id", F.regexp_extract("panel", rf'href="([^"]*{link}[^"]*)"', 1).alias("url")).filter("url <> ''").distinct()


def notice_zones(pages: DataFrame) -> DataFrame:
    """(page_id, scope, header, ordinal, zone) of the zones of each page."""
    return pages.select("page_id", F.explode(zones_column(F.col("html"))).alias("z")).select("page_id", "z.*")


def delegations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) features of a GeoJSON collection; the first of equal ids is accepted."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("place", "f"))
    p = F.col("f.properties")
    rows = rows.select("place", p["adm_id"].alias("adm_id"), p["deleg_na_1"].alias("name_ar"), p["deleg_name"].alias("name"), p["gov_name_f"].alias("governorate"), F.col("f.geometry.coordinates").alias("rings"))
    seen = F.row_number().over(Window.partitionBy("adm_id").orderBy("place"))
    ring = F.get("rings", F.lit(0))
    bad = F.coalesce((F.size(ring) < 4) | (F.get(ring, F.lit(0)) != F.element_at(ring, -1)), F.lit(True))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rows = rows.withColumn("reason", reasons((blank(F.col("name_ar")), "missing_arabic_name"), (blank(F.col("adm_id")), "missing_adm_id"), (seen > 1, "duplicate_adm_id"), (bad, "invalid_geometry")))
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def service_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of a CSV with a header, or of the first sheet of a workbook; incomplete coordinates become null."""
    raw = workbook(spark, path) if path.lower().endswith((".xls", ".xlsx")) else spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    lat, lng = (text(c).try_cast("double") for c in ("Lat", "Lon"))
    both = lat.isNotNull() & lng.isNotNull()
    rows = raw.select(text("Region").alias("region"), text("Gouvernorat").alias("governorate"), text("Type").alias("type"), text("District").alias("district"), F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng"))
    marked = unit_quarantine(rows)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as text columns, read on the driver (a directory of some thousand rows); needs a reader that pandas knows."""
    import pandas as pd

    sheet = pd.read_excel(path, sheet_name=0, dtype=str)
    return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None), ", ".join(f"`{c}` string" for c in sheet.columns))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a topology extract: JSON lines, or a PBF file where a reader for it is installed."""
    if not path.lower().endswith(".pbf"):
        return spark.read.schema(ELEMENTS).json(path)
    try:
        import osmium
    except ModuleNotFoundError as e:
        raise RuntimeError("PBF needs the osmium package; convert the extract to JSON lines otherwise") from e

    def rows() -> Iterator[tuple]:
        for x in osmium.FileProcessor(path).with_locations():
            tags = {t.k: t.v for t in x.tags}
            if x.is_node():
                yield "node", x.id, x.lat, x.lon, None, None, tags
            elif "power" in tags or x.is_relation():
                members = [(m.type, m.ref, m.role) for m in x.members] if x.is_relation() else None
                yield ("relation" if members is not None else "way"), x.id, None, None, None if members is not None else [n.ref for n in x.nodes], members, tags

    return spark.createDataFrame(list(rows()), ELEMENTS)  # an extract of one region


ELEMENTS = "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>"


def topology(elements: DataFrame, box: tuple[float, float, float, float] = PILOT_BOX) -> dict[str, DataFrame]:
    """nodes, assets, edges, relations and quarantined of elements(ELEMENTS).

    Areas take the mean of their nodes inside the box and keep all their node
    references; relations are set apart if their kind is not known, if they hold
    relations, or if no member is kept.
    """
    power = F.try_element_at("tags", F.lit("power"))
    nodes = elements.filter((F.col("type") == "node") & in_box(F.col("lat"), F.col("lon"), box))
    kept = nodes.select(F.col("id").alias("node"), "lat", "lon")
    ways = elements.filter("type = 'way'").withColumn("power", power)
    inside = ways.select("id", F.explode(F.array_distinct("nodes")).alias("node")).join(kept, "node").groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    edges = ways.filter(F.col("power").isin(*LINES)).join(inside.select("id"), "id", "left_semi").select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("edge_id"), F.col("nodes").alias("node_refs"), F.try_element_at("tags", F.lit("voltage")).alias("voltage"))
    area = ways.filter(F.col("power").isin(*AREA_ASSETS)).join(inside.withColumnsRenamed({"lat": "y", "lon": "x"}), "id")
    name = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("id").cast("string")).alias("asset_id")
    voltage = F.try_element_at("tags", F.lit("voltage")).alias("voltage")
    points = nodes.filter(power.isin(*ASSET_NODES)).select(name("node"), power.alias("asset_type"), "lat", F.col("lon").alias("lng"), voltage, F.array("id").alias("node_refs"))
    assets = points.unionByName(area.select(name("way"), F.col("power").alias("asset_type"), F.col("y").alias("lat"), F.col("x").alias("lng"), voltage, F.col("nodes").alias("node_refs")))
    members = elements.filter("type = 'relation'").select("id", F.explode_outer("members").alias("m"))
    known = kept.select(F.lit("node").alias("type"), F.col("node").alias("ref")).unionByName(inside.select(F.lit("way").alias("type"), F.col("id").alias("ref"))).withColumn("there", F.lit(True))
    found = members.select("id", F.col("m.type").alias("type"), F.col("m.ref").alias("ref")).join(known, ["type", "ref"], "left").groupBy("id").agg(F.count("there").alias("resolved"), F.count_if(F.col("type") == "relation").alias("nested"))
    kind = F.coalesce(F.try_element_at("tags", F.lit("type")), F.lit(""))
    relations = elements.filter("type = 'relation'").join(found, "id", "left").withColumn("reason", reasons((~kind.isin(*RELATIONS), "unsupported_relation_type"), (F.col("nested") > 0, "nested_relation"), (F.col("resolved") == 0, "no_resolvable_members")))
    ids = F.concat(F.lit("relation/"), F.col("id").cast("string"))
    return {
        "nodes": kept, "assets": assets, "edges": edges, "relations": relations.filter("reason is null").select(ids.alias("relation_id"), "members"),
        "quarantined": relations.filter("reason is not null").select(ids.alias("element_id"), "reason"),
    }


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, artifacts, artifacts of unknown sources) of a YAML registry."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    sources = spark.createDataFrame([(s["id"], s.get("name")) for s in found.get("sources", [])], "source_id string, name string")
    artifacts = spark.createDataFrame([(a["source_id"], a["path"], a.get("sha256"), a.get("size_bytes")) for a in found.get("artifacts", [])], "source_id string, path string, sha256 string, size_bytes long")
    return sources, artifacts, artifacts.join(sources, "source_id", "left_anti")


def verify_artifact(root: str, path: str, sha256: str | None, size: int | None) -> str | None:
    """None if the file stands below root as described, else the reason."""
    base, own = Path(root).resolve(), Path(path)
    if own.is_absolute() or ".." in own.parts or not (full := (base / own).resolve()).is_relative_to(base):
        return "path_outside_root"
    if not full.is_file():
        return "missing"
    if size is not None and full.stat().st_size != size:
        return "size_mismatch"
    digest = hashlib.sha256()
    with full.open("rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return "checksum_mismatch" if sha256 and digest.hexdigest() != sha256 else None
