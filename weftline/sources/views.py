"""The evidence tables over the test tables, as DataFrames. Every view reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evidence
from weftline.runtime import materialize, table


def number(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._settled: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def parses(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderkey") % 50 != 0, F.to_date("o_orderdate").cast("string")).alias("outage_date"),
            F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "warning").otherwise("ok").alias("parse_status"),
        )

    @property
    def notices(self) -> DataFrame:
        """Notices as they were read: dates and titles as written, some of them missing or wrong."""
        k = F.col("o_orderkey")
        raw = F.when(k % 50 == 0, F.lit(None)).when(k % 37 == 0, "31/02/2026").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
        return self.raw("orders").select(k.alias("notice_id"), raw.alias("raw_date"), F.concat(F.when(k % 29 == 0, "avis").otherwise("إشعار بانقطاع الكهرباء"), F.lit(" - "), F.col("o_orderpriority")).alias("title"))

    @property
    def localities(self) -> DataFrame:
        """Each line of a notice names one of five localities of the notice's community."""
        brand = F.substring("p_brand", 7, 9).cast("int")
        name = F.concat(F.lit("Brand#"), number(F.floor((brand - 1) / 5).cast("int") * 5 + (F.col("l_orderkey") % 5).cast("int") + 1))
        lines = self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(
            F.col("l_orderkey").alias("notice_id"), name.alias("canonical_name"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber") % 2).alias("scope_ordinal"),
            F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("subregion_name"), F.col("l_linenumber").alias("line"),
        )

    @property
    def context(self) -> DataFrame:
        """Of every locality that a part's block can name; read from the parts, not the facts."""
        block = F.floor((F.substring("p_brand", 7, 9).cast("int") - 1) / 5).cast("int")
        brand = self.raw("part").select(block.alias("block")).distinct().select(F.explode(F.sequence(F.col("block") * 5 + 1, F.col("block") * 5 + 5)).alias("b"))
        b = F.col("b")
        return brand.select(
            F.concat(F.lit("Brand#"), number(b)).alias("locality"), F.when(b % 7 != 0, F.concat(F.lit("unit-"), number(b % 10))).alias("service_unit_id"), F.when(b % 3 == 0, 1.0).otherwise(0.7).alias("spatial_confidence")
        )

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the build, written once for all its readers in a query."""
        if name not in self._settled:
            self._settled[name] = materialize(make(), name)
        return self._settled[name]

    @property
    def observations(self) -> DataFrame:
        return self._once("observations", lambda: evidence.observations(self.localities))

    @property
    def settled_pairs(self) -> DataFrame:
        return self._once("pairs", lambda: self.pairs)

    @property
    def pairs(self) -> DataFrame:
        return evidence.pair_observations(self.observations, self.parses, self.context)

    @property
    def edges(self) -> DataFrame:
        return evidence.edge_inputs(self.pairs)

    @property
    def marginals(self) -> DataFrame:
        return evidence.marginals(self.observations)

    @property
    def weighted(self) -> DataFrame:
        return evidence.weighted_edges(self.edges, self.marginals, evidence.notice_total(self.observations))

    @property
    def history(self) -> DataFrame:
        e = self.raw("events")
        drift = F.when(F.col("user_id") % 7 == 0, F.dayofmonth("ts")).otherwise(0)
        return e.select(F.to_date("ts").cast("string").alias("run_date"), F.concat(F.lit("u"), number("user_id")).alias("locality"), ((F.floor(F.col("user_id") / 10) + drift) % 5).cast("int").alias("cluster_id")).distinct()

    @property
    def reports(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view", "error"), "electricity").otherwise("water").alias("utility"),
            F.when(F.col("event_id") % 4 == 0, "restored").otherwise("active").alias("status"), F.concat(F.lit("GOV_"), number(F.col("user_id") % 24)).alias("governorate"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        )

    @property
    def jobs(self) -> DataFrame:
        e, running = self.raw("events"), (F.col("event_id") % 10 == 1) & (F.col("event_id") % 9 != 0)
        return e.select(
            F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), "scrape").otherwise("backfill").alias("job_type"),
            F.when(F.col("event_id") % 9 == 0, "failed").when(F.col("event_id") % 10 == 1, "running").otherwise("completed").alias("status"),
            F.col("ts").alias("started_at"), F.when(~running, F.col("ts") + F.expr("interval 5 minutes")).alias("finished_at"),
        )

    @property
    def job_events(self) -> DataFrame:
        kind = F.col("event_type")
        named = F.when(kind == "error", "job_failed").when(kind == "click", "page_started").when(kind == "view", "page_completed").when(kind == "signup", "job_started").otherwise("notice_imported")
        return self.raw("events").select(F.col("event_id").alias("id"), (F.col("event_id") - F.col("event_id") % 5).alias("job_id"), F.col("ts").alias("occurred_at"), named.alias("event_type"))

    @property
    def requests(self) -> DataFrame:
        i = F.col("event_id")
        status = F.when(i % 17 == 0, 500).when(i % 11 == 0, 404).when(i % 7 == 0, 302).otherwise(200)
        return self.raw("events").select(i.alias("seq"), F.concat(F.lit("/api/r"), number(F.col("user_id") % 13)).alias("route"), status.alias("status"), F.col("value").alias("duration_ms"), "ts")

    @property
    def snapshots(self) -> DataFrame:
        body = F.concat("l_returnflag", "l_linestatus")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("notice_id"), F.concat(number("l_orderkey"), F.lit("-"), F.substring(F.sha2(body, 256), 1, 20)).alias("snapshot_id"), body.alias("raw_html"), F.col("l_shipdate").alias("fetched_at"), F.col("l_linenumber").alias("seq")
        )

    @property
    def parse_versions(self) -> DataFrame:
        key, line = number("l_orderkey"), F.col("l_linenumber")
        found = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.to_date("l_shipdate").cast("string")).alias("parsed_at"), F.min("l_returnflag").alias("flag"))
        return found.select(
            F.col("l_orderkey").alias("notice_id"), F.concat(F.lit("s"), key).alias("snapshot_id"), F.concat(F.lit("p"), key, F.lit("-"), number("l_linenumber")).alias("parse_id"),
            number(1 + line % 3).alias("parser_version"), "parsed_at", F.when(F.col("flag") == "A", "ok").otherwise("warning").alias("parse_status"),
        )

    @property
    def states(self) -> DataFrame:
        """The active parse of each notice: its latest."""
        return self.parse_versions.groupBy("notice_id").agg(F.max_by("parse_id", F.struct("parsed_at", "parse_id")).alias("active_parse"))

    @property
    def places(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.col("s_name").alias("locality"), k.alias("k"), (34.2 + (k * 37 % 105) / 100).alias("lat"), (9.95 + (k * 53 % 145) / 100).alias("lng"), F.concat(F.lit("GOV_"), number("s_nationkey")).alias("governorate"),
            F.when(k % 6 != 0, F.concat(F.lit("unit-"), number("s_nationkey"))).alias("service_unit_id"), F.when(k % 8 == 0, 0.0).when(k % 3 == 0, 0.7).otherwise(1.0).alias("spatial_confidence"),
        )

    @property
    def units(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("unit_id"), F.concat(F.lit("GOV_"), number("c_nationkey")).alias("governorate"), F.when(k % 10 != 0, 30 + (k * 29 % 900) / 100).alias("lat"), F.when(k % 10 != 0, 6.5 + (k * 31 % 600) / 100).alias("lng")
        )

    @property
    def assets(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("node/"), number(k)).alias("asset_id"), (34.1 + (k * 41 % 125) / 100).alias("lat"), (9.85 + (k * 59 % 165) / 100).alias("lng"), F.when(F.col("p_size") % 4 != 0, number(F.col("p_size") * 1000)).alias("voltage"), k.alias("node_ref")
        )

    @property
    def lines(self) -> DataFrame:
        """Lines chain neighbouring nodes; every fifth line turns back on its own node."""
        k = F.col("p_partkey")
        return self.raw("part").select(F.concat(F.lit("way/"), number(k)).alias("edge_id"), k.alias("ref1"), F.when(k % 5 == 0, k).otherwise(k + 1).alias("ref2"))
