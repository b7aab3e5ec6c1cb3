"""From scoped localities to weighted co-occurrence edges.

Pairs are made inside a notice's scope only, by a self-join on the scope key; all
later steps are aggregations by pair, whose number is bounded by the localities and
not by the notices. Restrictions come before the aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import CONFIG, ModelConfig

SCOPE = ["notice_id", "scope_kind", "scope_ord"]


def observations(localities: DataFrame) -> DataFrame:
    """One row per locality and scope of a notice; the scope's name is for display."""
    kind = F.when(F.col("scope_ordinal").isNull(), "notice_fallback").otherwise("subregion")
    keyed = localities.select("notice_id", kind.alias("scope_kind"), F.coalesce("scope_ordinal", F.lit(0)).alias("scope_ord"), F.nullif(F.trim(F.coalesce("subregion_name", F.lit(""))), F.lit("")).alias("name"), "canonical_name")
    return keyed.groupBy(*SCOPE, "canonical_name").agg(F.min("name").alias("scope_name"))


def parse_confidence(status: Column, config: ModelConfig = CONFIG) -> Column:
    return F.when(status == "ok", config.ok_parse_confidence).otherwise(config.warning_parse_confidence)


def scope_confidence(kind: Column, config: ModelConfig = CONFIG) -> Column:
    return F.when(kind == "subregion", config.subregion_scope_confidence).otherwise(config.notice_fallback_confidence)


def geographic_confidence(unit_a: Column, unit_b: Column, conf_a: Column, conf_b: Column) -> Column:
    """Null where a unit is unknown, 0 where units differ, else the lesser confidence."""
    return F.when(unit_a.isNull() | unit_b.isNull(), F.lit(None).cast("double")).when(unit_a == unit_b, F.least(conf_a, conf_b)).otherwise(F.lit(0.0))


def pair_observations(obs: DataFrame, parses: DataFrame, context: DataFrame, config: ModelConfig = CONFIG) -> DataFrame:
    """Pairs within a scope. Units and parses are joined to the observations, before there are pairs, so pairs are not shuffled."""
    place = context.select(F.col("locality").alias("canonical_name"), F.col("service_unit_id").alias("unit"), F.col("spatial_confidence").alias("conf"))
    placed = obs.join(place, "canonical_name", "left")
    a, b = placed.join(parses, "notice_id").alias("a"), placed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in SCOPE]
    pairs = a.join(b, [*same, F.col("a.canonical_name") < F.col("b.canonical_name")])
    return pairs.select(
        *[F.col(f"a.{c}") for c in (*SCOPE, "scope_name", "outage_date")], F.col("a.canonical_name").alias("locality_a"), F.col("b.canonical_name").alias("locality_b"),
        parse_confidence(F.col("a.parse_status"), config).alias("parse_c"), scope_confidence(F.col("a.scope_kind"), config).alias("scope_c"),
        F.lit(config.canonicalization_confidence).alias("canon_c"), F.when(F.col("a.outage_date").isNotNull(), 1.0).alias("temporal_c"),
        geographic_confidence(*map(F.col, ("a.unit", "b.unit", "a.conf", "b.conf"))).alias("geo_c"),
    )


def restricted(df: DataFrame, dates: DataFrame | None = None, exclude: Column | None = None) -> DataFrame:
    """Rows of the given dates only (none for an empty list; a null date never matches), without one notice."""
    if dates is not None:
        df = df.join(dates.select("outage_date").distinct(), "outage_date", "left_semi")
    return df if exclude is None else df.filter(F.col("notice_id") != exclude)


def edge_inputs(pairs: DataFrame) -> DataFrame:
    """Means within a notice first, then over notices; unknown geography stays out of its mean."""
    by_notice = pairs.groupBy("locality_a", "locality_b", "notice_id", "outage_date").agg(*[F.avg(c).alias(o) for c, o in (("parse_c", "pc"), ("scope_c", "sc"), ("canon_c", "cc"), ("geo_c", "gc"))])
    return by_notice.groupBy("locality_a", "locality_b").agg(F.count("*").alias("notice_count"), F.countDistinct("outage_date").alias("dd"), *[F.avg(c).alias(c) for c in ("pc", "sc", "cc", "gc")])


def marginals(obs: DataFrame) -> DataFrame:
    return obs.groupBy(F.col("canonical_name").alias("locality")).agg(F.countDistinct("notice_id").alias("n"))


def notice_total(obs: DataFrame) -> DataFrame:
    return obs.agg(F.countDistinct("notice_id").alias("n_total"))


def cooccurrences(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("locality_a", "locality_b").agg(F.countDistinct("notice_id").alias("notice_count"), F.countDistinct("outage_date").alias("dd"), F.min("outage_date").alias("first_date"), F.max("outage_date").alias("last_date"))


def with_marginals(edges: DataFrame, marg: DataFrame, total: DataFrame) -> DataFrame:
    for side in "ab":
        edges = edges.join(marg.select(F.col("locality").alias(f"locality_{side}"), F.col("n").alias(f"n_{side}")), f"locality_{side}", "left")
    return edges.crossJoin(total)  # one row


def pmi() -> Column:
    n = F.col("n_total")
    return F.log((F.col("notice_count").cast("double") / n) / ((F.col("n_a").cast("double") / n) * (F.col("n_b").cast("double") / n)))


def weighted_edges(edges: DataFrame, marg: DataFrame, total: DataFrame, plain: bool = False, config: ModelConfig = CONFIG) -> DataFrame:
    """Edges with ppmi and weight, before the gate. plain: all confidences one and no geography; recurrence stays."""
    joined = with_marginals(edges, marg, total).withColumn("ppmi", F.greatest(F.lit(0.0), pmi()))
    recurrence = F.least(F.lit(1.0), F.col("dd") / config.recurrence_saturation_dates)
    weight = F.col("ppmi") * recurrence if plain else F.col("ppmi") * F.col("pc") * F.col("sc") * F.col("cc") * recurrence * (1 + config.max_geographic_bonus * F.coalesce("gc", F.lit(0.0)))
    return joined.withColumn("weight", weight)


def gated(weighted: DataFrame, dates: int = CONFIG.min_edge_distinct_dates) -> DataFrame:
    return weighted.filter((F.col("dd") >= dates) & (F.col("weight") > 0))


def inconsistencies(edges: DataFrame, marg: DataFrame, total: DataFrame) -> DataFrame:
    """Edges that break 0 < pair <= marginals <= total or the order of their ends."""
    joined = with_marginals(edges, marg, total)
    bad = F.col("n_a").isNull() | F.col("n_b").isNull() | (F.col("notice_count") <= 0) | (F.col("notice_count") > F.least("n_a", "n_b")) | (F.greatest("n_a", "n_b") > F.col("n_total")) | (F.col("locality_a") >= F.col("locality_b"))
    return joined.filter(bad)


def node_diagnostics(weighted: DataFrame, marg: DataFrame, dates: int = CONFIG.min_edge_distinct_dates) -> DataFrame:
    """Per locality: pairs below the date gate, and gated pairs of no weight; localities without a pair too."""
    ends = weighted.select(F.explode(F.array("locality_a", "locality_b")).alias("locality"), (F.col("dd") < dates).alias("gated"), ((F.col("dd") >= dates) & (F.col("weight") <= 0)).alias("flat"))
    counts = ends.groupBy("locality").agg(F.count_if("gated").alias("gated_pairs"), F.count_if("flat").alias("unweighted_pairs"))
    return marg.select("locality").join(counts, "locality", "left").na.fill(0, ["gated_pairs", "unweighted_pairs"])
