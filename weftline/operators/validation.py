"""Restricted rebuilds, agreement of partitions and other checks of a clustering."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CONFIG, ModelConfig
from weftline.operators import delta
from weftline.operators import evidence as ev
from weftline.operators.community import cluster_replicates, modularity
from weftline.runtime import materialize


def temporal_split(dates: DataFrame, fraction: float = CONFIG.temporal_holdout_train_fraction) -> DataFrame:
    """(outage_date, part): the first share of the distinct dates trains, one date at least on either side."""
    distinct = dates.select("outage_date").filter("outage_date is not null").distinct()
    place = F.row_number().over(Window.orderBy("outage_date"))  # one row per calendar day
    n = F.count("*").over(Window.partitionBy())
    cut = F.least(F.greatest(F.floor(n * fraction), F.lit(1)), n - 1)
    return distinct.select("outage_date", F.when(place <= cut, "train").otherwise("holdout").alias("part"))


def largest_notice(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("notice_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "notice_id").limit(1)


def without_largest(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return df.join(largest_notice(pairs).select("notice_id"), "notice_id", "left_anti")


def ablations(obs: DataFrame, pairs: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(edges, marginals) of the three ablations. Pairs are read once, for the sums by notice; what the largest notice
    brought to them is subtracted."""
    means = materialize(delta.notice_means(pairs), "means")
    whole = delta.sums_of_means(obs, means)
    whole = delta.Sums(materialize(whole.daily, "daily"), materialize(whole.marginals, "marginals"), whole.total)  # read by all three
    largest = means.groupBy("notice_id").agg(F.sum("observations").alias("n")).orderBy(F.desc("n"), "notice_id").limit(1).select("notice_id")
    own = [df.join(F.broadcast(largest), "notice_id", "left_semi") for df in (obs, means)]  # one row
    less = delta.together(whole, delta.sums_of_means(*own, sign=-1))
    return {
        "raw": (ev.gated(delta.weighted(whole, plain=True)), whole.marginals),
        "min_dates_plus_one": (ev.gated(delta.weighted(whole), CONFIG.min_edge_distinct_dates + 1), whole.marginals),
        "largest_notice_removed": (ev.gated(delta.weighted(less)), less.marginals),
    }


def edge_evidence(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The notices behind each wanted pair, with the names of their scopes."""
    found = pairs.join(wanted, ["locality_a", "locality_b"], "left_semi").groupBy("locality_a", "locality_b", "notice_id", "outage_date")
    return found.agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("scope_name", F.lit("")))), "|").alias("scopes"))


def independent_dates(pairs: DataFrame, names: DataFrame) -> DataFrame:
    for side in ("locality_a", "locality_b"):
        pairs = pairs.join(names.select(F.col("locality").alias(side)), side, "left_semi")
    return pairs.agg(F.countDistinct("outage_date").alias("dates"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule."""
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in rules])))


def scope_ordinals(df: DataFrame, order: list[str]) -> DataFrame:
    """Running number of the runs of equal subregions of a notice; null if it has none."""
    own, key = Window.partitionBy("notice_id").orderBy(*order), F.coalesce("subregion_name", F.lit(""))
    step = F.coalesce((F.lag(key).over(own) != key).cast("long"), F.lit(0).cast("long"))
    run = F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0))
    named = F.count("subregion_name").over(Window.partitionBy("notice_id"))
    return df.withColumn("step", step).withColumn("ordinal", F.when(named > 0, run)).drop("step")


def rand_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of pairs of shared members on whose togetherness two partitions(member, cluster) agree, by the contingency table; null below two members."""
    both = left.select("member", F.col("cluster").alias("i")).join(right.select("member", F.col("cluster").alias("j")), "member")
    cells = both.groupBy("i", "j").agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2
    total = cells.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("same"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"in_{c}"))
    row = total.crossJoin(side("i")).crossJoin(side("j"))  # single rows
    pairs = two(F.col("n"))
    return row.select(F.when(F.col("n") >= 2, (pairs + 2 * F.col("same") - F.col("in_i") - F.col("in_j")) / pairs).alias("agreement"))


def bootstrap(obs: DataFrame, pairs: DataFrame, parses: DataFrame, runs: int = CONFIG.bootstrap_runs, seed: int = CONFIG.random_seed) -> DataFrame:
    """(replicate, clusters, agreement) over resampled dates, all replicates in one job.

    Dates are drawn with replacement and collapse to a set; pairs, marginals and the
    total are all restricted to it. Dates are as many as calendar days.
    """
    spark = obs.sparkSession
    dated = obs.join(parses.select("notice_id", "outage_date").filter("outage_date is not null"), "notice_id")
    dates = [r[0] for r in dated.select("outage_date").distinct().orderBy("outage_date").collect()]  # calendar days
    rng = random.Random(seed)
    drawn = [(k, d) for k in range(runs) for d in sorted({rng.choice(dates) for _ in dates})] if dates else []
    sets = F.broadcast(spark.createDataFrame([*drawn, *[(-1, d) for d in dates]], "replicate int, outage_date string"))  # replicates times calendar days
    own = pairs.groupBy("locality_a", "locality_b", "notice_id", "outage_date").agg(*[F.avg(c).alias(o) for c, o in (("parse_c", "pc"), ("scope_c", "sc"), ("canon_c", "cc"), ("geo_c", "gc"))])
    daily = own.groupBy("locality_a", "locality_b", "outage_date").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("pc", "sc", "cc", "gc")], F.count("gc").alias("kg"))
    edges = daily.join(sets, "outage_date").groupBy("replicate", "locality_a", "locality_b").agg(
        F.sum("k").alias("notice_count"), F.count("*").alias("dd"), *[(F.sum(c) / F.sum("k")).alias(c) for c in ("pc", "sc", "cc")], F.try_divide(F.sum("gc"), F.sum("kg")).alias("gc")
    )
    by_day = dated.select("notice_id", "outage_date", F.col("canonical_name").alias("locality")).distinct().groupBy("locality", "outage_date").agg(F.count("*").alias("k"))
    marg = by_day.join(sets, "outage_date").groupBy("replicate", "locality").agg(F.sum("k").alias("n"))
    total = dated.select("notice_id", "outage_date").distinct().groupBy("outage_date").agg(F.count("*").alias("k")).join(sets, "outage_date").groupBy("replicate").agg(F.sum("k").alias("n_total"))
    for side in "ab":
        edges = edges.join(marg.select("replicate", F.col("locality").alias(f"locality_{side}"), F.col("n").alias(f"n_{side}")), ["replicate", f"locality_{side}"])
    edges = edges.join(total, "replicate").withColumn("ppmi", F.greatest(F.lit(0.0), ev.pmi()))
    weight = F.col("ppmi") * F.col("pc") * F.col("sc") * F.col("cc") * F.least(F.lit(1.0), F.col("dd") / CONFIG.recurrence_saturation_dates) * (1 + CONFIG.max_geographic_bonus * F.coalesce("gc", F.lit(0.0)))
    parts = cluster_replicates(ev.gated(edges.withColumn("weight", weight)), marg.select("replicate", "locality"))
    base = parts.filter("replicate = -1").select("locality", F.col("cluster").alias("j"))
    cells = parts.filter("replicate >= 0").join(base, "locality").groupBy("replicate", F.col("cluster").alias("i"), "j").agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2
    side = lambda c: cells.groupBy("replicate", c).agg(F.sum("n").alias("n")).groupBy("replicate").agg(F.sum(two(F.col("n"))).alias(f"in_{c}"), F.count("*").alias(f"kinds_{c}"))
    row = cells.groupBy("replicate").agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("same")).join(side("i"), "replicate").join(side("j"), "replicate")
    pairs_ = two(F.col("n"))
    return row.select("replicate", F.col("kinds_i").alias("clusters"), F.round(F.when(F.col("n") >= 2, (pairs_ + 2 * F.col("same") - F.col("in_i") - F.col("in_j")) / pairs_), 8).alias("agreement"))


def holdout_recall(partition: DataFrame, held: DataFrame) -> DataFrame:
    """One row (scorable, hits, recall): of the held(locality_a, locality_b) pairs whose ends both stand in
    partition(locality, cluster), the share with both in one cluster; null if there are none."""
    for side in "ab":
        held = held.join(partition.select(F.col("locality").alias(f"locality_{side}"), F.col("cluster").alias(f"c_{side}")), f"locality_{side}")
    hit = F.count_if(F.col("c_a") == F.col("c_b"))
    return held.agg(F.count("*").alias("scorable"), hit.alias("hits"), F.try_divide(hit, F.count("*")).alias("recall"))


#: what the figures of a report mean
DEFINITIONS = {
    "membership_agreement": "share of pairs of shared localities on whose togetherness two partitions agree, whatever the clusters are called",
    "bootstrap": "distinct outage dates are drawn with replacement, edges rebuilt from these dates and clustered, and compared with the partition of all dates",
    "held_out_edge_recall": "pairs of held-out dates whose localities both stand in the training partition; a hit has both in one cluster, unseen localities are left out",
    "raw_cooccurrence_baseline": "agreement with the clusters of the unweighted graph",
    "largest_notice_removed_agreement": "agreement with the clusters without the notice of most pairs",
    "config_sensitivity_agreement": "agreement with the clusters of edges of one more date",
}


#: figures of a clustering that need no draws, and what they are called in a report
_ABLATED = {"raw": "raw_cooccurrence_baseline", "largest_notice_removed": "largest_notice_removed_agreement", "min_dates_plus_one": "config_sensitivity_agreement"}


def cluster_readings(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: clusters, modularity, held_out_edge_recall of the clusters of the training dates, and the agreement of all dates' clusters with those of each ablation.

    All graphs are clustered together, as replicates."""
    edges, marg = materialize(ev.gated(ev.weighted_edges(ev.edge_inputs(pairs), ev.marginals(obs), ev.notice_total(obs))), "edges"), ev.marginals(obs)
    days = temporal_split(pairs.select("outage_date"))
    early, late = (ev.restricted(pairs, days.filter(F.col("part") == p)) for p in ("train", "holdout"))
    seen = obs.join(early.select("notice_id").distinct(), "notice_id", "left_semi")
    seen_marg = ev.marginals(seen)
    graphs = {"full": (edges, marg), "train": (ev.gated(ev.weighted_edges(ev.edge_inputs(early), seen_marg, ev.notice_total(seen))), seen_marg), **ablations(obs, pairs)}
    numbered = [(F.lit(k).alias("replicate"), *g) for k, g in enumerate(graphs.values())]
    both = [reduce(DataFrame.unionByName, dfs) for dfs in ([e.select(k, "locality_a", "locality_b", "weight") for k, e, _ in numbered], [m.select(k, "locality") for k, _, m in numbered])]
    parts = materialize(cluster_replicates(*both), "parts")
    part = {name: parts.filter(F.col("replicate") == k).select("locality", "cluster") for k, name in enumerate(graphs)}
    member = lambda name: part[name].withColumnRenamed("locality", "member")
    row = part["full"].agg(F.countDistinct("cluster").alias("clusters")).crossJoin(modularity(edges, part["full"]))  # single rows from here
    row = row.crossJoin(holdout_recall(part["train"], late.select("locality_a", "locality_b").distinct()).select(F.col("recall").alias("held_out_edge_recall")))
    for variant, name in _ABLATED.items():
        row = row.crossJoin(rand_index(member("full"), member(variant)).select(F.col("agreement").alias(name)))
    return row


def validation_report(obs: DataFrame, pairs: DataFrame, parses: DataFrame, build: str, config: ModelConfig = CONFIG) -> DataFrame:
    """One row: the figures of a build's clustering, why a figure is missing, and all of it as JSON.

    Baselines of geography and of service units are not measured, by definition of the report."""
    drawn = bootstrap(obs, pairs, parses, config.bootstrap_runs, config.random_seed).agg(F.avg("agreement").alias("mean_membership_agreement"))
    row = drawn.crossJoin(cluster_readings(obs, pairs))  # single rows
    figures = ["mean_membership_agreement", "held_out_edge_recall", *_ABLATED.values()]
    row = row.select(F.lit(build).alias("build_id"), F.lit(config.version).alias("config_version"), F.lit(config.random_seed).alias("random_seed"), F.lit(config.bootstrap_runs).alias("bootstrap_runs"), *[F.round(c, 8).alias(c) for c in figures], F.lit(None).cast("double").alias("geography_baseline"), F.lit(None).cast("double").alias("service_unit_baseline"))
    why = {"mean_membership_agreement": "no replicate shared two localities with the full partition", "held_out_edge_recall": "no held-out pair has both localities in training", **dict.fromkeys(_ABLATED.values(), "fewer than two shared localities")}
    row = row.withColumn("unmeasured", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}: {why[c]}")) for c in figures])))
    told = F.create_map(*[F.lit(x) for item in sorted(DEFINITIONS.items()) for x in item])
    return row.withColumn("report", F.to_json(F.struct(*sorted(row.columns), told.alias("definitions"))))
