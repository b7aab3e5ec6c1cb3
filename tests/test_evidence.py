import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import evidence as ev
from weftline.operators import readiness, validation
from weftline.operators.community import clusters_of, louvain


def notices(spark, *rows):
    """rows: (notice, [(locality, subregion, ordinal)], date, status)"""
    names = [(n, loc, o, s, i) for n, ls, _, _ in rows for i, (loc, s, o) in enumerate(ls)]
    localities = spark.createDataFrame(names, "notice_id string, canonical_name string, scope_ordinal int, subregion_name string, line int")
    parses = spark.createDataFrame([(n, d, s) for n, _, d, s in rows], "notice_id string, outage_date string, parse_status string")
    context = spark.createDataFrame([], "locality string, service_unit_id string, spatial_confidence double")
    obs = ev.observations(localities)
    return obs, ev.pair_observations(obs, parses, context), parses


def plain(*names):
    return [(n, None, None) for n in names]


def test_counts_by_distinct_notice_and_date(spark):
    obs, pairs, _ = notices(spark, ("n1", plain("A", "A", "B"), "2026-07-20", "ok"), ("n2", plain("A", "B", "C"), "2026-07-22", "ok"))
    assert {r.locality: r.n for r in ev.marginals(obs).collect()} == {"A": 2, "B": 2, "C": 1}
    ab = ev.cooccurrences(pairs).filter("locality_a = 'A' and locality_b = 'B'").first()
    assert (ab.notice_count, ab.dd, ab.first_date, ab.last_date) == (2, 2, "2026-07-20", "2026-07-22")


def test_null_date_is_no_day(spark):
    _, pairs, _ = notices(spark, ("n1", plain("A", "B"), None, "ok"))
    row = ev.cooccurrences(pairs).first()
    assert (row.dd, row.first_date) == (0, None)
    assert pairs.first().temporal_c is None


def test_pairs_stay_in_their_scope(spark):
    _, pairs, _ = notices(spark, ("n1", [("A", "S", 0), ("B", "S", 0), ("C", "K", 1)], "2026-01-01", "ok"), ("n2", plain("D", "E"), "2026-01-01", "ok"))
    assert {(r.locality_a, r.locality_b, r.scope_c) for r in pairs.collect()} == {("A", "B", 1.0), ("D", "E", 0.35)}


def test_two_disjoint_pairs_have_ln_2(spark):
    obs, pairs, _ = notices(spark, *[(f"n{i}", plain(*p), f"2026-01-0{i}", "ok") for i, p in enumerate(["AB", "AB", "CD", "CD"], 1)])
    edges = ev.weighted_edges(ev.edge_inputs(pairs), ev.marginals(obs), ev.notice_total(obs)).collect()
    assert len(edges) == 2 and all(math.isclose(e.ppmi, math.log(2)) for e in edges)


def test_means_are_taken_within_a_notice_first(spark):
    cells = [(x, "S", o) for o in range(4) for x in "AB"]
    _, pairs, _ = notices(spark, ("n1", cells, "2026-01-01", "warning"), ("n2", plain("A", "B"), "2026-01-02", "ok"), ("n3", plain("A", "B"), "2026-01-03", "ok"))
    row = ev.edge_inputs(pairs).first()
    assert row.notice_count == 3 and math.isclose(row.pc, (0.7 + 1 + 1) / 3)


@pytest.mark.parametrize("geo, bonus", [(None, 1.0), (0.0, 1.0), (1.0, 1.15)])
def test_weight_and_geography(spark, geo, bonus):
    edges = spark.createDataFrame([("A", "B", 3, 3, 1.0, 1.0, 1.0, geo)], "locality_a string, locality_b string, notice_count long, dd long, pc double, sc double, cc double, gc double")
    marg = spark.createDataFrame([("A", 4), ("B", 5)], "locality string, n long")
    row = ev.weighted_edges(edges, marg, spark.range(1).select(F.lit(10).alias("n_total"))).first()
    assert math.isclose(row.ppmi, math.log(1.5)) and math.isclose(row.weight, math.log(1.5) * bonus)
    bad = marg.filter("locality = 'A'")
    assert ev.inconsistencies(edges, bad, spark.range(1).select(F.lit(10).alias("n_total"))).count() == 1


def test_restriction_to_no_dates_gives_nothing(spark):
    _, pairs, _ = notices(spark, ("n1", plain("A", "B"), "2026-01-01", "ok"), ("n2", plain("A", "B"), None, "ok"))
    assert ev.restricted(pairs, spark.createDataFrame([], "outage_date string")).count() == 0
    assert ev.restricted(pairs, spark.createDataFrame([("2026-01-01",)], "outage_date string")).count() == 1


def test_readiness_passes_at_the_thresholds(spark):
    row = spark.createDataFrame([(30, 15, 10, 20, 0.80, 0.20)], "valid_notices int, distinct_outage_dates int, unique_localities int, repeated_pairs int, active_ok_ratio double, largest_notice_pair_share double")
    assert all(r.status == "pass" for r in readiness.gates(readiness.signals(row)).collect())
    less = row.withColumn("valid_notices", F.lit(29)).withColumn("largest_notice_pair_share", F.lit(0.21))
    assert {r.reason for r in readiness.gates(readiness.signals(less)).collect() if r.status == "fail"} == {"valid_notices_below_minimum", "largest_notice_pair_share_above_maximum"}


def test_split_keeps_a_day_on_either_side(spark):
    days = spark.createDataFrame([("a",), ("b",), (None,)], "outage_date string")
    assert {r.outage_date: r.part for r in validation.temporal_split(days).collect()} == {"a": "train", "b": "holdout"}


def test_rand_index(spark):
    part = lambda d: spark.createDataFrame(list(d.items()), "member string, cluster int")
    agree = lambda a, b: validation.rand_index(part(a), part(b)).first().agreement
    assert agree({"A": 0, "B": 0, "C": 1}, {"A": 7, "B": 7, "C": 3}) == 1.0
    assert math.isclose(agree({"A": 0, "B": 0, "C": 0}, {"A": 0, "B": 0, "C": 1}), 1 / 3)
    assert agree({"A": 0}, {"A": 0}) is None


def test_communities(spark):
    square = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0), ("c", "x", 0.05)]
    found = louvain(square, 2 * sum(w for *_, w in square))
    assert {found[n] for n in "abc"} == {"a"} and {found[n] for n in "xyz"} == {"x"}
    edges = spark.createDataFrame(square, "locality_a string, locality_b string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "locality string")
    ids = {r.locality: r.cluster_id for r in clusters_of(edges, nodes).collect()}
    assert ids["a"] == ids["b"] == ids["c"] and ids["x"] == ids["y"] == ids["z"] and len(set(ids.values())) == 3
