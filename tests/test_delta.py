import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import delta
from weftline.operators import evidence as ev

CONTEXT = [("a", "u1", 1.0), ("b", "u1", 0.7), ("c", "u2", 1.0), ("d", None, 0.5)]
DATES = ["2026-01-01", "2026-01-02", "2026-01-03", None]


class Facts:
    """Notices with their scopes, as they stand; each has a date and a status of its own."""

    def __init__(self, spark, seed):
        self.spark, self.rng, self.notices = spark, random.Random(seed), {}
        for n in range(60):
            self.change(n)

    def change(self, n):
        r = self.rng
        self.notices[n] = (r.choice(DATES), r.choice(["ok", "warning"]), sorted({(r.choice(["subregion", "notice_fallback"]), r.randint(0, 1), x) for x in r.choices("abcdef", k=r.randint(0, 5))}))

    def frames(self, only=None):
        chosen = {n: x for n, x in self.notices.items() if only is None or n in only}
        obs = self.spark.createDataFrame([(n, k, o, "s", x) for n, (_, _, rows) in chosen.items() for k, o, x in rows], "notice_id long, scope_kind string, scope_ord int, scope_name string, canonical_name string")
        parses = self.spark.createDataFrame([(n, d, s) for n, (d, s, _) in chosen.items()], "notice_id long, outage_date string, parse_status string")
        context = self.spark.createDataFrame(CONTEXT, "locality string, service_unit_id string, spatial_confidence double")
        return obs, ev.pair_observations(obs, parses, context)


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("locality_a", "locality_b", "notice_count", "dd", "n_a", "n_b", "n_total", "ppmi", "weight").collect())


def plain(obs, pairs):
    return ev.weighted_edges(ev.edge_inputs(pairs), ev.marginals(obs), ev.notice_total(obs))


def test_changes_give_what_a_full_build_gives(spark, tmp_path):
    facts = Facts(spark, 6)
    builds = delta.EvidenceBuilds(str(tmp_path / "b"), spark)
    with pytest.raises(ValueError, match="no active build"):
        builds.update("x", facts.frames([1]), facts.frames([1]))
    assert builds.full("b0", *facts.frames()) == "activated b0"
    assert rows(builds.edges.read(spark)) == rows(plain(*facts.frames()))
    for step in range(1, 3):
        touched = facts.rng.sample(range(70), 12)
        before = facts.frames(touched)
        for n in touched:
            if n % 3 == 0:
                facts.notices.pop(n, None)  # gone
            else:
                facts.change(n)  # new or changed
        assert builds.update(f"b{step}", before, facts.frames(touched)) == f"activated b{step}"
        assert rows(builds.edges.read(spark)) == rows(plain(*facts.frames()))
    held = rows(builds.edges.read(spark))
    assert builds.update("b9", facts.frames([999]), facts.frames([999])) is None
    with pytest.raises(ValueError, match="no edges"):
        builds.update("b9", facts.frames([1, 2, 4]), facts.frames([999]), lambda: "no edges")
    assert builds.edges.active() == "b2" and rows(builds.edges.read(spark)) == held


def test_taking_all_out_leaves_nothing(spark):
    obs, pairs = Facts(spark, 2).frames()
    own = delta.together(delta.sums(obs, pairs), delta.sums(obs, pairs, sign=-1))
    assert delta.edges(own).isEmpty() and own.marginals.isEmpty() and own.total.first().n_total == 0


def test_sums_without_geography(spark):
    obs, pairs = Facts(spark, 3).frames()
    pairs = pairs.withColumn("geo_c", F.lit(None).cast("double"))
    assert {r.gc for r in delta.edges(delta.together(delta.sums(obs, pairs))).collect()} == {None}
