"""Builds of the evidence by signed changes: what the changed notices brought is taken out, what they bring now is put in.

Three tables of sums carry a build. `daily` has, for each pair of localities and outage date, the number of notices and
the sums of their mean confidences; `marginals` the notices of each locality; `total` all notices. All are
sums over notices, so a change of some notices is the same sums over these alone, added with a sign. The
facts of notices that did not change are not read. Edges follow from the sums: notices and dates of a pair are
counts of what is left, means are sums over counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evidence as ev
from weftline.operators.state import VersionedTable

PAIR = ("locality_a", "locality_b")
MEANS = (("parse_c", "pc"), ("scope_c", "sc"), ("canon_c", "cc"), ("geo_c", "gc"))
_SUMS = ("k", "pc", "sc", "cc", "gc", "kg")


@dataclass(frozen=True)
class Sums:
    daily: DataFrame  # locality_a, locality_b, outage_date, k, pc, sc, cc, gc, kg
    marginals: DataFrame  # locality, n
    total: DataFrame  # n_total


def notice_means(pairs: DataFrame) -> DataFrame:
    """A row per pair and notice: the means of its confidences, unknown geography left out, and its observations."""
    return pairs.groupBy(*PAIR, "notice_id", "outage_date").agg(*[F.avg(c).alias(o) for c, o in MEANS], F.count("*").alias("observations"))


def daily(means: DataFrame, sign: int = 1) -> DataFrame:
    own = [F.sum(c).alias(c) for c in ("pc", "sc", "cc", "gc")]
    found = means.groupBy(*PAIR, "outage_date").agg(F.count("*").alias("k"), *own, F.count("gc").alias("kg"))
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(0)) * sign for c in _SUMS})


def present(obs: DataFrame, sign: int = 1) -> DataFrame:
    return obs.groupBy(F.col("canonical_name").alias("locality")).agg((F.countDistinct("notice_id") * sign).alias("n"))


def sums(obs: DataFrame, pairs: DataFrame, sign: int = 1) -> Sums:
    return sums_of_means(obs, notice_means(pairs), sign)


def sums_of_means(obs: DataFrame, means: DataFrame, sign: int = 1) -> Sums:
    return Sums(daily(means, sign), present(obs, sign), obs.agg((F.countDistinct("notice_id") * sign).alias("n_total")))


def together(*parts: Sums) -> Sums:
    """All sums added up; what nothing is left of goes. Dates that are unknown stay apart, as one."""
    days, names, totals = ([getattr(p, x) for p in parts] for x in ("daily", "marginals", "total"))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union([dfs[0].unionByName(dfs[1]), *dfs[2:]])
    return Sums(
        union(days).groupBy(*PAIR, "outage_date").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("k <> 0"),
        union(names).groupBy("locality").agg(F.sum("n").alias("n")).filter("n <> 0"),
        union(totals).agg(F.sum("n_total").alias("n_total")),
    )


def edges(own: Sums) -> DataFrame:
    """The inputs of weights, as evidence.edge_inputs gives them from pairs."""
    mean = lambda c: F.try_divide(F.sum(c), F.sum("k")).alias(c)
    geography = F.when(F.sum("kg") > 0, F.try_divide(F.sum("gc"), F.sum("kg"))).alias("gc")
    return own.daily.groupBy(*PAIR).agg(F.sum("k").alias("notice_count"), F.count("outage_date").alias("dd"), mean("pc"), mean("sc"), mean("cc"), geography)


def weighted(own: Sums, plain: bool = False) -> DataFrame:
    return ev.weighted_edges(edges(own), own.marginals, own.total, plain)


class EvidenceBuilds:
    """Builds of weighted edges below a folder, each with the sums that the next one starts from."""

    def __init__(self, root: str, spark: SparkSession) -> None:
        self.spark = spark
        self.edges, *self.parts = (VersionedTable(f"{root}/{x}", spark) for x in ("edges", "daily", "marginals", "total"))

    def active_sums(self) -> Sums | None:
        build = self.edges.active()
        return Sums(*(self.spark.read.parquet(t.path(build)) for t in self.parts)) if build else None

    def _publish(self, build: str, own: Sums, checks: tuple[Callable[[], str | None], ...]) -> str:
        for part, df in zip(self.parts, (own.daily, own.marginals, own.total)):
            part.write(df, build)
        written = Sums(*(self.spark.read.parquet(t.path(build)) for t in self.parts))
        self.edges.write(weighted(written), build)
        self.edges.activate(build, *checks)
        return f"activated {build}"

    def full(self, build: str, obs: DataFrame, pairs: DataFrame, *checks: Callable[[], str | None]) -> str:
        return self._publish(build, together(sums(obs, pairs)), checks)

    def update(self, build: str, before: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame], *checks: Callable[[], str | None]) -> str | None:
        """A build from the active one and (observations, pairs) of the changed notices before and now; None
        if neither has a row. A notice that is new has no rows before, one that is gone none now. A failed check leaves
        the active build as it was."""
        held = self.active_sums()
        if held is None:
            raise ValueError("no active build to start from")
        if before[0].isEmpty() and now[0].isEmpty():
            return None
        return self._publish(build, together(held, sums(*before, sign=-1), sums(*now)), checks)
