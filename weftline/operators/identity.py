"""Cluster history: memberships, stability, identity across days, lineage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import CONFIG, JACCARD_SCALE, STABILITY_LOOKBACK_DAYS
from weftline.operators.components import connected_components
from weftline.operators.ranks import running
from weftline.runtime import materialize


def recent_days(history: DataFrame, n: int) -> list[str]:
    """The last n run dates, newest first; so few values come to the driver and go back as literals."""
    return [r[0] for r in history.select("run_date").distinct().orderBy(F.desc("run_date")).limit(n).collect()]


def day(history: DataFrame, back: int = 0) -> DataFrame:
    """The members of the last day but `back`."""
    days = recent_days(history, back + 1)
    return history.filter(F.col("run_date").isin(days[back:])).select("locality", "cluster_id")


def lookback_dates(history: DataFrame, days: int = STABILITY_LOOKBACK_DAYS) -> DataFrame:
    """The last run dates before the latest one."""
    return history.sparkSession.createDataFrame([(d,) for d in recent_days(history, days + 1)[1:]], "run_date string")


def memberships(members: DataFrame) -> DataFrame:
    """(cluster_id, members, n): kept as one row per member's list only where a caller shows it."""
    return members.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("locality")), ",").alias("members"), F.countDistinct("locality").alias("n"))


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """Cluster pairs that share a member, with their Jaccard similarity; never a cross product."""
    both = new.select("locality", F.col("cluster_id").alias("new_id")).join(old.select("locality", F.col("cluster_id").alias("old_id")), "locality")
    shared = both.groupBy("new_id", "old_id").agg(F.count("*").alias("shared"))
    size = lambda df, n: df.groupBy(F.col("cluster_id").alias(f"{n}_id")).agg(F.count("*").alias(f"{n}_size"))
    joined = shared.join(size(new, "new"), "new_id").join(size(old, "old"), "old_id")
    union = F.col("new_size") + F.col("old_size") - F.col("shared")
    return joined.select("new_id", "old_id", "shared", union.alias("either"), (F.col("shared") / union).alias("similarity"), F.floor(F.col("shared") * JACCARD_SCALE / union).cast("long").alias("weight"))


def best_matching(weights: list[list[int]]) -> list[int]:
    """For each row of a weight matrix the column it is matched to, or -1, for the largest total weight (Hungarian method)."""
    rows, cols = len(weights), max((len(w) for w in weights), default=0)
    n = max(rows, cols)
    if not n:
        return []
    cost = [[-(weights[i][j] if i < rows and j < cols else 0) for j in range(n)] for i in range(n)]
    u, v, match, way = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, n + 1):
        i = match[j]
        if 1 <= i <= rows and j <= cols and weights[i - 1][j - 1] > 0:
            out[i - 1] = j - 1
    return out


def matched(eligible: DataFrame) -> DataFrame:
    """(new_id, old_id) of the matching of most weight in eligible(new_id, old_id, weight); of several of
    equal weight the one with the first pairs, in order of new_id and old_id.

    A pair without a rival on either side is matched as it is. Pairs that share no cluster, directly or through others, do not
    concern each other: each connected group is matched by itself. From a threshold of one half on, a group has three clusters at most,
    since both of a cluster's partners are then halves of it."""
    partners = lambda c: F.count("*").over(Window.partitionBy(c))
    counted = materialize(eligible.select("new_id", "old_id", "weight", ((partners("new_id") == 1) & (partners("old_id") == 1)).alias("alone")), "eligible")
    pairs, contested = counted.filter("alone").select("new_id", "old_id"), counted.filter("not alone")
    nodes = contested.select((F.col("new_id") * 2).cast("long").alias("u"), (F.col("old_id") * 2 + 1).cast("long").alias("v"))
    parts = connected_components(nodes)
    grouped = contested.select("new_id", "old_id", "weight", (F.col("new_id") * 2).cast("long").alias("node")).join(parts, "node")

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["new_id", "old_id"])
        news, olds = sorted(set(own.new_id)), sorted(set(own.old_id))
        row, column = {n: i for i, n in enumerate(news)}, {o: j for j, o in enumerate(olds)}
        table = [[0] * len(olds) for _ in news]
        for k, (n, o, w) in enumerate(zip(own.new_id, own.old_id, own.weight)):
            table[row[n]][column[o]] = (int(w) << len(own)) + (1 << (len(own) - 1 - k))  # the earlier pair outweighs all later ones
        found = [(n, olds[j]) for n, j in zip(news, best_matching(table)) if j >= 0]
        return pd.DataFrame(found, columns=["new_id", "old_id"])

    kinds = dict(eligible.dtypes)
    return pairs.unionByName(grouped.groupBy("component").applyInPandas(solve, f"new_id {kinds['new_id']}, old_id {kinds['old_id']}"))


def match_ids(new: DataFrame, old: DataFrame, next_id: int, threshold: float = CONFIG.min_id_inheritance_jaccard) -> DataFrame:
    """(new_id, stable_id): each new cluster's id is inherited by the matching of most weight among eligible pairs, else the next free one in order of new_id."""
    inherited = materialize(matched(overlaps(new, old).filter(F.col("similarity") >= threshold).select("new_id", "old_id", "weight")), "matched")
    rest = new.select(F.col("cluster_id").alias("new_id")).distinct().join(inherited, "new_id", "left_anti")
    fresh = running(rest, [F.col("new_id")]).select("new_id", (F.col("rank") + (next_id - 1)).cast("long").alias("stable_id"))
    return inherited.select("new_id", F.col("old_id").cast("long").alias("stable_id")).unionByName(fresh)


def lineage(new: DataFrame, old: DataFrame, inherited: DataFrame, threshold: float = CONFIG.min_id_inheritance_jaccard) -> DataFrame:
    """(new_id, old_id, similarity, role) given inherited(new_id, old_id)."""
    pairs = overlaps(new, old).withColumn("eligible", F.col("similarity") >= threshold)
    kinds = lambda c: F.count_if("eligible").over(Window.partitionBy(c))
    pairs = pairs.withColumns({"of_new": kinds("new_id"), "of_old": kinds("old_id")})
    pairs = pairs.join(inherited.select("new_id", "old_id", F.lit(True).alias("own")), ["new_id", "old_id"], "left")
    role = F.when(F.col("own"), "inherited").when(~F.col("eligible"), "related").when(F.col("of_new") > 1, "merged").when(F.col("of_old") > 1, "split").otherwise("related")
    return pairs.select("new_id", "old_id", "similarity", role.alias("role"))


def stability(history: DataFrame, days: int = STABILITY_LOOKBACK_DAYS) -> DataFrame:
    """(locality, stability): mean likeness of a locality's company today and on each past day.

    For a locality in cluster i today and j then, with n_ij members in both,
    its companions are n_ij - 1 of (a_i - 1) + (b_j - 1) - (n_ij - 1); no companions, or a
    day without the locality, count 0. No pairs of members are made.
    """
    latest, *earlier = recent_days(history, days + 1) or [None]
    today = history.filter(F.col("run_date") == latest).select("locality", "cluster_id")
    past = history.filter(F.col("run_date").isin(earlier))
    size = today.groupBy("cluster_id").agg(F.count("*").alias("a"))
    then = past.groupBy("run_date", F.col("cluster_id").alias("old_id")).agg(F.count("*").alias("b"))
    both = today.join(past.select("locality", "run_date", F.col("cluster_id").alias("old_id")), "locality")
    shared = both.groupBy("run_date", "cluster_id", "old_id").agg((F.count("*") - 1).alias("n"))
    cells = shared.join(size, "cluster_id").join(then, ["run_date", "old_id"])
    likeness = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("a") + F.col("b") - 2 - F.col("n")), F.lit(0.0))
    sums = both.join(cells.select("run_date", "cluster_id", "old_id", likeness.alias("x")), ["run_date", "cluster_id", "old_id"]).groupBy("locality").agg(F.sum("x").alias("total"))
    mean = F.coalesce("total", F.lit(0.0)) / max(len(earlier), 1)
    return today.select("locality").join(sums, "locality", "left").select("locality", mean.alias("stability"))
