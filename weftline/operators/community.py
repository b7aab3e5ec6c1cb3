"""Communities by modularity, component by component.

Communities never cross components, so each component is solved by itself with the
total weight of its whole graph. A component of few edges is the unit of work; one of many is first coarsened by
moves that all nodes make at once, as joins, and by contraction, until few edges are left. Isolated nodes are
communities of their own and skip it.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.operators.ranks import running
from weftline.runtime import materialize

MOST_EDGES = 200_000  # of a component that one task solves
MOST_STEPS, LEAST_MOVES, LEAST_SHRINK = 12, 0.02, 0.95


def _one_level(links: dict, degree: dict, total: float) -> dict:
    """Greedy moves of nodes, in order, to the neighbouring community of most gain, until none moves."""
    home = {n: n for n in links}
    weight = dict(degree)
    moved = True
    while moved:
        moved = False
        for n in sorted(links):
            beside: dict = defaultdict(float)
            for m, w in links[n].items():
                if m != n:
                    beside[home[m]] += w
            own = home[n]
            weight[own] -= degree[n]
            gain = lambda c: beside.get(c, 0.0) - degree[n] * weight[c] / total
            best, best_gain = own, gain(own)
            for c in sorted(beside):
                if gain(c) > best_gain + 1e-12:
                    best, best_gain = c, gain(c)
            weight[best] += degree[n]
            if best != own:
                home[n], moved = best, True
    return home


def louvain(edges: list[tuple[str, str, float]], total: float) -> dict[str, str]:
    """Community of each node, named by its least node; total is twice the weight of the whole graph."""
    links: dict = defaultdict(dict)
    for a, b, w in edges:
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
    members = {n: [n] for n in links}
    while True:
        degree = {n: sum(w for w in x.values()) for n, x in links.items()}
        home = _one_level(links, degree, total)
        if len(set(home.values())) == len(links):
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        groups: dict = defaultdict(list)
        for n, c in home.items():
            groups[c] += members[n]
            for m, w in links[n].items():
                merged[c][home[m]] += w
        links = {c: dict(x) for c, x in merged.items()}
        members = dict(groups)
    return {n: min(own) for own in members.values() for n in own}


def _totals(edges: DataFrame) -> DataFrame:
    """(node, d, total): the weight at each node, a loop's counted twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w", "total")
    return ends.groupBy("node").agg(F.sum("w").alias("d"), F.first("total").alias("total"))


def _moved(edges: DataFrame, degree: DataFrame, home: DataFrame, step: int) -> DataFrame:
    """home(node, c) after half of the nodes, drawn by their hash, have gone to the neighbouring community of most gain.

    All that move do so at once, by what stood before. Of two that stand alone only the one of greater number joins the other, so they do not trade places."""
    there = home.select(F.col("node").alias("v"), "c")
    both = edges.filter("u <> v")
    both = both.select("u", "v", "w").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    own_rows = home.select(F.col("node").alias("u"), "c", F.lit(0.0).alias("w"))  # the gain of staying
    beside = both.join(there, "v").select("u", "c", "w").unionByName(own_rows).groupBy("u", "c").agg(F.sum("w").alias("beside"))
    nodes = degree.join(home.withColumnRenamed("c", "own"), "node")
    weight = nodes.groupBy(F.col("own").alias("c")).agg(F.sum("d").alias("weight"), F.count("*").alias("n"))
    size = weight.select(F.col("c").alias("own"), F.col("n").alias("own_n"))
    options = beside.join(nodes.join(size, "own").withColumnRenamed("node", "u"), "u").join(weight, "c")
    stays = F.col("c") == F.col("own")
    gain = F.col("beside") - F.col("d") * (F.col("weight") - F.when(stays, F.col("d")).otherwise(0.0)) / F.col("total")
    allowed = stays | ~((F.col("own_n") == 1) & (F.col("n") == 1) & (F.col("c") > F.col("own")))
    best = options.withColumn("gain", gain).filter(allowed).groupBy("u").agg(
        F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("x"), F.max(F.when(stays, F.col("gain"))).alias("staying"), F.first("own").alias("own"), F.first("total").alias("total")
    )
    active = F.pmod(F.xxhash64("u", F.lit(step)), F.lit(2)) == 0
    goes = active & (F.col("x.gain") > F.col("staying") + 1e-12 * F.col("total"))
    return best.select(F.col("u").alias("node"), F.when(goes, -F.col("x.c")).otherwise(F.col("own")).alias("c"), (goes & (-F.col("x.c") != F.col("own"))).alias("moved"))


def coarsened(edges: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """Communities of edges(u, v, w, component, total) by parallel moves, contracted level by level until a level has at most `few`
    edges or no longer shrinks: (edges between communities, with loops; home(node, c) of the original nodes)."""
    home, level = None, materialize(edges, "level")
    edges_left = level.count()
    while edges_left > few:
        degree = materialize(_totals(level), "degree")
        own = degree.select("node", F.col("node").alias("c"))
        n = degree.count()
        for step in range(MOST_STEPS):
            found = materialize(_moved(level, degree, own, step), "moved")
            moves = found.filter("moved").count()
            own = found.select("node", "c")
            if moves <= LEAST_MOVES * n and step:
                break
        ends = level.join(own.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(own.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
        merged = ends.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w"), F.first("component").alias("component"), F.first("total").alias("total"))
        level = materialize(merged, "level")
        home = own if home is None else materialize(home.withColumnRenamed("c", "mid").join(own.select(F.col("node").alias("mid"), "c"), "mid").select("node", "c"), "home")
        before, edges_left = edges_left, level.count()
        if edges_left > LEAST_SHRINK * before:
            break
    if home is None:
        home = _totals(level).select("node", F.col("node").alias("c"))
    return level, home


def _solved(grouped: DataFrame) -> DataFrame:
    """(node, name) of edges(component, total, u, v, w): each component in one task, communities named by their least node."""
    kind = dict(grouped.dtypes)["u"]

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["u", "v"])
        found = louvain(list(zip(own.u, own.v, own.w)), float(own.total.iloc[0]))
        return pd.DataFrame({"node": list(found), "name": list(found.values())})

    return grouped.groupBy("component").applyInPandas(solve, f"node {kind}, name {kind}")


def cluster_replicates(edges: DataFrame, nodes: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(replicate, locality, cluster) from edges(replicate, locality_a, locality_b, weight) and nodes(replicate, locality).

    A component of up to most_edges edges is solved in one task. Greater ones are coarsened by parallel moves first, until they are as small."""
    key = lambda c: F.concat_ws("\u0001", F.col("replicate").cast("string"), F.col(c))
    edges = materialize(edges.select("replicate", key("locality_a").alias("u"), key("locality_b").alias("v"), F.col("weight").alias("w")), "graph")  # read several times below
    parts = connected_components(edges.select("u", "v"))
    total = edges.groupBy("replicate").agg((2 * F.sum("w")).alias("total"))
    grouped = materialize(edges.join(parts.withColumnRenamed("node", "u"), "u").join(total, "replicate").select("component", "total", "u", "v", "w"), "grouped")
    great = materialize(grouped.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most_edges).select("component"), "great")
    solved = _solved(grouped.join(great, "component", "left_anti"))
    if not great.isEmpty():
        solved = solved.unionByName(_great(grouped.join(great, "component", "left_semi"), most_edges))
    named = solved.select(F.col("node").alias("__key"), F.split_part("name", F.lit("\u0001"), F.lit(2)).alias("cluster"))
    found = nodes.withColumn("__key", key("locality")).join(named, "__key", "left")
    return found.select("replicate", "locality", F.coalesce("cluster", "locality").alias("cluster"))


def _great(grouped: DataFrame, most_edges: int) -> DataFrame:
    ids = materialize(running(grouped.select(F.explode(F.array("u", "v")).alias("node")).distinct(), [F.col("node")], rank="id"), "ids")
    end = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = grouped.join(end("u"), "u").join(end("v"), "v").select("component", "total", F.col("u_id").alias("u"), F.col("v_id").alias("v"), "w")
    level, home = coarsened(numbered, most_edges)
    small = level.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= most_edges).select("component")
    last = _solved(level.join(small, "component", "left_semi")).select(F.col("node").alias("c"), "name")
    found = ids.join(home.withColumnRenamed("node", "id"), "id").join(last, "c", "left").select("node", F.coalesce("name", "c").alias("c"))
    least = found.groupBy("c").agg(F.min("node").alias("name"))
    return found.join(least, "c").select("node", "name")


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (modularity) of edges(locality_a, locality_b, weight) under clusters(locality, cluster); null without edges."""
    for side in "ab":
        edges = edges.join(clusters.select(F.col("locality").alias(f"locality_{side}"), F.col("cluster").alias(f"c_{side}")), f"locality_{side}")
    inside = edges.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    weight = edges.select(F.explode(F.array("c_a", "c_b")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    squares = weight.agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    return inside.crossJoin(squares).select((F.try_divide(F.col("inside"), F.col("m")) - F.try_divide(F.col("squares"), 4 * F.col("m") * F.col("m"))).alias("modularity"))  # single rows


def clusters_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locality, cluster_id): communities numbered by their least member."""
    found = cluster_replicates(edges.withColumn("replicate", F.lit(0)), nodes.select(F.lit(0).alias("replicate"), "locality"))
    ids = running(found.select("cluster").distinct(), [F.col("cluster")])
    return found.join(ids, "cluster").select("locality", (F.col("rank") - 1).alias("cluster_id"))
