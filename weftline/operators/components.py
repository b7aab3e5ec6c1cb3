"""Connected components as a loop of joins, with one shared table written per round."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialize

MAX_ROUNDS = 60
FEW_EDGES = 20_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The contraction of at most FEW_EDGES edges, by union-find in one task."""
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["u"], batch["v"]):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in list(root)]
        yield pd.DataFrame({"u": [x for x, r in rows if x != r], "v": [r for x, r in rows if x != r]}).astype({"u": "int64", "v": "int64"} if kind == "bigint" else object)

    return edges.select("u", "v").coalesce(1).mapInPandas(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node.

    Self loops and null ends are left out. Alternates two star contractions until
    the edge set stops changing, which takes a number of rounds that grows with
    the logarithm of the node count; only two figures of a round reach the driver. Once
no more than FEW_EDGES are left, one task finishes them.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    edges = materialize(_small_star(edges), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        figure = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if figure["n"] == 0 or (figure["n"], figure["h"]) == seen:
            break
        if figure["n"] <= FEW_EDGES:
            edges = materialize(_in_one_task(edges), "edges")
            break
        seen = (figure["n"], figure["h"])
        edges = materialize(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
