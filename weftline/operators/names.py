"""Canonical names: each name, in order of first sight, joins the most similar canonical name before it or becomes one.

What is canonical depends on what came before. As a graph: names are nodes in order, similar ones are linked, and
the canonical names are the first independent set in that order. All names without an undecided
neighbour before them are canonical at once, their later neighbours are not, and so on in rounds of joins;
the number of rounds is that of the longest chain of decisions, not of the names.

Links come from an equi-join without loss. A pair of ratio t and lengths l <= m is at most k = (1 - t) * (l + m)
insertions and deletions apart, so of k + 1 pieces of the shorter one stands unharmed in the longer, near
its place. Pieces are the index, substrings at the places that can match are the probes; candidates are
held to a bounded edit distance in the JVM and then to the exact ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.functions import text as tx
from weftline.operators.ranks import running
from weftline.runtime import materialize

FEW_LINKS = 20_000
MAX_ROUNDS = 10_000


def _ratio(a: Column, b: Column) -> Column:
    """The Indel ratio of texts whose tokens are sorted already."""

    @arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([200.0 * tx.common_length(p, q) / (len(p) + len(q)) if p or q else 100.0 for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return of(a, b)


def similar(texts: DataFrame, threshold: float = tx.FUZZY_THRESHOLD) -> DataFrame:
    """(u, v, score) for all u < v of texts(id, t) whose ratio is at least the threshold; every pair once.

    A threshold of two thirds or less would leave pieces without a character, and is refused."""
    share = 1 - threshold / 100
    if 2 * share >= 1 - share:
        raise ValueError("threshold must be above 200 / 3")
    longest = (2 - threshold / 100) / (threshold / 100)  # the greatest ratio of two lengths
    slack = 1e-9
    edits = lambda l: F.floor(share * (l + F.floor(l * longest + slack)) + slack).cast("int")  # noqa: E731,E741
    sized = texts.select("id", "t", F.length("t").alias("m"))
    pieces = lambda df, length: df.withColumn("k", edits(F.col(length))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1)))
    width = F.floor(F.col("l") / (F.col("k") + 1)).cast("int")
    wider = F.col("l") % (F.col("k") + 1)  # so many of the last pieces are one longer
    before = F.greatest(F.lit(0), F.col("i") - 1 - (F.col("k") + 1 - wider))
    place = lambda df: df.withColumns({"p": ((F.col("i") - 1) * width + before).cast("int"), "w": (width + (F.col("i") > F.col("k") + 1 - wider).cast("int")).cast("int")})
    index = place(pieces(sized.withColumnRenamed("m", "l").filter("l > 0"), "l"))
    index = index.select("l", "i", F.col("t").substr(F.col("p") + 1, F.col("w")).alias("piece"), F.col("id").alias("a"), F.col("t").alias("ta"))
    least = F.ceil(F.col("m") / longest - slack).cast("int")
    probes = place(pieces(sized.filter("m > 0").withColumn("l", F.explode(F.sequence(F.greatest(least, F.lit(1)), F.col("m")))), "l"))
    more, left = F.col("m") - F.col("l"), F.col("k") + 1 - F.col("i")
    start = F.greatest(F.lit(0), F.col("p") - (F.col("i") - 1), F.col("p") + more - left)
    stop = F.least(F.col("m") - F.col("w"), F.col("p") + (F.col("i") - 1), F.col("p") + more + left)
    probes = probes.withColumns({"from": start, "to": stop}).filter(F.col("from") <= F.col("to")).withColumn("at", F.explode(F.sequence("from", "to")))
    probes = probes.select("l", "i", F.col("t").substr(F.col("at") + 1, F.col("w")).alias("piece"), F.col("id").alias("b"), F.col("t").alias("tb"))
    met = index.join(probes, ["l", "i", "piece"]).filter("a <> b")
    most = F.floor(share * (F.length("ta") + F.length("tb")) + slack).cast("int")
    near = met.filter((F.abs(F.length("ta") - F.length("tb")) <= most) & (F.levenshtein("ta", "tb") <= most))
    first = F.col("a") < F.col("b")
    pairs = near.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.col("ta")).otherwise(F.col("tb")).alias("tu"), F.when(first, F.col("tb")).otherwise(F.col("ta")).alias("tv"))
    scored = pairs.dropDuplicates(["u", "v"]).withColumn("score", _ratio(F.col("tu"), F.col("tv")))
    empty = texts.filter("t = ''").select("id")
    hub = empty.agg(F.min("id").alias("u"))  # empty texts are alike; chained to the first, as only equal ones can be near them
    alike = empty.crossJoin(hub).filter("id > u").select("u", F.col("id").alias("v"), F.lit(100.0).alias("score"))  # one row
    return scored.filter(F.col("score") >= threshold).select("u", "v", "score").unionByName(alike)


def _decided_in_one_task(links: DataFrame) -> DataFrame:
    """The nodes that are not canonical, of at most FEW_LINKS links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gone: set = set()
        links = sorted((v, u) for batch in batches for u, v in zip(batch["u"], batch["v"]))
        for v, u in links:
            if u not in gone:
                gone.add(v)
        yield pd.DataFrame({"v": sorted(gone)}, dtype="int64")

    return links.select("u", "v").coalesce(1).mapInPandas(run, "v long")


def followers(links: DataFrame) -> DataFrame:
    """(v): the nodes of links(u, v), u < v, that have a canonical node before them."""
    links = materialize(links.select("u", "v"), "links")
    out: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        n = links.count()
        if not n:
            break
        done = n <= FEW_LINKS
        if done:
            gone = materialize(_decided_in_one_task(links), "gone")
        else:
            first = links.select("u").distinct().join(links.select(F.col("v").alias("u")), "u", "left_anti")  # no undecided one before them
            gone = materialize(links.join(first, "u").select("v").distinct(), "gone")
            left = links.join(first, "u", "left_anti").join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti")
            links = materialize(left.select("u", "v"), "links")
        out = gone if out is None else out.unionByName(gone)
        if done:
            break
    else:
        raise RuntimeError(f"names were not decided in {MAX_ROUNDS} rounds")
    return links.select("v").limit(0) if out is None else out


def canonical_names(names: DataFrame, threshold: float = tx.FUZZY_THRESHOLD) -> DataFrame:
    """(name, canonical) of the distinct names of names(name, first), in order of `first`, then of the name.

    Names with equal keys (normalised) share what their key became; a name whose key is not canonical takes the most
    similar canonical name before it, the earliest of ties. A null name has no row. Empty input gives no rows."""
    names = names.filter("name is not null").groupBy("name").agg(F.min("first").alias("first"))
    key = tx.normalized(tx.composed(F.col("name")))
    names = materialize(running(names.withColumn("key", key), [F.col("first").asc_nulls_first(), F.col("name")], rank="seen"), "names")
    keys = names.groupBy("key").agg(F.min("seen").alias("id"), F.min_by("name", "seen").alias("raw"))
    keys = materialize(keys.withColumn("t", tx.token_sort_key(F.col("key"))), "keys")
    links = materialize(similar(keys.select("id", "t"), threshold), "similar")
    gone = materialize(followers(links), "followers").withColumnRenamed("v", "id")
    canonical = keys.join(gone, "id", "left_anti").select("id", "raw")
    own = names.join(keys.join(gone, "id", "left_anti").select("key", "raw"), "key").select("name", F.col("raw").alias("canonical"))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"))
    choice = names.join(keys.join(gone, "id", "left_semi").select("key", F.col("id").alias("v")), "key").join(both, "v")
    choice = choice.join(canonical.select(F.col("id").alias("u"), "raw"), "u").filter(F.col("u") < F.col("seen"))
    best = choice.groupBy("name").agg(F.max_by("raw", F.struct("score", -F.col("u"))).alias("canonical"))
    return own.unionByName(best)
