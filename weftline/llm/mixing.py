"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs
to), so the flow network has one node per pattern and one per source, however many
documents there are. From the origin a pattern can be used once, twice or three
times over, each use dearer than the last (convex repetition costs); a pattern sends
words to the sources it belongs to; a source passes on its target. Successive
shortest paths route the words, so a pattern is repeated only where fresh words are
used up. Sources that share no documents, directly or through others, are routed apart, so no
task holds the patterns of all; sources and patterns may be as many as they are.

The flow gives the number of words each pattern contributes. Its documents are then
all taken floor(words / size) times, and some once more: documents are ordered by a
seeded hash and taken until the next would overshoot; what is then missing is filled,
largest first, from the first later documents of each size class. The order is found
from sums over hash ranges, so no task holds more than one range of a pattern.

Null text has size 0; documents of size 0 take part with nothing taken. Rows with a
null source form a source of their own, the last. Texts are counted whole, however long.
Other columns are carried along, whatever their names, but for names that start with
`__wl_`, which are kept for this module. Equal rows share their hash and
are told apart by nothing, so ties are settled together through their count: equal
rows are taken all or none at the edge. Null ids are hashed as such. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.components import connected_components
from weftline.operators.ranks import running
from weftline.runtime import materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 7
RANGE_ROWS = 1 << 16  # rows of a range of hashes, near enough; there are 4096 ranges at least

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight; a share above `most` times its source stops there
    and the excess is shared out again by weight among the rest."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


class FlowNetwork:
    """Directed arcs with whole capacities and costs; cheapest flow by shortest paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, source: int, sink: int) -> int:
        """Route all that fits, cheapest first: each round finds distances once, then
        blocks every path of that length."""
        n, sent = len(self.out), 0
        height = [0] * n
        while True:
            far = [None] * n
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        b, reach = self.to[e], d + self.cost[e] + height[a] - height[self.to[e]]
                        if far[b] is None or reach < far[b]:
                            far[b] = reach
                            heapq.heappush(queue, (reach, b))
            if far[sink] is None:
                return sent
            for i in range(n):
                height[i] += far[sink] if far[i] is None else min(far[i], far[sink])
            sent += self._block(source, sink, height)

    def _block(self, source: int, sink: int, height: list[int]) -> int:
        """Depth-first along arcs of reduced cost 0 until none leads through."""
        at, sent = [0] * len(self.out), 0
        while True:
            path, a, on = [], source, {source}
            while a != sink:
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    b = self.to[e]
                    if self.room[e] and b not in on and self.cost[e] + height[a] - height[b] == 0:
                        break
                    at[a] += 1
                else:
                    if a == source:
                        return sent
                    on.discard(a)
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = b
                on.add(a)
            least = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= least
                self.room[e ^ 1] += least
            sent += least


def route(patterns: Sequence[Sequence[int]], sizes: Sequence[int], quotas: Sequence[int], most: int = MOST_REPEATS) -> list[int]:
    """Words each pattern contributes in the cheapest flow that fills the quotas as far as it can."""
    net = FlowNetwork(2 + len(patterns) + len(quotas))
    sink, uses = 1 + len(patterns) + len(quotas), []
    for p, (members, size) in enumerate(zip(patterns, sizes)):
        uses.append([net.arc(0, 1 + p, size, k * k) for k in range(most)])
        for s in members:
            net.arc(1 + p, 1 + len(patterns) + s, most * size, 0)
    for s, quota in enumerate(quotas):
        net.arc(1 + len(patterns) + s, sink, quota, 0)
    net.send(0, sink)
    return [sum(net.used(e) for e in arcs) for arcs in uses]


def mix(docs: DataFrame, size: Column, sources: Column, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """docs with __wl_size and __wl_copies (times taken) appended.

    sources is an array of the names a document belongs to (a null name is a source).
    """
    marked = _marked(docs, size, sources, seed)
    narrow = materialize(marked.select("__wl_pattern", "__wl_size", "__wl_hash"), "sizes")
    return _choose(marked, narrow, weights, most)


def _marked(docs: DataFrame, size: Column, sources: Column, seed: int) -> DataFrame:
    marked = docs.withColumns({"__wl_size": size.cast("long"), "__wl_pattern": F.array_sort(F.array_distinct(sources))})
    return marked.withColumn("__wl_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, size) of docs(__wl_size, __wl_pattern); a document counts in each of its sources."""
    patterns = docs.groupBy("__wl_pattern").agg(F.sum("__wl_size").alias("n"))
    return patterns.select(F.explode("__wl_pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").cast("long").alias("size"))


def target_table(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(id, source, size, target) of sizes(source, size): the targets() of the sources in order, null last, id from 1.

    A source stops at `most` times its size where its share is above that; the rest's shares then grow, so more
    stop, until none does. Each round is one sum over the sources; only sums come to the driver."""
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("id") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(running(sizes, [F.col("source").asc_nulls_last()], rank="id").withColumn("weight", nth), "sources")
    total, open_weight = ranked.agg(F.sum("size"), F.sum("weight")).first()
    left, closed, stopped = total or 0, 0, F.lit(False)
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(open_weight or 1.0)
        full = stopped | (share > most * F.col("size"))
        n, held, weight = ranked.filter(full).agg(F.count("*"), F.coalesce(F.sum(most * F.col("size")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == closed:
            break
        level = left / open_weight  # those that stopped stay so, as this only grows
        closed, left, stopped = n, (total or 0) - held, F.lit(level) * F.col("weight") > most * F.col("size")
        open_weight = ranked.agg(F.sum("weight")).first()[0] - weight
    target = F.when(full, (most * F.col("size")).cast("double")).otherwise(share)
    return ranked.select("id", "source", "size", target.alias("target"))


def _plan(marked: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """(pattern, each, rest): all documents of a pattern are taken `each` times and `rest` words once more.

    A pattern of one source that no other pattern has gives what its source wants. Sources that share documents are
    routed together, each connected group of them in a task of its own, one row per pattern."""
    patterns = materialize(marked.groupBy("__wl_pattern").agg(F.sum("__wl_size").cast("long").alias("n")), "patterns")
    goal = materialize(target_table(source_sizes(marked), weights, most), "targets").select("id", "source", F.rint("target").cast("long").alias("quota"))
    each = patterns.select("__wl_pattern", "n", F.explode("__wl_pattern").alias("s")).join(goal, F.col("s").eqNullSafe(F.col("source")))
    wanted = materialize(each.groupBy("__wl_pattern").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("id", "quota"))).alias("of")), "wanted")
    links = wanted.filter(F.size("of") > 1).select(F.col("of")[0]["id"].alias("u"), F.explode(F.slice("of", F.lit(2), F.size("of") - 1)).alias("x")).select("u", F.col("x.id").alias("v"))
    groups = materialize(connected_components(links), "groups")
    placed = wanted.withColumn("node", F.col("of")[0]["id"]).join(groups, "node", "left")
    flow = F.least(F.col("of")[0]["quota"], most * F.col("n"))
    alone = placed.filter("component is null").select("__wl_pattern", "n", flow.alias("flow"))

    def routed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("order")
        quotas = {int(x["id"]): int(x["quota"]) for of in own["of"] for x in of}
        place = {s: i for i, s in enumerate(sorted(quotas))}
        found = route([[place[int(x["id"])] for x in of] for of in own["of"]], [int(n) for n in own["n"]], [quotas[s] for s in sorted(quotas)], most)
        return pd.DataFrame({"order": own["order"], "flow": found})

    # patterns travel as numbers: arrays with null names do not survive pandas
    shared_ = materialize(running(placed.filter("component is not null"), [F.col("of.id")], rank="order"), "shared")
    flows = shared_.select("component", "order", "n", "of").groupBy("component").applyInPandas(routed, "order long, flow long")
    every = alone.unionByName(shared_.join(flows, "order").select("__wl_pattern", "n", "flow"))
    return every.select("__wl_pattern", F.when(F.col("n") > 0, F.expr("flow div n")).otherwise(0).alias("each"), F.when(F.col("n") > 0, F.col("flow") % F.col("n")).otherwise(0).alias("rest"))


def _choose(marked: DataFrame, sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """Seeded order by hash: whole ranges by sums over ranges, then rows within the range where the words run out."""
    plan = materialize(_plan(sizes, weights, most), "plan")  # small or not, it is joined as its size allows
    shift = 64 - max(12, (sizes.count() // RANGE_ROWS).bit_length())
    key, zone = ["__wl_pattern"], F.shiftrightunsigned("__wl_hash", shift).alias("zone")
    narrow = sizes.filter("__wl_size > 0").groupBy("__wl_pattern", "__wl_hash").agg(F.sum("__wl_size").alias("n"))
    narrow = narrow.withColumn("zone", zone).join(plan.filter("rest > 0"), key)
    zones = narrow.groupBy(*key, "zone", "rest").agg(F.sum("n").alias("n"))
    through = F.sum("n").over(Window.partitionBy(*key).orderBy("zone"))
    edge = zones.withColumn("before", through - F.col("n")).filter("before <= rest and before + n > rest").select(*key, "zone", "before")
    inside = narrow.join(edge, [*key, "zone"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*key, "zone").orderBy("__wl_hash")))
    last = inside.filter("upto <= rest").groupBy(*key).agg(F.max("__wl_hash").alias("last"), F.max("upto").alias("got"))
    cut = edge.join(last, key, "left").join(plan, key).select(*key, "zone", "last", F.coalesce("got", "before").alias("got"), "rest")
    cut = materialize(cut, "cuts")
    beyond = narrow.drop("rest").withColumnRenamed("zone", "own").join(cut, key).filter("own > zone or own = zone and (last is null or __wl_hash > last)")
    gap = F.col("rest") - F.col("got")
    fits = beyond.filter(F.col("n") <= gap).groupBy(*key, F.floor(F.log2("n")).alias("class"), F.col("__wl_hash").bitwiseAND(F.lit(7)).alias("slot"))
    fits = fits.agg(F.min(F.struct("__wl_hash", "n")).alias("x"), F.first(gap).alias("gap")).groupBy(*key).agg(F.collect_list(F.struct(F.col("x.n").alias("n"), F.col("x.__wl_hash").alias("h"))).alias("fits"), F.first("gap").alias("gap"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<long>").alias("taken"))
    take = lambda acc, x: F.when(x["n"] <= acc["gap"], F.struct((acc["gap"] - x["n"]).alias("gap"), F.concat(acc["taken"], F.array(x["h"])).alias("taken"))).otherwise(acc)
    extra = fits.select(*key, F.aggregate(F.sort_array("fits", asc=False), start, take)["taken"].alias("extra"))
    final = plan.join(cut.select(*key, "zone", "last"), key, "left").join(extra, key, "left")
    plain = ["each", "rest", "zone", "last", "extra"]
    final = materialize(final.select(*key, *(F.col(c).alias(f"__wl_{c}") for c in plain)), "choices")
    own, zone, last = F.shiftrightunsigned("__wl_hash", shift), F.col("__wl_zone"), F.col("__wl_last")
    more = F.when(F.col("__wl_rest") > 0, (own < zone) | ((own == zone) & (F.col("__wl_hash") <= last)) | F.coalesce(F.array_contains("__wl_extra", F.col("__wl_hash")), F.lit(False)))
    out = marked.join(final, key, "left")
    copies = F.when(F.col("__wl_size") > 0, F.col("__wl_each") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(0)
    return out.withColumn("__wl_copies", copies.cast("long")).drop(*(f"__wl_{c}" for c in plain), "__wl_pattern", "__wl_hash")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, __wl_size, __wl_copies) of docs(doc_id, text, source)."""
    marked = _marked(docs.select("doc_id", "text", "source"), word_count(F.col("text")), F.array("source"), seed)
    marked = materialize(marked.drop("text"), "sizes")
    return _choose(marked, marked, weights, most)


def source_table(mixed: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of what mixed_documents returned."""
    return target_table(source_sizes(mixed.withColumn("__wl_pattern", F.array("source"))), weights, most).withColumnRenamed("size", "source_size").drop("id")
