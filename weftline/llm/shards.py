"""Resharding that moves the fewest bytes, as a min-cost flow from old shards to new capacities.

The new shards' capacities are their shares of all bytes. A document of a 256th of a mean capacity and
more is a block of its own; there are at most 256 such blocks per new shard, so their table has
a proven bound and is dealt out on the driver: largest first, each stays where it is while its shard has room, else goes where most room is.
All smaller documents of an old shard form one supply. A flow network with a node per old
and per new shard routes the supplies into the room that is left, staying free and a moved byte at
its cost; the flow gives the bytes of each block transfer. An old shard's documents stand
in an order of their hashes, and each transfer takes a run of it, the part that stays first.
So a new shard misses its capacity by less than the runs' last documents, each smaller than a 256th.

Places in the order, and the bytes before each, come from ranges (`weftline.operators.ranks`): no task
holds a shard, and only narrow rows are shuffled, never texts. `rewrite` then writes
only what must change: a shard that loses documents is written again without them, arrivals are
new files beside a shard's old ones, and all other files stay as they are.

Null texts have size 1 (no bytes, plus 1) and the CRC of an empty text; null ids and null sources are values like others.
Texts are counted whole, however long; one that exceeds a capacity has a shard nearly to itself. Equal rows are told
apart by nothing and may be parted at the edge of a run. Other columns
are not read by `layout`, whatever their names, and kept by `rewrite`; names that begin with `__sh_` are kept for this
module. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.mixing import FlowNetwork
from weftline.operators.ranks import running
from weftline.runtime import materialize

BLOCKS_PER_SHARD = 256


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def old_shard(source: Column, shards: int) -> Column:
    """Where ingestion by source puts a document."""
    return F.pmod(F.xxhash64(source), F.lit(shards)).cast("int")


def rooms(shares: Sequence[float], loads: Sequence[int], amount: int) -> list[int]:
    """What each shard takes of `amount` so that loads and amounts together come as near to the shares as they can: all open shards are filled to one level."""
    if not amount:
        return [0] * len(shares)
    parts, open_ = [Fraction(s) for s in shares], set(range(len(shares)))
    while True:
        level = (amount + sum(loads[j] for j in open_)) / sum(parts[j] for j in open_)
        full = {j for j in open_ if loads[j] > level * parts[j]}
        if not full:
            break
        open_ -= full
    out = [int(level * parts[j]) - loads[j] if j in open_ else 0 for j in range(len(shares))]
    out = [max(x, 0) for x in out]
    short, order = amount - sum(out), sorted(open_)  # what rounding down left over
    for k, j in enumerate(order):
        out[j] += short // len(order) + (k < short % len(order))
    return out


def transfers(supplies: Mapping[int, int], room: Sequence[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard in the cheapest flow; room holds what the supplies hold."""
    olds = sorted(supplies)
    net, sink = FlowNetwork(2 + len(olds) + len(room)), 1 + len(olds) + len(room)
    arcs = {}
    for a, i in enumerate(olds):
        net.arc(0, 1 + a, supplies[i], 0)
        for j in range(len(room)):
            arcs[i, j] = net.arc(1 + a, 1 + len(olds) + j, supplies[i], cost(i, j))
    for j, r in enumerate(room):
        net.arc(1 + len(olds) + j, sink, r, 0)
    net.send(0, sink)
    return {k: net.used(e) for k, e in arcs.items() if net.used(e)}


@dataclass
class Plan:
    """blocks: (old shard, rank) -> new shard of each large document; runs: old shard -> [(first byte among its small documents, new shard)]."""

    threshold: int
    loads: list[int]
    blocks: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    runs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    moved: int = 0


def plan(sizes: Mapping[int, int], large: Sequence[tuple[int, int, int]], shares: Sequence[float], cost: Callable[[int, int], int], threshold: int) -> Plan:
    """sizes: bytes of each old shard; large: (old shard, rank, bytes) of its documents of threshold and more."""
    out, left = Plan(threshold, [0] * len(shares)), sum(sizes.values())
    goal, placed = rooms(shares, out.loads, left), [0] * len(shares)
    for old, rank, size in sorted(large, key=lambda x: (-x[2], x[0], x[1])):
        fits = old < len(shares) and out.loads[old] + size <= goal[old]
        to = old if fits else max(range(len(shares)), key=lambda j: (goal[j] - out.loads[j], -j))
        out.blocks[old, rank] = to, placed[to]
        placed[to] += 1
        out.loads[to] += size
        out.moved += size * (to != old)
        left -= size
        if out.loads[to] > goal[to]:  # then the others share what this one has too much of
            goal = [a + b for a, b in zip(out.loads, rooms(shares, out.loads, left))]
    small = dict(sizes)
    for old, _, size in large:
        small[old] -= size
    flow = transfers(small, rooms(shares, out.loads, left), cost)
    for old in sorted(small):
        at, out.runs[old] = 0, []
        for to in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):
            out.runs[old].append((at, to))
            at += flow[old, to]
            out.moved += flow[old, to] * (to != old)
    return out


def layout(rows: DataFrame, old: str, size: str, key: Sequence[str], shards: int, shares: Sequence[float] | None = None, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> tuple[DataFrame, Plan]:
    """rows with `shard`, `slot` (from 0 without gaps in each shard) and `large`, and the plan.

    rows are narrow: the old shard of each (below a number that the caller bounds, as the network has a node for each), its size, and the key that orders it."""
    spark, shares = rows.sparkSession, list(shares or [1.0] * shards)
    rows = materialize(rows, "sizes")
    sizes = {r[0]: r[1] for r in rows.groupBy(old).agg(F.sum(size)).collect()}  # a row per old shard
    threshold = max(sum(sizes.values()) // (shards * BLOCKS_PER_SHARD), 1) + 1
    is_large = F.col(size) >= threshold
    order = [F.when(is_large, -F.col(size)).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in key]]
    placed = running(rows, order, group=[old], sums=[size], rank="__sh_rank").withColumn("large", is_large)
    placed = materialize(placed, "placed")
    large = [tuple(r) for r in placed.filter("large").select(old, "__sh_rank", size).collect()]  # fewer than 256 rows per new shard, by the threshold
    found = plan(sizes, large, shares, cost, threshold)
    blocks = F.broadcast(spark.createDataFrame([(i, r, to, slot) for (i, r), (to, slot) in found.blocks.items()], "__sh_o int, __sh_r long, __sh_to int, __sh_slot long"))  # the same rows
    above = {i: sum(s for o, _, s in large if o == i) for i in sizes}
    olds = F.broadcast(spark.createDataFrame([(i, above[i], [{"at": a, "to": to} for a, to in runs]) for i, runs in found.runs.items()], "__sh_o int, __sh_above long, __sh_runs array<struct<at: long, to: int>>"))  # a row per old shard
    near = placed.join(olds, F.col(old) == F.col("__sh_o")).drop("__sh_o")
    last = F.element_at(F.filter("__sh_runs", lambda r: r["at"] <= F.col(f"before_{size}") - F.col("__sh_above")), -1)["to"]
    near = near.join(blocks, (F.col(old) == F.col("__sh_o")) & (F.col("__sh_rank") == F.col("__sh_r")), "left").withColumn("shard", F.coalesce("__sh_to", F.when(~F.col("large"), last)))
    counts = near.filter(~F.col("large")).groupBy(old, "shard").agg(F.count("*").alias("n"), F.min("__sh_rank").alias("first")).collect()  # old times new shards at most
    base, taken = [], [sum(to == j for to, _ in found.blocks.values()) for j in range(shards)]
    for i, j, n, first in sorted(map(tuple, counts)):
        base.append((i, j, taken[j] - first))
        taken[j] += n
    bases = F.broadcast(spark.createDataFrame(base, "__sh_o2 int, __sh_j int, __sh_base long"))
    out = near.join(bases, (F.col(old) == F.col("__sh_o2")) & (F.col("shard") == F.col("__sh_j")), "left")
    return out.select(*rows.columns, "shard", F.coalesce("__sh_slot", F.col("__sh_rank") + F.col("__sh_base")).alias("slot"), "large"), found


def _read(spark: SparkSession, shards: Mapping[int, Sequence[str]]) -> DataFrame:
    """All rows with their shard, file and place in the file."""
    own = None
    for number in sorted(shards):
        df = spark.read.parquet(*shards[number]).select("*", F.lit(number).alias("__sh_old"), F.col("_metadata.file_path").alias("__sh_file"), F.col("_metadata.row_index").alias("__sh_row"))
        own = df if own is None else own.unionByName(df)
    return own


def rewrite(spark: SparkSession, shards: Mapping[int, Sequence[str]], to: str, count: int, text: str = "text", shares: Sequence[float] | None = None, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> tuple[dict[int, list[str]], Plan]:
    """Reshard stored shards (number -> folders of Parquet files) to `count` shards.

    Writes below `to` the shards that lose documents, without them, and all arrivals; the folders of the
    new shards are returned, a kept one first. Old folders are left as they are: readers switch by the returned mapping."""
    docs = _read(spark, shards)
    docs = docs.select("*", text_size(F.col(text)).alias("__sh_size"), F.xxhash64("__sh_file", "__sh_row").alias("__sh_hash"))
    key = ["__sh_hash", "__sh_file", "__sh_row"]
    placed, found = layout(docs.select("__sh_old", "__sh_size", *key), "__sh_old", "__sh_size", key, count, shares, cost)
    own = F.struct(*key)
    blocks = placed.filter("large").select(F.col("__sh_file").alias("__sh_f"), F.col("__sh_row").alias("__sh_r"), F.col("shard").alias("__sh_to"))  # at most 256 per shard
    cuts = placed.filter("not large").groupBy("__sh_old", "shard").agg(F.min(own).alias("at"))
    cuts = cuts.groupBy(F.col("__sh_old").alias("__sh_o")).agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("__sh_cuts"))  # a row per old shard, an entry per run
    near = docs.join(F.broadcast(cuts), F.col("__sh_old") == F.col("__sh_o"), "left").join(F.broadcast(blocks), (F.col("__sh_file") == F.col("__sh_f")) & (F.col("__sh_row") == F.col("__sh_r")), "left")
    last = F.element_at(F.filter("__sh_cuts", lambda c: c["at"] <= own), -1)["shard"]
    near = near.withColumn("__sh_to", F.coalesce("__sh_to", last))
    moves = {(r[0], r[1]) for r in placed.filter("__sh_old <> shard").select("__sh_old", "shard").distinct().collect()}  # pairs of shards
    losing = sorted({i for i, _ in moves})
    plain = [c for c in docs.columns if not c.startswith("__sh_")]
    near = near.filter(F.col("__sh_old").isin(losing)).select(*plain, "__sh_to")
    fed = {r[0] for r in placed.filter(F.col("__sh_old").isin(losing)).select("shard").distinct().collect()}
    if losing:
        near.write.partitionBy("__sh_to").parquet(to)
    return {j: [*(shards.get(j, []) if j not in losing else []), *([f"{to}/__sh_to={j}"] if j in fed else [])] for j in range(count)}, found
