"""Near copies by the Jaccard similarity of shingle sets, beyond the reach of fingerprints.

Words are those of simhash: runs of bytes between ASCII white space, lower-cased in A-Z.
Texts with the same words in a row are one node, told apart by a 64-bit hash.

Candidates. Nodes whose fingerprints link in the index of simhash are linked. Copies of
0.8 similarity are ten bits of 64 and more apart, which no index of them reaches with
recall; so a node has BANDS keys as well, each of ROWS minima of its shingle hashes under
random orders; nodes that share a key are linked. A pair of similarity s has none in
common with probability (1 - s ** ROWS) ** BANDS: 2 in 10,000 at 0.8, less above.
Each node of a key is linked to the key's least node, so links grow with the nodes.

Comparison. Links are followed to components. A component's first member (least doc_id)
stays and what is similar to it goes, all components side by side. The rest is read in
order of doc_id: a member stays unless it is similar to one of those that stay, and then
others are compared with it. Comparisons are of whole sets, so a link alone removes
nothing. Those that stay of one component are held in one task, as sets of hashes, with
an index of the shingles of which two sets of that similarity must share one.

Rows. Null text and text without a word are one node. A null doc_id stands behind all others. Texts are compared whole,
however long; repeated rows and equal doc_ids are ties in which one row stays. An empty table gives an empty
result. Other columns are kept, whatever their names, but for names that start with `__wl_`, which are this module's.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.arrowtext import mixed, packed, pieces, texts, unpacked, unpacked_pieces, words
from weftline.operators.components import connected_components
from weftline.runtime import materialize, small_batches

SEED = 42
ROWS, BANDS = 6, 28

IS_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def node(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def node_column(text: Column) -> Column:
    """The text's node as a signed long."""

    @arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(np.fromiter(map(node, texts(column)), dtype=np.uint64, count=len(column)).view(np.int64))

    return of(text)


def shingles(at: np.ndarray, raw: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first of each row and the total); a row of fewer words has one shingle."""
    _, _, hashes, bound = words(at, _LOWER[raw], IS_WORD)
    size = np.diff(bound)
    count = np.maximum(1, size - shingle + 1)
    first = np.r_[0, np.cumsum(count)]
    start = np.repeat(bound[:-1] - first[:-1], count) + np.arange(first[-1])
    end = np.repeat(bound[1:], count)
    hashes = np.append(hashes, np.uint64(0))
    out = np.zeros(first[-1], dtype=np.uint64)
    for k in range(shingle):
        out = out * _STEP + np.where(start + k < end, hashes[np.minimum(start + k, len(hashes) - 1)], np.uint64(0))
    return mixed(out), first


def band_keys(at: np.ndarray, raw: np.ndarray, shingle: int) -> np.ndarray:
    """BANDS keys of each row."""
    hashes, first = shingles(at, raw, shingle)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(SEED)
    keys = np.empty((len(first) - 1, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(first) - 1, band + 1, dtype=np.uint64)
        for _ in range(ROWS):
            times, plus = rng.integers(0, 1 << 32, 2, dtype=np.uint32)
            order = short * (times | np.uint32(1))
            order ^= order >> np.uint32(15)
            order *= plus | np.uint32(1)
            key = mixed(key * _STEP + np.minimum.reduceat(order, first[:-1]))
        keys[:, band] = key
    return keys


def keys_column(text: Column, shingle: int) -> Column:
    """The keys as an array of signed longs."""

    @arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        found = [band_keys(at, raw, shingle) for _, _, at, raw in pieces(column)]
        flat = np.concatenate(found).reshape(-1).view(np.int64) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * BANDS), pa.array(flat))

    return of(text)


def groups(docs: DataFrame, shingle: int, fp: Column, linked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node, none, least_id) of every node of docs(doc_id, text), and (node, none, least_id, component) of those that link to another.

    fp is the text's fingerprint; linked gives (node, component) of the fingerprints of a table's column fp that link."""
    small_batches(docs.sparkSession)
    text = F.col("text")
    sketch = materialize(docs.select("doc_id", node_column(text).alias("node"), fp.alias("fp"), keys_column(text, shingle).alias("keys")), "sketch")
    least = sketch.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("r"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    least = materialize(least.select("node", "r.none", F.col("r.doc_id").alias("least_id"), "fp", "keys"), "nodes")
    near = linked(least.select("fp")).select(F.col("node").alias("fp"), "component")
    near = least.select("node", "fp").join(near, "fp", "left").select("node", F.xxhash64(F.coalesce("component", "fp")).alias("k"))
    keyed = least.select("node", F.explode("keys").alias("k")).unionByName(near)
    shared = keyed.groupBy("k").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last").select("k", "v")
    links = keyed.join(shared, "k").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    found = connected_components(materialize(links, "links"))
    least = least.drop("keys", "fp")
    return least, materialize(least.join(found, "node"), "members")


def sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each packed row."""
    found = []
    for _, _, at, raw in unpacked_pieces(column):
        hashes, first = shingles(at, raw, shingle)
        found += [np.unique(hashes[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
    return found


def jaccard(a: Column, b: Column, shingle: int) -> Column:
    """Similarity of the packed texts' sets of shingles."""

    @arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([likeness(p, q) for p, q in zip(sets(x, shingle), sets(y, shingle))], pa.float64())

    return of(a, b)


def likeness(p: np.ndarray, q: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = int((np.searchsorted(q, p, "right") - np.searchsorted(q, p, "left")).sum())
    return both / (len(p) + len(q) - both)


def _unlike(docs: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, none, least_id, component, body) of members not that similar to the first of their component."""
    text = F.col("text")
    own = docs.select("doc_id", packed(text).alias("body"), node_column(text).alias("n")).join(members, (F.col("n") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("least_id")))
    own = materialize(own.groupBy("node", "none", "least_id", "component").agg(F.min("body").alias("body")), "compared")
    first = members.groupBy("component").agg(F.min(F.struct("none", "least_id", "node")).alias("r")).select(F.col("r.node").alias("first"))
    first = own.join(first, F.col("node") == F.col("first")).select("first", "component", F.col("body").alias("first_body"))
    both = own.join(first, "component").filter("node <> first")
    return both.filter(jaccard(F.col("body"), F.col("first_body"), shingle) < similarity).select(*own.columns)


class Kept:
    """Sets that stay, no two of them similar, and whether another is similar to one of them."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.sets, self.places = similarity, [], defaultdict(list)

    def add(self, own: np.ndarray) -> bool:
        """Whether the sorted set stays. Of its n hashes all but n * similarity of the least are
        looked up: a similar set shares n * similarity or more of them, so one of these at least."""
        few = own[: len(own) - math.ceil(self.similarity * len(own) - 1e-9) + 1].tolist()
        for i in {i for h in few for i in self.places[h]} if self.sets else ():
            if likeness(own, self.sets[i]) >= self.similarity:
                return False
        for h in few:
            self.places[h].append(len(self.sets))
        self.sets.append(own)
        return True


def _rest_that_stays(rest: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node) of rows of rest(node, none, least_id, component, body) that stay in order within their component."""
    out = pa.schema([("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, kept = None, Kept(similarity)
        for batch in batches:
            stay = []
            nodes, owners = batch.column("node").to_pylist(), batch.column("component").to_pylist()
            for n, c, own in zip(nodes, owners, sets(batch.column("body"), shingle)):
                if c != component:
                    component, kept = c, Kept(similarity)
                if kept.add(own):
                    stay.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(stay, pa.int64())], schema=out)

    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rest.repartition(tasks, "component").sortWithinPartitions("component", "none", "least_id", "node")
    return dealt.select("node", "component", "body").mapInArrow(run, "node long")


def keep_unlike(docs: DataFrame, shingle: int, similarity: float, fp: Column, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of rows with equal words the one of
    least doc_id, unless it is that similar to one of lesser doc_id that stays. For fp and linked see groups."""
    least, members = groups(docs, shingle, fp, linked)
    first = members.groupBy("component").agg(F.min(F.struct("none", "least_id", "node")).alias("r")).select("r.node")
    rest = materialize(_unlike(docs, members, shingle, similarity), "unlike")
    rest = materialize(_rest_that_stays(rest, shingle, similarity), "rest")
    gone = members.select("node").join(first.unionByName(rest), "node", "left_anti")
    chosen = least.join(gone, "node", "left_anti").select(F.col("node").alias("__wl_node"), F.col("least_id").alias("__wl_id"))
    marked = docs.withColumns({"__wl_node": node_column(F.col("text")), "__wl_null": F.col("text").isNull(), "text": packed(F.col("text"))})
    kept = marked.join(chosen, "__wl_node").filter(F.col("doc_id").eqNullSafe(F.col("__wl_id"))).dropDuplicates(["__wl_node"])
    return kept.withColumn("text", F.when(~F.col("__wl_null"), _text(F.col("text")))).select(*docs.columns)


def _text(body: Column) -> Column:
    @arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([x.decode() for x in unpacked(column)], pa.string())

    return of(body)
