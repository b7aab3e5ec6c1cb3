"""SimHash near-duplicates through a Gray-ordered hierarchical index.

A fingerprint has bit b set if more than half of a text's shingle hashes have it.
Fingerprints within `radius` bits are linked and links are followed to components.

Candidates. The 64 bits are cut into radius + m bands. Two fingerprints within the
radius agree on at least m bands, so each distinct fingerprint is dealt to one bucket
for every m of the bands; no link is lost. m is 2, or more where the number of
fingerprints would fill the buckets. A bucket above `HOT_BUCKET`
fingerprints is dealt out further as pairs of its parts, so that no task holds a
whole hot bucket; all pairs of parts are visited, so nothing is dropped there either.

Index. A bucket's fingerprints are sorted by Gray rank, in which neighbours differ in few
bits, wherever these stand. Each FAN neighbours get a node above them that holds the bits
on which all of them agree, as a mask and a value; nodes are grouped likewise up to one
root. So a pattern that a group shares is stored, and compared, once. Trees of many buckets
are held together. Each is compared with itself from the top: a pair of nodes adds the
differing bits among those that their masks have in common and that no node above has
compared yet, and a pair whose sum exceeds the radius is left with all that stands below.

Rows. Null text and text without a word have fingerprint zero, which links like any
other. Equal rows have equal fingerprints and are linked. A null doc_id takes part in
links but cannot name a component unless no other id is there. Texts are read whole,
however long. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm import similar
from weftline.llm.arrowtext import texts
from weftline.operators.components import connected_components
from weftline.runtime import materialize, small_batches

SEED = 42
RADIUS = 3
SHINGLE = 3
HOT_BUCKET = 20_000
EVEN_BUCKET = 64
FRONTIER = 1 << 18
FAN = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())])
    columns = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    held = np.zeros(64, dtype=np.int64)
    for at in range(0, len(columns), 1 << 14):
        held += np.unpackbits(columns[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * held > len(columns)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x, shingle) for x in texts(column)), dtype=np.uint64, count=len(column))
        return pa.array(found.view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence."""
    x = x.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayForest:
    """A tree for each group of fingerprints: nodes of shared masked bit patterns over runs in Gray order."""

    def __init__(self, groups: np.ndarray, prints: np.ndarray) -> None:
        order = np.lexsort((gray_rank(prints), groups))
        self.prints, owner = prints[order], groups[order]
        value, mask = self.prints, np.full(len(prints), ~np.uint64(0))
        self.value, self.mask, self.first = [value], [mask], []
        while (fresh := np.r_[True, owner[1:] != owner[:-1]]).sum() < len(owner):
            place = np.arange(len(owner))
            starts = np.flatnonzero((place - np.maximum.accumulate(np.where(fresh, place, 0))) % FAN == 0)
            size = np.diff(np.r_[starts, len(owner)])
            apart = np.bitwise_or.reduceat((value ^ np.repeat(value[starts], size)) | ~mask, starts)
            mask, owner = ~apart, owner[starts]
            value = value[starts] & mask
            self.first.insert(0, np.r_[starts, place[-1] + 1])
            self.value.insert(0, value)
            self.mask.insert(0, mask)

    def close(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs a < b of prints within the radius, in blocks."""
        roots = np.arange(len(self.value[0]))
        stack = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
        while stack:
            level, a, b, spent = stack.pop()
            if level == len(self.first):
                yield a[a < b], b[a < b]
                continue
            first, value, mask = self.first[level], self.value[level + 1], self.mask[level + 1]
            compared = self.mask[level][a] & self.mask[level][b]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            room = np.cumsum(na * nb)
            cuts = np.unique(np.searchsorted(room, np.arange(FRONTIER, room[-1], FRONTIER)) + 1) if room[-1] > FRONTIER else []
            for part in np.split(np.arange(len(a)), cuts):
                if not len(part):
                    continue
                each = (na * nb)[part]
                owner = np.repeat(part, each)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                x, y = first[a[owner]] + k // nb[owner], first[b[owner]] + k % nb[owner]
                half = x <= y  # pairs of a node with itself have each pair of children once
                x, y, owner = x[half], y[half], owner[half]
                new = mask[x] & mask[y] & ~compared[owner]
                total = spent[owner] + np.bitwise_count((value[x] ^ value[y]) & new)
                good = total <= radius
                if good.any():
                    stack.append((level + 1, x[good], y[good], total[good]))


def local_links(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(print, least-placed print of its component in its group) for all linked prints but the roots; prints are distinct in a group."""
    tree = GrayForest(groups, prints)
    root = np.arange(len(tree.prints))
    for a, b in tree.close(radius):
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            differ = low < high
            if not differ.any():
                break
            np.minimum.at(root, high[differ], low[differ])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return tree.prints[moved], tree.prints[root[moved]]


def matched_bands(radius: int, count: int) -> int:
    """How many bands must agree so that an even deal leaves some tens of fingerprints in a bucket."""
    return next(m for m in range(2, 65) if count <= EVEN_BUCKET << (64 * m // (radius + m)) or m == 6)


def _band_masks(radius: int, matched: int = 2) -> list[int]:
    bands = radius + matched
    edge = [64 * i // bands for i in range(bands + 1)]
    mask = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(bands)]
    every = [sum(c) for c in combinations(mask, matched)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def _links_of_groups(radius: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            group = np.cumsum(np.r_[0, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
            u, v = local_links(group, np.ascontiguousarray(rows[:, -1]).view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            same = (rows[:, :-1] == rows[-1, :-1]).all(axis=1)
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut:
                yield from linked(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from linked(np.concatenate(held))

    return run


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(node, component) over the distinct fingerprints of column `fp` that link to another."""
    spark = prints.sparkSession
    small_batches(spark)
    distinct = prints.select("fp").filter("fp is not null").distinct()
    masks = _band_masks(radius, matched_bands(radius, distinct.count()))
    dealt = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("b"), "fp"
    ).select("b.t", "b.k", "fp")
    dealt = materialize(dealt, "bands")
    sizes = dealt.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = dealt.join(sizes, ["t", "k"])  # a fingerprint alone in its bucket has nothing to be compared with there
    parts = F.ceil(F.col("n") / F.lit(hot_bucket)).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small in bytes, long to compare
    grouped = dealt.repartition(tasks, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    links = materialize(grouped.mapInArrow(_links_of_groups(radius), "u long, v long"), "links")
    return connected_components(links)


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    prints = materialize(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "prints")
    return prints.join(_component_table(prints, radius).select("fp", "component_id"), "fp")


def _component_table(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least_id, component_id, rep_fp): one row per distinct fingerprint with its least
    doc_id; the representative is the least doc_id, then the least fingerprint."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    joined = least.join(fingerprint_components(prints, radius), F.col("fp") == F.col("node"), "left")
    joined = joined.select("fp", "least_id", F.coalesce("component", "fp").alias("c"))
    best = joined.groupBy("c").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")).alias("r"))
    best = best.select("c", F.col("r.least_id").alias("component_id"), F.col("r.fp").alias("rep_fp"))
    return joined.join(best, "c").select("fp", "least_id", "component_id", "rep_fp")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The rows of docs that stay, one of each component, with the columns of docs.

    The row with the least doc_id stays; of several such rows, one. With a similarity, a linked
    row goes only if its shingles are that similar to those of a row that stays, and links are
    completed to all rows of that similarity (similar.keep_unlike).
    """
    if similarity is not None:
        prints = fingerprint_column(F.col("text"), shingle)
        return similar.keep_unlike(docs, shingle, similarity, prints, lambda fps: fingerprint_components(fps, radius))
    small_batches(docs.sparkSession)
    fp = "__wl_fp"
    marked = docs.withColumn(fp, fingerprint_column(F.col("text"), shingle))
    prints = materialize(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "prints")
    table = materialize(_component_table(prints, radius), "groups")
    chosen = table.filter("fp = rep_fp").select(F.col("fp").alias(fp), F.col("component_id").alias("__wl_id"))
    kept = marked.join(chosen, fp).filter(F.col("doc_id").eqNullSafe(F.col("__wl_id")))
    return kept.dropDuplicates([fp]).select(*docs.columns)
