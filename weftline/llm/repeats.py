"""Removal of long byte strings that occur more than once, by suffix order.

A byte goes if some string of `length` bytes that covers it also starts anywhere else,
in the same text or another; overlapping occurrences count and all strings are judged
on the input. Matches never cross texts. Null text is empty. Equal rows are
occurrences of each other. Columns other than doc_id and text play no part.

1. Windows are grouped by a sampled anchor: of the `GRAM`-byte grams in a window, the
   one with the least hash (the leftmost of equal ones). The choice depends on the
   window's bytes only, so equal windows have equal anchors at equal places. The
   consecutive windows of one anchor make a block, and each window is in one block.
2. Blocks with equal bytes are repeated as a whole; counting (anchor, block hash)
   with map-side sums settles them, however many copies there are.
3. Anchors with several different blocks keep one of each block; those of an anchor go to
   one task, or, if there are more than HOT_KINDS, each of their cells to a task of its own.
   Their windows are cut into cells by distance to the anchor, `CELL` windows wide. All windows of a cell
   contain its core, the bytes that they have in common, so a window can only be
   repeated where the core is; cells with equal cores are written as the few bytes
   left of the core, one symbol for the core and the few bytes right of it. These
   strings are put in suffix order (`suffixes.suffix_array`), where suffixes that
   share `CELL` symbols, that is `length` bytes, stand side by side.
4. Repeated windows return to their texts as byte ranges and are merged.

Equal blocks are not sorted among themselves: counting tells the same, and only windows
near an edge of a repetition reach the suffix order. Blocks are told apart by a 64-bit
hash beside their anchor's, cores by 128 bits or by 63 beside their anchor's, texts by
doc_id and a 64-bit hash.

Texts of any length are read whole: their hashes are taken in sections that overlap by
`length`. Texts shorter than `length` lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrowtext import packed, pieces, unpacked
from weftline.llm.suffixes import suffix_array
from weftline.runtime import materialize, small_batches

LENGTH = 400
GRAM = 32
PLACE_BITS = 20
CELL = 16
SORTED_SYMBOLS = 1 << 18
HOT_KINDS = 64  # anchors with more different blocks are dealt out by cell
PLACE_SIZE = 12  # bits of a block's reference: windows lowest, the anchor's place in the block next, the first window above

_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_SYMBOL = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    h, span = _SYMBOL[raw], 1
    for factor in _FACTORS:
        h = h[:-span] * np.uint64(factor) + h[span:]
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(29)
    return h


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def blocks(at: np.ndarray, raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, windows, anchor hash, anchor place), as arrays, for a piece of texts; places count from the piece's start."""
    starts, ends = at[:-1], at[1:]
    section = (1 << PLACE_BITS) - length
    for a in range(0, max(1, int(at[-1]) - length + 1), section):
        part = raw[a : a + section + length - 1]
        if len(part) < length:
            return
        h = gram_hashes(part)
        keys = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        place = (_least_in_windows(keys, length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        low, high = np.maximum(starts - a, 0), np.minimum(ends - length - a + 1, len(place))
        rows = np.flatnonzero(low < high)
        if not len(rows):
            continue
        count = high[rows] - low[rows]
        window = np.arange(count.sum()) + np.repeat(low[rows] - (np.cumsum(count) - count), count)
        row, anchor = np.repeat(rows, count), place[window]
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        yield row[cut], window[cut] + a, np.diff(np.r_[cut, len(window)]), h[anchor[cut]], anchor[cut] + a


def _block_rows(length: int):
    out = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "ref", "a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for first, _, at, raw in pieces(batch.column(2)):
                whole = raw.tobytes()
                for row, s, n, a, place in blocks(at, raw, length):
                    b = [digest(whole[x:y], z) for x, y, z in zip(s.tolist(), (s + n - 1 + length).tolist(), (place - s).tolist())]
                    arrays = [k1[first + row], k2[first + row], (s - at[row]) << 2 * PLACE_SIZE | (place - s) << PLACE_SIZE | n, a.view(np.int64), np.array(b, dtype=np.uint64).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], schema=out)

    return run, "k1 long, k2 long, ref long, a long, b long"


def cells(place: int, part: bytes, length: int, cell: int) -> Iterator[tuple[int, bytes, tuple[bytes, bytes], int, int]]:
    """(cell, core, bytes left and right of it, first and last window) of a block whose anchor stands at place."""
    last = len(part) - length
    for g in range((place - last) // cell, place // cell + 1):
        core, end = place - g * cell, place - (g * cell + cell - 1) + length
        low, high = max(0, core - cell + 1), min(last, core)
        yield g, part[core:end], (part[low:core], part[end : high + length]), low, high


_PARTS = "a long, c long, b long, place long, low long, left binary, right binary"


def _cut_blocks(length: int, cell: int = CELL):
    """(text, refs) to rows of _PARTS: a block as a whole (c 0, its bytes at the left), or, of a hot
    anchor, each of its cells (c tells cell and core, place is the last window)."""
    out = pa.schema([*((c, pa.int64()) for c in ("a", "c", "b", "place", "low")), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, digest = (1 << PLACE_SIZE) - 1, xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            for raw, refs in zip(unpacked(batch.column(0)), batch.column(1).to_pylist()):
                for r in refs:
                    s, n, place = r["ref"] >> 2 * PLACE_SIZE, r["ref"] & bits, r["ref"] >> PLACE_SIZE & bits
                    part = raw[s : s + n - 1 + length]
                    if not r["hot"]:
                        rows.append((r["a"], 0, r["b"], place, 0, part, b""))
                        continue
                    for g, core, sides, low, high in cells(place, part, length, cell):
                        rows.append((r["a"], (digest(core, g & bits) >> 1) | 1, r["b"], high, low, *sides))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(out), out)], schema=out)

    return run


class CellSorter:
    """Collects cells of blocks, group by group, and finds their repeated windows in suffix order."""

    def __init__(self, length: int = LENGTH, cell: int = CELL) -> None:
        self.length, self.cell = length, cell
        self.cells: dict[tuple, dict[tuple[bytes, bytes], list]] = {}
        self.symbols = 0

    def add(self, group: int, place: int, part: bytes, tag: object) -> None:
        """A block's bytes with the anchor at `place`; tag comes back with its repeated windows."""
        for g, core, sides, low, high in cells(place, part, self.length, self.cell):
            self.add_cell((group, g, xxhash.xxh3_128_digest(core)), sides, tag, low, high)

    def add_cell(self, key: tuple, sides: tuple[bytes, bytes], tag: object, low: int, high: int) -> None:
        self.cells.setdefault(key, {}).setdefault(sides, []).append((tag, low, high))
        self.symbols += len(sides[0]) + len(sides[1]) + 2

    def settle(self) -> list[tuple[object, int, int]]:
        """(tag, first, last) runs of repeated windows of all that was added, which is then forgotten."""
        found, strings, owners = [], [], []
        for n, by_sides in enumerate(self.cells.values()):
            for sides, tags in by_sides.items():
                if len(tags) > 1:
                    found += tags
                if len(by_sides) > 1:
                    owners.append((len(strings), sides, tags))
                    strings += [x + 1 for x in sides[0]]
                    strings.append(257 + n)
                    strings += [x + 1 for x in sides[1]]
                    strings.append(0)
        hit, width = bytearray(len(strings)), self.cell
        valid = bytearray(len(strings))
        for at, sides, _ in owners:
            count = len(sides[0]) + len(sides[1]) + 2 - width
            valid[at : at + count] = b"\1" * count
        last = -1
        for i in suffix_array(strings):
            if not valid[i]:
                last = -1
                continue
            if last >= 0 and strings[i : i + width] == strings[last : last + width]:
                hit[i] = hit[last] = 1
            last = i
        for at, sides, tags in owners:
            size = len(sides[0]) + len(sides[1]) + 2 - width
            i = hit.find(1, at, at + size)
            while i >= 0:
                j = hit.find(0, i, at + size)
                j = at + size if j < 0 else j
                found += [(tag, low + i - at, low + j - 1 - at) for tag, low, _ in tags]
                i = hit.find(1, j, at + size)
        self.cells, self.symbols = {}, 0
        return found


def _sorted_groups(length: int):
    """Rows of _PARTS in order of a, c and b, to (a, b, first, last) runs of repeated windows."""
    out = pa.schema([(c, pa.int64()) for c in ("a", "b", "x", "y")])

    def settled(sorter: CellSorter) -> Iterator[pa.RecordBatch]:
        if found := sorter.settle():
            rows = np.array([(*tag, x, y) for tag, x, y in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(rows.T)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, before = CellSorter(length), None
        for batch in batches:
            for a, c, b, place, low, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, c, b) == before:
                    continue
                if sorter.symbols >= SORTED_SYMBOLS and (a, c) != before[:2]:
                    yield from settled(sorter)
                if c:
                    sorter.add_cell((a, c), (left, right), (a, b), low, place)
                else:
                    sorter.add(a, place, left, (a, b))
                before = a, c, b
        yield from settled(sorter)

    return run


def repeated_ranges(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, ranges) of keyed(k1, k2, text): start and end of byte ranges to remove, unmerged."""
    spark = keyed.sparkSession
    small_batches(spark)
    found = materialize(keyed.select("k1", "k2", "text").mapInArrow(*_block_rows(length)), "blocks")
    distinct = found.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "ref")).alias("r"))
    anchors = distinct.groupBy("a").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1")
    distinct = materialize(distinct.join(anchors.drop("total"), "a").select("a", "b", "copies", "kinds", "r.*"), "distinct")
    hot = (F.col("kinds") > HOT_KINDS).alias("hot")
    wanted = distinct.filter("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "ref", hot)).alias("refs"))
    parts = keyed.select("k1", "k2", packed(F.col("text")).alias("text")).join(wanted, ["k1", "k2"]).select("text", "refs")
    parts = parts.mapInArrow(_cut_blocks(length), _PARTS)
    # equal rows bring equal bodies; they stand side by side and one is used
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "c").sortWithinPartitions("a", "c", "b")
    near = parts.mapInArrow(_sorted_groups(length), "a long, b long, x long, y long").groupBy("a", "b").agg(F.collect_list(F.struct("x", "y")).alias("runs"))
    near = near.join(distinct.filter("copies = 1").select("a", "b"), ["a", "b"])
    whole = distinct.filter("copies > 1").select("a", "b", F.lit(None).cast("array<struct<x: long, y: long>>").alias("runs"))
    marks = materialize(whole.unionByName(near), "marks")
    first, count = F.shiftright("ref", 2 * PLACE_SIZE), F.col("ref").bitwiseAND(F.lit((1 << PLACE_SIZE) - 1))
    every = F.array(F.struct(F.lit(0).cast("long").alias("x"), (count - 1).alias("y")))
    hits = found.join(marks, ["a", "b"]).select("k1", "k2", first.alias("s"), F.explode(F.coalesce("runs", every)).alias("w"))
    hits = hits.select("k1", "k2", F.struct((F.col("s") + F.col("w.x")).alias("x"), (F.col("s") + F.col("w.y") + length).alias("y")).alias("range"))
    return hits.groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted((r["x"], r["y"]) for r in ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    for batch in batches:
        sizes, spans, kept = [], [], []
        for raw, ranges in zip(unpacked(batch.column(1)), batch.column(2).to_pylist()):
            gone = merged(ranges or [])
            edges = [0, *(z for x in gone for z in x), len(raw)]
            sizes.append(len(raw))
            spans.append([{"start": x, "end": y} for x, y in gone])
            kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], schema=out)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs(doc_id, text): the merged byte
    spans removed, and the remaining bytes, which need not be valid UTF-8 at the seams."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("k1"), F.xxhash64("text").alias("k2"))
    ranges = repeated_ranges(keyed, length)
    joined = keyed.withColumn("text", packed(F.col("text"))).join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_removal, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
