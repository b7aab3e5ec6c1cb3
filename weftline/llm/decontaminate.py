"""Benchmark decontamination by CGK embedding, bit sampling and edit verification.

An item of m words is found in a document if some passage is within k = (1 - SIMILARITY) m
word edits of it (a word put in, left out or replaced, typing errors included). Words are
runs of ASCII letters and digits and of all characters beyond ASCII, in lower case, told
apart by a 64-bit hash. The unit is the word because the embedding below stretches k
edits to k * k differences at worst: a fifth of all characters is out of its reach,
a fifth of all words is not.

Windows. Of each item the words that are rarest among the items are chosen from its first
half, ANCHORS of them or a sixth of its length; a window starts at each place where such a word stands, and is as long as
what the item still has from there, rounded down to a class of sizes (each 1 / SIMILARITY
times the one before). So places in documents where nothing can start cost one lookup.

Embedding. WALKS random walks read a window: each step writes the word it stands on, and
a random bit of that word and step says whether it goes on. Walks over similar texts
fall back into step after an edit, so edit distance becomes Hamming distance.

Bit sampling. Of each walk SAMPLINGS keys are made of the anchor and SAMPLED steps each; an
item and a window with a key in common are a candidate. An unchanged passage has all keys
in common and is always found. Of passages with a fifth of their words changed the
anchors, walks and samplings together find TARGET or more, those with fewer edits more
surely (tests/llm/test_decontaminate.py measures it by size and edits).

Verification. The least word edits of the item to any part of the passage around a
candidate, by a bit-parallel table over the whole item. Nothing is reported without it.
Items of so few words that k is 0 are compared word for word instead of the embedding,
so none is left out; items without a word never match.

Documents are streamed and never shuffled, so neither copies nor passages that many
documents share make a hot task. Items are a stated query set: they are dealt into
blocks of BLOCK_BYTES text at most, each of which is indexed and sent to the tasks,
so what is broadcast is bounded and more items make more passes.

Null texts and empty texts hold nothing; texts of any length are read whole, in pieces;
equal items are each reported; documents that repeat are each reported; null ids are
carried; an empty table on either side gives an empty result; other columns are ignored,
or carried along by without_items.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.arrowtext import flat, mixed, pieces, words
from weftline.runtime import small_batches

SIMILARITY, TARGET = 0.8, 0.95
ANCHORS, WALKS, SAMPLINGS, SAMPLED = 4, 6, 6, 3
SEED = 17
BLOCK_BYTES = 8 << 20
MAP_BITS = 20
RUN = 1 << 13

IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def most_edits(n: int) -> int:
    """Edits that a passage may have from an item of n words."""
    return int((1 - SIMILARITY) * n + 1e-9)


def best_distance(item: Sequence[int], passage: Sequence[int]) -> tuple[int, int]:
    """(least edits between item and a part of passage, where that part ends)."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(passage):
        x = eq.get(c, 0) | minus
        d = ((plus + (x & plus)) ^ plus | x) & full
        down, up = plus & d, (minus | ~(plus | d)) & full
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up = up << 1 & full
        minus = up & d
        plus = (down << 1 | ~(up | d)) & full
    return best, end


def size_class(n: int) -> int:
    """The largest size of 2, 3, 4 and on by 1 / SIMILARITY that is at most n."""
    size = 2
    while (more := max(size + 1, int(size / SIMILARITY))) <= n:
        size = more
    return size


@cache
def sampled_steps(size: int) -> np.ndarray:
    """(WALKS, SAMPLINGS, SAMPLED) steps for windows of that size, ascending. Walks reach the
    end of a window at about twice its size. Of each three samplings one draws from all of the
    window, one from its first half and one from its first quarter, where fewer edits lie."""
    rng = np.random.default_rng([SEED, size])
    last = [max(6, 1 + int(1.6 * size / 2 ** (s % 3))) for s in range(SAMPLINGS)]
    return np.sort(np.array([[rng.choice(np.arange(1, n), SAMPLED, replace=False) for n in last] for _ in range(WALKS)]), axis=2)


def walked(h: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Words that the walks from each start stand on, step by step, as (WALKS, starts); 0 from its end on. h ends with a 0."""
    rng = np.random.default_rng(SEED)
    place = np.tile(start, (WALKS, 1))
    for _ in range(steps):
        turn = rng.integers(0, 1 << 63, (WALKS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        symbol = np.where(place < end, h[np.minimum(place, len(h) - 1)], np.uint64(0))
        yield symbol
        place += (symbol * turn >> np.uint64(63)).astype(np.int64)


def window_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray, rows: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, keys as (WALKS * SAMPLINGS, rows)) of the windows of each size, which start at those rows of start; 0 is no key."""
    wanted: dict[int, list[tuple[int, int, int, bool]]] = {}
    for c in rows:
        steps = sampled_steps(c)
        for w, s, i in np.ndindex(steps.shape):
            wanted.setdefault(int(steps[w, s, i]), []).append((c, w, w * SAMPLINGS + s, i == SAMPLED - 1))
    keys = {c: np.tile(h[start[own]] + np.uint64(c), (WALKS * SAMPLINGS, 1)) + np.arange(WALKS * SAMPLINGS, dtype=np.uint64)[:, None] for c, own in rows.items()}
    inside = {c: np.zeros(k.shape, dtype=bool) for c, k in keys.items()}
    for t, symbol in enumerate(walked(h, start, end, 1 + max(wanted, default=-1))):
        for c, w, k, last in wanted.get(t, ()):
            read, key = symbol[w, rows[c]], keys[c][k]
            key *= _STEP
            key += read
            if last:  # a walk that has come to the end stays there
                inside[c][k] = read != 0
    for c, k in keys.items():
        yield c, np.where(inside[c], mixed(k), np.uint64(0))


class ItemIndex:
    """Anchors and keys of a block of items(id, lower-case text)."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        at, raw = flat(pa.array([t for _, t in items], pa.string()))
        _, _, h, bound = words(at, raw, IS_WORD)
        self.words = [h[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])]
        self.sets = [frozenset(w) for w in self.words]
        self.edits = [most_edits(len(w)) for w in self.words]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(w) for w, k in zip(self.words, self.edits) if w and not k}:
            mine = np.array([i for i, w in enumerate(self.words) if len(w) == size])
            own = np.array([_gram(np.array(self.words[i], dtype=np.uint64), size)[0] for i in mine])
            by = np.argsort(own, kind="stable")
            self.grams[size] = own[by], mine[by]
        known, often = np.unique(h, return_counts=True)
        starts: dict[int, list[tuple[int, int]]] = {}
        for i, (w, k) in enumerate(zip(self.words, self.edits)):
            if k:
                first = list(dict.fromkeys(w[: -(-len(w) // 2)]))
                rare = sorted(first, key=lambda x: (often[np.searchsorted(known, np.uint64(x))], x))[: max(ANCHORS, len(w) // 6)]
                for x in rare:
                    for place in [p for p, y in enumerate(w[: -(-len(w) // 2)]) if y == x]:
                        starts.setdefault(size_class(len(w) - place), []).append((i, place))
        self.keys: dict[int, tuple[np.ndarray, ...]] = {}
        tagged = np.append(h, np.uint64(0))
        for c, mine in starts.items():
            begin = np.array([bound[i] + p for i, p in mine])
            finish = np.array([bound[i + 1] for i, _ in mine])
            ((_, keys),) = window_keys(tagged, begin, finish, {c: np.arange(len(mine))})
            _, row = np.nonzero(keys)
            flat_keys = keys[keys != 0]
            by = np.argsort(flat_keys, kind="stable")
            pair = np.array(mine)[row[by]]
            may = np.zeros(1 << MAP_BITS, dtype=bool)
            may[flat_keys >> np.uint64(64 - MAP_BITS)] = True
            self.keys[c] = flat_keys[by], pair[:, 0].astype(np.int32), pair[:, 1].astype(np.int32), may
        anchors = {c: np.unique(h[[bound[i] + p for i, p in mine]]) for c, mine in starts.items()}
        self.anchor_map = np.zeros(1 << MAP_BITS, dtype=bool)
        self.anchors = np.unique(np.concatenate([*anchors.values(), np.zeros(0, np.uint64)]))
        self.anchor_map[self.anchors >> np.uint64(64 - MAP_BITS)] = True
        self.of_size = {c: np.isin(self.anchors, own) for c, own in anchors.items()}

    def _candidates(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, where its first word would stand) for windows of words h with a key in common; ends gives the end of each word's row."""
        near = np.flatnonzero(self.anchor_map[h >> np.uint64(64 - MAP_BITS)])
        which = np.minimum(np.searchsorted(self.anchors, h[near]), max(0, len(self.anchors) - 1))
        true = self.anchors[which] == h[near] if len(self.anchors) else np.zeros(0, bool)
        near, which = near[true], which[true]
        tagged = np.append(h, np.uint64(0))
        for a in range(0, len(near), RUN):
            start, own = near[a : a + RUN], which[a : a + RUN]
            rows = {c: np.flatnonzero(of[own]) for c, of in self.of_size.items()}
            for c, keys in window_keys(tagged, start, ends[start], {c: r for c, r in rows.items() if len(r)}):
                known, item, place, may = self.keys[c]
                _, row = some = np.nonzero(may[keys >> np.uint64(64 - MAP_BITS)])
                asked = keys[some]
                low = np.searchsorted(known, asked, "left")
                each = np.searchsorted(known, asked, "right") - low
                each[asked == 0] = 0
                hit = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
                pairs = np.stack([item[hit], np.repeat(start[rows[c][row]], each) - place[hit]], axis=1)
                yield from map(tuple, np.unique(pairs, axis=0).tolist())

    def hits(self, at: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, word where the passage starts, near enough) for each item found in each row of a piece of lower-case text."""
        _, _, h, bound = words(at, raw, IS_WORD)
        ends = np.repeat(bound[1:], np.diff(bound))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for size, (known, mine) in self.grams.items():
            own = _gram(h, size)
            place = np.flatnonzero(np.isin(own, known))
            for p in place[place + size <= ends[place]].tolist():
                r = int(np.searchsorted(bound, p, "right")) - 1
                for i in mine[np.searchsorted(known, own[p], "left") : np.searchsorted(known, own[p], "right")].tolist():
                    if h[p : p + size].tolist() == self.words[i]:
                        best.setdefault((r, i), (0, p - int(bound[r])))
        seen: set[tuple[int, int]] = set()
        for i, start in self._candidates(h, ends) if len(self.anchors) else ():
            if (i, start) in seen:
                continue
            seen.add((i, start))
            own, k = self.words[i], self.edits[i]
            r = int(np.searchsorted(bound, max(0, start + len(own) // 2), "right")) - 1
            r = min(r, len(bound) - 2)
            a, b = max(int(bound[r]), start - k), min(int(bound[r + 1]), start + len(own) + 2 * k)
            if best.get((r, i), (1, 0))[0] == 0:
                continue
            passage = h[a:b].tolist()
            if len(self.sets[i].difference(passage)) > k:  # each missing word takes an edit
                continue
            edits, end = best_distance(own, passage)
            if edits <= k and edits < best.get((r, i), (k + 1, 0))[0]:
                best[r, i] = edits, max(0, a + end - len(own) - int(bound[r]))
        return [(r, i, e, p) for (r, i), (e, p) in sorted(best.items())]


def _gram(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words from each place, size of them; fewer at the end."""
    out = np.zeros(len(h), dtype=np.uint64)
    for i in range(size):
        out = out * _STEP + np.append(h[i:], np.zeros(min(i, len(h)), np.uint64))
    return mixed(out)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """Indexes over blocks of items(item_id, text) of about block_bytes each."""
    items = items.select("item_id", F.lower("text").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        index = ItemIndex(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if index.keys or index.grams:
            yield index


_RESULT = "array<struct<item_id: long, edits: long, similarity: double, word: long>>"


def _found_column(text: Column, index: ItemIndex) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64()), ("word", pa.int64())]))

    @arrow_udf(_RESULT)
    def of(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for first, _, at, raw in pieces(column):
            for r, i, edits, word in index.hits(at, raw):
                out[first + r].append({"item_id": index.ids[i], "edits": edits, "similarity": 1 - edits / len(index.words[i]), "word": word})
        return pa.array(out, kind)

    return of(F.lower(text))


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, similarity, word) for each document and item found in it; word is where, near enough, the passage starts."""
    small_batches(docs.sparkSession)
    parts = [docs.select("doc_id", F.explode(_found_column(F.col("text"), index)).alias("x")).select("doc_id", "x.*") for index in item_blocks(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, similarity double, word long")
    return reduce(DataFrame.unionByName, parts)


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs."""
    small_batches(docs.sparkSession)
    for index in item_blocks(items):
        docs = docs.filter(F.size(_found_column(F.col("text"), index)) == 0)
    return docs
