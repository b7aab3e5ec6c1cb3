"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear SVM.

Kernel. Two words are compared by the ordered letter triples they share, adjacent or
with gaps: a triple that spans s letters weighs DECAY ** s, up to SPAN letters. Letters
put between those of a word or left out change only some triples. Letters are code
points: the forms of a to z count as these (wide, mathematical), letters with accents and of
other scripts fall into OTHERS classes by their number, and what is no letter (marks,
digits, white space without width) is passed over, so "i-d-i-o-t" and "i·d·i·o·t" are read as
"idiot". Runs of three or more words of one
letter are read as one word as well. The kernel is scaled by each word's own weight
and sharpened by a power, which leaves it a kernel.

Landmarks are words of the training texts: those that mark toxic ones best and do not
resemble each other too much, and a few ordinary ones. The Nystrom map of a word is its
kernel values with the landmarks times the inverse root of the landmarks' own kernel
matrix; a linear SVM separates words in these coordinates. Only texts are labelled, so a
toxic text is trained on through its worst word, chosen anew in every round, and
a clean text through its worst word likewise (every text has an empty word besides). A
text's score is a logistic function of its worst word's margin, fitted on the training texts.

Training reads a bounded sample: about PER_CLASS texts of each label, drawn and ordered by hash, of a longer
text a stretch of LONGEST characters from a place that its hash gives. Scoring reads every text whole, however long.

Null and empty texts score as a text without words. Null labels and null ids are not
learned from; of several labels of an id the largest counts. Repeated rows get equal
scores; ties of the draw go by id and text. Without both labels every text gets the share of toxic labels (0 with no
labels). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrowtext import pieces, words
from weftline.runtime import small_batches

SPAN, DECAY, POWER = 5, 0.75, 3
LANDMARKS, PLAIN = 40, 8
LEAST_LIFT, LEAST_SIGMAS, ALIKE = 1.0, 2.5, 0.9
PER_CLASS, LONGEST = 1200, 20_000
ROUNDS, STEPS, COST = 4, 1500, 200.0
THRESHOLD = 0.3
PIECE = 2 << 20
TRAIN_TEXTS = 200

OTHERS = 14
LETTERS = 26 + OTHERS

_SPACE = b" \t\n\x0b\x0c\r"
_IN_WORD = np.array([b not in _SPACE for b in range(256)])
_UNHEARD = -1


@cache
def letter_table() -> np.ndarray:
    """The letter of each code point up to 0x20000, or _UNHEARD."""
    out = np.full(0x20000, _UNHEARD, dtype=np.int8)
    for c in range(len(out)):
        x = unicodedata.normalize("NFKD", chr(c)).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(x) == 1 and "a" <= x <= "z":
            out[c] = ord(x) - 97
        elif x and unicodedata.category(x[0])[0] == "L":
            out[c] = 26 + (ord(chr(c).lower()[0]) * 0x9E3779B1 >> 16) % OTHERS
    return out


def heard(raw: np.ndarray) -> np.ndarray:
    """The letter of the code point that starts at each byte of UTF-8 text; _UNHEARD at all other bytes."""
    table = letter_table()
    out = table[:128][np.minimum(raw, 127)]
    out[raw > 127] = _UNHEARD
    for low, high, size, bits in ((0xC0, 0xE0, 2, 31), (0xE0, 0xF0, 3, 15), (0xF0, 0xF8, 4, 7)):
        at = np.flatnonzero((raw >= low) & (raw < high))
        at = at[at + size <= len(raw)]
        point = (raw[at] & bits).astype(np.int64)
        for k in range(1, size):
            point = point << 6 | raw[at + k] & 63
        out[at] = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], np.int8(26))
    return out


_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def _triples(letters: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first places, triple numbers, weight) for each way to leave gaps; stop: end of the word at each place."""
    n = len(letters)
    for i, j in _GAPS:
        m = max(0, n - j)
        at = np.arange(m)
        good = at + j < stop[:m]
        at = at[good]
        yield at, (letters[at] * LETTERS + letters[at + i]) * LETTERS + letters[at + j], DECAY ** (j + 1)


def _heard(word: bytes) -> np.ndarray:
    own = heard(np.frombuffer(word, np.uint8))
    return own[own != _UNHEARD].astype(np.int64)


def features(word: bytes) -> dict[int, float]:
    letters = _heard(word)
    found: dict[int, float] = {}
    for _, numbers, weight in _triples(letters, np.full(len(letters), len(letters))):
        for x in numbers.tolist():
            found[x] = found.get(x, 0.0) + weight
    return found


def own_weight(word: bytes) -> float:
    letters = _heard(word)
    return sum(len(at) * w * w for at, _, w in _triples(letters, np.full(len(letters), len(letters)))) ** 0.5


def _likeness(a: bytes, b: bytes) -> float:
    x, y = features(a), features(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (own_weight(a) * own_weight(b))


class Landmarks:
    def __init__(self, chosen: list[bytes]) -> None:
        self.words = chosen
        entries = sorted((x, k, v / own_weight(word)) for k, word in enumerate(chosen) for x, v in features(word).items())
        triples = np.array([e[0] for e in entries], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(np.bincount(triples, minlength=LETTERS**3))].astype(np.int32)
        self.marks, self.values = np.array([e[1] for e in entries], dtype=np.int64), np.array([e[2] for e in entries])
        self.known = self.first[1:] > self.first[:-1]
        square = np.array([self.of_words(w, np.array([0]), np.array([len(w)]))[1][0] for w in chosen], dtype=float)
        values, vectors = np.linalg.eigh((square + square.T) / 2 + 1e-3 * np.eye(len(chosen)))
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def of_words(self, raw: bytes | np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words with a triple of some landmark, their kernel values by landmark); words are byte ranges in order that do not overlap."""
        raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        size = end - start
        owner = np.repeat(np.arange(len(size)), size)
        offset = np.cumsum(size) - size
        letters = heard(raw[np.arange(len(owner)) + np.repeat(start - offset, size)])
        there = letters != _UNHEARD
        letters, owner = letters[there].astype(np.int64), owner[there]
        stop = np.cumsum(np.bincount(owner, minlength=len(size)))[owner]
        weight, shared, hits = np.zeros(len(size)), np.zeros(len(size)), []
        for at, numbers, w in _triples(letters, stop):
            some = self.known[numbers]  # few triples are any landmark's
            word = owner[at[some]]
            weight += np.bincount(owner[at], minlength=len(size)) * (w * w)
            shared += np.bincount(word, minlength=len(size)) * (w * w)
            hits.append((word, numbers[some], w))
        live = np.flatnonzero(shared > 0)
        place = np.zeros(len(size), np.int64)
        place[live] = np.arange(len(live))
        width = len(self.words)
        sums = np.zeros(len(live) * width)
        for word, numbers, w in hits:  # a triple is in few landmarks, so they are added one by one
            low = self.first[numbers]
            each = self.first[numbers + 1] - low
            entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
            sums += np.bincount(np.repeat(place[word], each) * width + self.marks[entry], self.values[entry] * w, len(sums))
        kernel = sums.reshape(-1, width) / np.sqrt(weight[live])[:, None]
        return live, np.minimum(kernel, 1).astype(np.float32) ** POWER


def _spelled(start: np.ndarray, end: np.ndarray, bound: np.ndarray, raw: np.ndarray) -> list[tuple[int, bytes]]:
    """(first word's number, letters) of runs of three or more words of a single letter."""
    if not len(start):
        return []
    lead = raw[start]
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
    single = end - start == size
    some = np.flatnonzero(single)
    first = np.cumsum(size[some]) - size[some]
    own = raw[np.repeat(start[some] - first, size[some]) + np.arange(size[some].sum())]
    single[some] = heard(own)[first] != _UNHEARD
    edges = np.flatnonzero(np.diff(np.r_[False, single, False]))
    found = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= 3:
            cuts = [a, *bound[(bound > a) & (bound < b)].tolist(), b]
            found += [(x, b"".join(raw[s:e].tobytes() for s, e in zip(start[x:y].tolist(), end[x:y].tolist()))) for x, y in zip(cuts, cuts[1:]) if y - x >= 3]
    return found


def word_values(at: np.ndarray, raw: np.ndarray, marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, values by number): which different words each row holds, of those with a triple of some
    landmark, and their kernel values; number 0 is the empty word, which every row holds."""
    n, width = len(at) - 1, len(marks.words)
    rows, numbers, parts = [np.arange(n)], [np.zeros(n, np.int64)], [np.zeros((1, width), np.float32)]
    start, end, hashes, bound = words(at, raw, _IN_WORD)
    if len(start):
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        live, values = marks.of_words(raw, start[first[order]], end[first[order]])
        place = np.full(len(first), -1)
        place[order[live]] = 1 + np.arange(len(live))
        own = place[number]
        token = np.flatnonzero(own >= 0)
        rows.append(np.searchsorted(bound, token, "right") - 1)
        numbers.append(own[token])
        parts.append(values)
        total = 1 + len(live)
        for k, letters in _spelled(start, end, bound, raw):
            live, value = marks.of_words(letters, np.array([0]), np.array([len(letters)]))
            if len(live):
                rows.append(np.searchsorted(bound, [k], "right") - 1)
                numbers.append(np.array([total]))
                parts.append(value)
                total += 1
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(parts)


def _worst(row: np.ndarray, margin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest margin, its word) of each row."""
    order = np.lexsort((-margin, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
    return margin[first], first


def svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, cost: float = COST) -> np.ndarray:
    """Linear SVM (smoothed hinge, both classes of equal weight) by accelerated gradient steps; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    pace = 1 / (1 + 2 * cost * (share[:, None] * x * x).sum())
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.clip(1 - sign * (x @ v), 0, 1)  # beyond 1 the loss is linear, so mislabelled texts pull no harder
        slope = np.append(v[:-1], 0) - 2 * cost * x.T @ (share * sign * slack)
        w2 = v - pace * slope
        v, w = w2 + t / (t + 3) * (w2 - w), w2
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic) over margins, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class ToxicityModel:
    def __init__(self, prior: float, marks: Landmarks | None = None, weights: np.ndarray | None = None, link: tuple[float, float] = (0, 0)) -> None:
        self.prior, self.marks, self.weights, self.link = prior, marks, weights, link

    def scores(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        if self.marks is None:
            return np.full(len(at) - 1, self.prior)
        row, number, values = word_values(at, raw, self.marks)
        margin = np.full(len(at) - 1, -np.inf)
        np.maximum.at(margin, row, (values @ (self.marks.root @ self.weights[:-1]) + self.weights[-1])[number])
        return 1 / (1 + np.exp(-np.clip(self.link[0] * margin + self.link[1], -30, 30)))


def _choose_landmarks(texts: list[bytes], y: np.ndarray) -> list[bytes]:
    bags = [set(t.split()) for t in texts]
    inside, outside = Counter(), Counter()
    for bag, label in zip(bags, y):
        (inside if label else outside).update(bag)
    pos, neg = max((y > 0).sum(), 1), max((y <= 0).sum(), 1)
    lift = {w: np.log(((n + 0.5) / pos) / ((outside[w] + 0.5) / neg)) for w, n in inside.items() if n > 1 and own_weight(w) > 0}
    worth = {w: inside[w] * x for w, x in lift.items() if x > LEAST_LIFT}
    sure = {w: v for w, v in worth.items() if lift[w] > LEAST_SIGMAS * (1 / (inside[w] + 0.5) + 1 / (outside[w] + 0.5)) ** 0.5}
    worth = sure or worth  # with few labels nothing is sure
    marking: list[bytes] = []
    for w in sorted(worth, key=lambda w: (-worth[w], w))[: 20 * LANDMARKS]:
        if len(marking) < LANDMARKS and all(_likeness(w, x) < ALIKE for x in marking):
            marking.append(w)
    plain = [w for w in sorted(outside, key=lambda w: (-outside[w], w))[: 20 * PLAIN] if w not in set(marking) and own_weight(w) > 0][:PLAIN]
    return marking + plain if marking else []


def train(texts: list[bytes], y: np.ndarray, share: float | None = None) -> ToxicityModel:
    """A model from labelled texts, lower-cased; share: of toxic texts where it will be used, if the sample has another."""
    prior = float((y > 0).mean()) if len(y) else 0.0
    if not 0 < prior < 1 or not (chosen := _choose_landmarks(texts, y)):
        return ToxicityModel(prior)
    marks = Landmarks(chosen)
    rows, numbers, parts, held = [], [], [], 0
    for a in range(0, len(texts), TRAIN_TEXTS):
        some = texts[a : a + TRAIN_TEXTS]
        own, number, part = word_values(np.r_[0, np.cumsum([len(t) for t in some])], np.frombuffer(b"".join(some), np.uint8), marks)
        rows.append(own + a)
        numbers.append(number + held)
        parts.append(part)
        held += len(part)
    row, number, values = np.concatenate(rows), np.concatenate(numbers), np.concatenate(parts)
    mapped = values @ marks.root
    margin = values[:, : max(1, len(chosen) - PLAIN)].max(axis=1)[number]
    for _ in range(ROUNDS):
        _, worst = _worst(row, margin, len(texts))
        weights = svm(mapped[number[worst]], y)
        margin = (mapped @ weights[:-1] + weights[-1])[number]
    best, _ = _worst(row, margin, len(texts))
    slope, offset = logistic(best, y)
    if share and 0 < share < 1:
        offset += np.log(share / (1 - share)) - np.log(prior / (1 - prior))
    return ToxicityModel(prior, marks, weights, (slope, offset))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}  # two rows
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(PER_CLASS / max(counts.get(1, 1), 1))).otherwise(F.lit(PER_CLASS / max(counts.get(0, 1), 1)))
    drawn = labels.filter(h < share * (1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * PER_CLASS)
    few = F.broadcast(drawn)  # 3 * PER_CLASS ids at most
    n, own = F.length("text"), F.xxhash64("doc_id", "text")
    start = F.pmod(own, F.greatest(n - LONGEST + 1, F.lit(1))).cast("int") + 1  # a longer text is learned from by a stretch of it
    stretch = F.when(n > LONGEST, F.col("text").substr(start, F.lit(LONGEST))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "text").filter("text is not null").join(few, "doc_id").select(own.alias("h"), "doc_id", F.lower(stretch).alias("text"), "toxic")
    rows = sorted(rows.orderBy("h", "doc_id", "text").limit(6 * PER_CLASS).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], dtype=int), counts.get(1, 0) / max(sum(counts.values()), 1))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first, end, at, raw in pieces(batch.column(1), PIECE):
                found[first:end] = model.scores(at, raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found)], schema=out)

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, score double")
