"""Language identification by a byte convolutional network trained in numpy.

Text is read as UTF-8 bytes in windows of WINDOW bytes that cover all of it. Filters of
several widths slide over a window, each is rectified and its largest value kept (max
pooling), and a softmax layer over these features gives the window's languages. A
text's probabilities are the mean over its windows.

Training windows come from at most about PER_LANG texts of each language (a bounded
sample, drawn by hash; equal texts of a language are drawn once), TAKEN characters from
a place of each that the hash gives too.

Null text and text without a letter give `und` with score 0. Null labels are not
learned; a null id is never held out of training nor trained on. Repeated rows get
equal results; with equal probabilities the first language in code point order is
given. Texts of any length are read whole, in pieces. With no labelled text at all
everything is `und`; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrowtext import pieces
from weftline.runtime import small_batches

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
PER_LANG, TAKEN = 400, 768
STEPS, BATCH, RATE, SEED = 500, 64, 0.15, 11
UNKNOWN = "und"
CHUNK = 512


def held_out(doc_id: Column, of: int = 4, is_: int = 2) -> Column:
    """crc32 of the id as text, modulo `of`, is `is_`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == is_, F.lit(False))


def windows_of(at: np.ndarray, raw: np.ndarray, size: int = WINDOW, lap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end of row) of the windows that cover each row; an empty row has one."""
    hop = size - lap
    count = np.maximum(1, -(-np.maximum(np.diff(at) - lap, 0) // hop))
    row = np.repeat(np.arange(len(count)), count)
    start = at[row] + hop * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return row, start, at[row + 1]


def cut(raw: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """One row of bytes per window, 0 beyond the end."""
    place = start[:, None] + np.arange(size)
    padded = np.append(raw, np.uint8(0))
    return np.where(place < end[:, None], padded[np.minimum(place, len(raw))], np.uint8(0))


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.pairs: list[np.ndarray] | None = None

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for taps, bias in zip(self.taps, self.bias):
            w = len(taps)
            z = sum(taps[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
            place = z.argmax(axis=1)
            values.append(np.take_along_axis(z, place[:, None], 1)[:, 0] + bias)
            places.append(place)
        return np.maximum(np.concatenate(values, axis=1), 0), places

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> "ByteNetwork":
        """Adagrad on the mean cross-entropy; languages are drawn evenly."""
        rng = np.random.default_rng(SEED)
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        state = [np.full_like(p, 1e-3) for p in (*self.taps, *self.bias, self.out, self.out_bias)]
        for _ in range(steps):
            pick = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(by_lang), BATCH)])
            bx, by = x[pick], y[pick]
            h, places = self._features(bx)
            p = _softmax(h @ self.out + self.out_bias)
            p[np.arange(BATCH), by] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (h > 0)
            slopes: list[np.ndarray] = []
            for n, (taps, place) in enumerate(zip(self.taps, places)):
                g, own = np.zeros_like(taps), back[:, n * FILTERS : (n + 1) * FILTERS]
                for k in range(len(taps)):
                    np.add.at(g[k], (np.take_along_axis(bx, place + k, 1), np.arange(FILTERS)), own)
                slopes.append(g)
            slopes += [back[:, n * FILTERS : (n + 1) * FILTERS].sum(axis=0) for n in range(len(WIDTHS))]
            slopes += [h.T @ p, p.sum(axis=0)]
            for value, slope, s in zip((*self.taps, *self.bias, self.out, self.out_bias), slopes, state):
                s += slope * slope
                value -= RATE * slope / np.sqrt(s)
        return self

    def _pair_tables(self) -> list[np.ndarray]:
        if self.pairs is None:
            self.pairs = [(t[k][:, None] + t[k + 1][None, :]).reshape(65536, FILTERS) for t in self.taps for k in range(0, len(t) - 1, 2)]
        return self.pairs

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window; taps are read two bytes at a time."""
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        tables, values, at = self._pair_tables(), [], 0
        for taps, bias in zip(self.taps, self.bias):
            w = len(taps)
            n = x.shape[1] - w + 1
            z = np.take(tables[at], pair[:, :n], axis=0)
            at += 1
            if w == 3:
                z += np.take(taps[2], x[:, 2 : 2 + n], axis=0)
            elif w == 4:
                z += np.take(tables[at], pair[:, 2 : 2 + n], axis=0)
                at += 1
            values.append(z.max(axis=1) + bias)
        return _softmax(np.maximum(np.concatenate(values, axis=1), 0) @ self.out + self.out_bias)

    def probabilities(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Mean over the windows of each row."""
        row, start, end = windows_of(at, raw)
        total = np.zeros((len(at) - 1, len(self.languages)))
        for a in range(0, len(row), CHUNK):
            part = slice(a, a + CHUNK)
            np.add.at(total, row[part], self.log_odds(cut(raw, start[part], end[part])))
        return total / np.bincount(row, minlength=len(total))[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame) -> ByteNetwork | None:
    """A network from labelled(text, lang); None without labelled text."""
    rows = labelled.select("text", "lang").filter("lang is not null and text is not null and text <> ''")
    h = F.xxhash64("text")
    counts = {r[0]: r[1] for r in rows.select("lang", h.alias("h")).distinct().groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, PER_LANG / n))]), F.col("lang"))
    drawn = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - TAKEN, F.lit(1))).cast("int") + 1
    sample = sorted(drawn.select(F.lower(F.substring("text", place, F.lit(TAKEN))), "lang", "h").dropDuplicates(["h", "lang"]).collect(), key=lambda r: (r[2], r[1], r[0]))
    languages = sorted({r[1] for r in sample})
    if not languages:
        return None
    bodies = [r[0].encode() for r in sample]
    at = np.r_[0, np.cumsum([len(b) for b in bodies])]
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    row, start, end = windows_of(at, raw)
    place_of = {k: i for i, k in enumerate(languages)}
    y = np.array([place_of[r[1]] for r in sample])[row]
    return ByteNetwork(languages).train(cut(raw, start, end), y)


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            for first, end, at, raw in pieces(batch.column(1)) if network else ():
                p = network.probabilities(at, raw)
                best = p.argmax(axis=1)
                names[first:end] = np.array(network.languages, dtype=object)[best]
                scores[first:end] = np.minimum(p[np.arange(len(best)), best], 1.0)
            names[~letters], scores[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores)], schema=out)

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")
