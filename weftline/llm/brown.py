"""Class-based n-grams (Brown): exchange clustering, then a smoothed class bigram model.

P(text) = product over tokens of P(class | class before) * P(word | class), with a
text's words and one end mark as tokens and the end mark as what stands before the first.

Counts. Texts are tokenised once, in groups of about GROUP_BYTES: a group is one row of
the shared folder with its texts as word numbers and its word list, each word once
as a 64-bit hash. Counts are summed over the word lists, so every word of all training
texts is counted and none is cut off.

Classes. The CORE most frequent words (a bounded part of the vocabulary; their bigrams
fit on the driver) are clustered by exchange: each word in turn moves to the class that
gives the bigrams of the core the highest likelihood, until a pass moves few words.
All other words then make the same move once, in parallel: a word's counts with the
classes before and after it decide, and classes stay as they are while words choose. A
word that never stands beside a core word is dealt to a class by its hash. Class bigrams
are then counted over all tokens.

Smoothing. Transitions are interpolated with class frequencies by Witten-Bell weights. A
class gives each word (count + 1) / (tokens of the class + words of the class + 1); the one
extra place is for a word not seen in training, which is taken as of the class likeliest
after the one before it.

Movement. Word lists meet the word table by a join on the hash, then their group by a
cogroup; a frequent word has one row for each group, so its rows are as few as the groups,
and a skewed join splits them. Texts are shuffled once.

Null text is empty: its only token is the end mark. Texts of any length are read whole; one
above GROUP_BYTES is a group by itself. A null id is not held out. Repeated rows count as
often as they stand there. Equal counts are ordered by hash, equal worth by class, and all
sums are of whole numbers, so reruns agree. Without training text all words are unknown; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrowtext import release, texts
from weftline.runtime import materialize, small_batches

GROUP_BYTES = 12 << 20
CORE, CLASSES, PASSES = 500, 32, 6
UNSEEN = 255  # stands for the class of a word not seen in training
END = b"\n"  # no word holds white space


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # of bytes: ASCII letters and white space only


def hash_of(word: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64))


_GROUP = "grp long, doc_ids array<long>, held binary, sizes binary, ids binary, words binary, counts binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) to rows of one group each."""
    from pyspark import TaskContext

    out = pa.schema([("grp", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "sizes", "ids", "words", "counts"))])
    attempt = TaskContext.get().taskAttemptId()  # names groups apart; only what a task commits is read
    index: dict[bytes, int] = {}
    doc_ids: list = []
    held: list[bool] = []
    ids: list[np.ndarray] = []
    weight = made = 0

    def row() -> pa.RecordBatch:
        learn = [x for x, h in zip(ids, held) if not h]
        counts = np.bincount(np.concatenate(learn), minlength=len(index)) if learn else np.zeros(len(index))
        digest = xxhash.xxh64_intdigest
        words = np.fromiter((digest(w) for w in index), dtype=np.uint64, count=len(index))
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        numbers = zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.concatenate(ids).tobytes())
        body = [np.array(held).tobytes(), sizes.tobytes(), numbers, words.tobytes(), counts.astype(np.int32).tobytes()]
        name = int(np.random.default_rng([attempt, made]).integers(0, 1 << 62))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in body)], schema=out)

    for batch in batches:
        for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            number = index.setdefault
            ids.append(np.array([number(w, len(index)) for w in tokens(text)], dtype=np.int32))
            doc_ids.append(doc_id)
            held.append(h)
            weight += len(text) + 1
            if weight >= GROUP_BYTES:
                yield row()
                index, doc_ids, held, ids, weight, made = {}, [], [], [], 0, made + 1
                release()
    if ids:
        yield row()


class Group:
    """A group's row, with its texts end to end."""

    def __init__(self, row: dict) -> None:
        self.name, self.doc_ids = row["grp"], row["doc_ids"]
        self.held = np.frombuffer(row["held"], dtype=bool)
        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), dtype=np.int32)
        self.words = np.frombuffer(row.get("words", b""), dtype=np.int64)
        self.counts = np.frombuffer(row.get("counts", b""), dtype=np.int32)
        sizes = np.frombuffer(row["sizes"], dtype=np.int32)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        self.learned = np.repeat(~self.held, sizes)

    def before(self, label: np.ndarray) -> np.ndarray:
        """What stands before each token, a text's end mark before its first."""
        out = np.empty_like(label)
        out[1:] = label[:-1]
        out[self.starts] = label[self.ends - 1]
        return out

    def looked_up(self, keys: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
        """values by word number, for sorted word hashes as keys."""
        if not len(keys):
            return np.full(len(self.words), missing, dtype=np.int32)
        at = np.minimum(np.searchsorted(keys, self.words), len(keys) - 1)
        return np.where(keys[at] == self.words, values[at], missing).astype(np.int32)


def _over_groups(groups: DataFrame, make, schema: str) -> DataFrame:
    """Rows of make(group), given as a dict of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in make(Group(row)).items()})
                release()

    return groups.mapInArrow(run, schema)


def _word_counts(g: Group) -> dict:
    seen = g.counts > 0
    return {"word": g.words[seen], "n": g.counts[seen].astype(np.int64)}


def _word_places(g: Group) -> dict:
    return {"word": g.words, "grp": np.full(len(g.words), g.name), "num": np.arange(len(g.words), dtype=np.int32)}


def _pairs(first: np.ndarray, second: np.ndarray, size: int) -> dict:
    pair, n = np.unique(first * np.int32(size) + second, return_counts=True)
    return {"pair": pair.astype(np.int64), "n": n.astype(np.int64)}


# -- clustering -----------------------------------------------------------------------


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each core word, from its square table of bigram counts (last row and column: all that is no core word)."""
    size = len(bigrams) - 1
    k = min(classes, max(size, 1))
    own = np.arange(size) % k  # by frequency rank, so classes start alike
    side = k  # the class of all other words stays by itself
    label = np.append(own, side)
    table = np.zeros((k + 1, k + 1))
    np.add.at(table, (label[:, None], label[None, :]), bigrams)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(passes):
        moved = 0
        for w in range(size):
            before, after = np.zeros(k + 1), np.zeros(k + 1)
            np.add.at(after, label, bigrams[w])
            np.add.at(before, label, bigrams[:, w])
            loop = bigrams[w, w]
            c = label[w]
            after[c] -= loop
            before[c] -= loop
            if not (after.any() or before.any()):
                continue
            table[c] -= after
            table[:, c] -= before
            table[c, c] -= loop
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            out_w, in_w = after.sum() + loop, before.sum() + loop
            gain = (xlogx(table + after[None, :]) - xlogx(table)).sum(axis=1) + (xlogx(table.T + before[None, :]) - xlogx(table.T)).sum(axis=1)
            d = np.arange(k + 1)
            own_cell = table[d, d]
            gain += xlogx(own_cell + after + before + loop) - xlogx(own_cell + after) - xlogx(own_cell + before) + xlogx(own_cell)
            gain -= xlogx(rows + out_w) - xlogx(rows) + xlogx(cols + in_w) - xlogx(cols)
            best = int(gain[:k].argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            moved += best != c
            label[w] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += loop
        if moved <= size // 200:
            break
    return label[:size].astype(np.int64)


def _core_bigrams(core: np.ndarray):
    rank = np.arange(len(core))
    order = np.argsort(core)

    def make(g: Group) -> dict:
        label = g.looked_up(core[order], rank[order], CORE)[g.ids]
        return _pairs(g.before(label)[g.learned], label[g.learned], CORE + 1)

    return make


def _neighbours(core: np.ndarray, label: np.ndarray):
    """Of words that are no core words: how often each core class stands before (side 0) and after (side 1)."""
    order = np.argsort(core)

    def make(g: Group) -> dict:
        c = g.looked_up(core[order], label[order], -1)[g.ids]
        rare = (c < 0) & g.learned
        before = g.before(c)
        after = np.append(c[1:], np.int32(-1))
        after[g.ends - 1] = -1
        keys = [g.ids[use].astype(np.int64) * (2 * CLASSES) + side * CLASSES + beside[use] for side, beside in ((0, before), (1, after)) for use in [rare & (beside >= 0)]]
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        return {"word": g.words[found // (2 * CLASSES)], "code": found % (2 * CLASSES) | n << 8}

    return make


def _choices(beside: DataFrame, worth: np.ndarray) -> DataFrame:
    """(word, class) of the words in beside(word, code), by total worth over their neighbours, in millionths."""
    whole = np.round(worth * 1e6).astype(np.int64)
    table = F.broadcast(beside.sparkSession.createDataFrame([(k, w.tolist()) for k, w in enumerate(whole)], "k long, w array<long>"))  # 2 * CLASSES rows
    beside = beside.repartition("word").join(table, F.col("code").bitwiseAND(F.lit(255)) == F.col("k")).withColumn("n", F.shiftright("code", 8))
    sums = beside.groupBy("word").agg(*[F.sum(F.col("n") * F.get("w", F.lit(c))).alias(f"w{c}") for c in range(CLASSES)])
    scores = F.array(*[f"w{c}" for c in range(CLASSES)])
    return sums.select("word", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("near"))


class Model:
    """Figures of the classes; transitions are set once class bigrams are counted."""

    def __init__(self, total: int, kinds: int, sizes: dict[int, tuple[int, int]]) -> None:
        self.total, self.kinds = total, kinds
        self.tokens = np.array([sizes.get(k, (0, 0))[0] for k in range(CLASSES)], dtype=float)
        words = np.array([sizes.get(k, (0, 0))[1] for k in range(CLASSES)], dtype=float)
        self.room = self.tokens + words + 1
        self.transition = np.zeros((CLASSES, CLASSES))

    def set_transitions(self, moves: np.ndarray) -> None:
        plain = (self.tokens + 1) / (self.tokens.sum() + CLASSES)
        kinds = np.maximum((moves > 0).sum(axis=1, keepdims=True), 1)
        self.transition = np.log10((moves + kinds * plain) / (moves.sum(axis=1, keepdims=True) + kinds))


def fit_classes(groups: DataFrame) -> tuple[DataFrame, Model]:
    """The word table (word, c, class) and the model without transitions."""
    counts = materialize(_over_groups(groups, _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long"), F.count("*")).first()
    if not totals[1]:
        return counts.withColumn("class", F.lit(0)), Model(0, 0, {})
    top = counts.orderBy(F.desc("c"), "word").limit(CORE).collect()  # CORE rows
    core = np.array([r["word"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))], dtype=np.int64)
    square = np.zeros((CORE + 1, CORE + 1))
    for pair, n in _over_groups(groups, _core_bigrams(core), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # (CORE + 1) ** 2 rows at most
        square[divmod(pair, CORE + 1)] += n
    used = [*range(len(core)), CORE]
    square = square[np.ix_(used, used)]
    label = exchange(square)

    moves = np.zeros((CLASSES + 1, CLASSES + 1))
    named = np.append(label, CLASSES)
    np.add.at(moves, (named[:, None], named[None, :]), square)
    moves = moves[:CLASSES, :CLASSES] + 0.5
    worth = np.concatenate([np.log(moves / moves.sum(axis=1, keepdims=True)), np.log(moves / moves.sum(axis=0, keepdims=True)).T])
    chosen = _choices(_over_groups(groups, _neighbours(core, label), "word long, code long"), worth)
    few = F.broadcast(groups.sparkSession.createDataFrame([(int(w), int(c)) for w, c in zip(core, label)], "word long, own int"))  # CORE rows
    table = counts.join(few, "word", "left").join(chosen, "word", "left")
    table = materialize(table.select("word", "c", F.coalesce("own", "near", F.pmod("word", F.lit(CLASSES)).cast("int")).alias("class")), "classes")
    sizes = {r[0]: (r[1], r[2]) for r in table.groupBy("class").agg(F.sum("c"), F.count("*")).collect()}  # CLASSES rows
    return table, Model(int(totals[0]), int(totals[1]), sizes)


def _read_texts(model: Model):
    """A group and its words' (num, c, class) to a row per text: figures and the class of each token."""
    log_all = math.log10(model.total + model.kinds + 1)
    out = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emitted", pa.float64()), ("classes", pa.binary())])

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        parts = []
        for row in rows.to_pylist():
            g = Group(row)
            size = int(g.ids.max()) + 1
            count, label = np.zeros(size, np.int64), np.full(size, UNSEEN)
            at = words.column("num").to_numpy()
            count[at], label[at] = words.column("c").to_numpy(), words.column("class").to_numpy()
            total = lambda per_word: np.add.reduceat(per_word[g.ids], g.starts)
            known = total((count > 0).astype(np.int64))
            base = total(np.log10(count + 1.0) - log_all)
            emitted = total(np.where(label < UNSEEN, np.log10((count + 1.0) / model.room[np.minimum(label, CLASSES - 1)]), 0.0))
            classes = label.astype(np.uint8)[g.ids].tobytes()
            cuts = zip(g.starts.tolist(), g.ends.tolist())
            parts.append(pa.table([pa.array(g.doc_ids, pa.int64()), pa.array(g.held), pa.array(g.ends - g.starts), pa.array(known), pa.array(base), pa.array(emitted), pa.array([classes[a:b] for a, b in cuts], pa.binary())], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()

    return run, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"


def _class_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            c = np.frombuffer(raw, np.uint8).astype(np.int64)
            total += np.bincount(np.r_[c[-1], c[:-1]] * CLASSES + c, minlength=len(total))
    yield pa.RecordBatch.from_pydict({"pair": pa.array(np.flatnonzero(total)), "n": pa.array(total[total > 0])})


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs(doc_id, held, text); held texts are not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    groups = materialize(docs.select("doc_id", "held", "text").mapInArrow(_grouped, _GROUP), "groups")
    table, model = fit_classes(groups)
    places = _over_groups(groups, _word_places, "word long, grp long, num int").join(table, "word").select("grp", "num", "c", "class")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = groups.select("grp", "doc_ids", "held", "sizes", "ids").repartition(parts, "grp").groupBy("grp").cogroup(places.repartition(parts, "grp").groupBy("grp"))
    read = materialize(both.applyInArrow(*_read_texts(model)), "read")
    moves = np.zeros((CLASSES, CLASSES))
    for pair, n in read.filter(~F.col("held")).select("classes").mapInArrow(_class_moves, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # CLASSES ** 2 rows at most
        moves[divmod(pair, CLASSES)] += n
    model.set_transitions(moves)
    flat, rooms = model.transition.ravel(), np.log10(model.room)
    likeliest = (model.transition - rooms[None, :]).argmax(axis=1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for raw in batch.column("classes").to_pylist():
                c = np.frombuffer(raw, np.uint8).astype(np.int64)
                lost = np.flatnonzero(c == UNSEEN)
                if len(lost):
                    end = 0 if c[-1] == UNSEEN else c[-1]
                    for i in lost.tolist():
                        c[i] = likeliest[c[i - 1] if i else end]
                sums.append(float(flat[np.r_[c[-1], c[:-1]] * CLASSES + c].sum() - rooms[c[lost]].sum()))
            rest = [batch.column(c) for c in ("doc_id", "held", "n_tokens", "n_known", "base_score")]
            score_ = pa.array(np.array(sums) + batch.column("emitted").to_numpy())
            yield pa.RecordBatch.from_arrays([*rest, score_], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = read.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(model.total).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
