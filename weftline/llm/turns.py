"""Repair of conversations by cheapest edits, with a lazily determinised weighted automaton.

A good conversation's role initials read `(s?(ua)+)?`. Four states stand for what has been said so
far: nothing, s, u, a. Keeping a row costs 0, giving it the role that fits 2, deleting it 3, inserting an
empty turn 2; a truncated row that is not deleted costs 1 more; blank rows and repetitions must go. The
costs from each state to the end form a vector. Rows are scanned from the last to the first; a vector less its
least entry is a state of the determinised automaton, numbered when it first occurs, and (state, kind of row) leads to
the next state and the amount taken off, kept in a table that is filled as it is needed. Few states
occur, so nearly every row is one look into the table. The audit is traced the other way: from nothing said,
each step takes, of the edits whose cost is just the difference of the vectors (the tight arcs), the letter
that sorts first; these steps are kept by (state, kind of row, what was said) too. As the trace runs from the first row
on, the audit is the least in ASCII order of all that cost the least.

Repetitions are found by an aggregate, the first turn of each (conversation, role, digest of text), whose rows then
take their place before the row they mark. Conversations are dealt by their id in two streams: digests of the rows in order give the audits, then texts in
order, each conversation's audit before them, give the repaired rows. A task holds an audit, a
byte or two per row of one conversation, and one batch of texts; the digest of a conversation runs through it from its first row
to its last, so one conversation is one stream, however many rows it has.

Null roles and texts are one space. A null id is a conversation of its own; rows of a null turn come first. Rows of equal turn stand in
order of role and of their text's SHA-256, equal rows beside each other. Texts are read whole, however long. Other columns
are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.runtime import materialize, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state that an inserted turn, or one with a fitting role, leads to
FITTING = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
MUST_GO, CUT = 8, 4  # a kind of row: 0 s, 1 u, 2 a, 3 other, CUT added if truncated; or MUST_GO
LEGAL = {(0, 1), (1, 2), (2, 1)}
FIGURES = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_BATCH = 2000


class Automaton:
    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._number(self._inserted([0, 2 * INSERT, INSERT, 0]))

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        for _ in range(2):  # three turns in a row are never inserted: the third is where the first was
            costs = [min(c, INSERT + costs[to]) for c, to in zip(costs, FITTING)]
        return costs

    def _number(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def _edits(after: tuple[int, ...], kind: int, said: int) -> list[tuple[str, int, int]]:
        """(letter, cost to the end, what is said then) of the edits of one row, letters in order."""
        out = [("D", DELETE + after[said], said)]
        if kind != MUST_GO:
            cut = TRUNCATED if kind & CUT else 0
            kept = _KEPT.get((said, kind & 3))
            if kept is not None:
                out.append(("K", KEEP + cut + after[kept], kept))
            out.append(("R", REROLE + cut + after[FITTING[said]], FITTING[said]))
        return out

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row, given the state after it, and the amount taken off."""
        found = self.steps.get((state, kind))
        if found is None:
            after = self.vectors[state]
            found = self._number(self._inserted([min(c for _, c, _ in self._edits(after, kind, q)) for q in range(4)]))
            self.steps[state, kind] = found
        return found

    def trace(self, state: int, kind: int, said: int) -> tuple[str, int]:
        """Letters up to and with the edit of a row, and what is said then."""
        found = self.traces.get((state, kind, said))
        if found is None:
            before, less = self.step(state, kind)
            own, letters, now = self.vectors[before], "", said
            while True:
                tight = [(x, to) for x, c, to in self._edits(self.vectors[state], kind, now) if c == own[now] + less]
                if (not tight or tight[0][0] > "I") and INSERT + own[FITTING[now]] == own[now]:
                    letters, now = letters + "I", FITTING[now]
                    continue
                letters, now = letters + tight[0][0], tight[0][1]
                break
            found = self.traces[state, kind, said] = letters, now
        return found

    def audit(self, kinds: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation whose rows are of these kinds."""
        states, state, cost = [], self.end, 0
        for kind in reversed(kinds):
            states.append(state)
            state, less = self.step(state, kind)
            cost += less
        cost += self.vectors[state][START]
        said, out = START, []
        for kind, after in zip(kinds, reversed(states)):
            letters, said = self.trace(after, kind, said)
            out.append(letters)
        return cost, "".join(out) + {SYSTEM: "II", USER: "I"}.get(said, "")


@cache
def automaton() -> Automaton:
    """One table for all conversations of a task."""
    return Automaton()


def prepared(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _kind(role: Column, text: Column) -> Column:
    body, first = F.rtrim(text, F.lit(SPACE)), F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.when(body == "", kind + MUST_GO).when(F.right(body, F.lit(1)).isin(".", "!", "?"), kind).otherwise(kind + CUT).cast("int")


class _Conversation:
    """What the rows of one conversation, in order, come to."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.kinds = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.last = self.mark = None

    def row(self, turn: int | None, role: str, digest: bytes, kind: int, is_row: int) -> None:
        key = turn, role, digest
        if not is_row:  # the first row of this key, if not blank, says something new
            self.mark = key
            return
        if turn is not None and turn != self.most:
            self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1
        initial = kind & 3
        if self.last is not None and (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.last = initial
        new, self.mark = self.mark == key, None
        if kind & MUST_GO:
            self.blank += 1
            kind = MUST_GO
        elif not new:
            self.duplicate += 1
            kind = MUST_GO
        elif kind & CUT:
            self.truncated += 1
        self.kinds.append(kind)

    def figures(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv_id, len(self.kinds), gaps, self.blank, self.duplicate, self.truncated, self.illegal, *automaton().audit(bytes(self.kinds))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= _BATCH or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    small_batches(conversations.sparkSession)
    rows = prepared(conversations).select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), _kind(F.col("role"), F.col("text")).alias("kind"), F.lit(1).alias("is_row"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    marks = first.select("conv_id", "t.turn", "role", "digest", F.lit(0).alias("kind"), F.lit(0).alias("is_row"))
    ordered = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "is_row")
    ids = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {ids}, {FIGURES}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            own = None
            for conv_id, *row in _rows(batches, ["conv_id", "turn", "role", "digest", "kind", "is_row"]):
                if own is None or own.conv_id != conv_id:
                    if own is not None:
                        yield own.figures()
                    own = _Conversation(conv_id)
                own.row(*row)
            if own is not None:
                yield own.figures()

        yield from _batches(found(), arrow)

    return ordered.mapInArrow(run, schema)


_STREAM = ["conv_id", "turn", "role", "text", "head", *[x.split()[0] for x in FIGURES.split(", ")]]


def _beside(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its figures before them."""
    small_batches(conversations.sparkSession)
    rows = prepared(conversations).select("*", F.lit(1).alias("head"))
    heads = found.withColumn("head", F.lit(0))
    return rows.unionByName(heads, allowMissingColumns=True).withColumn("digest", _digest("text")).repartition("conv_id").sortWithinPartitions("conv_id", "head", F.col("turn").asc_nulls_first(), "role", "digest")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head, None) at the start of each conversation, then (None, (letter, turn, role, text)) of what it becomes."""
    left: Iterator[str] = iter("")
    said = START

    def inserted() -> Iterator[tuple]:
        nonlocal said
        said = FITTING[said]
        yield None, ("I", None, "user" if said == USER else "assistant", "")

    for conv_id, turn, role, text, head, *figures in _rows(batches, _STREAM):
        if not head:
            for _ in left:  # what the conversation before ends with
                yield from inserted()
            yield (conv_id, *figures), None
            left, said = iter(figures[-1]), START
            continue
        letter = next(left)
        while letter == "I":
            yield from inserted()
            letter = next(left)
        if letter == "K":
            said = _KEPT[said, "sua".index(role[0])]
            yield None, ("K", turn, role, text)
        elif letter == "R":
            said = FITTING[said]
            yield None, ("R", turn, "user" if said == USER else "assistant", text)
    for _ in left:
        yield from inserted()


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of the repaired conversations; inserted ones have no turn."""
    found = materialize(audits(conversations), "audits") if found is None else found
    kind = lambda c: conversations.schema[c].dataType.simpleString()
    schema = f"conv_id {kind('conv_id')}, place long, edit string, turn {kind('turn')}, role string, text string"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own, place = None, 0
            for head, row in _edited(batches):
                if head is not None:
                    own, place = head[0], 0
                else:
                    yield own, place, *row
                    place += 1

        yield from _batches(rows(), arrow)

    return _beside(conversations, found).select(*_STREAM).mapInArrow(run, schema)


def digests(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The audits with repaired_sha256: of `role:text` of the repaired rows, joined by newlines."""
    found = materialize(audits(conversations), "audits") if found is None else found
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {FIGURES}, repaired_sha256 string"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own, total, between = None, hashlib.sha256(), b""
            for head, row in _edited(batches):
                if head is not None:
                    if own is not None:
                        yield *own, total.hexdigest()
                    own, total, between = head, hashlib.sha256(), b""
                else:
                    total.update(between + f"{row[2]}:{row[3]}".encode())
                    between = b"\n"
            if own is not None:
                yield *own, total.hexdigest()

        yield from _batches(rows(), arrow)

    return _beside(conversations, found).select(*_STREAM).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults: by the CRC of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes
    its full stops, 3 repeats it, 4 makes it the user's."""
    rows = prepared(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.withColumn("case", case).filter("case <> 0").select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1).cast("int"))).alias("copy"))
    return changed.drop("copy")
