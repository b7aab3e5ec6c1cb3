"""Fill-in-the-middle over ropes.

A text is a rope: a balanced tree whose leaves are runs of UTF-8 bytes and whose nodes
keep the units (runs of ASCII letters, or single other characters), the code points
and the bytes below them, and whether they begin or end within letters; a run of letters that crosses a
seam counts once. Splitting at a rank walks down one path and shares all else. The
prefix, middle and suffix of a text are two splits, the output is their subtrees
joined in another order with the sentinels as leaves; the way back finds the
sentinels in the output's rope, splits there and joins the parts again. Nothing but the leaves
on a cut is copied until the bytes are written out.

Rows are independent and stay where they are: no shuffle. A null text is empty, an empty text
or one that holds a sentinel is left plain, and so is a share of all others; a null id is drawn for as an empty one. Texts are taken
whole, however long: a batch has a bounded size and a longer text stands alone. Rows with equal
ids have the same draw, and equal rows equal results. Other columns stay, whatever their names, but for
those of the result, which must be free. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.arrowtext import texts
from weftline.runtime import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of a hundred
LEAF_BYTES = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_HEAD = np.ones(256, bool)  # every byte but those that continue a character
_HEAD[0x80:0xC0] = False

RESULT = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


class Rope:
    """A node, or a leaf where it has bytes. Ropes are never changed."""

    __slots__ = ("left", "right", "data", "units", "points", "size", "opens", "closes")

    def __init__(self, left: Rope | None, right: Rope | None, data: bytes | None, units: int, points: int, size: int, opens: bool, closes: bool) -> None:
        self.left, self.right, self.data = left, right, data
        self.units, self.points, self.size, self.opens, self.closes = units, points, size, opens, closes

    def leaves(self) -> Iterator[bytes]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.data is not None:
                yield node.data
            else:
                stack += [node.right, node.left]

    def body(self) -> bytes:
        return b"".join(self.leaves())


def _starts(data: bytes) -> np.ndarray:
    """Where units begin, as if a unit began with the data."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    inner = np.zeros(len(raw), bool)
    inner[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(_HEAD[raw] & ~inner)


EMPTY = Rope(None, None, b"", 0, 0, 0, False, False)


def leaf(data: bytes) -> Rope:
    if not data:
        return EMPTY
    points = int(np.count_nonzero(_HEAD[np.frombuffer(data, np.uint8)])) if not data.isascii() else len(data)
    return Rope(None, None, data, len(_starts(data)), points, len(data), bool(_LETTER[data[0]]), bool(_LETTER[data[-1]]))


def join(a: Rope, b: Rope) -> Rope:
    if not a.size or not b.size:
        return a if a.size else b
    seam = a.closes and b.opens
    return Rope(a, b, None, a.units + b.units - seam, a.points + b.points, a.size + b.size, a.opens, b.closes)


def rope(data: bytes, leaf_bytes: int = LEAF_BYTES) -> Rope:
    """A balanced tree over the data; leaves end with a character."""
    row, at = [], 0
    while at < len(data):
        end = min(at + leaf_bytes, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        row.append(leaf(data[at:end]))
        at = end
    while len(row) > 1:
        row = [join(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def split_units(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.units:
        return node, EMPTY
    if node.data is not None:
        at = int(_starts(node.data)[rank])
        return leaf(node.data[:at]), leaf(node.data[at:])
    left, right = node.left, node.right
    seam = left.closes and right.opens
    if rank < left.units or rank == left.units and not seam:
        a, b = split_units(left, rank)
        return a, join(b, right)
    a, b = split_units(right, rank - left.units + seam)
    return join(left, a), b


def split_bytes(node: Rope, at: int) -> tuple[Rope, Rope]:
    if at <= 0:
        return EMPTY, node
    if at >= node.size:
        return node, EMPTY
    if node.data is not None:
        return leaf(node.data[:at]), leaf(node.data[at:])
    if at <= node.left.size:
        a, b = split_bytes(node.left, at)
        return a, join(b, node.right)
    a, b = split_bytes(node.right, at - node.left.size)
    return join(node.left, a), b


def find(node: Rope, mark: bytes) -> int:
    """Place of the first byte of a mark, or -1; marks may lie across leaves."""
    before, tail = 0, b""
    for data in node.leaves():
        own = tail + data
        at = own.find(mark)
        if at >= 0:
            return before - len(tail) + at
        before += len(data)
        tail = own[-(len(mark) - 1) :] if len(mark) > 1 else b""
    return -1


def rearranged(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, ...]) -> tuple[Rope, Rope, Rope, Rope]:
    """(whole, prefix, middle, output), cut after the lesser and the greater of two draws modulo the units and one."""
    whole = rope(text)
    a, b = sorted((first % (whole.units + 1), second % (whole.units + 1)))
    front, suffix = split_units(whole, b)
    prefix, middle = split_units(front, a)
    p, s, m = map(leaf, marks)
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return whole, prefix, middle, out


def restored(output: bytes, form: str, marks: tuple[bytes, ...]) -> Rope:
    """The text of an output, by splits at the sentinels."""
    node = rope(output)
    if form == "plain":
        return node
    p, s, m = marks
    order = (p, s, m) if form == "psm" else (s, p, m)
    parts: list[Rope] = []
    for mark in order[1:]:
        _, node = split_bytes(node, len(order[len(parts)]))
        own, node = split_bytes(node, find(node, mark))
        parts.append(own)
    _, middle = split_bytes(node, len(m))
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return join(join(prefix, middle), suffix)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2 ** 32 of each id."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _marks(*sentinels: str) -> tuple[bytes, ...]:
    """Sentinels as bytes. None may arise by chance where a text and a sentinel meet, so all begin with one byte
    that they hold nowhere else, and none begins another."""
    marks = tuple(x.encode() for x in sentinels)
    for x in marks:
        if len(x) < 2 or x[:1] != marks[0][:1] or x[:1] in x[1:] or sum(y.startswith(x) for y in marks) > 1:
            raise ValueError("sentinels must begin with one character, hold it nowhere else, and not begin one another")
    return marks


def infilled(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output appended."""
    marks = _marks(prefix, suffix, middle)
    small_batches(docs.sparkSession)
    forms = _forms(marks)
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    kind = F.when(third % 100 >= plain_from, "plain").when(fourth % 100 < spm_below, "spm").otherwise("psm")
    made = docs.withColumn("__if", forms(F.col("text"), first, second, kind))
    return made.select(*docs.columns, "__if.*")


def _forms(marks: tuple[bytes, ...]) -> Callable[..., Column]:
    @arrow_udf(RESULT)
    def of(text: pa.Array, first: pa.Array, second: pa.Array, kind: pa.Array) -> pa.Array:
        n, forms, prefixes, middles, outputs = [], [], [], [], []
        for body, a, b, form in zip(texts(text), first.to_pylist(), second.to_pylist(), kind.to_pylist()):
            if not body or form == "plain" or any(m in body for m in marks):
                n.append(rope(body).units)
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                outputs.append(body)
                continue
            whole, front, inner, out = rearranged(body, a, b, form, marks)
            n.append(whole.units)
            forms.append(form)
            prefixes.append(front.points)
            middles.append(inner.points)
            outputs.append(out.body())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return of


def original(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The text that an output of infilled() was made of."""
    marks = _marks(prefix, suffix, middle)

    @arrow_udf("string")
    def of(column: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restored(body, form, marks).body() for body, form in zip(texts(column), forms.to_pylist())], pa.binary()).cast(pa.string())

    return of(output, form)
