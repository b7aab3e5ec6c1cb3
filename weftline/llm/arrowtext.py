"""Arrow text columns as flat numpy arrays, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

PIECE_BYTES = 1 << 20
PACKED_BYTES = 1 << 17  # longer texts are left as they are, so that a batch of packed rows has a bounded size unpacked

pa.set_memory_pool(pa.system_memory_pool())


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


_trim = _trimmer()


def release() -> None:
    """Give freed memory back: workers are reused, and what large arrays leave behind adds up."""
    _trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty. Both start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return at - at[0], raw


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows of about `most` bytes; a longer row stands alone."""
    at, raw = flat(column)
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end, at[start : end + 1] - at[start], raw[at[start] : at[end]]
        start = end
    release()


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null counts as empty."""
    at, raw = flat(column)
    view, at = raw.tobytes(), at.tolist()
    for a, b in zip(at, at[1:]):
        yield view[a:b]
    del view
    release()


def packed(text: Column) -> Column:
    """Text as bytes for the way through a shuffle, compressed unless it is long; see unpacked."""

    @arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        return pa.array([b"\1" + press(x) if len(x) <= PACKED_BYTES else b"\0" + x for x in texts(column)], pa.binary())

    return of(text)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts of packed rows, in UTF-8."""
    unpress = zstandard.ZstdDecompressor().decompress
    for x in column:
        body = x.as_py()
        yield unpress(body[1:]) if body[:1] == b"\1" else body[1:]


def unpacked_pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """pieces() of packed rows."""
    first, held, size = 0, [], 0
    for body in unpacked(column):
        if held and size + len(body) > most:
            yield _joined(first, held)
            first, held, size = first + len(held), [], 0
        held.append(body)
        size += len(body)
    if held:
        yield _joined(first, held)
    release()


def _joined(first: int, held: list[bytes]) -> tuple[int, int, np.ndarray, np.ndarray]:
    return first, first + len(held), np.r_[0, np.cumsum([len(x) for x in held])], np.frombuffer(b"".join(held), np.uint8)


_POWER = 0x5851F42D4C957F2D
_INVERSE = pow(_POWER, -1, 1 << 64)


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64; one table per base is kept."""
    if base not in kept or len(kept[base]) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        kept[base] = np.multiply.accumulate(steps)
    return kept[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(at: np.ndarray, raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first word of each row and the total) of the maximal runs of word bytes.

    is_word is a table of 256 booleans. A run ends with its row. The hash depends on
    the run's bytes only.
    """
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at[at <= n]] = True
    opens = inside[1:] & (~inside[:-1] | edge)
    closes = inside[:-1] & (~inside[1:] | edge)
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_POWER, n), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts])
    return starts, ends, hashes, np.searchsorted(starts, at)
