"""Word and word-sequence hashes of whole Arrow string columns, vectorised over the bytes.

Words are runs of bytes that are no separators. All separators used here are ASCII, so UTF-8 text is
cut right without decoding it. Hashes have 64 bits: a polynomial over one random number per byte,
then a bit mixer. They are the same in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; the work arrays take some 40 times as much.
SLICE = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Space, tab, line feed, vertical tab, form feed and carriage return.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))


def _powers(base: int) -> np.ndarray:
    out = np.empty(2 * SLICE + 1, _U)
    out[0], filled = 1, 1
    step = _U(base)
    with np.errstate(over="ignore"):
        while filled < len(out):
            n = min(filled, len(out) - filled)
            out[filled : filled + n] = out[:n] * step
            filled, step = filled + n, step * step
    return out


class _Tables:
    """Made in a worker at first use, so that closures stay small."""

    kept: dict[str, np.ndarray] = {}

    @classmethod
    def get(cls) -> dict[str, np.ndarray]:
        if not cls.kept:
            numbers = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
            lower = numbers.copy()
            lower[65:91] = numbers[97:123]
            cls.kept = {"exact": numbers, "lower": lower, "up": _powers(_BASE), "down": _powers(_INVERSE)}
        return cls.kept


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Words:
    """The words of a string column.

    ``hashes``: one number per word; ``first``: for each row the index of its first word, and the
    total at the end; ``starts``, ``ends``: byte places in ``data``. A null row has no words.
    """

    def __init__(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.hashes, self.first, self.starts, self.ends = data, hashes, first, starts, ends

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i in range(len(self.first) - 1):
            yield i, int(self.first[i]), int(self.first[i + 1])

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place where each row begins, with the end at last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may lie over bytes that do not count
        filled = column.fill_null("")
        _, offsets, values = filled.buffers()
        at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if not len(at):
        at = np.zeros(1, np.int64)
    return data[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, apart: np.ndarray = WHITE, lower: bool = False) -> Words:
    """Cut and hash a string column; ``lower`` folds A-Z only."""
    data, at = column_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, _U), np.zeros(len(at), np.int64), none, none)
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, at)
    hashes = np.empty(len(starts), _U)
    table, low = _Tables.get(), 0
    number, up, down = table["lower" if lower else "exact"], table["up"], table["down"]
    with np.errstate(over="ignore"):
        while low < len(starts):
            origin = starts[low]
            high = max(low + 1, int(np.searchsorted(ends, origin + SLICE, "right")))
            if ends[high - 1] - origin > SLICE:  # one word longer than a slice
                hashes[low] = _long_word(data[origin : ends[low]], number)
            else:
                piece = number[data[origin : ends[high - 1]]] * up[: ends[high - 1] - origin]
                total = np.concatenate([np.zeros(1, _U), np.cumsum(piece, dtype=_U)])
                s, e = starts[low:high] - origin, ends[low:high] - origin
                hashes[low:high] = (total[e] - total[s]) * down[s]
            low = high
    return Words(data, mix(hashes), first, starts, ends)


def _long_word(data: np.ndarray, number: np.ndarray) -> np.uint64:
    """The same polynomial in slices, for a word without an end in sight."""
    up, total, factor = _Tables.get()["up"], _U(0), _U(1)
    with np.errstate(over="ignore"):
        for k in range(0, len(data), SLICE):
            part = data[k : k + SLICE]
            total += np.sum(number[part] * up[: len(part)], dtype=_U) * factor
            factor *= up[SLICE]
    return total


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``k`` words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(seed + k))
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _U(_BASE) + hashes[j : j + n]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text, a longer row by itself."""
    array = batch.column(batch.schema.get_field_index(column))
    _, at = column_bytes(array)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
