"""Hashes of words and shingles of many texts at once, from their UTF-8 bytes.

Works on Arrow buffers with numpy: no loop over words. A substring's hash comes from
running sums of ``table[byte] * base**place`` modulo 2**64, divided by the power of
its start, so any substring costs two look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fieldkpi.llm.common import travels

travels(__name__)

_ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(v: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


BYTE_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


class Powers:
    """Tables of powers that grow with the longest batch seen."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up, self.down


TABLES = Powers()


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column run together, and where each row starts (n + 1 values)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums for ``substring_hash``, one more than there are bytes."""
    up, _ = TABLES.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = TABLES.upto(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all k-word shingles of each text, repeats included.

    Letters A-Z are lower-cased; words are what white space leaves. A text of fewer words
    is one shingle of all its words.
    """
    rows = len(at) - 1
    white = _WHITE[data]
    inside = ~white
    begins = inside.copy()
    begins[1:] &= white[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] |= inside[first]  # a text never goes on in the next one
    ends = inside.copy()
    ends[:-1] &= white[1:]
    last = at[1:][at[1:] > at[:-1]] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = substring_hash(running(_LOWER[data]), start, end)
    row = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    # Shingle i starts at word i, if its text has k words from there on.
    place = np.arange(len(word)) - begin[row]
    whole = place + k <= count[row]
    short = (place == 0) & (count[row] < k)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    value = np.full(len(word), k, np.uint64)
    for j in range(k):
        part = padded[j : j + len(word)]
        part = np.where(place + j < count[row], part, np.uint64(0))
        value = mixed(value * _ODD + part)
    chosen = whole | short
    return row[chosen], value[chosen]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per row, in order of row and hash."""
    order = np.lexsort((value, row)) if len(row) and row[-1] > 255 else None
    if order is None:  # eight bits of row and 56 of hash sort as one number
        key = np.sort(row.astype(np.uint64) << np.uint64(56) | value >> np.uint64(8))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        return (key >> np.uint64(56)).astype(np.int64), mixed(key << np.uint64(8))
    row, value = row[order], mixed(value & ~np.uint64(255))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def slices(batch, column: int, rows: int = 256, most: int = 2 << 20):
    """Parts of a batch of at most ``rows`` rows and about ``most`` bytes of text, one row at least."""
    text = batch.column(column).cast(pa.large_binary())
    if not len(text):
        return
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    start = 0
    while start < len(text):
        stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(text))
        yield batch.slice(start, stop - start)
        start = stop
