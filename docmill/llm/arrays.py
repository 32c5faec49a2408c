"""Numpy kernels over Arrow string columns, shared by the operators that read whole texts.

A column of texts is one byte buffer with offsets.  The kernels find words, lines and their
64-bit hashes with array operations, a few megabytes at a time, so that a task's memory
depends on the block size (or its longest single text) and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


class _Powers:
    """Powers of the hash base and of its inverse, extended as longer blocks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about max_bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(off_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


#: Longer strings are hashed by BLAKE2.
SHORT = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def string_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes after another are mixed in, strings over SHORT bytes go through BLAKE2.

    No sums of powers, which agree on whole families of strings (complementary Thue-Morse words, for one).
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _GOLD + np.uint64(1))
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))  # from any byte on
    todo = np.flatnonzero(size <= SHORT)
    at, left = starts[todo], size[todo]
    while len(todo):
        out[todo] = mix(out[todo] * _GOLD + (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = data.tobytes()
        out[long] = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), np.uint64)
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """One longer than data; range_hash takes a rolling hash of any range from it.

    For cutting texts at places that depend on their content, where equal hashes of different strings do no harm;
    what decides whether strings are equal takes string_hash.
    """
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a block: byte starts and ends, hashes, the row of each, and first[row] .. first[row + 1] as its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool, hashes: bool = True) -> None:
        self.rows = len(offsets) - 1
        if lower:
            data = LOWER[data]
        self.starts, self.ends = spans(table[data], offsets)
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        if hashes:
            self.hashes = string_hash(data, self.starts, self.ends)


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive hashes, order included."""
    out = hashes[: max(0, len(hashes) - size + 1)].copy()
    for k in range(1, size):
        out = mix(out * _GOLD + hashes[k : k + len(out)])
    return out


def full_windows(words: Words, size: int) -> np.ndarray:
    """First word of every window of `size` words that lies in one row."""
    if len(words.row) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.row[: len(words.row) - size + 1] == words.row[size - 1 :])


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """True at each of n places that lies in [start, start + length) for some start."""
    if not len(starts):
        return np.zeros(n, bool)
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True at the keys that occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out
