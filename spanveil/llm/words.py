"""Vectorised word splitting and hashing over Arrow string columns.

A task cuts its rows into pieces of a few megabytes (never through a row), finds the words of a piece with
byte masks, and hashes words and word windows with polynomial prefix sums modulo 2**64. No Python code runs
per word. Texts are taken whole; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task holds as numpy arrays at one time; a longer row is a piece of its own.
PIECE_BYTES = 500_000
#: Rows of a piece at most.
PIECE_ROWS = 1 << 14
#: Powers that a worker keeps from piece to piece (32 MB a base); those of a longer row are made anew.
KEPT_POWERS = 1 << 21

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xF1357AEA2E62A9C5))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        n = 1 << (n - 1).bit_length() if n <= KEPT_POWERS else n
        out = []
        for b in (base, _inverse(base)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if n <= KEPT_POWERS:
            _POWERS[int(base)] = have
    return have


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES, most: int = PIECE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of at most ``most`` whole rows of about ``limit`` bytes."""
    body, at = column_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(rows, first + most, max(first + 1, end))
        yield first, end, body[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind each, a worker gives back what Arrow holds of it, so that idle workers stay small."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a piece: maximal runs of bytes outside space, tab, newline, VT, FF and CR."""

    def __init__(self, body: np.ndarray, rows: np.ndarray, lower: bool = False):
        self.body = _LOWER[body] if lower else body
        self.rows = rows
        n = len(body)
        solid = ~_SPACE[body]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before[edge[:n]] = False
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        #: Words of row r are numbers first[r] to first[r + 1].
        self.first = np.searchsorted(self.start, rows)
        self.count = np.diff(self.first)
        #: The row of each word.
        self.row = np.repeat(np.arange(len(rows) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.body, self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; meaningful where ``whole(k)``."""
        n = len(hashes)
        if n == 0:
            return hashes
        up, down = _powers(_WORD_BASES[which], n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=prefix[1:])
        out = np.zeros(n, np.uint64)
        if n >= k:
            out[: n - k + 1] = mix((prefix[k:] - prefix[: n - k + 1]) * down[: n - k + 1])
        return out

    def whole(self, k: int) -> np.ndarray:
        """True where the k words from a word on lie in its row."""
        return np.arange(len(self.start)) + k <= self.first[self.row + 1]


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    n = len(body)
    up, down = _powers(_BASE, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * up[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)
