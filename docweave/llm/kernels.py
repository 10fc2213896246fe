"""Vectorised byte kernels shared by the text operators.

They work on Arrow string columns without creating Python strings: a column is one byte buffer with offsets,
cut into chunks of bounded size.  All hashes are 64-bit and depend on content alone, so every executor and
every rerun computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("_powers", BASE), ("_inverses", BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class RangeHash:
    """Prefix sums of a polynomial; ``of(start, end)`` hashes any byte ranges of the buffer in O(1) each."""

    def __init__(self, buf: np.ndarray):
        _grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTE_VALUE[buf] * _powers[: len(buf)], dtype=U64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _inverses[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * _inverses[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets); a text is never cut, so one longer than limit stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_ranges(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): maximal runs without separators; words bounds[i] to bounds[i+1] are those of text i."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = space[buf]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    first[heads] = ~gap[heads]
    last[tails] = ~gap[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; shorter texts are one shingle, those without words none."""
    buf = LOWER[buf]
    starts, ends, bounds = word_ranges(buf, offs)
    if not len(starts):
        return [np.zeros(0, U64)] * (len(offs) - 1)
    words = RangeHash(buf).of(starts, ends)
    n = len(words)
    rolled = words.copy()
    shingles = np.zeros(n, U64)
    for k in range(width):
        rolled = words[k:]
        shingles[: len(rolled)] = mix(shingles[: len(rolled)] * BASE + rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, U64)
            for k in range(a, b):
                h = mix(h * BASE + words[k : k + 1])
            out.append(h ^ U64(0x5851F42D4C957F2D))
        else:
            out.append(np.zeros(0, U64))
    return out


def groups_of(batches, keys: list[str]):
    """Splits a stream of batches sorted by keys into one table per key; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
