"""Vectorised hashing of words, shingles and byte runs over the buffers of an Arrow batch.

All arithmetic is modulo 2**64.  A word's hash is a polynomial over a random table of byte
values, finished with a bit mixer; equal bytes give equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
RADIX = np.uint64(0x9E3779B97F4A7C55)
RADIX_INVERSE = np.uint64(pow(int(RADIX), -1, 1 << 64))
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """`n` odd 64-bit values that depend on the seed alone."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


def byte_table(lower: bool) -> np.ndarray:
    """A random value for each byte; with `lower`, A-Z share those of a-z."""
    table = seeded(256, 7)
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and its inverse for i < n or more."""
    for size, kept in _POWERS.items():
        if size >= n:
            return kept
    size = max(n, PIECE) + 1
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, RADIX))))
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, RADIX_INVERSE))))
    _POWERS.clear()
    _POWERS[size] = (up, down)
    return up, down


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[starts[i]:ends[i]], for runs in order of their start."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        top = int(ends[last - 1])
        up, down = powers(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(values[base:top] * up[: top - base], out=sums[1:])
        s, e = starts[k:last] - base, ends[k:last] - base
        out[k:last] = (sums[e] - sums[s]) * down[s]
        k = last
    return mix(out ^ (ends - starts).astype(np.uint64))


def row_slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes together, one row at least."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offset of each row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4))
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices small enough to work on at once."""
    raw, off = text_buffer(texts)
    for lo, hi in row_slices(np.diff(off)):
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def word_bounds(raw: np.ndarray, off: np.ndarray, inside: np.ndarray):
    """Starts and ends of the runs of bytes that `inside` marks, and each row's first run.

    A run ends with its row.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    here = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], here[:-1])) & ~edge[:-1]
    after = np.concatenate((here[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


# [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct signed hashes of its runs of `n` lower-cased words.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    starts, ends, first = word_bounds(raw, off, NOT_SPACE)
    words = run_hashes(byte_table(True)[raw], starts, ends)
    factors = seeded(n, 11)
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * factors[k]
    total = signed(mix(total))
    for row in range(len(off) - 1):
        lo, hi = int(first[row]), int(first[row + 1])
        if hi - lo >= n:
            yield np.unique(total[lo : hi - n + 1])
        elif hi > lo:
            short = (words[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield signed(mix(short + np.uint64(hi - lo)))
        else:
            yield np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """array<bigint> from one array for each row."""
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int64, copy=False)))
