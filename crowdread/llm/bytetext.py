"""Words, hashes and windows of whole texts, computed over the bytes of Arrow batches.

A batch of texts is one byte array with row offsets, so that a few numpy passes do the work of a
Python loop over words. Work arrays are bounded: batches are cut into slices of a few MB, and only
a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Segments of this many bytes or more are hashed one by one.
LONG = 32
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All bytes but ASCII digits and letters and those of other characters.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """One random value per byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 7919))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a length rounded up, so that few lengths are kept."""
    return powers((int(n) + (1 << 20) - 1) >> 20 << 20)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every byte segment.

    Short segments are hashed by a polynomial modulo 2**64, from running sums of the whole array. The difference of two long
    ones can hold so many factors of two that they collide whatever the seed is, so these are hashed one by one.
    """
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    short = sizes < LONG
    if short.any():
        up, down = powers_for(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values(seed)[data] * up[: len(data)], out=sums[1:])
        if short.all():
            return mix((sums[ends] - sums[starts]) * down[starts])
        a, b = starts[short], ends[short]
        out[short] = mix((sums[b] - sums[a]) * down[a])
    long = np.flatnonzero(~short)
    if len(long):
        view, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        found = [blake2b(view[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.frombuffer(b"".join(found), np.uint64)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    plain = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    held = plain.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ``breaks``, ASCII white space if not told) and the word offsets of the rows."""
    space = breaks[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = ~space[heads], ~space[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n consecutive word hashes; shorter input gives none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    out = np.full(size, mix(np.array([seed + 1], np.uint64))[0], np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : k + size]
    return mix(out)


def inside_rows(bounds: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` windows of n items lie within one row; ``bounds`` are the rows' item offsets."""
    good = np.zeros(size + 1, np.int64)
    a, b = bounds[:-1], bounds[1:] - n + 1
    long = b > a
    np.add.at(good, a[long], 1)
    np.add.at(good, b[long], -1)
    return np.cumsum(good)[:size] > 0


def sliding(op, x: np.ndarray, n: int) -> np.ndarray:
    """op (minimum or maximum) over every n consecutive values."""
    width, out = 1, x
    while width * 2 <= n:
        out = op(out[: len(out) - width], out[width:])
        width *= 2
    if width < n:
        size = len(x) - n + 1
        out = op(out[:size], out[n - width : n - width + size])
    return out


def anchors(values: np.ndarray, window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that are least in some valid window of ``window`` values, and the least value of each window.

    Which values of a window are marked depends on that window alone, so equal windows have
    equal marks. All equal least values are marked; ``valid`` says which windows count.
    """
    if len(values) < window:
        return np.zeros(len(values), bool), np.zeros(0, np.uint64)
    least = sliding(np.minimum, values, window)
    least = np.where(valid, least, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    best = sliding(np.maximum, np.concatenate([pad, least, pad]), window)
    return (best == values) & (best > 0), least


def group_firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays sorted by these keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every segment, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def runs(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lengths of the runs of consecutive values of equal keys (sorted by key and value)."""
    firsts = group_firsts(keys, values - np.arange(len(values)))
    return firsts, np.diff(np.append(firsts, len(values)))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit values as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """One list per row."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
