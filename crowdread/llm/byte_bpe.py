"""Byte-level BPE encoding and decoding of whole texts.

Two tiers: a minimal perfect hash finds whole pre-tokens of the vocabulary; the others are merged
with a heap over linked bytes. Each batch is split into pre-tokens by a few passes over its code
points, and each distinct pre-token of a slice is encoded once.

Nulls and empty texts give no ids. Texts of any length are encoded whole; memory follows the slice
or, where longer, the single text. Repeated rows stay repeated rows, an empty table gives an empty
one, and only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crowdread.llm import bytetext as bt

LETTER, NUMBER, SPACE = 1, 2, 3
#: Words of a generation that a worker remembers.
KEPT_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (on the driver; a vocabulary is bounded)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: key -> slot, one slot per key.

    Keys fall into buckets by their hash. Buckets, larger ones first, look for a shift that puts
    all their keys into free slots; a bucket of one key takes a free slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.data = np.frombuffer(b"".join(keys), np.uint8)
        self.ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        self.starts = self.ends - np.array([len(k) for k in keys], np.int64)
        self.n, hashes = len(keys), bt.segment_hashes(self.data, self.starts, self.ends)
        assert len(np.unique(hashes)) == self.n, "two keys with one hash"
        self.buckets = max(1, self.n // 3)
        owner = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=self.buckets)
        firsts = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        free = np.ones(self.n, bool)
        for bucket in np.argsort(-sizes, kind="stable"):
            mine = order[firsts[bucket] : firsts[bucket] + sizes[bucket]]
            if len(mine) < 2:
                break
            slots, shift = self.find(hashes[mine], free)
            self.shift[bucket] = shift
            free[slots] = False
            self.key_at[slots] = mine
        left = np.flatnonzero(free)
        singles = np.flatnonzero(sizes == 1)
        self.shift[singles] = -1 - left[: len(singles)]
        self.key_at[left[: len(singles)]] = order[firsts[singles]]

    def place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (bt.mix(hashes + shift.astype(np.uint64) * np.uint64(bt.BASE)) % np.uint64(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, int]:
        start, count = 1, 64
        while True:
            shifts = np.arange(start, start + count)
            slots = self.place(hashes[None, :], shifts[:, None])
            good = free[slots].all(axis=1)
            for row in np.flatnonzero(good):
                if len(np.unique(slots[row])) == len(hashes):
                    return slots[row], int(shifts[row])
            start, count = start + count, min(count * 4, 1 << 16)

    def keys_of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the key equal to each segment, -1 where no key equals it byte for byte."""
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self.place(hashes, np.maximum(shift, 0)))
        key = self.key_at[slots]
        sizes = ends - starts
        same = self.ends[key] - self.starts[key] == sizes
        for at in range(int(sizes[same].max(initial=0))):
            rows = np.flatnonzero(same & (sizes > at))
            same[rows] = data[starts[rows] + at] == self.data[self.starts[key[rows]] + at]
        return np.where(same, key, -1)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the pair of least rank, leftmost first, until no pair has a rank."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or not end[i] or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        kinds[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return kinds


def pre_tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens, and the pre-token offsets of the rows.

    The split of the public pattern: contractions, then letters, numbers or other signs with one
    space before them, then white space, which leaves its last character to what follows.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = kinds[code]
    head = np.zeros(len(code) + 1, bool)
    head[np.searchsorted(byte_at, offsets)] = True
    run = head[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    token = run.copy()
    space_end = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:-1])
    token[space_end] = True
    token[space_end[code[space_end] == 32] + 1] = False
    mark = np.flatnonzero((code[:-1] == 39) & token[:-1] & run[1:] & (kind[1:] == LETTER) & ~head[1:-1])
    one = np.isin(code[mark + 1], [ord(c) for c in "stmd"])
    second = np.where(mark + 2 < len(code), code[np.minimum(mark + 2, len(code) - 1)], 0)
    second[head[np.minimum(mark + 2, len(code))]] = 0
    pair = code[mark + 1].astype(np.int64) * 0x110000 + second
    two = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
    for found, size in ((mark[one], 1), (mark[two & ~one], 2)):
        token[found + 1] = False
        token[(found + 1 + size)[found + 1 + size < len(code)]] = True
    starts = byte_at[token]
    return starts, np.searchsorted(starts, offsets)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word is found first, and which of them every word is.

    Words of equal hashes are compared byte by byte; should two differ, another hash is taken.
    """
    sizes, seed = ends - starts, 0
    while True:
        hashes = bt.segment_hashes(data, starts, ends, seed)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        again = starts[first][inverse]
        if (sizes == sizes[first][inverse]).all() and (data[bt.expand(starts, sizes)] == data[bt.expand(again, sizes)]).all():
            return first, inverse
        seed += 1


class Known:
    """Ids of words that have been encoded, in two generations: words that come again stay, the rest is dropped.

    A Python worker keeps them from task to task, so that a word is encoded about once per worker.
    """

    def __init__(self):
        self.new, self.old = {}, {}

    def ids(self, words: list[bytes], encode_words: Callable[[list[bytes]], list[list[int]]]) -> list[bytes]:
        """32-bit ids of distinct words."""
        new, old, missing = self.new, self.old, []
        for word in words:
            if word not in new:
                ids = old.get(word)
                if ids is None:
                    missing.append(word)
                else:
                    new[word] = ids
        for word, ids in zip(missing, encode_words(missing)):
            new[word] = np.array(ids, np.int32).tobytes()
        out = [new[word] for word in words]
        if len(new) > KEPT_WORDS:
            self.old, self.new = new, {}
        return out


@lru_cache(maxsize=2)
def known_words(vocabulary: str) -> Known:
    """The words of this worker; ``vocabulary`` is a digest of the ranks or merges that encode them."""
    return Known()


class Encoder:
    """Ids of all texts of a slice. ``encode_words`` gives the ids of words that are not whole tokens."""

    def __init__(
        self, table: PerfectHash, ids: np.ndarray, encode_words: Callable[[list[bytes]], list[list[int]]], known: Known | None = None
    ):
        self.table, self.ids, self.encode_words = table, ids, encode_words
        self.kinds, self.known = character_kinds(), known or Known()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the id offsets of the rows."""
        starts, rows = pre_tokens(data, offsets, self.kinds)
        ends = np.append(starts[1:], len(data))
        first, inverse = distinct_words(data, starts, ends)
        key = self.table.keys_of(bt.segment_hashes(data, starts[first], ends[first]), data, starts[first], ends[first])
        missing = np.flatnonzero(key < 0)
        raw = data.tobytes()
        found = self.known.ids([raw[starts[i] : ends[i]] for i in first[missing].tolist()], self.encode_words)
        sizes = np.ones(len(first), np.int64)
        sizes[missing] = [len(x) // 4 for x in found]
        at = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        flat[at[key >= 0]] = self.ids[key[key >= 0]]
        flat[bt.expand(at[missing], sizes[missing])] = np.frombuffer(b"".join(found), np.int32)
        each = sizes[inverse]
        bounds = np.concatenate([[0], np.cumsum(each)])
        return flat[bt.expand(at[inverse], each)], bounds[rows]


def encode_and_decode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id column, ``ids`` array<int> of the whole text, and ``decoded`` binary, the bytes of the ids."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    keys = list(ranks)
    vocabulary = sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((PerfectHash(keys), np.array([ranks[k] for k in keys], np.int32), ranks))
    key_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids_of, ranks = shared.value
        encoder = Encoder(table, ids_of, lambda words: [merge(w, ranks) for w in words], known_words(vocabulary))
        key_of = np.zeros(int(ids_of.max(initial=0)) + 1, np.int64)
        key_of[ids_of] = np.arange(len(ids_of))
        for batch in bt.slices(batches, text):
            ids, bounds = encoder.encode(*bt.text_bytes(batch.column(text)))
            keys = key_of[ids]
            sizes = table.ends[keys] - table.starts[keys]
            plain = table.data[bt.expand(table.starts[keys], sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            decoded = pa.Array.from_buffers(
                pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column(id_column), bt.lists(ids, bounds), decoded], [id_column, "ids", "decoded"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key_type}, ids array<int>, decoded binary")
