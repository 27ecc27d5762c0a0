"""Benchmark decontamination: suffix arrays over training words, searched for every test suffix.

Words are runs of ASCII digits and letters (A-Z in lower case) and of all characters beyond ASCII. Documents are dealt into shards
of a few MB. The words of a shard become numbers of the tests' vocabulary; runs of known words that are long enough to hold a
window are laid one after another with a break behind each, and sorted as suffixes by doubling ranks until the
longest test text is ordered. Every suffix of every test text is searched in it by binary search, word by word for all
suffixes at once: the range left after a window's words holds all its places, and the range that outlasts all
others is the longest verbatim match. Words that no test has cannot be part of a match, so leaving them out changes nothing.

Tests are searched in blocks of at most about ``BLOCK_BYTES`` of text, each of which goes to all tasks; a later block is one more
pass over the documents, whose hits are merged by doc_id and a digest of the text.

A window is ``window`` consecutive words of a test text; a test text of fewer words, but not none, is one window. Matches
never cross documents. Null and empty texts have no words: such documents have no hits, such tests no windows. Rows
that repeat a document have equal results; a row without doc_id is searched like any other. Test rows that repeat id and
text count once, an id with several texts is one item, and a test without item_id hits words but is not named or counted. Only
ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.staging import release, staged, text_size

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<start:int,end:int>>"


class Tests:
    """Test texts as numbers of their own vocabulary, from 1, and their suffixes that hold a window."""

    def __init__(self, texts: list[str], window: int):
        data, offsets = bt.text_bytes(pa.array(texts, pa.string()))
        starts, ends, self.bounds = bt.word_spans(data, offsets, bt.MARKS)
        self.vocabulary, words = np.unique(bt.segment_hashes(bt.LOWER[data], starts, ends), return_inverse=True)
        self.words = words + 1
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.vocabulary >> np.uint64(44)] = True
        sizes = np.diff(self.bounds)
        of_text = np.repeat(np.arange(len(sizes)), sizes)
        windows = np.minimum(sizes, window)[of_text]
        room = self.bounds[1:][of_text] - np.arange(len(of_text))
        held = np.flatnonzero(room >= windows)
        self.starts, self.text, self.window, self.room = held, of_text[held], windows[held], room[held]
        self.least, self.longest = (int(self.window.min()), int(sizes.max())) if len(held) else (0, 0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; 0 for words that no test has."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes[maybe]
        out[maybe[known]] = at[known] + 1
        return out


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Where the suffixes start, in the order of their first ``depth`` symbols."""
    rank, width = symbols, 1
    while width < depth and len(symbols):
        later = np.zeros_like(rank)
        later[: max(0, len(rank) - width)] = rank[width:]
        kinds, rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)
        if len(kinds) == len(symbols):
            break
        width *= 2
    return np.argsort(rank, kind="stable")


class Shard:
    """The suffix array of the known words of a slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tests: Tests):
        starts, ends, self.bounds = bt.word_spans(data, offsets, bt.MARKS)
        self.tests = tests
        numbers = np.zeros(0, np.int64)
        if len(tests.starts) and len(starts):
            numbers = tests.numbers(bt.segment_hashes(bt.LOWER[data], starts, ends))
        known = numbers > 0
        first, last = known.copy(), known.copy()
        first[1:] &= ~known[:-1]
        last[:-1] &= ~known[1:]
        full = np.flatnonzero(np.diff(self.bounds)) if len(numbers) else np.zeros(0, np.int64)
        heads, tails = self.bounds[full], self.bounds[full + 1] - 1
        first[heads], last[tails] = known[heads], known[tails]
        heads, sizes = np.flatnonzero(first), np.flatnonzero(last) - np.flatnonzero(first) + 1
        heads, sizes = heads[sizes >= tests.least], sizes[sizes >= tests.least]
        self.places = bt.expand(heads, sizes + 1)
        self.symbols = np.zeros(len(self.places), np.int64)
        inside = np.ones(len(self.places), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        self.symbols[inside] = numbers[self.places[inside]]
        self.order = suffix_order(self.symbols, tests.longest)

    def edge(self, low: np.ndarray, high: np.ndarray, words: np.ndarray, depth: int, behind: bool) -> np.ndarray:
        """Of each range, where the symbols at ``depth`` reach the word, or pass it."""
        low, high = low.copy(), high.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            seen = self.symbols[self.order[middle] + depth]
            less = seen <= words[active] if behind else seen < words[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        return low

    def narrowed(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
        """The test suffixes that one more word leaves a range, and their ranges."""
        words = self.tests.words[self.tests.starts[which] + depth]
        if depth == 0:
            edges = np.searchsorted(self.symbols[self.order], np.arange(len(self.tests.vocabulary) + 2))
            low, high = edges[words], edges[words + 1]
        else:
            low, high = self.edge(low, high, words, depth, False), self.edge(low, high, words, depth, True)
        left = low < high
        return which[left], low[left], high[left]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes whose window occurs, and the ranges of its places."""
        which = np.arange(len(self.tests.starts) if len(self.order) else 0)
        low = high = np.zeros(len(which), np.int64)
        found, depth = [(which[:0], low[:0], high[:0])], 0
        while len(which):
            which, low, high = self.narrowed(which, low, high, depth)
            depth += 1
            done = self.tests.window[which] == depth
            found.append((which[done], low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
        return tuple(np.concatenate(x) for x in zip(*found))

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes whose window occurs, the words of their longest match and its first place in the shard."""
        which, low, high = self.windows()
        size, place = np.zeros(len(self.tests.starts), np.int64), np.zeros(len(self.tests.starts), np.int64)
        depth = 0
        waiting = self.tests.window[which]
        while len(which):
            depth += 1
            now = waiting <= depth  # the range of a shorter window waits for its depth
            if now.any():
                size[which[now]] = depth
                heads = self.places[self.order]
                place[which[now]] = np.array([heads[a:b].min() for a, b in zip(low[now], high[now])], np.int64)
                more = now & (self.tests.room[which] > depth)
                kept, a, b = self.narrowed(which[more], low[more], high[more], depth)
                low, high = np.concatenate([low[~now], a]), np.concatenate([high[~now], b])
                which = np.concatenate([which[~now], kept])
                waiting = self.tests.window[which]
        found = np.flatnonzero(size)
        return found, size[found], place[found]

    def rows_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, "right") - 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and the distinct pairs of row and test text with a common window."""
        which, low, high = self.windows()
        size = self.tests.window[which]
        order = np.lexsort((size, low))  # equal windows have equal ranges, and every place has one window of a size
        which, low, high, size = which[order], low[order], high[order], size[order]
        firsts = bt.group_firsts(low, size)
        of_window = np.cumsum(np.bincount(firsts, minlength=len(which))) - 1 if len(which) else firsts
        places = self.places[self.order[bt.expand(low[firsts], (high - low)[firsts])]]
        counts = (high - low)[firsts]
        change = np.zeros(int(self.bounds[-1]) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + np.repeat(size[firsts], counts), -1)
        # Pairs of row and window, then of row and test text.
        rows, windows = distinct(self.rows_of(places), np.repeat(np.arange(len(firsts)), counts))
        windows_texts = distinct(of_window, self.tests.text[which])
        edges = np.searchsorted(windows_texts[0], np.arange(len(firsts) + 1))
        each = edges[windows + 1] - edges[windows]
        texts = windows_texts[1][bt.expand(edges[windows], each)]
        return np.cumsum(change[:-1]) > 0, *distinct(np.repeat(rows, each), texts)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in their order."""
    order = np.lexsort((b, a))
    firsts = order[bt.group_firsts(a[order], b[order])]
    return a[firsts], b[firsts]


def span_lists(hit: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """The runs of hit words of each row, counted from its first word."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(hit)
    firsts, sizes = bt.runs(at, row[at])
    heads = at[firsts] - bounds[row[at[firsts]]]
    edges = np.searchsorted(row[at[firsts]], np.arange(len(bounds)))
    spans = pa.StructArray.from_arrays([pa.array(heads, pa.int32()), pa.array(heads + sizes, pa.int32())], fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)


def blocks(items: DataFrame, item: str, text: str, window: int) -> Iterator[tuple[Tests, list[list[str]]]]:
    """The tests in blocks of a bounded size, and the ids of every text; equal texts of a block are searched once."""
    rows = items.select(F.col(item).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    rows = staged(rows, "tests")
    count = 1 + text_size(rows) // BLOCK_BYTES
    for number in range(count):
        ids: dict[str, list[str]] = {}
        for row in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == number).collect():
            ids.setdefault(row.text, []).extend([row.id] if row.id is not None else [])
        yield Tests(list(ids), window), list(ids.values())
    release(rows)


def searched(docs: DataFrame, tests: Tests, ids: list[list[str]], text: str) -> DataFrame:
    """doc_id, mark, n_words, ``spans`` of hit words and ``items`` of every document for one block of tests."""
    shared = docs.sparkSession.sparkContext.broadcast((tests, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, ids = shared.value
        for batch in bt.slices(batches, text, SHARD_BYTES):
            shard = Shard(*bt.text_bytes(batch.column(text)), tests)
            hit, rows, texts = shard.hits()
            named: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for row, number in zip(rows.tolist(), texts.tolist()):
                named[row].update(ids[number])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(shard.bounds)),
                    span_lists(hit, shard.bounds), pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                ],
                ["doc_id", "mark", "n_words", "spans", "items"],
            )

    rows = docs.select("doc_id", text, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("mark"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, mark string, n_words long, spans {SPANS}, items array<string>")


def merged(spans: list) -> list:
    """Word ranges without overlaps, those that touch as one."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, mark (SHA-256 of the text), n_words, ``spans`` of hit words, ``items`` in their order as strings, of every row."""
    out = None
    union = F.udf(merged, SPANS)
    for tests, ids in blocks(items, item, text, window):
        rows = searched(docs, tests, ids, text)
        if out is None:
            out = staged(rows, "hits")
            continue
        more = rows.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"]).drop("n_words")
        more = staged(more.withColumnsRenamed({"doc_id": "_id", "mark": "_mark", "spans": "_spans", "items": "_items"}), "hits")
        both = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
        spans = union(F.concat("spans", F.coalesce("_spans", F.slice("spans", 1, 0))))
        names = F.array_sort(F.array_union("items", F.coalesce("_items", F.slice("items", 1, 0))))
        new = staged(both.select("doc_id", "mark", "n_words", spans.alias("spans"), names.alias("items")), "hits")
        release(out, more)
        out = new
    return out


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """item_id (as string), item_start, length, doc_id and doc_start of the longest match of every test suffix whose window occurs.

    Positions are words. Of several places the one of the smallest doc_id, then of the first word, is told; shards send one row
    per suffix, so a passage that stands in many documents stays small.
    """
    out = None
    for tests, ids in blocks(items, item, text, window):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bt.slices(batches, text, SHARD_BYTES):
                batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_end"))
                shard = Shard(*bt.text_bytes(batch.column(text)), shared.value)
                which, size, place = shard.longest()
                rows = shard.rows_of(place)
                columns = [pa.array(which), pa.array(size), batch.column("doc_id").take(pa.array(rows)), pa.array(place - shard.bounds[rows])]
                yield pa.RecordBatch.from_arrays(columns, ["suffix", "length", "doc_id", "doc_start"])

        found = docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "suffix long, length long, doc_id long, doc_start long")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_start")
        best = found.groupBy("suffix").agg(F.max("length").alias("length"), F.min_by(place, F.struct(-F.col("length"), place)).alias("at"))
        names = [
            (int(k), name, int(start - tests.bounds[number]))
            for k, (start, number) in enumerate(zip(tests.starts.tolist(), tests.text.tolist())) for name in ids[number]
        ]
        names = docs.sparkSession.createDataFrame(names, "suffix long, item_id string, item_start long")
        rows = staged(names.join(best, "suffix").select("item_id", "item_start", "length", "at.doc_id", "at.doc_start"), "matches")
        out = rows if out is None else out.unionByName(rows)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that hold no window of any test."""
    hits = contamination(docs, items, window, text, item).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), "mark").distinct()
    mine = F.sha2(F.coalesce(docs[text], F.lit("")), 256) == hits["mark"]
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]) & mine, "left_anti")
