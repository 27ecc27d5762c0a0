"""Substring dedup: words of phrases that an earlier document has are removed.

A window of ``WINDOW`` consecutive words is removed where the same words start in a document with a
smaller id. Recurring anchors name the documents that can share a window at all; these are dealt into shards by a hash
of their id. The first document of a shard that has a window asks, in the bucket of equal anchors, whether a document
with a smaller id has it anywhere; windows that are confirmed so, or that a second document of the shard has, are the recurring phrases. Each
shard compiles its phrases into an Aho-Corasick automaton over word numbers, and all its documents are streamed
through it to find every occurrence; no one else tells where the other documents hold them.

Null texts have no words. Texts with fewer words than a window lose nothing. Windows never cross
documents and are judged on the input. A row without doc_id is kept whole and judges nothing. Rows with
one doc_id count as one document: they never judge each other, and each loses the words of its own text that a smaller id has,
so rows that repeat a text lose the same words. Result columns replace input columns of the same name.

Each text of an id is searched once. Word positions of an id's further texts begin at ``base``, behind those of the texts before;
the number of texts of one id is not bounded, and they meet in one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.recurring import deal, recurring_anchors, undeal
from crowdread.llm.staging import release, staged, text_size

WINDOW = 13
GRAM = 7
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 1 << 20
DIGEST_SEED = 1
ALPHABET = 509
NO_SPANS = pa.table(
    {"doc_id": pa.array([], pa.int64()), "mark": pa.array([], pa.string()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
)
#: Texts and anchors are both dealt by shard, which is enough to join them by shard and document.
WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Phrases:
    """Words of a slice, and the anchors of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.bounds = bt.word_spans(data, offsets)
        self.words = bt.segment_hashes(data, self.starts, self.ends)
        grams = bt.gram_hashes(self.words, GRAM)
        width = window - GRAM + 1
        valid = bt.inside_rows(self.bounds, window, max(0, len(grams) - width + 1))
        self.marked, self.least = bt.anchors(grams, width, valid)
        self.grams = grams

    def rows_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, "right") - 1

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows that start at these words."""
        other = bt.segment_hashes(self.data, self.starts, self.ends, DIGEST_SEED)
        return bt.gram_hashes(self.words, self.window, 1)[at], bt.gram_hashes(other, self.window, 2)[at]


def confirm(candidates: DataFrame, buckets: int, window: int, text: str, place_kind: type = np.int32) -> DataFrame:
    """doc_id, start, length and ``own``: runs of windows that recur, at their first occurrence in a shard.

    ``own`` says that a document with a smaller id has them, so they go here too; the others recur within the shard.
    Starts count from the base of the row, and ``place_kind`` holds the largest.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            phrases = Phrases(*bt.text_bytes(batch.column(text)), window)
            recurring = np.asarray(batch.column("anchors").flatten()).view(np.uint64)
            at = np.flatnonzero(np.isin(phrases.least, recurring) & (phrases.least > 0))
            first, second = phrases.digests(at) if len(at) else (np.zeros(0, np.uint64),) * 2
            rows = phrases.rows_of(at)
            ids, base, shard = (np.asarray(batch.column(c))[rows] for c in ("doc_id", "base", "shard"))
            place, anchor = at - phrases.bounds[rows] + base, phrases.least[at]
            order = np.lexsort((place, ids, shard, second, first))
            first, second, shard, ids, place, anchor = (x[order] for x in (first, second, shard, ids, place, anchor))
            heads = bt.group_firsts(first, second, shard)
            ends = np.append(heads[1:], len(ids)) - 1
            numbers, payloads = deal(
                (anchor[heads] % np.uint64(buckets)).astype(np.int64),
                [first[heads], second[heads], ids[heads], place[heads].astype(place_kind)],
            )
            again = heads[ids[ends] != ids[heads]]
            found, at, size = run_rows(ids[again], place[again])
            a, b = len(numbers), len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*numbers, *[-1] * b], pa.int32()),
                    pa.array([*payloads, *[None] * b], pa.binary()),
                    *(pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(x, pa.int64())]) for x in (found, at, size)),
                ],
                ["bucket", "payload", "doc_id", "start", "length"],
            )

    def answer(group: pa.Table) -> pa.Table:
        first, second, ids, place = undeal(group.column("payload").to_pylist(), [np.uint64, np.uint64, np.int64, place_kind])
        order = np.lexsort((ids, second, first))
        first, second, ids, place = first[order], second[order], ids[order], place[order]
        heads = bt.group_firsts(first, second)
        later = ids > np.repeat(ids[heads], np.diff(np.append(heads, len(ids))))
        found, at, size = run_rows(ids[later], place[later].astype(np.int64))
        return pa.table({"doc_id": found, "start": at, "length": size})

    sent = staged(
        candidates.mapInArrow(send, "bucket int, payload binary, doc_id long, start long, length long"), "phrases"
    )
    answered = sent.filter("bucket >= 0").select("bucket", "payload").groupBy("bucket")
    earlier = answered.applyInArrow(answer, "doc_id long, start long, length long").withColumn("own", F.lit(True))
    within = sent.filter("bucket < 0").select("doc_id", "start", "length", F.lit(False).alias("own"))
    out = staged(earlier.unionByName(within), "confirmed")
    release(sent)
    return out


def run_rows(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    firsts, sizes = bt.runs(places, ids)
    return ids[firsts], places[firsts], sizes


def locate(candidates: DataFrame, phrases: DataFrame, shards: int, window: int, text: str) -> DataFrame:
    """doc_id, mark and ``spans``: the word ranges that are covered by a phrase of the document's shard."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or not found.num_rows:
            return NO_SPANS
        docs = docs.combine_chunks()
        data, offsets = bt.text_bytes(docs.column(text))
        starts, ends, bounds = bt.word_spans(data, offsets)
        words = bt.segment_hashes(data, starts, ends)
        plain, exact = letters(words), bt.gram_hashes(words, window).tolist()
        ids, bases = docs.column("doc_id").to_pylist(), docs.column("base").to_pylist()
        rows_of: dict[int, list[tuple[int, int]]] = {}
        for row, (key, base) in enumerate(zip(ids, bases)):
            rows_of.setdefault(key, []).append((base, row))
        # A phrase goes from all documents with at least this id.
        since: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for phrase in found.to_pylist():
            base, row = max(x for x in rows_of[phrase["doc_id"]] if x[0] <= phrase["start"])
            begin = int(bounds[row]) + phrase["start"] - base
            from_id = phrase["doc_id"] + (0 if phrase["own"] else 1)
            for at in range(begin, begin + phrase["length"]):
                known = since.get(exact[at])
                if known is None:
                    automaton.add_word(plain[at : at + window], True)
                if known is None or known > from_id:
                    since[exact[at]] = from_id
        automaton.make_automaton()
        spans = []
        for row, key in enumerate(ids):
            a, b = int(bounds[row]), int(bounds[row + 1])
            heads = (a + end + 1 - window for end, _ in automaton.iter(plain[a:b]))
            tails = np.array([at - a + window - 1 for at in heads if since.get(exact[at], key + 1) <= key], np.int64)
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, tails - window + 1, 1)
            np.add.at(change, tails + 1, -1)
            edges = np.diff(np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0))])
        out = pa.table([docs.column("doc_id"), docs.column("mark"), pa.array(spans, NO_SPANS.schema.field("spans").type)], NO_SPANS.schema)
        return out.filter(pa.array([len(s) > 0 for s in spans], pa.bool_()))

    texts = candidates.select("shard", "doc_id", "mark", "base", text).groupBy("shard")
    found = phrases.withColumn("shard", shard_of(shards)).groupBy("shard")
    return texts.cogroup(found).applyInArrow(run, "doc_id long, mark string, spans array<struct<start:int,end:int>>")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def letters(words: np.ndarray) -> str:
    """Every word as one letter of a small alphabet, so that an automaton's nodes have few children.

    Different words can share a letter, so what the automaton finds is compared by its full hash.
    """
    return (words % np.uint64(ALPHABET) + np.uint64(33)).astype("<u2").tobytes().decode("utf-16-le")


def mark(text: str) -> Column:
    """Tells the texts of one id apart."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def of_row(text: str) -> Column:
    """Which spans s belong to which documents d; spans of ids with a single row have no mark."""
    return (F.col("d.doc_id") == F.col("s.doc_id")) & (F.col("s.mark").isNull() | (F.col("s.mark") == mark(f"d.{text}")))


def each_text_once(rows: DataFrame) -> DataFrame:
    """One row per doc_id and text, with its mark and the base of its word positions."""
    rows = rows.withColumn("mark", mark("text")).dropDuplicates(["doc_id", "mark"])
    before = Window.partitionBy("doc_id").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce(F.length("text"), F.lit(0)) + 1  # a text has at most as many words
    bases = rows.select("doc_id", "mark", F.coalesce(F.sum(room.cast("long")).over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["doc_id", "mark"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, mark and ``spans`` (word ranges, end exclusive) of the documents that lose words; see ``of_row``."""

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phrases = Phrases(data, offsets, window)
        at = np.flatnonzero(phrases.marked)
        return phrases.grams[at], phrases.rows_of(at)

    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    size = text_size(docs)
    buckets, shards = 1 + size // BUCKET_BYTES, 1 + size // SHARD_BYTES
    anchors = recurring_anchors(docs, find, buckets, within=False)
    repeats = staged(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeats")
    columns = ["shard", "doc_id", "text", "anchors", "mark", "base"]
    dealt = docs.filter("doc_id IS NOT NULL").withColumn("shard", shard_of(shards)).repartition("shard")
    once = anchors.join(repeats, "doc_id", "left_anti").withColumn("shard", shard_of(shards)).repartition("shard")
    rows = dealt.join(once, ["shard", "doc_id"]).withColumn("mark", F.lit(None).cast("string")).withColumn("base", F.lit(0).cast("long"))
    rows = rows.select(*columns)
    top, several = 0, None
    if repeats.take(1):
        every = staged(docs.join(anchors.join(repeats, "doc_id", "left_semi"), "doc_id"), "every")
        several = staged(each_text_once(every).withColumn("shard", shard_of(shards)).select(*columns), "several")
        release(every)
        top = several.agg(F.max(F.col("base") + F.length("text"))).first()[0] or 0
        rows = rows.unionByName(several).repartition("shard")
    spark = docs.sparkSession
    before = spark.conf.get(WHOLE_KEYS)
    spark.conf.set(WHOLE_KEYS, "false")
    try:
        candidates = staged(rows.sortWithinPartitions("shard"), "candidates")
    finally:
        spark.conf.set(WHOLE_KEYS, before)
    phrases = confirm(candidates, buckets, window, "text", np.int32 if top < 1 << 31 else np.int64)
    spans = staged(locate(candidates, phrases, shards, window, "text"), "spans")
    release(anchors, repeats, candidates, phrases, *([several] if several is not None else []))
    return spans


def remove_words(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the words outside the spans, joined by one space, and n_words and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "spans")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            data, offsets = bt.text_bytes(batch.column(text))
            starts, ends, bounds = bt.word_spans(data, offsets)
            keep = np.ones(len(starts), bool)
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                for span in spans or ():
                    keep[bounds[row] + span["start"] : bounds[row] + span["end"]] = False
            texts, left = joined(data, starts, ends, bounds, keep)
            n_words = np.diff(bounds)
            columns = [texts if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_words - left, pa.int64())], [*kept, "n_words", "n_removed"]
            )

    both = docs.select(*kept).alias("d").join(spans.alias("s"), of_row(text), "left").select(*[f"d.`{c}`" for c in kept], "s.spans")
    return both.mapInArrow(run, f"{fields}, n_words long, n_removed long")


def joined(data, starts, ends, bounds, keep) -> tuple[pa.Array, np.ndarray]:
    """The kept words of each row joined by one space, and their number."""
    sums = np.concatenate([[0], np.cumsum(keep)])
    left = sums[bounds[1:]] - sums[bounds[:-1]]
    starts, sizes = starts[keep], (ends - starts)[keep] + 1
    row_ends = np.cumsum(left)
    at = bt.expand(starts, sizes)
    plain = data[np.minimum(at, max(0, len(data) - 1))].copy() if len(at) else np.zeros(0, np.uint8)
    word_ends = np.cumsum(sizes)
    plain[word_ends - 1] = 32
    drop = np.ones(len(plain), bool)
    drop[word_ends[row_ends[left > 0] - 1] - 1] = False
    edges = np.concatenate([[0], word_ends])[np.concatenate([[0], row_ends])]
    edges = edges - np.concatenate([[0], np.cumsum(left > 0)])
    plain = plain[drop]
    return (
        pa.Array.from_buffers(pa.string(), len(left), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes())]),
        left,
    )


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All documents without the words that repeat an earlier document."""
    return remove_words(docs, repeated_spans(docs, window, text), text)
