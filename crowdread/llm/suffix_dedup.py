"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed.

A string of LENGTH bytes has an anchor, its least gram hash, at the same place in each of its occurrences,
so only suffixes at recurring anchors need sorting. Per bucket of anchors, the suffixes are sorted deep and
shallow: multikey quicksort on eight-byte keys to a shallow depth, then blind tries order the groups that
still agree. The order and its common prefixes give a tree of suffixes; within each node that
is deep enough, the order of the reversed bytes before the anchors tells how far a match reaches
to the left, and both sides together cover LENGTH bytes or not.

Only the strings that have a place as their anchor count there, which bounds its surroundings to less than LENGTH bytes
on either side. Surroundings that are equal are one class, found by 128-bit digests: a class of two or
more recurs whole, and one suffix stands for it. Only anchors with several classes of which one occurs once are sorted.

Anchors with more than ``MOST`` such classes are decided by the digests of the strings that start before them
(counted over all documents with partial sums), which leaves no group unbounded and drops nothing.

Null and empty texts have no bytes. Matches never cross documents and are judged on the input. A row without
doc_id is kept whole and judges nothing; rows that repeat a doc_id and its text count as one document, and rows of one doc_id
with different texts as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.recurring import deal, recurring_anchors, undeal
from crowdread.llm.staging import release, staged, text_size

LENGTH = 400
GRAM = 32
SHALLOW = 32
MOST = 3000
BUCKET_BYTES = 16 << 20
PLACE = ["anchor", "first", "second", "doc_id", "at", "left", "right", "many"]


class Anchors:
    """Gram hashes of a slice and the places that are least in some string of ``length`` bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        up, down = bt.powers_for(len(data) + 1)
        sums = np.append(np.uint64(0), np.cumsum(bt.byte_values(3)[data] * up[: len(data)]))
        size = max(0, len(data) - GRAM + 1)
        self.values = bt.mix((sums[GRAM : GRAM + size] - sums[:size]) * down[:size]) if size else np.zeros(0, np.uint64)
        width = length - GRAM + 1
        valid = bt.inside_rows(offsets, length, max(0, size - width + 1))
        marked, self.least = bt.anchors(self.values, width, valid)
        self.at = np.flatnonzero(marked)
        self.rows = np.searchsorted(offsets, self.at, "right") - 1
        self.width, self.length = width, length

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First start and last end of the strings that have these places as anchors.

        The windows around a place without a smaller value are neighbours, so their starts are one run of ``least``.
        """
        firsts = bt.group_firsts(self.least)
        ends = np.append(firsts[1:], len(self.least))
        low, open_, run = at - self.width + 1, np.arange(len(at)), np.zeros(len(at), np.int64)
        run[:] = np.searchsorted(firsts, np.maximum(low, 0), "right") - 1
        while len(open_):
            open_ = open_[self.least[firsts[run[open_]]] != self.values[at[open_]]]
            run[open_] += 1
        return np.maximum(firsts[run], low), np.minimum(ends[run] - 1, at) + self.length


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders strings by a trie that keeps only the depths at which they part."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, number: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        node = self.root  # blind descent: letters between the kept depths are not looked at
        while isinstance(node, tuple):
            depth, children = node
            key = text[depth] if depth < len(text) else -1
            node = children.get(key) or next(iter(children.values()))
        other = self.strings[node[0]]
        split = common(text, other)
        if split == len(text) == len(other):
            node.append(number)
            return
        key, old = (x[split] if split < len(x) else -1 for x in (text, other))
        parent, place, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < split:
            parent, place = node, text[node[0]] if node[0] < len(text) else -1
            node = parent[1][place]
        if isinstance(node, tuple) and node[0] == split:
            node[1][key] = [number]
            return
        new = (split, {old: node, key: [number]})
        if parent is None:
            self.root = new
        else:
            parent[1][place] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Suffix order: three-way quicksort on eight bytes at a time to SHALLOW bytes, then blind tries."""
    done: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            done += group
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for number in group:
                trie.insert(number)
            done += trie.order()
        else:
            keys = {i: strings[i][depth : depth + 8] for i in group}
            pivot = keys[group[len(group) // 2]]
            less, same, more = [], [], []
            for i in group:
                (same if keys[i] == pivot else less if keys[i] < pivot else more).append(i)
            stack += [(more, depth), (same, depth + 8 if len(pivot) == 8 else SHALLOW), (less, depth)]
    return done


def reaches(before: list[bytes], after: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each suffix, how far matches with others that cover ``length`` bytes reach to its left and right.

    All matches of a suffix hold its anchor, so together they cover one range; (0, 0) without a match.
    """
    order = deep_shallow(after)
    depths = [common(after[a], after[b]) for a, b in zip(order, order[1:])]
    out = [(0, 0)] * len(order)

    def node(first: int, last: int, depth: int) -> None:
        """All suffixes order[first:last] share ``depth`` bytes."""
        if depth + max(len(before[i]) for i in order[first:last]) < length:
            return
        mine = sorted(order[first:last], key=lambda i: before[i])
        left = [0] * len(mine)
        for k in range(len(mine) - 1):
            n = common(before[mine[k]], before[mine[k + 1]])
            left[k], left[k + 1] = max(left[k], n), n
        for i, n in zip(mine, left):
            if n + depth >= length:
                out[i] = (max(out[i][0], n), max(out[i][1], depth))

    # The nodes of the suffix tree are the maximal ranges whose common prefixes are at least their depth.
    open_nodes: list[tuple[int, int]] = []
    for k in range(len(order)):
        depth = depths[k] if k < len(depths) else -1
        first = k
        while open_nodes and open_nodes[-1][0] > depth:
            value, first = open_nodes.pop()
            node(first, k + 1, value)
        if depth >= 0 and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, first))
    return out


def places(candidates: DataFrame, length: int) -> DataFrame:
    """Recurring anchors with digests of the strings around them: anchor, first, second, doc_id, at, reach to the
    left and right, and ``many``, how often a slice has these surroundings.

    Each slice sends equal surroundings once. If it has them twice, they recur, and rows without ``many`` hold
    their byte ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text"):
            data, offsets = bt.text_bytes(batch.column("text"))
            found = Anchors(data, offsets, length)
            recurring = np.asarray(batch.column("anchors").flatten()).view(np.uint64)
            keep = np.isin(found.values[found.at], recurring)
            if not keep.any():
                continue
            at, rows = found.at[keep], found.rows[keep]
            anchor = found.values[at]
            low, high = found.reach(at)
            left, right = at - low, high - at
            first, second = (bt.segment_hashes(data, at - left, at + right, seed) for seed in (21, 22))
            first ^= bt.mix(left.astype(np.uint64) + np.uint64(1))
            fields = [anchor, first, second, np.asarray(batch.column("doc_id"))[rows], at - offsets[rows], left, right]
            order = np.lexsort((second, first, anchor))
            anchor, first, second, ids, at, left, right = (x[order] for x in fields)
            heads = bt.group_firsts(anchor, first, second)
            sizes = np.diff(np.append(heads, len(anchor)))
            twice = np.repeat(sizes > 1, sizes)
            hit, start, end = merged(ids[twice], (at - left)[twice], (at + right)[twice])
            n, m = len(heads), len(hit)
            none, zero = pa.nulls(m, pa.int64()), np.zeros(m, np.int64)
            columns = [pa.concat_arrays([pa.array(bt.signed(x[heads])), none]) for x in (anchor, first, second)]
            columns += [pa.array(np.append(x[heads], y)) for x, y in ((ids, hit), (at, start), (left, zero), (right, end - start))]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.array(sizes), none])], PLACE)

    return candidates.mapInArrow(run, ", ".join(f"{c} long" for c in PLACE))


def merged(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of byte ranges per document."""
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    number = np.cumsum(np.append(0, ids[1:] != ids[:-1]))[: len(ids)] << 40
    reached = np.maximum.accumulate(number + ends) - number if len(ids) else ends
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > reached[:-1])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(ids))[: len(firsts)] - 1
    return ids[firsts], starts[firsts], reached[lasts]


def contexts(asked: DataFrame, buckets: int) -> DataFrame:
    """The suffixes to sort: per bucket, the anchor, place, bytes before (reversed) and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text"):
            data, offsets = bt.text_bytes(batch.column("text"))
            plain, lists = data.tobytes(), batch.column("places")
            rows = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            at, anchor, single, left, right = (lists.flatten().field(i) for i in range(5))
            place = np.asarray(at) + offsets[rows]
            before = [plain[a:p][::-1] for p, a in zip(place.tolist(), (place - np.asarray(left)).tolist())]
            after = [plain[p:b] for p, b in zip(place.tolist(), (place + np.asarray(right)).tolist())]
            bucket = (np.asarray(anchor).view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket), anchor, pa.array(np.asarray(batch.column("doc_id"))[rows]), at, single,
                    pa.array(before, pa.binary()), pa.array(after, pa.binary()),
                ],
                ["bucket", "anchor", "doc_id", "at", "single", "before", "after"],
            )

    schema = "bucket int, anchor long, doc_id long, at long, single boolean, before binary, after binary"
    return asked.mapInArrow(run, schema)


def match_group(group: pa.Table, length: int) -> pa.Table:
    """doc_id, start and end (bytes) of the matches of one bucket of anchors, for the suffixes that occur once."""
    ids, at, anchor = (np.asarray(group.column(c)) for c in ("doc_id", "at", "anchor"))
    before, after = (group.column(c).to_pylist() for c in ("before", "after"))
    by_anchor: dict[int, list[int]] = {}
    for i, key in enumerate(anchor.tolist()):
        by_anchor.setdefault(key, []).append(i)
    left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for rows in by_anchor.values():
        found = reaches([before[i] for i in rows], [after[i] for i in rows], length)
        left[rows], right[rows] = np.array(found).T
    hit = (right > 0) & group.column("single").to_numpy(zero_copy_only=False)
    return pa.table({"doc_id": ids[hit], "start": (at - left)[hit], "end": (at + right)[hit]})


def frequent_matches(candidates: DataFrame, anchors: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, start, end of repeated strings whose anchors occur very often, by digests of the strings.

    Each slice sends a string once, so a string that all documents hold costs one entry per slice.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text"):
            data, offsets = bt.text_bytes(batch.column("text"))
            found = Anchors(data, offsets, length)
            often = np.asarray(batch.column("often").flatten()).view(np.uint64)
            starts = np.flatnonzero(np.isin(found.least, often) & (found.least > 0))
            digests = [bt.segment_hashes(data, starts, starts + length, seed) for seed in (11, 12)]
            rows = np.searchsorted(offsets, starts, "right") - 1
            ids, place = np.asarray(batch.column("doc_id"))[rows], starts - offsets[rows]
            order = np.lexsort((place, ids, digests[1], digests[0]))
            a, b, ids, place = digests[0][order], digests[1][order], ids[order], place[order]
            firsts = bt.group_firsts(a, b)
            sizes = np.diff(np.append(firsts, len(a)))
            numbers, payloads = deal(
                (a[firsts] % np.uint64(buckets)).astype(np.int64), [a[firsts], b[firsts], ids[firsts], place[firsts], (sizes == 1).astype(np.uint8)]
            )
            twice = np.repeat(sizes > 1, sizes)
            hit, first, last = byte_runs(ids[twice], place[twice], length)
            n, m = len(numbers), len(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*numbers, *[-1] * m], pa.int32()), pa.array([*payloads, *[None] * m], pa.binary()),
                    *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (hit, first, last)),
                ],
                ["bucket", "payload", "doc_id", "start", "end"],
            )

    def answer(group: pa.Table) -> pa.Table:
        a, b, ids, place, asks = undeal(group.column("payload").to_pylist(), [np.uint64, np.uint64, np.int64, np.int64, np.uint8])
        order = np.lexsort((b, a))
        a, b, ids, place, asks = a[order], b[order], ids[order], place[order], asks[order]
        firsts = bt.group_firsts(a, b)
        sizes = np.diff(np.append(firsts, len(a)))
        hit = np.repeat(sizes > 1, sizes) & (asks > 0)
        return pa.table(dict(zip(("doc_id", "start", "end"), byte_runs(ids[hit], place[hit], length))))

    wide = candidates.select("doc_id", "text", F.explode("anchors").alias("anchor")).select("doc_id", "anchor").join(anchors, "anchor")
    each = wide.groupBy("doc_id").agg(F.collect_list("anchor").alias("often"))
    rows = candidates.select("doc_id", "text").join(each, "doc_id")
    sent = staged(rows.mapInArrow(send, "bucket int, payload binary, doc_id long, start long, end long"), "strings")
    answered = sent.filter("bucket >= 0").select("bucket", "payload").groupBy("bucket").applyInArrow(answer, "doc_id long, start long, end long")
    return answered.unionByName(sent.filter("bucket < 0").select("doc_id", "start", "end"))


def byte_runs(ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges covered by runs of neighbouring string starts."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    firsts, sizes = bt.runs(starts, ids)
    return ids[firsts], starts[firsts], starts[firsts] + sizes - 1 + length


def mark_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def each_text_its_own_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The distinct texts, each under an id of its own, and own_id, doc_id and mark of those whose doc_id has several rows."""
    repeats = staged(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeats")
    if not repeats.take(1):
        release(repeats)
        return docs, None
    top = docs.agg(F.max("doc_id")).first()[0]
    texts = docs.join(repeats, "doc_id", "left_semi").withColumn("mark", mark_of("text")).dropDuplicates(["doc_id", "mark"])
    texts = staged(texts, "repeated-texts")
    own = (F.lit(top + 1) + F.monotonically_increasing_id()).alias("own_id")
    named = staged(texts.select("doc_id", "mark", own), "own-ids")
    several = texts.join(named, ["doc_id", "mark"]).select(F.col("own_id").alias("doc_id"), "text")
    return docs.join(repeats, "doc_id", "left_anti").unionByName(several), named


def repeated_bytes(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """doc_id, ``spans`` (start, end), the merged byte ranges that recur, and mark, which tells the texts of an id with several rows apart."""

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = Anchors(data, offsets, length)
        return found.values[found.at], found.rows

    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    docs, named = each_text_its_own_id(docs)
    buckets = 1 + text_size(docs) // BUCKET_BYTES
    anchors = recurring_anchors(docs, find, buckets, within=True)
    candidates = staged(docs.join(anchors, "doc_id"), "candidates")
    sent = staged(places(candidates, length), "places")
    entries = sent.filter("many IS NOT NULL")
    key = ["anchor", "first", "second"]
    # All firsts are of one row, and all rows of a class have the same surroundings.
    classes = entries.groupBy(*key).agg(F.sum("many").alias("n"), *[F.first(c).alias(c) for c in PLACE[3:7]])
    classes = staged(classes, "classes")
    whole = entries.filter("many = 1").join(classes.filter("n > 1").select(*key), key)
    span = ["doc_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")]
    found = sent.filter("many IS NULL").select(*span).unionByName(whole.select(*span))
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    kinds = staged(kinds.filter("kinds > 1 AND fewest = 1").select("anchor", "kinds"), "kinds")
    often = kinds.filter(F.col("kinds") > MOST).select("anchor")
    rare = classes.join(kinds.filter(F.col("kinds") <= MOST), "anchor")
    rare = rare.groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor", (F.col("n") == 1).alias("single"), "left", "right")).alias("places"))
    suffixes = contexts(candidates.select("doc_id", "text").join(rare, "doc_id"), 16 * buckets)
    ranges = suffixes.groupBy("bucket").applyInArrow(lambda t: match_group(t, length), "doc_id long, start long, end long")
    found = found.unionByName(ranges)
    if often.take(1):
        found = found.unionByName(frequent_matches(candidates, often, length, buckets))
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    if named is None:
        spans = spans.withColumn("mark", F.lit(None).cast("string"))
    else:
        spans = spans.withColumnRenamed("doc_id", "own_id").join(named, "own_id", "left")
        spans = spans.select(F.coalesce("doc_id", "own_id").alias("doc_id"), "spans", "mark")
    out = staged(spans, "spans")
    release(anchors, candidates, sent, classes, kinds)
    return out


def remove_bytes(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs) and ``kept``, the other bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            data, offsets = bt.text_bytes(batch.column(text))
            change = np.zeros(len(data) + 1, np.int64)
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                for span in spans or ():
                    change[offsets[row] + span["start"]] += 1
                    change[offsets[row] + span["end"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            first[heads] = gone[heads]
            sums, run_sums = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(first))
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            edges = (offsets - sums[offsets]).astype(np.int32)
            kept = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data[~gone].tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(run_sums[offsets[1:]] - run_sums[offsets[:-1]]), kept],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows, found = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).alias("d"), spans.alias("s")
    mine = (F.col("d.doc_id") == F.col("s.doc_id")) & (F.col("s.mark").isNull() | (F.col("s.mark") == mark_of("d.text")))
    both = rows.join(found, mine, "left").select("d.doc_id", F.col("d.text").alias(text), "s.spans")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """All documents without the bytes that recur."""
    return remove_bytes(docs, repeated_bytes(docs, length, text), text)
