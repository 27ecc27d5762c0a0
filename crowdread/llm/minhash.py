"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set has its distinct word shingles, hashed once to 64 bits; its sketch keeps the k least
hashes. Documents with one set are one class, found by a digest, and one row stands for it from there on.
Inverted lists of retained values (neighbouring pairs of the least ``RANKS`` values, so that a common passage does not put
all its documents in one list) give candidates. First each list is compared with its least
document only, which joins groups of copies in linear work: a candidate passes if the union of both sketches shares enough
values, and is a link if the full sets confirm it. Then documents of a list that lie in different components are compared within
the list, three times over what is left of it: by the least ``FEW`` values, by whole sketches, by full sets. Each pair
is compared in one list alone, that of the least key the two share, and no pairs are written: the first two
steps tell which documents of a list stay, the last one tells the links that join components.

A list of more than ``LONG`` documents is not compared as it is, as its pairs grow with its square. Its documents are listed anew by single values
of their whole sketches, the most frequent ones last, as many as two sketches that pass cannot both do without. A value
that no other of these documents has so opens no list, so documents that share a common passage and nothing else do not meet. No pair that would pass is lost.

Lists are kept apart by classes of set size. Sets of at most ``KEPT`` shingles are whole in their sketches and
compared exactly, however large their union. For larger sets, a pair passes down to five standard deviations below the least similarity, so the chance to reject one there is about 1e-6, and that no list holds a pair about 1e-8;
no list is cut, and what is still longer than ``BLOCK`` is compared block by block.

Empty and null texts have no shingles and no links. A row without doc_id is its own component. Very
long texts are hashed whole. Repeated rows fall in one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.components import components
from crowdread.llm.staging import release, staged

KEPT = 192
FEW = 48
RANKS = 12
BLOCK = 512
#: Documents of a list beyond which it is replaced by lists of rare values.
LONG = 8
#: Values whose numbers of documents every task knows, and documents up to which a value is not one of them.
KNOWN, LIGHT = 1 << 18, 64
#: Rows of a matrix of pairs that are judged at once.
ROWS = 128
#: Shingles of the full sets of a block, and columns of a product.
ELEMENTS = 1_000_000
COLUMNS = 4096
#: Pairs per document from which a group's full sets are compared all at once.
DENSE = 4
HUB_PARTS = 64
#: Fixed values of xxHash64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the set offsets of the rows."""
    data = bt.LOWER[data]
    starts, ends, bounds = bt.word_spans(data, offsets)
    words = bt.segment_hashes(data, starts, ends)
    grams = bt.gram_hashes(words, width)
    at = np.flatnonzero(bt.inside_rows(bounds, width, len(grams)))
    rows = [np.searchsorted(bounds, at, "right") - 1]
    values = [grams[at]]
    counts = np.diff(bounds)
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            rows.append(few)
            values.append(bt.gram_hashes(words, n, 100 + n)[bounds[:-1][few]])
    rows, values = np.concatenate(rows), np.concatenate(values) >> np.uint64(1)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    firsts = bt.group_firsts(rows, values)
    return values[firsts], np.searchsorted(rows[firsts], np.arange(len(counts) + 1))


def sketches(docs: DataFrame, width: int, text: str) -> DataFrame:
    """doc_id, n (set size), digest_a and digest_b of the set, ``low``, its least
    hashes, and ``least``, the upper halves of its KEPT least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            values, bounds = shingle_sets(*bt.text_bytes(batch.column(text)), width)
            sums = [np.cumsum(np.append(np.uint64(0), bt.mix(values ^ np.uint64(s)))) for s in (0, 0x5BD1E995)]
            digests = [bt.signed(x[bounds[1:]] - x[bounds[:-1]]) for x in sums]
            sizes = np.diff(bounds)
            parts = []
            for most in (RANKS + 2, KEPT):
                kept = np.minimum(sizes, most)
                parts.append((values[bt.expand(bounds[:-1], kept)].astype(np.int64), np.append(0, np.cumsum(kept))))
            low, least = bt.lists(*parts[0]), bt.lists((parts[1][0] >> 32).astype(np.int32), parts[1][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *map(pa.array, digests), low, least],
                ["doc_id", "n", "digest_a", "digest_b", "low", "least"],
            )

    schema = "doc_id long, n long, digest_a long, digest_b long, low array<long>, least array<int>"
    return docs.select("doc_id", text).mapInArrow(run, schema)


def shared_in_union(a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the union of two sketches, how many values there are and how many are in both.

    Where a sketch is not the whole set, only the least values count, as many as one sketch keeps.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    kept, real = np.where(whole, both.shape[1], a.shape[1]), both < np.iinfo(np.int32).max
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, axis=1)
    twice = real & ~new & (rank <= kept[:, None])
    return np.minimum(rank[:, -1], kept), twice.sum(axis=1)


def padded(column: pa.Array, most: int = KEPT, kind: type = np.int32) -> np.ndarray:
    """Lists as rows of ``most`` values, filled up with the greatest value."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    out = np.full((len(sizes), most), np.iinfo(kind).max, kind)
    inside = np.arange(most) < sizes[:, None]
    out[inside] = np.asarray(column.flatten())
    return out


def least_shared(kept: int, percent: int) -> int:
    """Shared values of a union sketch, five standard deviations below those of the least similarity."""
    p = percent / 100
    return int(kept * p - 5 * (kept * p * (1 - p)) ** 0.5)


def alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may belong to sets of this similarity."""
    whole = np.maximum(n_a, n_b) <= a.shape[1]
    size, shared = shared_in_union(a, b, whole)
    enough = np.where(whole, 100 * (shared + 1) >= percent * size, shared >= least_shared(a.shape[1], percent))
    return enough & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def star_pairs(lists: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): each list's least document with the others, where their sketches pass."""
    centers = lists.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).filter("a < last")
    pairs = lists.join(centers.select("key", "a"), "key").filter("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    first = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("least").alias("least_a"))
    second = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("least").alias("least_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(batch.column(c)) for c in ("n_a", "n_b")]
            good = alike(padded(batch.column("least_a")), padded(batch.column("least_b")), *sizes, percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def full_sets(needed: DataFrame, docs: DataFrame, width: int, text: str) -> DataFrame:
    """doc_id and ``members``, the whole set, of the documents that are needed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            values, bounds = shingle_sets(*bt.text_bytes(batch.column(text)), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bt.lists(values.astype(np.int64), bounds)], ["doc_id", "members"])

    # The same plan at every size: ids may be many, so they are not broadcast.
    texts = docs.select("doc_id", text).join(needed.distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return staged(texts.mapInArrow(sets, "doc_id long, members array<long>"), "sets")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, ascending, are as similar as is asked."""
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def hub_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. The set of a is sent once per part of its partners, not once per pair."""
    members = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, width, text)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)))
    hubs = dealt.select("a", "part", F.col("a").alias("doc_id")).distinct().withColumn("hub", F.lit(0))
    rows = dealt.select("a", "part", F.col("b").alias("doc_id"), F.lit(1).alias("hub")).unionByName(hubs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, ids, kind = (np.asarray(batch.column(c)) for c in ("a", "doc_id", "hub"))
            flat, ends = np.asarray(batch.column("members").flatten()), list_ends(batch.column("members"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                mine = flat[ends[i] : ends[i + 1]]
                if kind[i] == 0:
                    hub, hub_set = a[i], mine.copy()
                else:
                    assert hub == a[i]
                    good[i] = similar(mine, hub_set, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(ids[good])], ["a", "b"])

    sent = rows.join(members, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "hub")
    links = staged(sent.mapInArrow(run, "a long, b long"), "links")
    release(members)
    return links


def list_ends(column: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)))


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of one 64-bit value, as Spark's function of that name computes it."""
    one, two, three, four, five = (np.uint64(p) for p in PRIMES)
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    out = (seed + five + np.uint64(8)) ^ (turned(x * two, 31) * one)
    out = turned(out, 27) * one + four
    out = (out ^ (out >> np.uint64(33))) * two
    out = (out ^ (out >> np.uint64(29))) * three
    return out ^ (out >> np.uint64(32))


def list_keys(low: pa.Array, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the lists of each row, and the rows; the same as the column of keys."""
    flat, ends = np.asarray(low.flatten()).view(np.uint64), list_ends(low)
    row = np.repeat(np.arange(len(low)), np.diff(ends))
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in (1, 2):
        at = np.flatnonzero(row[: len(row) - gap] == row[gap:]) if len(row) > gap else np.zeros(0, np.int64)
        both = hash_long(flat[at + gap], hash_long(flat[at], np.full(len(at), 42, np.uint64)))
        for more in (0, 1):
            kind = (size_class[row[at]] + more).astype(np.int64).view(np.uint64)
            keys.append(hash_long(kind, both).view(np.int64))
            rows.append(row[at])
    return np.concatenate(keys), np.concatenate(rows)


class Group:
    """Documents of one list, or of two blocks of one, and which pairs of them are to be compared here.

    A pair is compared if its components differ, if the list is the one of the least key among those that both are in,
    and, between two blocks, if it has a document of each.
    """

    def __init__(self, rows: pa.Table):
        self.ids, self.components, self.n = (np.asarray(rows.column(c)) for c in ("doc_id", "component", "n"))
        self.right, self.inner = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("right", "inner"))
        key, rare = rows.column("key")[0].as_py(), rows.column("rare").combine_chunks()
        if key in (rare[0].as_py() or ()):
            keys, owner = np.asarray(rare.flatten()), np.repeat(np.arange(len(rare)), np.diff(list_ends(rare)))
        else:
            keys, owner = list_keys(rows.column("low").combine_chunks(), np.asarray(rows.column("size_class")))
        below = keys < key
        open_ = self.components[:, None] != self.components
        if not self.inner[0]:
            open_ &= self.right[:, None] != self.right
        self.open = np.triu(open_, 1)
        if self.open.any():
            self.open &= shared_values(keys[below], owner[below], len(self.ids)) == 0


def shared_values(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows share (exact, as less than 2**24); a value stands at most once in a row."""
    kinds, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    common = counts > 1
    place = (np.cumsum(common) - 1)[inverse]
    keep = common[inverse]
    place, rows = place[keep], rows[keep]
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    total = np.zeros((n, n), np.float32)
    for at in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(place, (at, at + COLUMNS))
        holds = np.zeros((n, min(COLUMNS, int(common.sum()) - at)), np.float32)
        holds[rows[a:b], place[a:b] - at] = 1
        total += holds @ holds.T
    return total


def by_list(compare):
    """Calls ``compare`` with the rows of each list, which come one after another in the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            firsts = bt.group_firsts(np.asarray(rows.column("list")))
            yield from (out for a, b in zip(firsts, firsts[1:]) if (out := compare(rows.slice(a, b - a))) is not None)
            rest = rows.slice(int(firsts[-1]))
        if rest is not None and (out := compare(rest)) is not None:
            yield out

    return run


def open_rows(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, doc_id) of lists that hold several components, with ``component`` and ``total``, the documents of the list."""
    named = lists.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_lists = named.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("total"))
    return named.join(open_lists.filter("first < last").select("key", "total"), "key")


def rare_values(needed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """doc_id and ``rare``: the keys of the values of each needed document's sketch by which alone it is compared.

    Of two sketches that pass, each holds ``bound`` values of the other, so in one order of all values their first common one
    is among the first ``held - bound + 1`` of each. Frequent values come last, by how many needed documents have them: those of more than
    ``total / KNOWN``, of which there are fewer than ``KNOWN`` however many documents there are. The others come by value. Only the first ones are written, and of
    them those that one document has are left out.
    """
    most = max(1, least_shared(KEPT, percent))
    held = reps.join(needed.distinct(), "doc_id", "left_semi").select("doc_id", "n", F.array_distinct("least").alias("held"))
    enough = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("n") * percent / 100).cast("int") - 1))
    bound = F.when(F.col("n") <= KEPT, enough).otherwise(most)
    held = staged(held.select("doc_id", F.greatest(F.size("held") - bound + 1, F.lit(1)).alias("first"), "held"), "held")
    total = held.agg(F.sum(F.size("held"))).first()[0] or 0
    docs = held.select(F.explode("held").alias("value")).groupBy("value").agg(F.count("*").alias("docs"))
    known = docs.filter(F.col("docs") > max(LIGHT, total // KNOWN)).orderBy("value").toArrow()
    frequent, times = (np.asarray(known.column(c)) for c in ("value", "docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = np.asarray(batch.column("held").flatten()), list_ends(batch.column("held"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            docs = np.zeros(len(flat), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                docs = np.where(frequent[at] == flat, times[at], 0)
            order = np.lexsort((flat, docs, row))
            order = order[np.arange(len(flat)) - ends[row] < np.asarray(batch.column("first"))[row]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[order])), pa.array(flat[order])], ["doc_id", "value"])

    first = staged(held.mapInArrow(run, "doc_id long, value int"), "first-values")
    common = first.groupBy("value").agg(F.count("*").alias("docs")).filter("docs > 1").select("value")
    key = F.xxhash64(F.lit("rare"), "value")
    rare = staged(first.join(common, "value").groupBy("doc_id").agg(F.collect_list(key).alias("rare")), "rare")
    release(held, first)
    return rare


def in_groups(lists: DataFrame, labels: DataFrame, values: DataFrame, whole: bool) -> DataFrame:
    """The rows of lists (key, doc_id) that hold several components, dealt so that a task gets a list, or two blocks of one, at once.

    ``values`` has doc_id, n, low, size_class, rare and ``held``, what is compared. A list of more than BLOCK documents, or whose
    ``whole`` sets have more than ELEMENTS shingles, is cut into blocks, and each pair of blocks is a group of its own.
    """
    rows = open_rows(lists, labels) if "total" not in lists.columns else lists
    rows = rows.withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    if whole:
        sizes = rows.join(values.select("doc_id", "n"), "doc_id").groupBy("key").agg(F.sum("n").alias("weight"))
        rows = rows.join(sizes, "key").withColumn("blocks", F.greatest("blocks", F.ceil(F.col("weight") / ELEMENTS).cast("int")))
    rows = rows.join(values, "doc_id")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("list"), "key",
        (F.col("mine") > F.col("other")).alias("right"), (F.col("mine") == F.col("other")).alias("inner"),
        "doc_id", "component", "n", "low", "size_class", "rare", "held",
    )
    return rows.repartition("list").sortWithinPartitions("list")


def open_members(lists: DataFrame, labels: DataFrame, reps: DataFrame, kept: int, percent: int) -> DataFrame:
    """The rows (key, doc_id) of lists that stay: documents with a partner in the list whose first ``kept`` values may be similar enough.

    No pair leaves a task, only the documents that have one, so what is written grows with the lists and not with their pairs.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        group = Group(rows)
        if not group.open.any():
            return None
        least, n = rows.column("held").combine_chunks(), group.n
        owner = np.repeat(np.arange(len(n)), np.asarray(pc.list_value_length(least), np.int64))
        shared = shared_values(np.asarray(least.flatten()), owner, len(n))
        stay = np.zeros(len(n), bool)
        for at in range(0, len(n), ROWS):  # few rows of the matrix at a time
            mine, both = n[at : at + ROWS, None], shared[at : at + ROWS]
            whole = (mine <= kept) & (n <= kept)
            good = np.where(whole, 100 * (both + 1) >= percent * (mine + n - both), both >= least_shared(kept, percent))
            good &= group.open[at : at + ROWS] & (100 * np.minimum(mine, n) >= percent * np.maximum(mine, n))
            stay |= good.any(axis=0)
            stay[at : at + ROWS] |= good.any(axis=1)
        if not stay.any():
            return None
        keys = np.full(int(stay.sum()), rows.column("key")[0].as_py(), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(group.ids[stay])], ["key", "doc_id"])

    values = reps.select("doc_id", "n", "low", "size_class", "rare", F.slice("least", 1, kept).alias("held"))
    found = in_groups(lists, labels, values, False).mapInArrow(by_list(compare), "key long, doc_id long")
    return staged(found.distinct(), "open")


def group_links(lists: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, text: str) -> DataFrame:
    """Links (a, b) within lists, by the full sets: of each group as many as join its components, no more."""

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        group = Group(rows)
        a, b = np.nonzero(group.open)
        if not len(a):
            return None
        held, n = rows.column("held").combine_chunks(), group.n
        flat, ends = np.asarray(held.flatten()), list_ends(held)
        if len(a) > DENSE * len(n):
            shared = shared_values(flat, np.repeat(np.arange(len(n)), np.diff(ends)), len(n))
            good = 100 * shared[a, b] >= percent * (n[a] + n[b] - shared[a, b])
            a, b = a[good], b[good]
            tested = True
        else:
            tested = False
        head = {c: c for c in group.components.tolist()}

        def find(c: int) -> int:
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        links = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(int(group.components[i])), find(int(group.components[j]))
            if x != y and (tested or similar(flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]], percent)):
                head[x] = y
                links.append((int(group.ids[i]), int(group.ids[j])))
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    members = full_sets(lists.select("doc_id"), docs, width, text)
    values = members.withColumnRenamed("members", "held").join(reps.select("doc_id", "n", "low", "size_class", "rare"), "doc_id")
    found = in_groups(lists, labels, values, True).mapInArrow(by_list(compare), "a long, b long")
    links = staged(found, "links")
    release(members)
    return links


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included) and kept."""
    docs = docs.select(F.col("doc_id").cast("long"), text)
    known = staged(sketches(docs, width, text), "sketches")
    sets = known.filter("n > 0 AND doc_id IS NOT NULL")
    digest = ["digest_a", "digest_b", "n"]
    classes = staged(sets.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    # Sets that differ more in size cannot be similar: a list holds two neighbouring classes of sizes (a little wider
    # than the similarity asks, for rounding), and a document is in both lists that hold its class.
    size_class = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).alias("size_class")
    reps = staged(reps.select("doc_id", "n", "low", "least", size_class), "representatives")
    # Sets of which one more or less shingle is too much have links only within their class.
    smallest = -(-percent // (100 - percent))
    keys = F.flatten(F.transform("low", lambda v, i: F.flatten(F.transform(
        F.slice("low", i + 2, 2),
        lambda w: F.array(F.xxhash64(v, w, F.col("size_class")), F.xxhash64(v, w, F.col("size_class") + 1)),
    ))))
    lists = staged(reps.filter(F.col("n") >= smallest).select("doc_id", F.explode(F.array_distinct(keys)).alias("key")), "lists")
    pairs = staged(star_pairs(lists, reps, percent), "stars")
    links = hub_links(pairs, docs, width, percent, text)
    first = staged(components(links), "components")
    labels = first.select(F.col("node").alias("doc_id"), "component")
    open_ = staged(open_rows(lists, labels), "open-rows")
    release(lists, pairs)
    long = F.col("total") > LONG
    rare = rare_values(open_.filter(long).select("doc_id"), reps, percent)
    listed = reps.join(rare, "doc_id", "left")
    few = open_members(open_.filter(~long), labels, listed, FEW, percent)
    both = few.unionByName(rare.select("doc_id", F.explode("rare").alias("key")))
    left = open_members(both, labels, listed, KEPT, percent)
    links = links.union(group_links(left, labels, listed, docs, width, percent, text))
    final = staged(components(links), "components").select(F.col("node").alias("rep"), "component")
    release(open_, rare, few, left, first, reps)
    rows = known.select("doc_id", *digest).join(classes, digest, "left").join(final, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
