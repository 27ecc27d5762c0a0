"""Conversation prefix trie: union-find over the common-prefix edges of sorted neighbours, deepest edges first.

A conversation is the sequence of its turns (role, text), a turn is told by 128 bits of SHA-256, and a node of the trie is a distinct
sequence of first turns. Conversations are dealt by ranges of their sequences and sorted, so that the members of a node
stand together. Within a block of a range, equal sequences are one; the edges between neighbours, each as deep as
their common prefix, are taken in descending depth, and every union of two components makes, or widens, the branching node of that
depth. Chains of nodes between branching nodes follow from the component's size.

Only the nodes on the paths of a block's first and last sequence can go on in a neighbouring block. They are contracted:
what is closed below them is added up, and the rest, two paths a block, is merged with the neighbours', ``FAN`` forests at a
time, until one forest is left. A merge closes every node that is not on the outer paths of its forests. Parents that
were open are joined to their children by (range, prefix). Ids that end at an open node are hashed in order, as a stream of pieces.

Turns are ordered by turn, null first, then by digest, so rows that repeat a turn count as turns of their own in a fixed order.
Null roles and texts are empty. Rows without conv_id belong to no conversation. An empty table has no nodes, not even the root.
A conversation's digests and sizes, 24 bytes a turn, have to fit in one row; its texts stay behind. Only the four columns of
turns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.staging import release, staged

BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 16 << 20
#: Blocks of a range are told by this many bits; ``FAN_BITS`` of forests are merged at a time.
BLOCK_BITS = 20
FAN_BITS = 4
PIECE_IDS = 1 << 15
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Closed nodes, open nodes, and pieces of the ids that end at open nodes.
CLOSED, OPENED, ENDS = 0, 1, 2
TABLE = pa.schema(
    [("kind", pa.int32()), ("range", pa.int64()), ("key", pa.binary()), ("parent", pa.binary())]
    + [(x, pa.int64()) for x in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "forest", "size")]
    + [("left", pa.bool_()), ("right", pa.bool_()), ("ends", pa.string()), ("piece", pa.int64())]
)
FIELDS = ", ".join(f"`{f.name}` {dict(int32='int', int64='long', bool='boolean').get(str(f.type), f.type)}" for f in TABLE)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns`` in their order, each as digest (hex) and size of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))


def rebuilt(conversations: DataFrame, shared: str, source: str, most: int) -> DataFrame:
    """Conversations that begin with the first ``shared`` turns (``most`` at most) of conversation ``source``, then go on with their own.

    ``shared`` and ``source`` are SQL expressions of conv_id.
    """
    heads = conversations.select(F.col("conv_id").alias("source"), F.slice("turns", 1, most).alias("head"))
    rows = conversations.withColumn("shared", F.expr(shared).cast("int")).withColumn("source", F.expr(source))
    rows = rows.join(heads, "source", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def common_prefixes(turns: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many first turns each sequence has in common with the one before; ``turns`` is two words a turn."""
    sizes = np.diff(bounds)
    most = np.minimum(sizes[1:], sizes[:-1])
    here, there = bt.expand(bounds[1:-1], most), bt.expand(bounds[:-2], most)
    differs = np.flatnonzero((turns[here] != turns[there]).any(axis=1))
    ends = np.cumsum(most)
    at = np.searchsorted(differs, ends - most)
    first = np.append(differs, len(here))[at]
    return np.minimum(first, ends) - (ends - most)


class Forest:
    """The branching and ending nodes of a block of sorted sequences."""

    def __init__(self, ids: np.ndarray, turns: np.ndarray, sizes: np.ndarray, bounds: np.ndarray):
        lengths = np.diff(bounds)
        common = common_prefixes(turns, bounds) if len(ids) > 1 else np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate([[True], (common < lengths[1:]) | (lengths[1:] != lengths[:-1])]))
        self.ids, self.turns, self.sizes = ids, turns, sizes
        self.begins, self.ends = bounds[:-1][new], np.append(new, len(ids))
        # Nodes 0 .. n - 1 are the ends of the distinct sequences; further ones are made by unions.
        self.n = n = len(new)
        self.depth = lengths[new].tolist()
        self.count = np.diff(self.ends).tolist()
        self.least = np.minimum.reduceat(ids, new).tolist()
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.low, self.high = list(range(n)), list(range(n))  # the sequences that go through the node
        edges = common[new[1:] - 1]
        self.root = self.union(np.argsort(-edges, kind="stable").tolist(), edges.tolist())

    def union(self, order: list[int], edges: list[int]) -> int:
        """Takes the edges in their order and returns the root."""
        head, node = list(range(self.n)), list(range(self.n))

        def find(i: int) -> int:
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        for e in order:
            a, b = find(e), find(e + 1)
            node[a] = self.joined(node[a], node[b], edges[e])
            head[b] = a
        top = node[find(0)]
        return top if self.depth[top] == 0 else self.made(0, [top])

    def made(self, depth: int, children: list[int]) -> int:
        self.depth.append(depth)
        self.count.append(sum(self.count[c] for c in children))
        self.least.append(min(self.least[c] for c in children))
        self.children.append(children)
        self.low.append(min(self.low[c] for c in children))
        self.high.append(max(self.high[c] for c in children))
        return len(self.depth) - 1

    def joined(self, a: int, b: int, depth: int) -> int:
        """The node of this depth above both components."""
        if self.depth[a] > depth and self.depth[b] > depth:
            return self.made(depth, [a, b])
        if self.depth[a] > depth:
            a, b = b, a
        self.children[a].extend(self.children[b] if self.depth[b] == depth else [b])
        self.count[a] += self.count[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        return a

    def path(self, sequence: int) -> list[bytes]:
        """The keys of all prefixes of a sequence."""
        begin, out = int(self.begins[sequence]), [b""]
        for turn in self.turns[begin : begin + self.depth[sequence]]:
            out.append(hashlib.sha256(out[-1] + turn.tobytes()).digest()[:DIGEST])
        return out

    def members(self, v: int) -> list[int]:
        """Ids of the conversations that end at a node."""
        return self.ids[self.ends[v] : self.ends[v + 1]].tolist() if v < self.n else []

    def rows(self, place: int, forest: int) -> Iterator[tuple]:
        """Closed nodes, open ones and pieces of ids, in the columns of ``TABLE``."""
        paths = {True: self.path(0), False: self.path(self.n - 1)}
        order, above, outer = [self.root], {self.root: None}, {self.root: (True, True)}
        for v in order:  # grows while it is read
            for c in self.children[v]:
                above[c] = v
                outer[c] = (outer[v][0] and self.low[c] == 0, outer[v][1] and self.high[c] == self.n - 1)
            order.extend(self.children[v])
        leaves, saved = {}, {}
        for v in reversed(order):
            parent, (left, right) = above[v], outer[v]
            up = -1 if parent is None else self.depth[parent]
            below = [c for c in self.children[v] if not any(outer[c])]
            n_leaves, sums = sum(leaves[c] for c in below), sum(saved[c] for c in below)
            begin, count, least = int(self.begins[self.low[v]]), self.count[v], self.least[v]
            for depth in range(self.depth[v], up, -1):
                size = int(self.sizes[begin + depth - 1]) if depth else 0
                bottom = depth == self.depth[v]
                if left or right:
                    keys = paths[left]
                    sums_here = (len(below), n_leaves, sums) if bottom else (0, 0, 0)
                    before = keys[depth - 1] if depth else None
                    yield OPENED, place, keys[depth], before, depth, least, None, count, *sums_here, forest, size, left, right, None, None
                    continue
                n_leaves = n_leaves or 1
                sums += (count - 1) * size
                before, of_parent = None, least
                if depth == up + 1:
                    before, of_parent = (paths[outer[parent][0]][up], None) if any(outer[parent]) else (None, self.least[parent])
                ends = hashlib.sha256(",".join(map(str, self.members(v))).encode()).hexdigest() if bottom else NOTHING
                n_children = len(self.children[v]) if bottom else 1
                yield CLOSED, place, None, before, depth, least, of_parent, count, n_children, n_leaves, sums, *[None] * 4, ends, None
            leaves[v], saved[v] = n_leaves, sums
            if left or right:
                ids = self.members(v)
                for piece, at in enumerate(range(0, len(ids), PIECE_IDS)):
                    some = ",".join(map(str, ids[at : at + PIECE_IDS]))
                    yield ENDS, place, paths[left][self.depth[v]], *[None] * 8, forest, *[None] * 3, some, piece


def as_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield as_batch(held, schema)
            held = []
    yield as_batch(held, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def forests(conversations: DataFrame) -> DataFrame:
    """The forests of all blocks: closed nodes, open ones, and pieces of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, number = [], 0, 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield from of_block(held, number)
                    held, rows, size, number = [], 0, 0, number + 1
        if held:
            yield from of_block(held, number)

    def of_block(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held).combine_chunks()
        data, offsets = bt.text_bytes(block.column("key"))
        sizes = np.asarray(block.column("sizes").combine_chunks().flatten(), np.int64)
        turns = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
        place = block.column("range")[0].as_py()
        forest = Forest(np.asarray(block.column("conv_id")), turns, sizes, offsets // DIGEST)
        yield from as_batches(forest.rows(place, (place << BLOCK_BITS) + number), TABLE)

    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    dealt = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return staged(dealt.withColumn("range", F.spark_partition_id().cast("long")).mapInArrow(run, FIELDS), "forests")


def merged(opened: DataFrame, bits: int, last: bool) -> DataFrame:
    """Forests that share the upper bits of their number become one; the last merge closes all nodes."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select([f.name for f in TABLE if f.name != "group"]).to_pylist()
        first, final = min(r["forest"] for r in rows), max(r["forest"] for r in rows)
        nodes: dict[bytes, dict] = {}
        for row in rows:
            left = row["left"] and row["forest"] == first and not last
            right = row["right"] and row["forest"] == final and not last
            node = nodes.get(row["key"])
            if node is None:
                nodes[row["key"]] = row | {"left": left, "right": right, "forest": first >> bits}
                continue
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            node["left"], node["right"] = node["left"] or left, node["right"] or right
        for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
            if node["left"] or node["right"]:
                continue
            node["kind"] = CLOSED
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
            parent = nodes.get(node["parent"]) if node["depth"] else None
            if parent is not None:
                parent["n_children"] += 1
                parent["n_leaves"] += node["n_leaves"]
                parent["saved_tokens"] += node["saved_tokens"]
                if not (parent["left"] or parent["right"]):
                    node["parent"], node["parent_conv_id"] = None, parent["conv_id"]
        return pa.Table.from_pylist(list(nodes.values()), TABLE)

    grouped = opened.withColumn("group", F.shiftright("forest", bits)).groupBy("group")
    return staged(grouped.applyInArrow(run, FIELDS), "forests")


def ends_of(pieces: DataFrame) -> DataFrame:
    """The hash of the ids of every key, read as a stream in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, some in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key != now:
                    if state is not None:
                        keys.append(now)
                        hashes.append(state.hexdigest())
                    now, state = key, hashlib.sha256(some.encode())
                else:
                    state.update(b"," + some.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "hashed"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "hashed"])

    return pieces.repartition("key").sortWithinPartitions("key", "forest", "piece").select("key", "ends").mapInArrow(run, "key binary, hashed string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of conversations (conv_id, turns); see ``sequences`` and ``rebuilt``.

    conv_id is the smallest member, parent_conv_id that of the node one turn shorter, n_convs the members, n_leaves and
    saved_tokens are over the node's subtree, ends_sha256 is the hash of the ids of the conversations that end there.
    """
    blocks = forests(conversations)
    tables, bits, opened = [blocks], BLOCK_BITS, blocks.filter(F.col("kind") == OPENED)
    while True:
        top = opened.agg(F.max(F.shiftright("forest", bits))).first()[0]
        if top is None:  # no conversations
            break
        tables.append(merged(opened, bits, top == 0))
        if top == 0:
            break
        opened, bits = tables[-1].filter(F.col("kind") == OPENED), FAN_BITS
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    late = tables[0].limit(0)
    for table in tables[1:]:
        late = late.unionByName(table.filter(F.col("kind") == CLOSED))
    late = staged(late, "closed")
    release(*tables[1:])
    hashed = ends_of(blocks.filter(F.col("kind") == ENDS))
    late = late.join(hashed, "key", "left").withColumn("ends", F.coalesce("hashed", F.lit(NOTHING))).drop("hashed")
    here = blocks.filter(F.col("kind") == OPENED).select("range", "key").distinct()
    known = here.join(late.select("key", F.col("conv_id").alias("above")), "key").select("range", F.col("key").alias("parent"), "above")
    closed = blocks.filter(F.col("kind") == CLOSED).unionByName(late)
    waiting = closed.filter("parent IS NOT NULL").join(known, ["range", "parent"]).withColumn("parent_conv_id", F.col("above"))
    done = closed.filter("parent IS NULL").unionByName(waiting.drop("above"))
    return done.select(*columns, F.col("ends").alias("ends_sha256"))
