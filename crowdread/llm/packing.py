"""Packing of tokenised documents into training sequences by best fit, decreasing.

A document's ids and its end id are cut into full windows and one rest. Each full window is a
sequence; rests are packed in bounded groups of documents: longest first, each into the open window
with the tightest room, found in a segment tree indexed by remaining capacity.

Null and empty texts have the end id alone. Texts of any length are encoded whole. Repeated rows are
packed as rows of their own, an empty table gives an empty one, and only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.byte_bpe import Encoder, PerfectHash, known_words

WINDOW = 2048
GROUP_DOCS = 20_000


class Capacity:
    """Segment tree over remaining capacities: how many open windows have each capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.open[room].append(bin_id)
        self.change(room, 1)

    def change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, taken out."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self.change(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first; equal lengths in their given order."""
    rooms, bins, offsets, used = Capacity(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        taken = rooms.take(need)
        if taken is None:
            taken, used = (window, used), used + 1
        room, bins[i] = taken
        offsets[i] = window - room
        if room > need:
            rooms.add(room - need, int(bins[i]))
    return bins, offsets


@lru_cache(maxsize=2)
def loaded(text: str):
    """The tokenizer of a JSON text, read once per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of the full windows and the rest of each document."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = loaded(shared.value)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def encode(words: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

        known = known_words(sha256(shared.value.encode()).hexdigest())
        encoder = Encoder(PerfectHash([b"\0"]), np.array([tokenizer.encode("\0").ids[0]]), encode, known)
        for batch in bt.slices(batches, text):
            column = batch.column(text)
            data, offsets = bt.text_bytes(column)
            ids, bounds = encoder.encode(data, offsets)
            # A text that holds the string of a special token is encoded by the library as a whole.
            plain = data.tobytes()
            whole = {}
            if any(s.encode() in plain for s in special):
                for i, value in enumerate(column.to_pylist()):
                    if value and any(s in value for s in special):
                        whole[i] = np.array(tokenizer.encode(value, add_special_tokens=False).ids, np.int32)
            out: list[list] = [[], [], [], [], []]
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                mine = np.append(whole.get(i, ids[bounds[i] : bounds[i + 1]]), end_id).astype("<u4")
                for start in range(0, len(mine), window):
                    piece = mine[start : start + window]
                    for values, value in zip(out, (key, start, len(piece), zlib.crc32(piece.tobytes()), len(mine))):
                        values.append(value)
            key = pa.array(out[0], batch.schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([key, *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", text).mapInArrow(run, schema)


def pack(cut: DataFrame, window: int = WINDOW, groups: int = 1) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` ids.

    Pieces are dealt to ``groups`` by a hash of the whole row, so groups stay even; each is packed by
    itself, and ids of sequences carry the group, so they differ everywhere.
    """
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    cut = cut.select(*names).withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_group")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last")
        bins, offsets = best_fit(rows["length"].to_numpy(), window)
        group = int(rows["_group"].iloc[0])
        return rows.drop(columns="_group").assign(sequence_id=(group << 32) + bins, offset=offsets)

    return cut.groupBy("_group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """All documents as pieces with their places; ``group_docs`` documents share a packing group."""
    groups = max(1, -(-docs.count() // group_docs))
    return pack(pieces(docs, tokenizer_path, window), window, groups)
