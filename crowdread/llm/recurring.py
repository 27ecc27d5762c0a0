"""Anchors of texts that recur elsewhere, found with one entry per slice and anchor.

A window of text has an anchor: its least gram hash. Equal windows have equal anchors, so a window
that recurs has a recurring anchor. Each slice of documents sends an anchor once, whatever number of
its documents hold it, to the bucket of that anchor, and the bucket says whether another slice has
it. So a passage that a third of all documents share costs one entry per task, not one per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.staging import release, staged

MOST_SENT = 1 << 20
Find = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def deal(buckets: np.ndarray, fields: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The entries packed per bucket: each field's values, one field after another."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    firsts = bt.group_firsts(buckets)
    ends = np.append(firsts[1:], len(buckets))
    fields = [f[order] for f in fields]
    return buckets[firsts].tolist(), [b"".join(f[a:b].tobytes() for f in fields) for a, b in zip(firsts, ends)]


def undeal(payloads: list[bytes], kinds: list) -> list[np.ndarray]:
    """The fields of all packed entries."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for payload in payloads:
        n, at = len(payload) // width, 0
        for part, kind in zip(parts, kinds):
            part.append(np.frombuffer(payload, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def recurring_anchors(docs: DataFrame, find: Find, buckets: int, within: bool, text: str = "text") -> DataFrame:
    """doc_id and ``anchors``, the document's anchors that recur.

    ``find`` gives the anchors of a slice and the rows that hold them. With ``within`` an anchor that
    occurs twice in one document recurs, else it has to occur in two documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)
        for batch in bt.slices(batches, text):
            values, rows = find(*bt.text_bytes(batch.column(text)))
            ids = np.asarray(batch.column("doc_id"))[rows]
            order = np.lexsort((ids, values))
            values, ids = values[order], ids[order]
            firsts = bt.group_firsts(values)
            sizes = np.diff(np.append(firsts, len(values)))
            low, high, anchor = ids[firsts], ids[firsts + sizes - 1], values[firsts]
            many = (sizes > 1) if within else (low != high)
            old = np.isin(anchor, sent)
            if len(sent) < MOST_SENT:
                sent = np.concatenate([sent, anchor[many & ~old]])
            numbers, payloads = deal(
                (anchor[~old] % np.uint64(buckets)).astype(np.int64), [anchor[~old], low[~old], (~many[~old]).astype(np.uint8)]
            )
            known = np.repeat(many | old, sizes)
            values, ids = values[known], ids[known]
            firsts = bt.group_firsts(values, ids)
            values, ids = values[firsts], ids[firsts]
            a, b = len(numbers), len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*numbers, *[-1] * b], pa.int32()),
                    pa.array([*payloads, *[None] * b], pa.binary()),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(ids, pa.int64())]),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(bt.signed(values))]),
                ],
                ["bucket", "payload", "doc_id", "anchor"],
            )

    def answer(group: pa.Table) -> pa.Table:
        values, ids, asks = undeal(group.column("payload").to_pylist(), [np.uint64, np.int64, np.uint8])
        order = np.lexsort((ids, values))
        values, ids, asks = values[order], ids[order], asks[order]
        firsts = bt.group_firsts(values)
        sizes = np.diff(np.append(firsts, len(values)))
        many = sizes > 1 if within else ids[firsts] != ids[firsts + sizes - 1]
        hit = np.repeat(many, sizes) & (asks > 0)
        return pa.table({"doc_id": ids[hit], "anchor": bt.signed(values[hit])})

    plain = docs.select(F.col("doc_id").cast("long"), text).filter("doc_id IS NOT NULL")
    entries = staged(plain.mapInArrow(send, "bucket int, payload binary, doc_id long, anchor long"), "anchors")
    answered = entries.filter("bucket >= 0").select("bucket", "payload").groupBy("bucket").applyInArrow(answer, "doc_id long, anchor long")
    known = entries.filter("bucket < 0").select("doc_id", "anchor")
    out = answered.unionByName(known).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    out = staged(out, "recurring")
    release(entries)
    return out
