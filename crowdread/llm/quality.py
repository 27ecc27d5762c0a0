"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are scaled, mapped to random cosines that approximate a Gaussian kernel, and
fitted to the labels by normal equations summed over partitions. Scores of rows that a fit has
not seen (one fold of four left out) are binned, and pooled adjacent violators over the bins
give a rising map to probabilities.

Rows of the fold ``crc32(doc_id) % 5 = 0`` are never learned from. Only the text is an input of a score. Null
and empty texts have statistics of zero and a score like others. Without labelled rows every score is 0.5.
A row without doc_id is scored and not learned from. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.staging import staged

WAVES = 192
SPREAD = 0.25
RIDGE = 1e-3
PARTS = 16
BINS = 1000
CUT = 0.3
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!?", "point": b".,;:",
    "bar": b"|", "line": b"\n",
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text: sizes, shares of character classes, repetition of words and lines."""
    n = len(offsets) - 1
    starts, ends, bounds = bt.word_spans(data, offsets)
    words = np.diff(bounds).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    per_word = np.maximum(words, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    out = [np.log1p(words), np.diff(np.append(0, np.cumsum(ends - starts))[bounds]) / per_word]
    for chars in CLASSES.values():
        held = np.zeros(256, bool)
        held[list(chars)] = True
        out.append(count(held[data]) / size)
    out.append(count(data >= 0x80) / size)
    hashes = bt.segment_hashes(bt.LOWER[data], starts, ends)
    for width in (1, 3):
        grams = bt.gram_hashes(hashes, width)
        at = np.flatnonzero(bt.inside_rows(bounds, width, len(grams)))
        rows = np.searchsorted(bounds, at, "right") - 1
        order = np.lexsort((grams[at], rows))
        new = bt.group_firsts(rows[order], grams[at][order])
        total, distinct = np.bincount(rows, minlength=n), np.bincount(rows[order][new], minlength=n)
        out.append(1 - distinct / np.maximum(total, 1))
    breaks = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    breaks = breaks[breaks < len(data)]
    rows = np.searchsorted(offsets, breaks, "right") - 1
    tails = np.append(breaks[1:], len(data))
    lines = bt.segment_hashes(data, breaks, tails)
    order = np.lexsort((lines, rows))
    new = bt.group_firsts(rows[order], lines[order])
    total, distinct = np.bincount(rows, minlength=n), np.bincount(rows[order][new], minlength=n)
    out.append(1 - distinct / np.maximum(total, 1))
    upper_words = np.append(0, np.cumsum((data[starts] >= 65) & (data[starts] <= 90)))
    out.append((upper_words[bounds[1:]] - upper_words[bounds[:-1]]) / per_word)
    return np.stack(out, axis=1)


def features(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            values = statistics(*bt.text_bytes(batch.column(text)))
            bounds = np.arange(len(values) + 1) * values.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bt.lists(values.ravel(), bounds)], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, f array<double>")


class Waves:
    """Random cosines of scaled statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, waves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, SPREAD, (len(mean), waves))
        self.phase = rng.uniform(0, 2 * np.pi, waves)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, x, np.ones((len(x), 1))], axis=1)


def rising(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the closest rising means."""
    pools: list[list[float]] = []
    for s, c in zip(sums.tolist(), counts.tolist()):
        pools.append([s, c, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / c) for s, c, n in pools])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("f").flatten(), float).reshape(batch.num_rows, -1)


def fit(rows: DataFrame, waves: int) -> tuple[Waves, np.ndarray, np.ndarray, np.ndarray] | None:
    """Waves, weights and the calibration's knots from rows (f, y, fold)."""
    rows = rows.repartition(PARTS)
    width = rows.select(F.size("f")).first()
    if width is None:
        return None
    moments = rows.agg(*[g(F.col("f")[i]) for i in range(width[0]) for g in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(moments[::2]), np.array(moments[1::2])
    waves_of = Waves(mean, np.where(scale > 1e-9, scale, 1.0), waves)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, fold = waves_of(matrix(batch)), np.asarray(batch.column("y"), float), np.asarray(batch.column("fold"))
            both = np.concatenate([z, y[:, None]], axis=1)
            for k in np.unique(fold).tolist():
                part = both[fold == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fold", "sums"])

    def added(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")  # always in one order, as sums of doubles depend on it
        sums = sum(np.frombuffer(s.as_buffer()) for s in parts.column("sums"))
        return pa.table({"fold": parts.column("fold").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    # One row per fold and part, summed before the driver gets one per fold.
    sent = rows.mapInArrow(equations, "fold int, sums binary").withColumn("part", F.spark_partition_id())
    summed = sent.groupBy("fold").applyInArrow(added, "fold int, sums binary").orderBy("fold").collect()
    folds = {row.fold: np.frombuffer(row.sums).reshape(int((len(row.sums) // 8) ** 0.5), -1) for row in summed}
    total = sum(folds.values())

    def solve(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[:-1, :-1] + RIDGE * max(1.0, sums[-2, -2]) * np.eye(len(sums) - 1), sums[:-1, -1])

    weights = solve(total)
    others = {k: solve(total - s) if len(folds) > 1 else weights for k, s in folds.items()}

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.einsum("ij,ij->i", waves_of(matrix(batch)), np.stack([others[k] for k in batch.column("fold").to_pylist()])) if batch.num_rows else np.zeros(0)
            bins = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(np.asarray(batch.column("y"), float))], ["bin", "y"])

    binned = rows.mapInArrow(unseen, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    bins, sums, counts = (np.array(c, float) for c in zip(*binned))
    return waves_of, weights, (bins + 0.5) / BINS * 2 - 0.5, rising(sums, counts)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", waves: int = WAVES) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of ``CUT``)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = staged(features(docs, text).withColumn("fold", fold.cast("int")), "features")
    truth = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL")
    model = fit(known.filter("fold <> 0").join(truth, "doc_id").select("f", "y", "fold"), waves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                waves_of, weights, knots, heights = model
                score = np.clip(np.interp(waves_of(matrix(batch)) @ weights, knots, heights), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(score)], ["doc_id", "fold", "score"])

    rows = known.mapInArrow(run, "doc_id long, fold int, score double")
    return rows.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
