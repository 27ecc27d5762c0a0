"""Target-distribution importance resampling: documents whose n-grams look like the target's are drawn.

Words are runs of ASCII digits and letters (A-Z in lower case) and of all characters beyond ASCII. The features
of a text are its runs of 1 to ``GRAMS`` consecutive words, joined by one space, repeats counted; a feature falls into the
bucket of its CRC-32. A document is scanned once, in its form with single spaces, storing the running CRC at every word
edge. The CRC of any n-gram follows from those of the two prefixes that end where it starts and ends: CRC-32 is
linear over GF(2), so the shorter prefix, shifted by the n-gram's bytes, cancels out of the longer one.

Bucket counts of all texts are summed per task, then over tasks; gains of the buckets, a table of fixed size, go to all
tasks, which read the texts again. Weights get Gumbel noise from a hash of the id, so the highest scores are a draw without
replacement. Scores are ranked by ranges: rows are dealt by range of their order, numbered within each range
and shifted by the counts of the ranges before.

Null texts have no words: no features, weight 0. A row without doc_id gets a weight, but no score and no rank, and does not
count among the documents that are drawn from. Rows that repeat an id count as documents of their own; equal scores go
by doc_id, then weight. An empty table gives no rows; an empty target has no counts. Of the input, only the id and the text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm.staging import release, staged

GRAMS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
POLYNOMIAL = 0xEDB88320
#: Byte lengths below this are shifted by one table of their own, longer ones bit by bit.
SHORT = 128
SPACED = re.compile(rb"[^ ]+ ")


@cache
def steps() -> np.ndarray:
    """The register after one zero byte, by its lowest byte: the table of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


def by_bytes(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of single bits, as four tables of 256."""
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            out[place] ^= np.where(np.arange(256) >> bit & 1, images[8 * place + bit], 0).astype(np.uint32)
    return out


def applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@cache
def short_shifts() -> np.ndarray:
    """Tables that shift a CRC by 0 to SHORT - 1 zero bytes, one after another."""
    images, out = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(SHORT):
        out.append(by_bytes(images))
        images = steps()[images & 255] ^ (images >> np.uint32(8))
    return np.stack(out)


@cache
def doubling(bit: int) -> np.ndarray:
    """Tables that shift a CRC by 2**bit zero bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    half = short_shifts()[1] if bit == 0 else doubling(bit - 1)
    images = applied(half, images)
    return by_bytes(images if bit == 0 else applied(half, images))


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRCs multiplied by x**(8 size): what they add to the CRC of a text with ``size`` more bytes."""
    flat = short_shifts().reshape(-1)
    at = (sizes % SHORT) * 1024
    out = flat[at + (crcs & 255)] ^ flat[at + 256 + (crcs >> 8 & 255)]
    out ^= flat[at + 512 + (crcs >> 16 & 255)] ^ flat[at + 768 + (crcs >> 24)]
    left, bit = sizes // SHORT, SHORT.bit_length() - 1
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = applied(doubling(bit), out[odd])
        left, bit = left >> 1, bit + 1
    return out


def without_space(crcs: np.ndarray) -> np.ndarray:
    """The CRCs one byte earlier, where that byte was a space."""
    table = steps()
    origin = np.zeros(256, np.uint32)
    origin[table >> 24] = np.arange(256)
    after = crcs ^ np.uint32(0xFFFFFFFF)
    low = origin[after >> 24]
    return (((after ^ table[low]) << np.uint32(8)) | (low ^ np.uint32(32))) ^ np.uint32(0xFFFFFFFF)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words in lower case, each with one space behind it."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    out = bt.LOWER[data[np.minimum(bt.expand(starts, sizes), len(data) - 1)]]
    out[np.cumsum(sizes) - 1] = 32
    return out.tobytes()


def running_crcs(text: bytes, words: int) -> np.ndarray:
    """The CRC of everything before each word, and of the whole text."""
    out, crc = np.zeros(words + 1, np.uint32), 0
    found = []
    for word in SPACED.findall(text):
        crc = crc32(word, crc)
        found.append(crc)
    out[1:] = found
    return out


def grams_of(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(first words, CRCs) of the runs of 1, 2, ... words of each row, and the rows' word offsets."""
    starts, ends, bounds = bt.word_spans(data, offsets, bt.MARKS)
    before = running_crcs(spaced(data, starts, ends), len(starts))
    after, places = without_space(before[1:]), np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = []
    for n in range(1, most + 1):
        heads = np.flatnonzero(bt.inside_rows(bounds, n, max(0, len(starts) - n + 1)))
        sizes = places[heads + n] - 1 - places[heads]
        out.append((heads, after[heads + n - 1] ^ shifted(before[heads], sizes)))
    return out, bounds


def bucket_counts(texts: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; one short row per task and bucket is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in bt.slices(batches, text):
            for _, crcs in grams_of(*bt.text_bytes(batch.column(text)), grams)[0]:
                sums += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    rows = texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share of each bucket over the corpus's, one added to every count."""
    k, of_corpus, of_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (of_corpus + k) / ((s + 1.0) * (of_target + k)))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            found, bounds = grams_of(*bt.text_bytes(batch.column(text)), grams)
            features, weights = np.zeros((2, len(bounds) - 1), np.int64)
            for heads, crcs in found:
                edges = np.searchsorted(heads, bounds)
                sums = np.concatenate([[0], np.cumsum(gains[crcs % np.uint32(len(gains))])])
                features += np.diff(edges)
                weights += sums[edges[1:]] - sums[edges[:-1]]
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(features), pa.array(weights)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), text)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((bits.cast("double") + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """The rows numbered from 1 in an order by column names over all of them; no task holds more than one range of it."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    firsts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", within).join(firsts, "_range").withColumn(out, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Drawn is the floor of ``percent`` of all documents that have an id and ``least_words`` words at least.
    """
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, text))
    weights = staged(weighed(docs, gains, text), "weights")
    scored = weights.withColumn("score", F.col("weight") + noise("doc_id", seed))
    entitled = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = weights.filter((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()).count() * percent // 100
    ranks = ranked(scored.filter(entitled), [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words")])
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.unionByName(scored.filter(~F.coalesce(entitled, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
