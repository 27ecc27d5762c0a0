import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdread.llm import bytetext as bt
from crowdread.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most=3):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


def counts(texts, buckets=10_000):
    out = Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[0])
    return [out[b] for b in range(buckets)]


def brute(docs, items, percent=5):
    s, t = counts([d[1] for d in docs]), counts(items)
    gains = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for key, text in docs:
        found, n = features(text)
        weight, score = sum(gains[zlib.crc32(f.encode()) % 10_000] for f in found), None
        if key is not None:
            h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, n, len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, row in enumerate(able[: len(able) * percent // 100]):
        row[5] = rank + 1
    return sorted(map(tuple, rows), key=repr)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉx7中") for _ in range(rng.randint(1, 4)))
    docs = [(0, None), (1, ""), (2, " .,"), (3, "A" * 70_000 + " b c"), (4, " ".join(word() for _ in range(9000))), (None, "x y z " * 20)]
    docs += [(10 + i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*docs, docs[-1], docs[-1]], [docs[7][1], docs[9][1].upper(), None, "word " * 40]


def resampled(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, weight int, score string").repartition(4)
    right = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return sorted((tuple(r) for r in im.resampled(left, right, **options).collect()), key=repr)


@pytest.mark.parametrize("slice_bytes, percent", [(2 << 20, 5), (300, 60)])
def test_equals_brute_force(spark, monkeypatch, slice_bytes, percent):
    monkeypatch.setattr(im.bt.slices, "__defaults__", (slice_bytes,))
    docs, items = texts()
    assert resampled(spark, docs, items, percent=percent) == brute(docs, items, percent)


def test_empty_tables(spark):
    docs, items = texts()
    assert resampled(spark, [], items) == []
    assert resampled(spark, docs, []) == brute(docs, [])


def test_crcs_of_substrings():
    rng = random.Random(3)
    rows = ["".join(rng.choice("aZ é9.\n") for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(80)]
    rows += ["y" * 100_000 + " " + "z" * 5000 + " q", "a", ""]
    found, bounds = im.grams_of(*bt.text_bytes(pa.array(rows)), 4)
    for n, (heads, crcs) in enumerate(found, 1):
        want = [zlib.crc32(f.encode()) for r in rows for f in features(r, 4)[0] if f.count(" ") == n - 1]
        assert crcs.tolist() == want and len(heads) == len(want)


def test_shifts():
    crcs = np.array([0, 1, 0xFFFFFFFF, 0x12345678] * 5, np.uint32)
    sizes = np.repeat([0, 1, 127, 128, 70_001], 4)
    for crc, size, got in zip(crcs.tolist(), sizes.tolist(), im.shifted(crcs, sizes).tolist()):
        assert got == zlib.crc32(bytes(size), crc) ^ zlib.crc32(bytes(size))


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9) if i % 3 else 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(7)
    got = {r.id: r["rank"] for r in im.ranked(df, [F.desc("score"), F.asc("id")]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
