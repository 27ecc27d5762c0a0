import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from crowdread.llm import prefix_trie as pt
from crowdread.llm.queries import REBUILT_FROM, REBUILT_SHARED, REBUILT_TURNS

SCHEMA = "conv_id long, turn long, role string, text string, turns string, key int"


def in_order(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            out.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t[2] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {n: [m for m in nodes if m[: len(n)] == n] for n in nodes}
    out = []
    for n, members in nodes.items():
        kids = [m for m in below[n] if len(m) == len(n) + 1]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(n))
        out.append((
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids),
            sum(not any(len(k) == len(m) + 1 for k in below[m]) for m in below[n]),
            sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below[n] if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def made(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return pt.sequences(df)


def nodes(conversations):
    return sorted((tuple(r) for r in pt.trie(conversations).collect()), key=repr)


def some(seed, n, turns=4, words="ab"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        rows += [(c, k, rng.choice(["user", None]), rng.choice([*words, None])) for k in range(rng.randint(1, turns))]
    rows += [(None, 1, "user", "a"), (5000, None, "user", "a"), (5000, 3, "user", "é"), (5000, 3, "user", "é"), (5000, 3, "a", "b")]
    rows += [(6000 + i, k, "user", "ab"[k % 2]) for i in range(40) for k in range(3)]  # copies
    rows += [(7000, k, "user", "a") for k in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, piece, parts", [(1 << 16, 1 << 15, 1), (3, 4, 4), (1, 1, 37), (1 << 16, 2, 8)])
def test_equals_brute_force(spark, monkeypatch, block, piece, parts):
    monkeypatch.setattr(pt, "BLOCK_ROWS", block)
    monkeypatch.setattr(pt, "PIECE_IDS", piece)
    monkeypatch.setattr(pt, "FAN_BITS", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, words in ((1, "ab"), (2, "abcdefghijkl")):
            rows = some(seed, 60, words=words)
            assert nodes(made(spark, rows)) == brute(in_order(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rebuilt(spark):
    rows = some(3, 80, 8)
    convs = made(spark, rows)
    again = pt.rebuilt(convs, REBUILT_SHARED, REBUILT_FROM, REBUILT_TURNS)
    assert nodes(again) == brute(rebuilt(in_order(rows)))
    own = [(c, t, "user", f"{c}") for c in (3, 14) for t in range(2)]  # their sources are absent, and few turns are left
    again = pt.rebuilt(made(spark, own), REBUILT_SHARED, REBUILT_FROM, REBUILT_TURNS)
    assert nodes(again) == brute(rebuilt(in_order(own)))


def test_one_conversation_and_none(spark):
    one = [(9, 0, "user", "hi")]
    assert nodes(made(spark, one)) == brute(in_order(one))
    assert nodes(made(spark, [])) == []
    empty = made(spark, one).withColumn("turns", F.slice("turns", 1, 0))
    assert nodes(empty) == brute({9: []})


def test_common_prefixes():
    import numpy as np

    rng = random.Random(5)
    rows = sorted([rng.randint(0, 2) for _ in range(rng.randint(0, 5))] for _ in range(200))
    turns = np.array([(t, 7) for r in rows for t in r], np.uint64)
    bounds = np.cumsum([0, *map(len, rows)])
    want = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(rows, rows[1:])]
    assert pt.common_prefixes(turns, bounds).tolist() == want
