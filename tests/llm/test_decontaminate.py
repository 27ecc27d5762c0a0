import random
import re

import numpy as np
import pyarrow as pa
import pytest

from crowdread.llm import bytetext as bt
from crowdread.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, n=10):
    windows = {}
    for name, text in items:
        w = words_of(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for key, text in docs:
        w, hit, names = words_of(text), set(), set()
        for size in range(1, n + 1):
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((key, len(w), sorted(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=repr)


def tables(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉx7") for _ in range(rng.randint(1, 3)))
    line = lambda n: [word() for _ in range(n)]
    passages = [line(k) for k in (1, 9, 10, 11, 25, 60)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    items += [(7, "the " * 30), (8, "the the the"), (100, None), (101, " .,- "), (None, " ".join(line(12))), (3, " ".join(line(15)))]
    items += [(9, items[4][1]), (9, items[4][1]), (10, items[5][1].upper())]
    docs = [(0, None), (1, ""), (2, "..."), (3, "the " * 500), (4, " ".join(line(5000))), (None, items[4][1]), (6, items[-5][1] + " x")]
    for i in range(120):
        parts = [line(rng.randint(0, 20)), rng.choice(passages), line(rng.randint(0, 9)), rng.choice(passages)[: rng.randint(1, 60)]]
        docs.append((10 + i, rng.choice([" ", "-", ".\n"]).join(sum(parts, []))))
    return docs + [docs[9], docs[9], (10, "other text " + items[2][1])], items


def found(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, items int").repartition(4)
    right = spark.createDataFrame([(*t, 0) for t in items], "item_id long, text string, doc_id int")
    rows = dc.contamination(left, right, **options).collect()
    hits = lambda r: sorted(i for s in r.spans for i in range(s.start, s.end))
    return sorted(((r.doc_id, r.n_words, hits(r), r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize("shard, block", [(4 << 20, 8 << 20), (300, 8 << 20), (4 << 20, 300)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, items = tables()
    assert found(spark, docs, items) == brute(docs, items)


def test_other_windows(spark):
    docs, items = tables(2)
    assert found(spark, docs, items, window=4) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = tables()
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, docs, [(1, None), (2, "")]) == brute(docs, [])
    assert found(spark, [], items) == []


def test_suffixes_are_in_order():
    docs, items = tables()
    tests = dc.Tests([t or "" for _, t in items], 10)
    shard = dc.Shard(*bt.text_bytes(pa.array([t for _, t in docs])), tests)
    breaks = np.flatnonzero(shard.symbols == 0)

    def suffix(i):
        return shard.symbols[i : breaks[np.searchsorted(breaks, i)]][: tests.longest].tolist()

    suffixes = [suffix(i) for i in shard.order]
    assert sorted(shard.order) == list(range(len(shard.symbols)))
    assert suffixes == sorted(suffixes)


def test_longest_matches(spark):
    docs, items = tables(3)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = dc.longest_matches(left, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.item_id, r.item_start, r.length, r.doc_id, r.doc_start) for r in rows}
    want, texts = set(), [(k, words_of(t)) for k, t in docs]
    for name, text in set(items):
        w = words_of(text)
        for start in range(len(w) - min(10, len(w)) + 1 if w and name is not None else 0):
            best = None
            for key, words in texts:
                for i in range(len(words)):
                    size = 0
                    while start + size < len(w) and i + size < len(words) and w[start + size] == words[i + size]:
                        size += 1
                    if size >= min(10, len(w)):
                        mine = (-size, key is None, key or 0, i)
                        best = mine if best is None else min(best, mine)
            if best:
                want.add((str(name), start, -best[0], None if best[1] else best[2], best[3]))
    assert got == want


def test_removal(spark):
    docs, items = tables()
    left = spark.createDataFrame([(*d, "m") for d in docs], "doc_id long, text string, mark string")
    rows = dc.decontaminated(left, spark.createDataFrame(items, "item_id long, text string"))
    assert rows.columns == left.columns
    clean = {(k, text) for k, text in docs if not brute([(k, text)], items)[0][2]}
    assert {(r.doc_id, r.text) for r in rows.collect()} == clean
