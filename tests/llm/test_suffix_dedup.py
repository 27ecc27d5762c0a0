import random
from collections import Counter

import pytest

from crowdread.llm import queries, suffix_dedup as sd


def brute(rows, length=400):
    raw = {k: (t or "").encode() for k, t in rows}
    counts = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def texts():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    long = [noise(k) for k in (200, 399, 400, 401, 700, 2000)]
    docs = [None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 600, noise(5000), long[2], long[2], long[4] * 2]
    for _ in range(90):
        pieces = []
        for _ in range(3):
            p = rng.choice(long)
            a = rng.randint(0, len(p) // 2)
            pieces += [noise(rng.randint(0, 300)), p[a : a + rng.randint(100, 2000)]]
        docs.append("".join(pieces))
    return list(enumerate(docs))


@pytest.mark.parametrize("most, slice_bytes", [(3000, 2 << 20), (5, 2 << 20), (3000, 3000)])
def test_equals_brute_force(spark, monkeypatch, most, slice_bytes):
    monkeypatch.setattr(sd, "MOST", most)
    monkeypatch.setattr(sd.bt.slices, "__defaults__", (slice_bytes,))
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_spans int, at string").repartition(4)
    assert result(sd.dedup(docs)) == brute(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert result(sd.dedup(queries.table(spark, sf, "documents"))) == brute(rows)


def test_order_of_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    strings += [b"a" * n for n in range(100)] + [b"ab" * 50 + bytes([n]) for n in range(50)]
    order = sd.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "x" * 500), (3, "y" * 100), (3, "y" * 100)], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.dedup(docs).collect()) == [0, 0, 0]
    assert sd.dedup(docs.filter("false")).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two = noise(500), noise(600)
    rows = [(1, noise(50) + one), (4, one + noise(40)), (4, one + noise(40)), (4, noise(900)), (4, two), (9, noise(30) + two + noise(30)), (4, None), (12, "z")]
    rows[2] = rows[1]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in sd.dedup(docs).collect())
    distinct = list(dict.fromkeys(rows))  # each text judges as a document of its own
    want = brute([(i, t) for i, (_, t) in enumerate(distinct)])
    of = {row: want[i] for i, row in enumerate(distinct)}
    removed = lambda row: of[row][1]
    assert [(k, len((t or "").encode()), removed((k, t))) for k, t in sorted(rows, key=lambda r: (r[0], len(r[1] or ""), removed(r)))] == [x[:3] for x in got]
    assert sum(x[2] for x in got) == 500 * 3 + 600 * 2
