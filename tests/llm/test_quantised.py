import numpy as np
import pytest

from crowdread.llm import quantised
from test_minhash import roots


def rows_of(seed=4):
    rng = np.random.default_rng(seed)
    rows = [(0, None, 1), (1, [0.0] * 16, 1), (2, [float("nan")] * 16, 1), (3, [None] + [1.0] * 15, 1), (4, [], 1), (5, [1.0, 2.0], 1), (6, [1e200] * 16, 1)]
    hot = rng.normal(size=16)
    for i in range(7, 700):
        kind = rng.random()
        base = hot if kind < 0.35 else rng.normal(size=16) if kind < 0.6 else np.array(rows[rng.integers(6, len(rows))][1], float)
        noise = 0 if rng.random() < 0.3 else rng.choice([0.02, 0.05, 0.08]) * np.abs(base).max()
        label = None if rng.random() < 0.02 else int(rng.integers(0, 3))
        rows.append((i, (base * rng.choice([1, 3]) + noise * rng.normal(size=16)).tolist(), label))
    return rows


def brute(rows):
    keys = [r[0] for r in rows]
    good = {}
    for k, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.abs(v).max()
            good[k] = (label, u / np.sqrt((u * u).sum()))
    links = [(a, b) for a in good for b in good if a != b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    comp = roots(keys, links)
    n = dict.fromkeys(keys, 0)
    for a, _ in links:
        n[a] += 1
    return {k: (n[k], comp[k], comp[k] == k) for k in keys}


@pytest.mark.parametrize("block, lists", [(1024, 32), (20, 5)])
def test_equals_brute_force(spark, monkeypatch, block, lists):
    monkeypatch.setattr(quantised, "BLOCK", block)
    monkeypatch.setattr(quantised, "SIDE", 2 * block)
    rng = np.random.default_rng(8)
    rows = rows_of()
    for i in range(700, 760):  # other lengths, some with partners of their own length
        width = int(rng.integers(3, 6))
        rows.append((i, (np.ones(width) + 0.1 * rng.normal(size=width)).tolist(), int(rng.integers(0, 2))))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in quantised.near_duplicates(df, lists=lists).collect()}
    assert got == brute(rows)


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in quantised.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert quantised.near_duplicates(df.filter("false")).collect() == []


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in quantised.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
