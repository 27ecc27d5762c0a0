import random
import re

import numpy as np
import pyarrow as pa
import pytest

from crowdread.llm import minhash
from crowdread.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def roots(nodes, links):
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in nodes}


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = roots(keys, links)
    return {k: (len(sets[k]), comp[k], comp[k] == k) for k in keys}


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(12))
    docs = [None, "", " \n", "one", "One", "one two", "one two", "one two three", "x " * 500, "y " * 500]
    for size in (8, 9, 20, 60, 200, 900):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 18))):
                i = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.5:
                    copy[i] = word()
                elif kind < 0.75:
                    copy.insert(i, word())
                elif len(copy) > 2:
                    del copy[i]
            docs.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    for _ in range(60):
        docs.append(line + "\n" + " ".join(word() for _ in range(rng.randint(1, 30))))
    rng.shuffle(docs)
    return list(enumerate([*docs, " ".join(word() for _ in range(30_000))]))


@pytest.mark.parametrize("block, elements, dense", [(512, 1_000_000, 4), (7, 1_000_000, 0), (512, 3000, 0)])
def test_equals_brute_force(spark, monkeypatch, block, elements, dense):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ELEMENTS", elements)
    monkeypatch.setattr(minhash, "DENSE", dense)
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).fillna(-1, ["doc_id", "component_id"]).collect())
    assert [r[3] for r in got] == [True, True, True] and got[1] == (7, 1, 7, True)
    assert minhash.near_duplicates(docs.filter("false")).collect() == []


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 260)] + [(300, 301), (5, 5)]
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(range(400), links)
    assert got == {k: v for k, v in want.items() if k in {x for e in links for x in e if e[0] != e[1]}}


#: Sizes of two sets and how many they share: just similar enough.
WHOLE = {85: [(185, 185, 170), (191, 192, 176), (192, 192, 177), (180, 180, 166)], 80: [(189, 189, 168), (180, 180, 160), (192, 192, 171)]}


@pytest.mark.parametrize("percent", [85, 80])
def test_whole_sketches_with_a_larger_union(spark, percent):
    rows, want = [], {}
    for n, (a, b, shared) in enumerate(30 * WHOLE[percent]):
        assert max(a, b) <= minhash.KEPT < a + b - shared and 100 * shared >= percent * (a + b - shared)
        common = [f"s{n}x{i}" for i in range(shared)]
        rows += [(2 * n, " ".join(common + [f"a{n}x{i}" for i in range(a - shared)])), (2 * n + 1, " ".join(common + [f"b{n}x{i}" for i in range(b - shared)]))]
        want |= {2 * n: 2 * n, 2 * n + 1: 2 * n}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("kept, a, b, shared", [(minhash.KEPT, 185, 185, 170), (minhash.KEPT, 192, 192, 177), (minhash.FEW, 47, 47, 44), (minhash.FEW, 48, 48, 45)])
def test_whole_sketches_pass_by_their_exact_similarity(kept, a, b, shared):
    rng = np.random.default_rng(4)
    for less, good in ((0, True), (4, False)):  # one shared value of slack
        for _ in range(200):
            values = rng.choice(1 << 30, a + b - shared + less, replace=False).astype(np.int32)
            sketches = np.full((2, kept), np.iinfo(np.int32).max, np.int32)
            sketches[0, :a], sketches[1, :b] = np.sort(values[:a]), np.sort(values[a - shared + less :])
            n = np.array([[a], [b]])
            assert minhash.alike(sketches[:1], sketches[1:], *n, 85) == [good]


def test_list_keys_are_those_of_the_column(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [([rng.randrange(1 << 63) for _ in range(rng.randint(0, 5))], rng.randint(-3, 90)) for _ in range(40)]
    df = spark.createDataFrame(rows, "low array<long>, kind long")
    key = F.flatten(F.transform("low", lambda v, i: F.flatten(F.transform(
        F.slice("low", i + 2, 2), lambda w: F.array(F.xxhash64(v, w, F.col("kind")), F.xxhash64(v, w, F.col("kind") + 1))))))
    want = [sorted(r.k) for r in df.select(key.alias("k")).collect()]
    keys, owner = minhash.list_keys(pa.array([r[0] for r in rows], pa.list_(pa.int64())), np.array([r[1] for r in rows]))
    assert [sorted(keys[owner == i].tolist()) for i in range(len(rows))] == want


def near_but_apart(n, words=300, own=8):
    """Texts that each have some words of their own in random places, so that no two are similar enough."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for i, at in enumerate(rng.sample(range(words), own)):
            text[at] = f"own{k}x{i}"
        out.append((k, " ".join(text)))
    return out


def test_what_is_written_grows_with_documents_and_not_with_pairs(spark, monkeypatch):
    written = {}
    keep = minhash.staged

    def counted(df, name):
        out = keep(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "staged", counted)
    sizes = []
    for n in (100, 400):
        written.clear()
        rows = near_but_apart(n)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert {r.doc_id: r.component_id for r in got} == {k: v[1] for k, v in brute(rows).items()}
        sizes.append(sum(v for k, v in written.items() if k in ("open", "links", "stars")))
    assert sizes[1] <= 6 * max(sizes[0], 100)


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_of_drawn_pairs_at_the_limit(spark, percent):
    """Sets too large for their sketches, just similar enough: every pair is found."""
    rng, rows = random.Random(percent), []
    for k in range(150):
        size = rng.randint(250, 700)
        shared = -(-2 * size * percent // (100 + percent))
        common = [f"c{k}x{i}" for i in range(shared)]
        for side in "ab":
            rows.append((len(rows), " ".join(common + [f"{side}{k}x{i}" for i in range(size - shared)])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


@pytest.mark.parametrize("long", [1, 100])
def test_lists_of_rare_values_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(minhash, "LONG", long)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_rows_of_a_long_list_grow_with_its_documents(spark, monkeypatch):
    """Documents that share a passage: what is dealt grows in proportion, not with the square of the list."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LONG", 8, raising=False)
    dealt, deal = [], minhash.in_groups

    def counted(*args):
        out = deal(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(minhash, "in_groups", counted)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"{i}-{rng.randrange(10**6)}" for _ in range(60))) for i in range(160)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 160, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert sum(dealt) <= 10 * len(rows)


@pytest.mark.parametrize("light", [0, 64])
def test_joins_of_values_do_not_bring_every_value(spark, monkeypatch, light):
    """Documents that share a passage: only values that open a list are joined, whatever number of them is frequent."""
    monkeypatch.setattr(minhash, "LIGHT", light, raising=False)
    monkeypatch.setattr(minhash, "LONG", 8)
    joined, deal, join = [], minhash.rare_values, type(spark.range(1)).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "value":
            joined.append(out.count())
        return out

    def rare(*args):
        with monkeypatch.context() as m:
            m.setattr(type(spark.range(1)), "join", counted)
            return deal(*args)

    monkeypatch.setattr(minhash, "rare_values", rare)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"{i}-{rng.randrange(10**6)}" for _ in range(60))) for i in range(160)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 160, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert joined and max(joined) <= 20 * len(rows)  # each row has about 118 values
