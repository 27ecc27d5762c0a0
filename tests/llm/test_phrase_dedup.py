import random
import re

import pytest

import corpus_pipeline
from crowdread.llm import phrase_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    words = {k: WORD.findall(t or "") for k, t in rows}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - n + 1):
            first.setdefault(tuple(words[k][i : i + n]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passage = [" ".join(word() for _ in range(k)) for k in (12, 13, 14, 40, 300)]
    docs = [None, "", "  \n ", "a " * 40, "a " * 13, "a " * 12, passage[1], passage[1], passage[0]]
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        docs.append(rng.choice([" ", "\n", "\t "]).join([parts[0], rng.choice(passage), parts[1], rng.choice(passage), parts[2]]))
    return list(enumerate([*docs, "x" * 100_000, " ".join(word() for _ in range(20_000))]))


@pytest.mark.parametrize("slice_bytes", [2 << 20, 500])
def test_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrase_dedup.bt.slices, "__defaults__", (slice_bytes,))
    rows = texts()
    schema = "doc_id long, text string, n_words string, anchors int"
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], schema).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in phrase_dedup.dedup(docs).collect()}
    assert got == brute(rows)


def test_rows_without_id_and_repeated_rows(spark):
    phrase = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, phrase), (4, phrase), (4, phrase), (9, phrase)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in phrase_dedup.dedup(docs).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (9, 20)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrase_dedup.dedup(docs).collect() == []


@pytest.mark.parametrize("slice_bytes", [2 << 20, 50])
def test_repeated_rows_that_lose_words(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrase_dedup.bt.slices, "__defaults__", (slice_bytes,))
    monkeypatch.setattr(phrase_dedup, "SHARD_BYTES", slice_bytes)
    one, two, new = (" ".join(f"{c}{i}" for i in range(20)) for c in "xyz")
    mixed = f"a {two} b"
    rows = [(4, f"{one} {two}"), *[(9, one)] * 3, *[(9, mixed)] * 2, (9, f"c\n{one} {two}"), (9, new), (9, None), (12, new), (12, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_removed, r.text) for r in phrase_dedup.dedup(docs).collect())
    want = [(4, 0, f"{one} {two}"), *[(9, 20, "")] * 3, *[(9, 20, "a b")] * 2, (9, 40, "c"), (9, 0, new), (9, 0, ""), (12, 20, ""), (12, 20, "")]
    assert got == sorted(want)


def test_pipeline_keeps_repeated_rows_once_each(spark):
    phrase = " ".join(f"x{i}" for i in range(20))
    rows = [(4, phrase), *[(9, f"a {phrase}")] * 3, (9, "two\nlines")]
    docs = corpus_pipeline.documents(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string"))
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_phrases(spark, docs, "").collect())
    assert got == [(4, phrase), *[(9, "a")] * 3, (9, "two\nlines")]


def test_occurrences_come_from_the_automaton(spark, monkeypatch):
    """Within a shard only the first document of a phrase asks, so without the search the others keep it."""
    phrase = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"own{k} {phrase} tail{k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.n_removed for r in phrase_dedup.dedup(docs).collect()}
    assert whole == {k: 30 if k else 0 for k, _ in rows}


    asked = []
    confirm = phrase_dedup.confirm

    def kept(*args, **options):
        out = confirm(*args, **options)
        asked.extend((r.doc_id, r.own) for r in out.collect())
        return out

    monkeypatch.setattr(phrase_dedup, "confirm", kept)
    phrase_dedup.dedup(docs).collect()
    assert asked == [(0, False)]  # all are in one shard: one occurrence is confirmed, nineteen are found
    assert {r.doc_id: r.n_removed for r in phrase_dedup.dedup(docs).collect()} == whole
