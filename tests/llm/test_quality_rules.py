import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdread.llm import quality, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_scores_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op4_quality(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])) > 0.9


def test_rising_means():
    assert quality.rising(np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 4, 2])).tolist() == [0.25, 0.25, 0.75, 1.0]


def odd(spark):
    texts = [None, "", " \n", "a " * 60, "!" * 3000, "x", "a b c d " * 500, "ein Wort\n" * 80]
    rows = [(i, t, "n", 1.0) for i, t in enumerate([*texts, *texts])] + [(None, "some words", "n", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double")


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None), (3, 1)], "doc_id long, quality int")
    assert quality.scored(docs, some).count() == 17
    assert quality.scored(docs.filter("false"), some).collect() == []


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else __import__("collections").Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_base_statistics(spark, sf):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b ", "c\n", "é", " ", "$", "\x0b", " ", "ab cd ef "]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += [r.text for r in queries.table(spark, sf, "documents").collect()] + [None, "", "w " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in rules.judged(docs, none).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)


def test_rules_drop_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_rules(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.02 * counts[1, True]
    assert counts.get((0, False), 0) >= 0.7 * (counts.get((0, True), 0) + counts.get((0, False), 0))


def test_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert rules.judged(odd(spark), labels).count() == 17
    assert rules.judged(odd(spark).filter("false"), labels).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op6_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    stats = rules.statistics(queries.table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan + stats)


def test_driver_gets_one_matrix_per_fold(spark, monkeypatch):
    """Not one per fold and part, whose number would grow with the parts."""
    sent, frame = [], type(spark.range(1))
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        if "sums" in self.columns:
            sent.append(sorted(r.fold for r in rows))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    rows = [([float(i % 7), float(i % 11)], float(i % 2), 1 + i % 4) for i in range(200)]
    model = quality.fit(spark.createDataFrame(rows, "f array<double>, y double, fold int"), 8)
    assert sent == [[1, 2, 3, 4]]
    assert len(model[1]) == 8 + 2 + 1
