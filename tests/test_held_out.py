"""Scores judged on held-out rows, against plain computations."""

import random

import pytest
from check_queries import plan_of

import __spark_entry__ as contract
from crowdread.operators import metrics


def scores(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("ab"), t := int(rng.random() < 0.3), min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * t, 0.2)))) for _ in range(n)]


@pytest.mark.parametrize("bins", [16, 4096])
def test_auc_and_best_cut(spark, bins):
    rows = scores(3) + [("a", None, 0.5), ("b", 1, None), ("c", 0, 0.2)]
    df = spark.createDataFrame(rows, "k string, truth int, score double").repartition(4)
    binned = metrics.score_bins(df, "truth", "score", bins, ["k"])
    aucs = {r.k: r.auc for r in metrics.rank_sum_auc(binned, ["k"]).collect()}
    cuts = {r.k: r for r in metrics.best_cut(binned, bins, ["k"]).collect()}
    for key in "ab":
        place = lambda s: min(int(s * bins), bins - 1)
        pos = [place(s) for k, t, s in rows if k == key and t == 1 and s is not None]
        neg = [place(s) for k, t, s in rows if k == key and t == 0]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert aucs[key] == pytest.approx(won / len(pos) / len(neg))
        best = max((2 * sum(p >= b for p in pos) / (sum(x >= b for x in pos + neg) + len(pos)), b) for b in set(pos + neg))
        assert cuts[key].f1 == pytest.approx(best[0]) and cuts[key].cut == best[1] / bins
    assert aucs["c"] is None and cuts["c"].f1 == 0


def test_batches_read_the_texts_once(spark, sf):
    plan = plan_of(contract.queries()["p1_pack_batches"](spark, sf))
    assert "documents.parquet" not in plan and "cut-texts" in plan
