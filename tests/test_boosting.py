"""Boosted trees of cells against a plain computation and against Spark's own."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from crowdread.operators import boosting, likes


def plain(rows, bins, trees):
    """The same trees row by row: every split tried, the largest drop of squared error taken."""
    y = np.array(rows, float)
    x = np.array(bins)
    p = np.full(len(y), y.mean())
    for _ in range(trees):
        r = y - p
        node = np.zeros(len(y), int)
        for _ in range(boosting.DEPTH):
            new = 2 * node
            for v in set(node.tolist()):
                here = node == v
                best = (1e-12, None)
                for f in range(x.shape[1]):
                    for c in sorted(set(x[here, f]))[:-1]:
                        left, right = r[here & (x[:, f] <= c)], r[here & (x[:, f] > c)]
                        gain = left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right) - r[here].sum() ** 2 / here.sum()
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, c))
                if best[1]:
                    f, c = best[1]
                    new[here & (x[:, f] > c)] += 1
            node = new
        for v in set(node.tolist()):
            p[node == v] += boosting.RATE * r[node == v].mean()
    return p


def test_cells_give_what_rows_give():
    rng = np.random.default_rng(1)
    x = rng.integers(0, [3, 4, 2], (120, 3))
    y = rng.normal(size=120) + x[:, 0] - 2 * (x[:, 1] > 1) * x[:, 2]
    cells, of = np.unique(x, axis=0, return_inverse=True)
    predicted, parts = boosting.boost(cells, np.bincount(of).astype(float), np.bincount(of, y), 20)
    assert predicted[of] == pytest.approx(plain(y, x, 20))
    assert parts.sum() == pytest.approx(1) and (parts >= 0).all()


def comments(spark, videos=(("a", 400), ("b", 90), ("few", 14), ("none", 5))):
    rng, rows = random.Random(3), []
    for video, n in videos:
        for i in range(n):
            pos, length, question = rng.random(), rng.randint(5, 300), rng.random() < 0.3
            like = 0 if video == "none" else 1 + int(rng.random() * 9 + 40 * pos**2 + length / 20 * (video == "a"))
            rows.append((video, len(rows), "x" * length, pos, 1 - pos, 0.0, "question" if question else "praise", False, False, like, rng.randint(0, 60)))
    rows.append(("a", len(rows), "plain", None, None, None, None, None, None, None, None))
    schema = ("video_id string, comment_id long, text string, positive_score double, negative_score double, neutral_score double, "
              "intent string, is_sarcastic boolean, is_toxic boolean, like_count long, reply_count long")
    return spark.createDataFrame(rows, schema).repartition(5)


def test_loss_is_near_that_of_spark(spark):
    df = comments(spark).filter("video_id = 'a' AND like_count > 0")
    scores, _ = likes.predict_likes_by_video(df)
    ours = scores.select(F.avg(F.pow(F.col("predicted_log_likes") - F.log1p("like_count"), 2))).first()[0] ** 0.5
    rows = VectorAssembler(inputCols=list(likes.FEATURES), outputCol="v").transform(likes.like_features(df)).withColumn("y", F.log1p("like_count"))
    model = GBTRegressor(featuresCol="v", labelCol="y", maxIter=100, stepSize=0.1, maxDepth=3, seed=42).fit(rows)
    theirs = RegressionEvaluator(labelCol="y").evaluate(model.transform(rows))
    spread = rows.select(F.stddev_pop("y")).first()[0]
    assert ours < 0.6 * spread and ours <= theirs + 0.1 * spread


def test_models_of_videos(spark):
    scores, weights = likes.predict_likes_by_video(comments(spark), trees=30)
    rows = scores.collect()
    assert len(rows) == 510
    by_video = {}
    for r in rows:
        by_video.setdefault(r.video_id, []).append(r)
    for video in ("few", "none"):
        assert all((r.predicted_likes, r.virality_score) == (0, 0.0) for r in by_video[video])
    for video in ("a", "b"):
        assert max(r.virality_score for r in by_video[video]) == 1.0
        high = [r.predicted_likes for r in by_video[video] if (r.positive_score or 0) > 0.7]
        low = [r.predicted_likes for r in by_video[video] if (r.positive_score or 1) < 0.6]
        assert min(high) > sum(low) / len(low)
    sums = {r.video_id: (r.s, r.n) for r in weights.groupBy("video_id").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()}
    assert set(sums) == {"a", "b"} and all(s == pytest.approx(1) and n == len(likes.FEATURES) for s, n in sums.values())
    top = weights.filter("video_id = 'b'").orderBy(F.desc("importance")).first()
    assert top.feature in ("f_positive", "f_negative")


def test_alone_equals_together(spark):
    df = comments(spark)
    cuts = boosting.quantile_cuts(likes.like_features(df), likes.FEATURES)
    rows = likes.like_features(df)
    args = (["video_id"], cuts, F.log1p("like_count"), F.col("like_count") > 0, 15, 10)
    together = {(r.video_id, r.cell): r.predicted for r in boosting.boosted(rows, *args).collect()}
    for video in ("a", "b"):
        alone = {(r.video_id, r.cell): r.predicted for r in boosting.boosted(rows.filter(F.col("video_id") == video), *args).collect()}
        assert alone == {k: pytest.approx(v) for k, v in together.items() if k[0] == video}
    assert boosting.boosted(rows.limit(0), *args).collect() == []
