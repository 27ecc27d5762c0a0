"""Grouped work when one video holds almost all comments."""

import random

import pytest
from pyspark.sql import functions as F

from crowdread.operators import batches, grouping, likes, topics
from crowdread.sources import tables


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 comments, nine in ten of them under one video, at scattered positions."""
    rng = random.Random(5)
    positions = rng.sample(range(1 << 42), 19_000) + list(range(1 << 43, (1 << 43) + 1_000))
    rows = [(i, "hot" if i % 10 else f"v{i % 70}", p, i % 97) for i, p in enumerate(positions)]
    return spark.createDataFrame(rows, "comment_id bigint, video_id string, pos bigint, like_count bigint").cache()


def by_video(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.video_id, []).append(r)
    return groups


def test_number_rows_is_exact(hot):
    for rows in by_video(grouping.number_rows(hot, ["video_id"], "pos")).values():
        assert [r.ordinal for r in sorted(rows, key=lambda r: r.pos)] == list(range(len(rows)))


@pytest.mark.parametrize("n", [7, 1500])
def test_top_per_group_is_exact_below_and_above_the_limit(hot, n):
    order = [F.col("like_count").desc(), F.col("pos")]
    got = by_video(grouping.top_per_group(hot, ["video_id"], order, n))
    for video, rows in by_video(hot).items():
        wanted = sorted(rows, key=lambda r: (-r.like_count, r.pos))[:n]
        assert [r.comment_id for r in sorted(got[video], key=lambda r: r.rank)] == [r.comment_id for r in wanted]


def test_attach_keeps_every_row_once(hot):
    sizes = hot.groupBy("video_id").agg(F.count("*").alias("n"))
    joined = grouping.attach(hot, sizes, ["video_id"])
    assert joined.count() == hot.count() == joined.select("comment_id").distinct().count()
    assert joined.filter("video_id = 'hot'").select("n").distinct().count() == 1


def test_virality_per_video(hot):
    df = hot.withColumn("predicted_log_likes", F.when(F.col("video_id") == "hot", F.col("like_count") / 10.0).otherwise(-1.0))
    rows = likes.virality_score(df).collect()
    assert max(r.virality_score for r in rows if r.video_id == "hot") == 1.0
    assert {r.virality_score for r in rows if r.video_id != "hot"} == {-1.0}


def test_too_few_guard(spark):
    df = spark.createDataFrame([("a", i, 3) for i in range(9)] + [("b", i, 3) for i in range(10)], "video_id string, comment_id bigint, topic int")
    got = {(r.video_id, r.topic, r.has_topics) for r in topics.too_few_guard(df).collect()}
    assert got == {("a", 0, False), ("b", 3, True)}


def test_pack_batches(spark):
    df = spark.createDataFrame(
        [("v", i, f"text {i}" + "x" * 300, "hinglish" if i < 4 else "en") for i in range(45)],
        "video_id string, pos bigint, text string, language string",
    )
    rows = {r.batch: r for r in batches.pack_batches(df).collect()}
    assert [rows[b].size for b in (0, 1, 2)] == [20, 20, 5]
    first = rows[0].lines.split("\n")
    assert first[0].startswith('0. [hinglish] "text 0x') and len(first[0]) == len('0. [hinglish] ""') + 200
    assert rows[0].language_mix == "Mixed English + Hinglish (4/20 Hinglish)"
    assert rows[1].language_mix == "Mostly English"


@pytest.mark.parametrize(
    ("reply", "wanted"),
    [
        ('[{"id": 0, "emotion": "joy", "intent": "praise"}]', [(0, "joy", "praise")]),
        ('```\n[{"id": 1, "emotion": "fear"}]\n```', [(1, "fear", "general")]),
        ('text ```json\n[{"id": 2}]``` more', [(2, "neutral", "general")]),
        ('[{"id": -1, "emotion": "joy"}, {"emotion": "joy"}]', []),
        ('[{"id": 3, "emotion": "joy"}, {"id": 3, "emotion": "fear"}]', [(3, "fear", "general")]),
        ('[{"id": 0, "emotion": "joy"', []),
        ("sorry", []),
        ('{"id": 0}', []),
        (None, []),
    ],
)
def test_parse_reply(spark, reply, wanted):
    df = spark.createDataFrame([("v", 0, reply)], "video_id string, batch bigint, reply string")
    got = [(r.id, r.emotion, r.intent) for r in batches.parse_label_reply(df).collect()]
    assert got == wanted


def test_labels_past_the_batch_change_nothing(spark):
    df = spark.createDataFrame([("v", 0, 0, "joy", "praise")], "video_id string, batch bigint, item bigint, dominant_emotion string, intent string")
    replies = spark.createDataFrame([("v", 0, '[{"id": 5, "emotion": "fear"}]')], "video_id string, batch bigint, reply string")
    row = batches.apply_labels(df, batches.parse_label_reply(replies)).first()
    assert (row.dominant_emotion, row.intent) == ("joy", "praise")


def test_stored_comments(spark, tmp_path):
    path = str(tmp_path / "comments")

    def load(rows, load_id):
        df = spark.createDataFrame(rows, "video_id string, comment_id bigint")
        tables.save_comments(df, path, load_id)

    load([("a", 1), ("a", 2), ("b", 3)], 1)
    load([("a", 9)], 2)
    load([("a", 9)], 2)
    load([], 3)
    got = sorted((r.video_id, r.comment_id) for r in tables.stored_comments(spark, path).collect())
    assert got == [("a", 9), ("b", 3)]


def test_like_model(spark, tmp_path):
    rows = [(i, "v", "x" * (i % 90), 0.5, 0.2, 0.3, "praise" if i % 2 else "general", False, False, i % 40, 0) for i in range(80)]
    df = spark.createDataFrame(
        rows,
        "comment_id bigint, video_id string, text string, positive_score double, negative_score double, "
        "neutral_score double, intent string, is_sarcastic boolean, is_toxic boolean, like_count bigint, reply_count bigint",
    )
    assert likes.train_like_model(df.limit(10)) is None
    none = likes.predict_likes(df, None).first()
    assert (none.predicted_likes, none.virality_score) == (0, 0.0)
    model = likes.train_like_model(df, trees=3)
    likes.save_like_model(model, str(tmp_path / "m"))
    fresh = likes.predict_likes(df, likes.load_like_model(str(tmp_path / "m")))
    same = likes.predict_likes(df, model)
    key = lambda d: sorted((r.comment_id, r.predicted_likes, r.virality_score) for r in d.collect())
    assert key(fresh) == key(same)
    assert max(r.virality_score for r in same.collect()) == 1.0
