import pytest
from pyspark.sql import functions as F

from crowdread.functions import audience
from crowdread.functions.matching import TextTerms
from crowdread.operators import reports, segments
from crowdread.plans import fixtures, video_report
from crowdread.schema import EMOTIONS, INTENTS, SENTIMENTS


@pytest.mark.parametrize(
    ("text", "pos", "neg", "wanted"),
    [
        ("bawaal video", 0.1, 0.8, ("positive", 0.72, 0.12)),
        ("please go on, great series", 0.1, 0.8, ("positive", 0.60, 0.20)),
        ("🙏 and 👏", 0.1, 0.8, ("positive", 0.58, 0.22)),
        ("please go on, great 🙏 👏", 0.1, 0.8, ("positive", 0.58, 0.22)),
        ("please go on, great 🙏 🙏", 0.7, 0.1, ("negative", 0.7, 0.1)),
        ("please go on", 0.1, 0.8, ("negative", 0.1, 0.8)),
        ("🙏 🙏", 0.1, 0.8, ("negative", 0.1, 0.8)),
    ],
)
def test_correction_rules(spark, text, pos, neg, wanted):
    df = spark.createDataFrame(
        [(text, "negative", pos, neg)], "text string, sentiment string, positive_score double, negative_score double"
    )
    row = segments.correct_sentiment(df).first()
    assert (row.sentiment, row.positive_score, row.negative_score) == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("I appreciate how you did it?", False),
        ("my code is not working", True),
        ("what about the second part", True),
        ("  Why " + "so " * 20 + "long?", True),
        ("tell me " + "so " * 20 + "long?", False),
        ("short one?", True),
        ("how it goes", False),
    ],
)
def test_genuine_question(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "text string").withColumn("low", F.lower("text"))
    got = df.select(audience.genuine_question(TextTerms("low"), F.col("text")).alias("v")).first().v
    assert got is wanted


def segment(one, positivity, criticism, curiosity, pos=0.5, neg=0.5, likes=0, intent="general", helps=False):
    return one(
        audience.assign_segment(*[F.col(c) for c in ("p", "c", "q", "pos", "neg", "likes", "intent", "helps")]),
        p=positivity, c=criticism, q=curiosity, pos=pos, neg=neg, likes=likes, intent=intent, helps=helps,
    )


def test_segment_borders(one):
    assert segment(one, 0.1, 0.36, 0.1) == 1
    assert segment(one, 0.1, 0.35, 0.1) == 3
    assert segment(one, 0.1, 0.36, 0.1, helps=True) == 3
    assert segment(one, 0.46, 0.1, 0.46, likes=5) == 0
    assert segment(one, 0.46, 0.1, 0.46, likes=4, neg=0.54) == 2
    assert segment(one, 0.46, 0.1, 0.46, likes=4, neg=0.55) == 3
    assert segment(one, 0.45, 0.1, 0.36, likes=5) == 2
    assert segment(one, 0.39, 0.1, 0.1, pos=0.56) == 0
    assert segment(one, 0.38, 0.1, 0.1, pos=0.56) == 3


@pytest.mark.parametrize(("likes", "bonus"), [(4, 0.0), (5, 0.03), (10, 0.03), (11, 0.07), (50, 0.07), (51, 0.15)])
def test_like_steps(one, likes, bonus):
    value = one(
        audience.positivity(F.lit(0.4), F.lit("general"), F.col("n"), F.lit(10)), n=likes
    )
    assert value == pytest.approx(0.2 + bonus)


@pytest.fixture(scope="module")
def analysed(spark, sf):
    return video_report.analyse_comments(fixtures.scored_comments(spark, sf)).cache()


def test_every_branch_is_reached(analysed):
    for column, domain in (
        ("dominant_emotion", EMOTIONS), ("intent", INTENTS), ("sentiment", SENTIMENTS), ("segment", range(4)),
    ):
        assert {r[0] for r in analysed.select(column).distinct().collect()} == set(domain)


def test_invariants(analysed):
    row = analysed.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("quality_score").between(0, 1)).alias("quality"),
        F.count("segment_label").alias("segments"),
        F.countDistinct("comment_id").alias("ids"),
    ).first()
    assert len({row.n, row.quality, row.segments, row.ids}) == 1


def test_counts_add_up(analysed, spark, sf):
    report = video_report.video_report(analysed, fixtures.videos(spark, sf)).collect()
    for row in report:
        for counts in (row.sentiment_counts, row.emotion_counts, row.intent_counts):
            assert sum(counts.values()) == row.total
        assert sum(s["count"] for s in row.segment_summary.values()) == row.total
        assert len(row.segment_summary) == 4 and row.topics == []


def test_absent_segments_are_zero(spark):
    df = spark.createDataFrame(
        [("v", 1, "hello", 3, 3), ("v", 2, "hi", 4, 3), ("v", 3, "hey", 4, 3)],
        "video_id string, comment_id bigint, text string, like_count bigint, segment int",
    )
    rows = {r.segment_label: r for r in segments.segment_summary(df).collect()}
    assert (rows["Casual Viewers"]["count"], rows["Casual Viewers"].avg_likes, rows["Casual Viewers"].top_comment) == (3, 3.7, "hi")
    assert (rows["Critics"]["count"], rows["Critics"].avg_likes, rows["Critics"].top_comment) == (0, 0.0, "")


def test_top_emotions_keep_zeros_and_domain_order(spark):
    df = spark.createDataFrame([("v", "fear"), ("v", "fear"), ("v", "anger")], "video_id string, dominant_emotion string")
    got = [r.emotion for r in reports.top_emotions(df).orderBy("rank").collect()]
    assert got == ["fear", "anger", "joy", "sadness", "surprise"]


def test_report_without_model_scores(spark):
    """Comments with nothing but text: the default scorers speak."""
    df = spark.createDataFrame(
        [(1, "v", 1, "thank you, amazing teacher", 7), (2, "v", 2, "worst video, waste of time", 0)],
        "comment_id bigint, video_id string, pos bigint, text string, like_count bigint",
    )
    rows = {r.comment_id: r for r in video_report.analyse_comments(df).collect()}
    assert rows[1].sentiment == "positive" and rows[1].emotion_model_rule == "joy"
    assert rows[2].sentiment == "negative" and rows[2].emotion_model_rule == "anger"
    assert rows[1].is_toxic is False and rows[1].sarcasm_score == 0.0
