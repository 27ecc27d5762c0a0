"""From raw comments to one report row per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crowdread.functions.labels import lexicon_sentiment
from crowdread.functions.matching import ScannedTerms, scan_terms
from crowdread.functions.text import working_text
from crowdread.operators import cleaning, labelling, language, reports, segments, topics
from crowdread.operators.ensemble import ensemble_emotion
from crowdread.schema import EMOTIONS, INTENTS, SCORES, SEGMENTS, SENTIMENTS
from crowdread.session import staged

# Score columns a model may have filled; where a comment has none the default scorer speaks.
MODEL_COLUMNS = {
    "sentiment_scores": SCORES.simpleString(),
    "emotion_scores": SCORES.simpleString(),
    "toxic_label": "string",
    "toxic_raw": "double",
    "irony_label": "string",
    "irony_raw": "double",
}
# Labels that the report counts.
LABELS = ("sentiment", "dominant_emotion", "intent", "is_toxic", "is_sarcastic")


def analyse_comments(
    comments: DataFrame, overrides: DataFrame | None = None, max_comments: int | None = None
) -> DataFrame:
    """Cleaned comments with all labels, votes, segments and quality.

    The order of steps matters: votes read the sentiment as scored, segments correct it, and
    quality and all counts read the corrected one. ``max_comments`` keeps the most-liked
    comments of each video, as a reader with a fixed budget would.
    """
    if max_comments is not None:
        comments = cleaning.cap_comments(comments, max_comments)
    missing = {c: F.lit(None).cast(t) for c, t in MODEL_COLUMNS.items() if c not in comments.columns}
    df = cleaning.parse_comments(comments.withColumns(missing) if missing else comments)
    df = df.withColumn("working_text", working_text(F.col("clean_text"), F.col("text")))
    df = df.withColumn("_scan", scan_terms(F.lower("text"), F.lower("working_text")))
    raw, work = ScannedTerms("_scan"), ScannedTerms("_scan", 1)
    df = language.detect_language(df, "working_text", work)
    df = df.withColumn("sentiment_scores", F.coalesce("sentiment_scores", lexicon_sentiment(work)))
    df = labelling.label_sentiment(df)
    df = labelling.label_emotions(df, "working_text", work)
    df = labelling.label_toxicity(df)
    df = labelling.label_sarcasm(df, "working_text", work)
    df = labelling.label_intent(df, "working_text", work)
    df = labelling.with_defaults(df.withColumn("dominant_emotion", F.col("emotion_model_rule")))
    df = ensemble_emotion(df, overrides, terms=raw)
    df = segments.quality_scores(segments.segment_audience(df, raw))
    return df.drop("_scan", "sentiment_scores", "emotion_scores", "toxic_label", "toxic_raw",
                   "irony_label", "irony_raw")


def report_columns() -> list[Column]:
    """All per-video aggregates in one pass."""
    return [
        F.count("*").alias("total"),
        reports.approval().alias("approval_score"),
        F.count_if("is_toxic").alias("toxic_count"),
        F.count_if("is_sarcastic").alias("sarcasm_count"),
        reports.count_map("sentiment", SENTIMENTS).alias("sentiment_counts"),
        reports.count_map("dominant_emotion", EMOTIONS).alias("emotion_counts"),
        reports.count_map("intent", INTENTS).alias("intent_counts"),
        *segments.segment_totals(),
    ]


def video_report(
    analysed: DataFrame, videos: DataFrame, topics_of: DataFrame | None = None
) -> DataFrame:
    """One row per video with comments.

    ``topics_of`` holds ``video_id`` and ``topics``, see ``topics_per_video``.
    """
    slim = segments.summary_input(analysed, *LABELS)
    counted = slim.groupBy("video_id").agg(*report_columns())
    summary = F.map_from_entries(
        F.transform(segments.segment_entries(), lambda s: F.struct(s["segment_label"], s))
    )
    report = counted.withColumn("segment_summary", summary).drop(
        *[f"_{name}{seg}" for seg in SEGMENTS for name in ("n", "likes", "top")]
    )
    report = report.join(videos.select("video_id", "title", "channel"), "video_id", "left")
    none = F.array().cast(
        "array<struct<topic_id: int, count: bigint, label: string, words: array<string>>>"
    )
    if topics_of is None:
        return report.withColumn("topics", none)
    listed = topics_of.select("video_id", F.col("topics").alias("_topics"))
    return (
        report.join(listed, "video_id", "left")
        .withColumn("topics", F.coalesce("_topics", none)).drop("_topics")
    )


def full_report(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """The report with topics of each video's own comments.

    Clustering reads the comments many times, so what it and the report need of the analysed rows is written once.
    """
    analysed = segments.summary_input(analyse_comments(comments), "working_text", *LABELS)
    analysed = staged(analysed, "analysed")
    clustered = topics.assign_topics(
        analysed.select("video_id", "comment_id", "working_text"), text="working_text"
    )
    size = topics.text_bytes(analysed, "working_text")
    return video_report(analysed, videos, topics.topics_per_video(clustered, "working_text", size))
