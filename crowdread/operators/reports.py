"""Aggregates and lists over labelled comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.functions.audience import approval_band
from crowdread.operators.cleaning import likes
from crowdread.operators.grouping import top_per_group
from crowdread.operators.segments import segment_summary
from crowdread.schema import EMOTIONS, INTENTS, SENTIMENTS

TEXT_CUT = 200
PAGE = 30


def count_map(column: str, domain: Sequence[str]) -> Column:
    """Counts over a fixed domain, zeros kept, as a map."""
    pairs = [(F.lit(v), F.count_if(F.col(column) == v)) for v in domain]
    return F.create_map(*[c for pair in pairs for c in pair])


def approval() -> Column:
    positive = F.count_if(F.col("sentiment") == "positive")
    return F.round(100.0 * positive / F.greatest(F.count("*"), F.lit(1)), 1)


def approval_score(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(approval().alias("approval_score"))


def label_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """One column per label of the domain."""
    return df.groupBy("video_id").agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in domain]
    )


def sentiment_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "sentiment", SENTIMENTS)


def emotion_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "dominant_emotion", EMOTIONS)


def intent_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "intent", INTENTS)


def flag_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(
        F.count_if("is_toxic").alias("toxic_count"),
        F.count_if("is_sarcastic").alias("sarcasm_count"),
    )


def shares(df: DataFrame) -> DataFrame:
    """Percentages of the comments with a sentiment."""
    known = F.greatest(F.count_if(F.col("sentiment").isin(*SENTIMENTS)), F.lit(1))

    def percent(test: Column) -> Column:
        return F.round(100.0 * F.count_if(test) / known, 1)

    return df.groupBy("video_id").agg(
        *[percent(F.col("sentiment") == s).alias(f"{s}_pct") for s in SENTIMENTS],
        percent(F.col("is_toxic")).alias("toxic_pct"),
        percent(F.col("is_sarcastic")).alias("sarcastic_pct"),
    )


def approval_bands(df: DataFrame) -> DataFrame:
    return approval_score(df).withColumn("band", approval_band(F.col("approval_score")))


def intent_by_sentiment(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id", "intent", "sentiment").agg(F.count("*").alias("count"))


def most_liked(df: DataFrame, group: str, k: int, *extra: str) -> DataFrame:
    """The k most-liked comments per video and group, texts cut for display."""
    slim = df.select(
        "video_id", group, "comment_id", likes().alias("like_count"),
        F.substring("text", 1, TEXT_CUT).alias("text"), *extra,
    )
    order = [F.col("like_count").desc(), F.col("comment_id")]
    return top_per_group(slim, ["video_id", group], order, k)


def top_comment_per_emotion(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("dominant_emotion").isin(*EMOTIONS))
    return most_liked(known, "dominant_emotion", 1).drop("rank")


def top_comments_per_segment(df: DataFrame, k: int = 5) -> DataFrame:
    return most_liked(df, "segment_label", k, "sentiment", "is_sarcastic", "is_toxic")


def filter_comments(
    df: DataFrame, sentiment: str = "All", intent: str = "All", segment: str = "All"
) -> DataFrame:
    tests = {"sentiment": sentiment, "intent": intent, "segment_label": segment}
    for column, wanted in tests.items():
        if wanted != "All":
            df = df.filter(F.col(column) == wanted)
    return df


def _sort_keys(df: DataFrame, by: str) -> list[Column]:
    if by not in df.columns:
        return [F.col("comment_id")]
    return [F.col(by).desc_nulls_last(), F.col("comment_id")]


def sort_comments(df: DataFrame, by: str = "like_count") -> DataFrame:
    """Per video, descending by the column if it exists; ids break ties, which also splits hot values."""
    return df.orderBy("video_id", *_sort_keys(df, by))


def page_comments(df: DataFrame, by: str = "like_count", n: int = PAGE) -> DataFrame:
    """Per video the first n comments in that order, with the number of matches."""
    matches = df.groupBy("video_id").agg(F.count("*").alias("matches"))
    first = top_per_group(df, ["video_id"], _sort_keys(df, by), n)
    return first.join(matches, "video_id")


def top_emotions(df: DataFrame, k: int = 5) -> DataFrame:
    """The k largest emotion counts of each video, zeros kept, ties in domain order."""
    entries = [
        F.struct(F.lit(e).alias("emotion"), F.col(e).alias("count"), F.lit(i).alias("_place"))
        for i, e in enumerate(EMOTIONS)
    ]
    rows = emotion_counts(df).select("video_id", F.inline(F.array(*entries)))
    return top_per_group(rows, ["video_id"], [F.col("count").desc(), F.col("_place")], k).drop("_place")


def topics_by_size(topics: DataFrame) -> DataFrame:
    return topics.orderBy("video_id", "count", "label")


def likes_by_segment(df: DataFrame) -> DataFrame:
    """Mean likes and share of the video's comments per segment."""
    summary = segment_summary(df)
    total = F.sum("count").over(Window.partitionBy("video_id"))
    return summary.select(
        "video_id", "segment_label", "count", "avg_likes",
        F.round(100.0 * F.col("count") / total, 1).alias("share_pct"),
    )
