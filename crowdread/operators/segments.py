"""Audience segments and comment quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crowdread.functions import audience
from crowdread.functions.labels import Terms
from crowdread.operators.cleaning import likes
from crowdread.operators.terms import scanned
from crowdread.schema import SEGMENTS

# Term lists that the rules ask for.
CORRECTION_LISTS = ("HINGLISH_POSITIVE", "POSITIVE_EMOJI", "REQUEST_WORDS", "COMPLIMENT_WORDS")
AXIS_LISTS = ("HELP_REQUESTS", "CRITICISM_MARKERS", "PRAISE_WITH_QUESTION_WORD", "CURIOUS_MARKERS")
TOP_COMMENT_CUT = 120


def correct_sentiment(df: DataFrame, terms: Terms | None = None) -> DataFrame:
    """``sentiment`` and two scores after the correction rules."""
    df, terms = scanned(df, "text", terms, CORRECTION_LISTS)
    fixed = audience.correct_sentiment(
        terms, F.col("sentiment"), F.col("positive_score"), F.col("negative_score")
    )
    df = df.withColumn("_fixed", fixed)
    fields = ("sentiment", "positive_score", "negative_score")
    return df.withColumns({f: F.col("_fixed")[f] for f in fields}).drop("_fixed")


def axis_scores(df: DataFrame, terms: Terms | None = None) -> DataFrame:
    """``positivity``, ``criticism`` and ``curiosity`` of each comment."""
    df, terms = scanned(df, "text", terms, AXIS_LISTS)
    df = df.withColumns(
        {
            "_helps": terms.any("HELP_REQUESTS"),
            "_blames": terms.any("CRITICISM_MARKERS"),
            "_asks": audience.genuine_question(terms, F.col("text")),
        }
    )
    pos, neg, intent = F.col("positive_score"), F.col("negative_score"), F.col("intent")
    helps, blames, asks = F.col("_helps"), F.col("_blames"), F.col("_asks")
    return df.withColumns(
        {
            "positivity": audience.positivity(pos, intent, likes(), F.length("text")),
            "criticism": audience.criticism(
                pos, neg, intent, likes(), F.col("is_sarcastic"), blames, helps
            ),
            "curiosity": audience.curiosity(neg, intent, asks, blames, helps),
        }
    )


def assign_segment(df: DataFrame) -> DataFrame:
    """``segment`` with its name, colour and icon, from the axis scores."""
    segment = audience.assign_segment(
        F.col("positivity"), F.col("criticism"), F.col("curiosity"), F.col("positive_score"),
        F.col("negative_score"), likes(), F.col("intent"), F.col("_helps"),
    )
    df = df.withColumn("segment", segment)
    return df.withColumns(
        {
            "segment_label": _segment_info(0),
            "segment_color": _segment_info(1),
            "segment_icon": _segment_info(2),
        }
    )


def _segment_info(i: int) -> Column:
    return F.element_at(F.array(*[F.lit(info[i]) for info in SEGMENTS.values()]), F.col("segment") + 1)


def segment_audience(df: DataFrame, terms: Terms | None = None) -> DataFrame:
    """Corrected sentiment, axis scores and segment."""
    df, terms = scanned(df, "text", terms, (*CORRECTION_LISTS, *AXIS_LISTS))
    segmented = assign_segment(axis_scores(correct_sentiment(df, terms), terms))
    return segmented.drop("_helps", "_blames", "_asks", "_text_scan")


def summary_input(df: DataFrame, *labels: str) -> DataFrame:
    """What per-video aggregates need, with texts cut before the rows are sorted by video."""
    return df.select(
        "video_id", "comment_id", "segment", likes().alias("like_count"),
        F.substring("text", 1, TOP_COMMENT_CUT).alias("text"), *labels,
    )


def segment_totals() -> list[Column]:
    """Aggregates behind the segment summary: count, mean likes and top text per segment."""
    columns = []
    for seg in SEGMENTS:
        here = F.col("segment") == seg
        best = F.struct("like_count", -F.col("comment_id"))
        columns += [
            F.count_if(here).alias(f"_n{seg}"),
            F.avg(F.when(here, F.col("like_count"))).alias(f"_likes{seg}"),
            F.max_by("text", F.when(here, best)).alias(f"_top{seg}"),
        ]
    return columns


def segment_entries() -> Column:
    """The four summary entries of a row of ``segment_totals``; absent segments as zeros."""
    entries = [
        F.struct(
            F.lit(name).alias("segment_label"),
            F.col(f"_n{seg}").alias("count"),
            F.lit(color).alias("color"),
            F.lit(icon).alias("icon"),
            F.lit(about).alias("description"),
            F.coalesce(F.round(f"_likes{seg}", 1), F.lit(0.0)).alias("avg_likes"),
            F.coalesce(f"_top{seg}", F.lit("")).alias("top_comment"),
        )
        for seg, (name, color, icon, about) in SEGMENTS.items()
    ]
    return F.array(*entries)


def segment_summary(df: DataFrame) -> DataFrame:
    """Four rows per video."""
    totals = summary_input(df).groupBy("video_id").agg(*segment_totals())
    return totals.select("video_id", F.inline(segment_entries()))


def quality_scores(df: DataFrame) -> DataFrame:
    score = audience.quality_score(
        F.length("text"), likes(), F.col("positive_score"), F.col("negative_score"),
        F.col("is_toxic"), F.col("intent"),
    )
    return df.withColumn("quality_score", score)


