"""Emotion by vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crowdread.functions import votes
from crowdread.functions.labels import Terms
from crowdread.operators.terms import lowered

VOTES = ("vote_model", "vote_sentiment", "vote_keywords")


def cast_votes(df: DataFrame, text: str = "text", terms: Terms | None = None) -> DataFrame:
    """The three votes. Needs ``emotion_scores``, ``sentiment`` and ``negative_score``."""
    df, terms = lowered(df, text, terms)
    return df.withColumns(
        {
            "vote_model": F.coalesce(votes.vote_model(F.col("emotion_scores")), F.lit("neutral")),
            "vote_sentiment": votes.vote_sentiment(F.col("sentiment"), F.col("negative_score")),
            "vote_keywords": votes.vote_keywords(terms),
        }
    ).drop(f"_{text}_low")


def settle_votes(df: DataFrame) -> DataFrame:
    """``dominant_emotion`` by majority and ``conflict`` for three different votes."""
    cast = [F.col(v) for v in VOTES]
    return df.withColumns(
        {
            "dominant_emotion": votes.majority_vote(*cast, F.col("sentiment")),
            "conflict": votes.votes_conflict(*cast),
        }
    )


def vote_conflicts(df: DataFrame) -> DataFrame:
    return df.filter("conflict")


def apply_tiebreaks(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Outside labels (``comment_id``, ``emotion``) replace the winner of conflict rows, whatever they are.

    Of several labels for a comment the least one counts.
    """
    known = overrides.groupBy("comment_id").agg(F.min("emotion").alias("_override"))
    won = F.col("dominant_emotion")
    settled = F.when(F.col("conflict"), F.coalesce("_override", won)).otherwise(won)
    return df.join(known, "comment_id", "left").withColumn("dominant_emotion", settled).drop("_override")


def ensemble_emotion(
    df: DataFrame, overrides: DataFrame | None = None, text: str = "text",
    terms: Terms | None = None,
) -> DataFrame:
    settled = settle_votes(cast_votes(df, text, terms))
    return settled if overrides is None else apply_tiebreaks(settled, overrides)
