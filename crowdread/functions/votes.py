"""Emotion votes and how they are settled."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crowdread.functions.labels import Terms, first_match, group_emotions, top_label
from crowdread.functions.lexicon import EVAL_EMOTIONS, KEYWORD_EMOTIONS
from crowdread.schema import VALID_EMOTIONS

STRONG_NEGATIVE = 0.70


def vote_model(scores: Column) -> Column:
    """The display emotion with the highest summed score, scores as they came."""
    return top_label(group_emotions(scores))


def vote_sentiment(sentiment: Column, negative_score: Column) -> Column:
    return (
        F.when(sentiment == "positive", F.lit("joy"))
        .when((sentiment == "negative") & (negative_score > STRONG_NEGATIVE), F.lit("anger"))
        .when(sentiment == "negative", F.lit("sadness"))
        .otherwise(F.lit("neutral"))
    )


def vote_keywords(terms: Terms) -> Column:
    return first_match([(v, k) for k, v in KEYWORD_EMOTIONS.items()], terms, "neutral")


def eval_vote_keywords(terms: Terms) -> Column:
    return first_match([(v, k) for k, v in EVAL_EMOTIONS.items()], terms, "neutral")


def is_valid(emotion: Column, sentiment: Column) -> Column:
    """May this emotion stand beside this sentiment?"""
    chain = F
    for name, allowed in VALID_EMOTIONS.items():
        chain = chain.when(sentiment == name, emotion.isin(*allowed))
    return chain.otherwise(F.lit(True))


def _first_valid(candidates: list[Column], sentiment: Column) -> Column:
    chosen = [F.when(is_valid(c, sentiment), c) for c in candidates]
    default = (
        F.when(sentiment == "positive", F.lit("joy"))
        .when(sentiment == "negative", F.lit("anger"))
        .otherwise(F.lit("neutral"))
    )
    return F.coalesce(*chosen, default)


def majority_vote(model: Column, mood: Column, words: Column, sentiment: Column) -> Column:
    """The most frequent vote that suits the sentiment; ties by vote order."""
    winner = F.when(mood == words, mood).otherwise(model)
    return _first_valid([winner, model, mood, words], sentiment)


def votes_conflict(model: Column, mood: Column, words: Column) -> Column:
    """Three different votes."""
    return (model != mood) & (mood != words) & (model != words)


def weighted_vote(model: Column, words: Column, sentiment: Column) -> Column:
    """Evaluation form: the model vote counts twice, so it stands wherever it is valid."""
    mood = (
        F.when(sentiment == "positive", F.lit("joy"))
        .when(sentiment == "negative", F.lit("anger"))
        .otherwise(F.lit("neutral"))
    )
    return _first_valid([model, mood, words], sentiment)
