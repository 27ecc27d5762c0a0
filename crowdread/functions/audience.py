"""Audience rules: questions, sentiment correction, axes, segments, quality."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from crowdread.functions.labels import Terms
from crowdread.functions.lexicon import QUESTION_OPENERS
from crowdread.functions.text import has_more_words, starts_with_any, strip

SHORT_QUESTION = 15


def genuine_question(terms: Terms, text: Column) -> Column:
    """Is the comment asking, and not only using a question word?"""
    asks = text.contains("?")
    opener = starts_with_any(F.lower(strip(text)), QUESTION_OPENERS)
    return F.when(terms.any("PRAISE_WITH_QUESTION_WORD"), F.lit(False)).otherwise(
        terms.any("HELP_REQUESTS")
        | terms.any("CURIOUS_MARKERS")
        | (asks & (opener | ~has_more_words(text, SHORT_QUESTION)))
    )


def correct_sentiment(terms: Terms, sentiment: Column, pos: Column, neg: Column) -> Column:
    """(sentiment, positive_score, negative_score) after the three correction rules.

    The later of two rules that both apply decides, and each reads the scores as they came.
    """
    slang = terms.any("HINGLISH_POSITIVE")
    emoji = (terms.count("POSITIVE_EMOJI") >= 2) & (neg > pos)
    kind_request = terms.any("REQUEST_WORDS") & terms.any("COMPLIMENT_WORDS") & (neg > pos)

    def lifted(floor: float, ceiling: float) -> Column:
        return F.struct(
            F.lit("positive").alias("sentiment"),
            F.greatest(pos, F.lit(floor)).alias("positive_score"),
            F.least(neg, F.lit(ceiling)).alias("negative_score"),
        )

    unchanged = F.struct(
        sentiment.alias("sentiment"), pos.alias("positive_score"), neg.alias("negative_score")
    )
    return (
        F.when(slang, lifted(0.72, 0.12))
        .when(emoji, lifted(0.58, 0.22))
        .when(kind_request, lifted(0.60, 0.20))
        .otherwise(unchanged)
    )


def exact(number: str) -> Column:
    return F.lit(Decimal(number))


def score(value: Column) -> Column:
    """A score as a decimal of six places."""
    return value.cast("decimal(9,6)")


def _points(*parts: tuple[Column, str]) -> Column:
    total = exact("0.00")
    for test, value in parts:
        total = total + F.when(test, exact(value)).otherwise(exact("0.00"))
    return total


def positivity(pos: Column, intent: Column, likes: Column, length: Column) -> Column:
    liked = (
        F.when(likes > 50, exact("0.15"))
        .when(likes > 10, exact("0.07"))
        .when(likes > 4, exact("0.03"))
        .otherwise(exact("0.00"))
    )
    return F.round(
        score(pos) * exact("0.50")
        + _points(
            (intent == "praise", "0.20"), ((intent == "suggestion") & (pos > 0.4), "0.10"), (length > 100, "0.05")
        )
        + liked,
        3,
    ).cast("double")


def criticism(
    pos: Column, neg: Column, intent: Column, likes: Column, sarcastic: Column,
    blames: Column, helps: Column,
) -> Column:
    praise = (intent == "praise") | (pos > 0.70)
    base = F.when(praise | helps, exact("0.00")).otherwise(score(neg) * exact("0.45"))
    return F.round(
        base
        + _points(
            (blames & ~helps, "0.30"),
            ((intent == "complaint") & ~helps, "0.15"),
            (sarcastic & (neg > 0.3) & ~praise, "0.10"),
            ((likes > 20) & (neg > 0.5) & ~praise, "0.10"),
        ),
        3,
    ).cast("double")


def curiosity(neg: Column, intent: Column, asks: Column, blames: Column, helps: Column) -> Column:
    rhetorical = blames & (neg > 0.55)
    return F.round(
        _points((asks & ~rhetorical, "0.50"), ((intent == "question") & ~rhetorical, "0.20"), (helps, "0.10")), 3
    ).cast("double")


def assign_segment(
    positive_axis: Column, critical_axis: Column, curious_axis: Column, pos: Column,
    neg: Column, likes: Column, intent: Column, helps: Column,
) -> Column:
    """Segment id; the first test that holds decides."""
    happy = (intent == "praise") | (pos > 0.70) | (positive_axis > 0.60)
    critic = (
        (critical_axis > 0.35) & (critical_axis > positive_axis)
        & (critical_axis > curious_axis) & (neg > 0.40) & ~happy & ~helps
    )
    fan = (
        (positive_axis > 0.45) & (positive_axis > critical_axis)
        & (positive_axis >= curious_axis) & ((likes >= 5) | (pos > 0.65))
    )
    curious = (curious_axis > 0.35) & (curious_axis > critical_axis) & (neg < 0.55)
    late_fan = (positive_axis > 0.38) & (positive_axis > critical_axis) & (pos > 0.55)
    return (
        F.when(critic, 1).when(fan, 0).when(curious, 2).when(late_fan, 0).otherwise(3)
    )


def quality_score(
    length: Column, likes: Column, pos: Column, neg: Column, toxic: Column, intent: Column
) -> Column:
    """Exact decimals until the one rounding, half up; 0.30 / 200 and 0.30 / 50 are the steps of length and likes."""
    raw = (
        exact("0.0015") * F.least(length, F.lit(200))
        + exact("0.006") * F.least(likes, F.lit(50))
        + exact("0.20") * score(pos)
        + exact("0.10") * (1 - score(neg))
        + _points((toxic, "-0.5"), (intent.isin("question", "suggestion"), "0.2"))
    )
    return F.round(F.greatest(exact("0"), F.least(exact("1"), raw)), 3).cast("double")


def approval_band(approval: Column) -> Column:
    """Bands split at 40 and 65."""
    return (
        F.when(approval < 40, F.lit("low")).when(approval < 65, F.lit("mid")).otherwise(F.lit("high"))
    )
