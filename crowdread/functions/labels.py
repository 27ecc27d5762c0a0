"""Scores to labels, as column expressions.

``terms`` arguments take a ``TextTerms`` or a ``ScannedTerms`` matcher.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from crowdread.functions import lexicon
from crowdread.functions.matching import ScannedTerms, TextTerms
from crowdread.functions.text import has_more_words
from crowdread.schema import EMOTIONS

Terms = TextTerms | ScannedTerms

CONFIDENCE = 0.30
TOXIC_AT = 0.85
SARCASTIC_AT = 0.92
SHORT_SARCASTIC_AT = 0.95
SHORT_WORDS = 8

SENTIMENT_SPELLINGS = {
    "pos": "positive", "neg": "negative", "neu": "neutral",
    "label_0": "negative", "label_1": "neutral", "label_2": "positive",
}


def first_match(rules: list[tuple[str, str]], terms: Terms, default: Column | str) -> Column:
    """The label of the first list with a term in the text."""
    chain = F
    for name, label in rules:
        chain = chain.when(terms.any(name), F.lit(label))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


SENTIMENT_LISTS = ("POSITIVE_TERMS", "NEGATIVE_TERMS")


def lexicon_sentiment(terms: Terms) -> Column:
    """Default sentiment scores from term counts, as an array of (label, score)."""
    p, n = terms.count("POSITIVE_TERMS"), terms.count("NEGATIVE_TERMS")
    total = (p + n + 1).cast("double")
    parts = [("positive", p), ("negative", n), ("neutral", F.lit(1))]
    return F.array(
        *[
            F.struct(F.lit(k).alias("label"), F.round(v / total, 4).alias("score"))
            for k, v in parts
        ]
    )


def _best(scores: Column, label) -> Column:
    """The label with the highest score; the first one on a tie."""
    ranked = F.transform(
        scores, lambda s, i: F.struct(s["score"].alias("s"), (-i).alias("p"), label(s).alias("l"))
    )
    return F.array_max(ranked)["l"]


def rounded(scores: Column, places: int = 4) -> Column:
    return F.transform(
        scores,
        lambda s: F.struct(s["label"].alias("label"), F.round(s["score"], places).alias("score")),
    )


def score_of(scores: Column, label: str) -> Column:
    """The score of a label, NULL where it is not in the array."""
    return F.get(F.filter(scores, lambda s: s["label"] == label), F.lit(0))["score"]


def dominant_sentiment(scores: Column) -> Column:
    """sentiment and the three scores from an array of (label, score)."""
    lowered = F.transform(
        rounded(scores),
        lambda s: F.struct(F.lower(s["label"]).alias("label"), s["score"].alias("score")),
    )

    def named(full: str, short: str) -> Column:
        return F.coalesce(score_of(lowered, full), score_of(lowered, short), F.lit(0.0))

    return F.struct(
        normalise_label(_best(lowered, lambda s: s["label"])).alias("sentiment"),
        named("positive", "pos").alias("positive_score"),
        named("negative", "neg").alias("negative_score"),
        named("neutral", "neu").alias("neutral_score"),
    )


def normalise_label(label: Column) -> Column:
    """Other spellings of the sentiment labels to the full names."""
    low = F.lower(label)
    chain = F
    for spelling, full in SENTIMENT_SPELLINGS.items():
        chain = chain.when(low == spelling, F.lit(full))
    return chain.otherwise(low)


def emotion_group(fine: Column) -> Column:
    """One of 28 fine emotion labels to its display emotion; neutral if unknown."""
    groups = {label: group for group, members in lexicon.FINE_EMOTIONS.items() for label in members}
    table = F.from_json(F.lit(json.dumps(groups)), "map<string, string>")
    return F.coalesce(F.try_element_at(table, fine), F.lit("neutral"))


def group_emotions(scores: Column) -> Column:
    """Display emotions that occur, as an array of (label, score), in order of first sight."""
    grouped = F.transform(
        scores,
        lambda s: F.struct(emotion_group(s["label"]).alias("label"), s["score"].alias("score")),
    )
    labels = F.array_distinct(F.transform(grouped, lambda s: s["label"]))
    return F.transform(
        labels,
        lambda g: F.struct(
            g.alias("label"),
            F.aggregate(
                F.filter(grouped, lambda s: s["label"] == g),
                F.lit(0.0),
                lambda acc, s: acc + s["score"],
            ).alias("score"),
        ),
    )


def group_score(groups: Column, emotion: str) -> Column:
    """The score of one display emotion, 0.0 where it did not occur."""
    return F.coalesce(score_of(groups, emotion), F.lit(0.0))


def group_columns(groups: Column) -> list[Column]:
    return [group_score(groups, e).alias(e) for e in EMOTIONS]


def top_label(scores: Column) -> Column:
    return _best(scores, lambda s: s["label"])


def top_score(scores: Column) -> Column:
    return F.array_max(F.transform(scores, lambda s: s["score"]))


def rule_emotion(terms: Terms, sentiment: Column) -> Column:
    """Keyword fallback for texts whose emotion scores are low."""
    rules = [
        ("RULE_THANKS", "joy"), ("RULE_DELIGHT", "joy"), ("RULE_SURPRISE", "surprise"),
        ("RULE_FEAR", "fear"), ("RULE_SADNESS", "sadness"), ("RULE_ANGER", "anger"),
    ]
    by_sentiment = (
        F.when(sentiment == "positive", F.lit("joy"))
        .when(sentiment == "negative", F.lit("anger"))
        .otherwise(F.lit("neutral"))
    )
    return first_match(rules, terms, by_sentiment)


def fix_praise_negation(terms: Terms, emotion: Column, sentiment: Column) -> Column:
    """Anger and sadness that are praise in a negated form become joy."""
    praised = terms.any("PRAISE_NEGATION") | (
        (sentiment == "positive") & terms.any("PRAISE_WORDS")
    )
    misread = emotion.isin("anger", "sadness") & ~terms.any("GENUINE_ANGER") & praised
    return F.when(misread, F.lit("joy")).otherwise(emotion)


def model_emotion(groups: Column, terms: Terms, sentiment: Column) -> Column:
    """The top group, or the keyword fallback below the confidence mark, praise-corrected."""
    sure = F.coalesce(top_score(groups), F.lit(0.0)) >= CONFIDENCE
    emotion = F.when(sure, top_label(groups)).otherwise(rule_emotion(terms, sentiment))
    return fix_praise_negation(terms, emotion, sentiment)


def toxicity_label(label: Column, score: Column) -> Column:
    """(is_toxic, toxic_score) from the top label and its score."""
    toxic = label == "toxic"
    value = F.round(F.when(toxic, score).otherwise(1 - score), 4)
    return F.struct((toxic & (value >= TOXIC_AT)).alias("is_toxic"), value.alias("toxic_score"))


def sarcasm_label(label: Column, score: Column) -> Column:
    """(is_sarcastic, sarcasm_score) from the top label and its score."""
    irony, raw = label == "irony", F.round(score, 4)
    return F.struct(
        (irony & (raw >= SARCASTIC_AT)).alias("is_sarcastic"),
        F.when(irony, raw).otherwise(F.round(1 - raw, 4)).alias("sarcasm_score"),
    )


def sarcasm_override(terms: Terms, text: Column, flagged: Column, score: Column) -> Column:
    """The sarcasm flag after the phrase and length rules."""
    doubtful = (F.round(score, 4) < SHORT_SARCASTIC_AT) & ~has_more_words(text, SHORT_WORDS)
    return (
        F.when(terms.any("SARCASM_SIGNALS"), flagged)
        .when(terms.any("SINCERE_MARKERS"), F.lit(False))
        .when(doubtful, F.lit(False))
        .otherwise(flagged)
    )


def classify_intent(terms: Terms) -> Column:
    rules = [
        ("INTENT_QUESTION", "question"), ("INTENT_SUGGESTION", "suggestion"),
        ("INTENT_PRAISE", "praise"), ("INTENT_COMPLAINT", "complaint"),
    ]
    return first_match(rules, terms, "general")


def title_category(terms: Terms) -> Column:
    """Category of a video by the terms of its title."""
    rules = [(name, label) for label, name in lexicon.TITLE_CATEGORIES.items()]
    return first_match(rules, terms, "General")
