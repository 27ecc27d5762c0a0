"""Language detection and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdread.functions.labels import Terms
from crowdread.functions.lexicon import LANGUAGE_WORDS
from crowdread.operators.language_model import UNKNOWN, LanguageModel, language_of
from crowdread.operators.terms import lowered

MULTILINGUAL = ("hinglish", "hi", "ur")
SCRIPTS = {"hi": r"[\x{0900}-\x{097f}]+", "ur": r"[\x{0600}-\x{06ff}]+"}
MOSTLY_ENGLISH_BELOW = 0.2


def hinglish_flag(terms: Terms) -> Column:
    return terms.any("HINGLISH_MARKERS")


def known_words(words: Column, known: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def detect_language(
    df: DataFrame, text: str, terms: Terms | None = None, model: LanguageModel | None = None
) -> DataFrame:
    """``language``: hinglish by its markers, else what the model says.

    Where the model knows no language, a script that only one language uses tells it. Without a model the language
    with most function words is taken.
    """
    df, terms = lowered(df, text, terms)
    df = df.withColumn("_hinglish", hinglish_flag(terms))
    scripts = {lang: F.regexp_count(F.col(text), F.lit(p)) for lang, p in SCRIPTS.items()}
    if model is None:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
        df = df.withColumn("_words", F.when(~F.col("_hinglish"), words))
        hits = {lang: known_words(F.col("_words"), ws) for lang, ws in LANGUAGE_WORDS.items()}
        counted = most_frequent(hits | scripts)
    else:
        df = df.withColumn("_model", language_of(F.when(~F.col("_hinglish"), F.col(text)), model))
        counted = F.when(F.col("_model") == UNKNOWN, most_frequent(scripts)).otherwise(F.col("_model"))
    df = df.withColumn("_best", F.when(~F.col("_hinglish"), counted))
    language = F.when(F.col("_hinglish"), F.lit("hinglish")).otherwise(F.coalesce("_best", F.lit(UNKNOWN)))
    return df.withColumn("language", language).drop("_hinglish", "_words", "_model", "_best", f"_{text}_low")


def most_frequent(hits: dict[str, Column]) -> Column:
    """The key with the highest count, the first one on a tie; null where all are 0."""
    ranked = [
        F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(lang).alias("lang"))
        for i, (lang, n) in enumerate(hits.items())
    ]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["lang"])


def three_way() -> Column:
    language = F.col("language")
    return F.when(language.isin("hinglish", "en"), language).otherwise(F.lit("other"))


def route_three_way(df: DataFrame) -> dict[str, DataFrame]:
    """Rows by route: hinglish, en, other."""
    return {route: df.filter(three_way() == route) for route in ("hinglish", "en", "other")}


def route_two_way(multilingual: Column, default: Column) -> Column:
    """One pass for scorers that are expressions."""
    return F.when(F.col("language").isin(*MULTILINGUAL), multilingual).otherwise(default)


def route_scorers(
    df: DataFrame,
    multilingual: Callable[[DataFrame], DataFrame],
    default: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Two filters and a union, for scorers that take a DataFrame."""
    multi = F.col("language").isin(*MULTILINGUAL)
    return multilingual(df.filter(multi)).unionByName(default(df.filter(~multi)))


def mix_text(hinglish: Column, total: Column) -> Column:
    mixed = F.concat(
        F.lit("Mixed English + Hinglish ("), hinglish.cast("string"), F.lit("/"),
        total.cast("string"), F.lit(" Hinglish)"),
    )
    few = hinglish < total * MOSTLY_ENGLISH_BELOW
    return F.when(few, F.lit("Mostly English")).otherwise(mixed)


def language_mix(df: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    counted = df.groupBy(*keys).agg(
        F.count_if(F.col("language") == "hinglish").alias("hinglish"), F.count("*").alias("total")
    )
    return counted.withColumn("language_mix", mix_text(F.col("hinglish"), F.col("total")))


def hinglish_count(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(
        F.count_if(F.col("language").isin("hinglish", "hi")).alias("hinglish_count")
    )
