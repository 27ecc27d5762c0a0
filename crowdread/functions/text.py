"""Text clean-up as column expressions."""

from __future__ import annotations

import functools
from operator import or_

from pyspark.sql import Column, functions as F

from crowdread.functions.emoji import emoji_to_words

# White space as Unicode counts it, which is more than Java's ``\s`` or a plain ``trim``.
WHITE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITE_CHARS = "".join(map(chr, WHITE_CODES))
WHITE = "".join(rf"\x{{{code:x}}}" for code in WHITE_CODES)
EMOJI_RANGES = r"[\x{2600}-\x{27bf}\x{2b50}\x{2b55}\x{1f300}-\x{1faff}]"


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def has_more_words(text: Column, n: int) -> Column:
    """True if the text has more than n words; reads no further than word n + 1."""
    return text.rlike(f"^[{WHITE}]*+(?:[^{WHITE}]++[{WHITE}]++){{{n}}}[^{WHITE}]")


def clean_text(text: Column) -> Column:
    """Links dropped, white space collapsed and trimmed, emoji named, in that order.

    Regular expressions are the costly part, so they only run where there is something to
    find.
    """
    linked = text.contains("http") | text.contains("www")
    link = f"http[^{WHITE}]+|www[^{WHITE}]+"
    unlinked = F.when(linked, F.regexp_replace(text, link, "")).otherwise(text)
    blanks = F.translate(unlinked, WHITE_CHARS, " " * len(WHITE_CHARS))
    single = F.when(blanks.contains("  "), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks)
    return emoji_to_words(F.trim(single))


def has_emoji(text: Column) -> Column:
    """Plain ASCII text, told by its length in bytes, is not searched."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(EMOJI_RANGES)


def working_text(clean: Column, raw: Column) -> Column:
    """The clean text, or the raw text where cleaning left nothing."""
    return F.coalesce(F.nullif(clean, F.lit("")), raw, F.lit(""))


def model_input(text: Column, cut: int = 512) -> Column:
    """What a scoring model is given: its input is cut to a fixed number of characters."""
    return F.substring(text, 1, cut)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return functools.reduce(or_, [text.startswith(p) for p in prefixes])
