"""Names of emoji: every sign with the Unicode property, and sequences of signs as one name.

Common signs have their usual short names; all others are named by their character name, in lower case
with underscores, from the Unicode data of the running Python. A sequence is matched as long as it goes: a sign
with its variation selector or skin tone, signs joined by a zero-width joiner, flags of two regional letters,
flags of tags, keycaps. Names of the parts of a sequence are joined by underscores. Letter pairs that
are no region, and signs without a name, stay as they are.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import regex
from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from crowdread.functions import lexicon

LETTER_A, TONES = 0x1F1E6, (0x1F3FB, 0x1F3FF)
SELECTOR, JOINER, KEYCAP, BLACK_FLAG = 0xFE0F, 0x200D, 0x20E3, 0x1F3F4
#: Ranges that hold all signs, the keycap too.
WIDE = r"\x{a9}\x{ae}\x{2030}-\x{214f}\x{2190}-\x{33ff}\x{1f000}-\x{1ffff}"
#: Flags of tags that are in use, by their letters. Fixed values.
TAG_FLAGS = {"gbeng": "England", "gbsct": "Scotland", "gbwls": "Wales"}


@cache
def sign_names() -> dict[int, str]:
    """Code point and name of every sign; plain digits and marks count only as keycaps."""
    found = regex.compile(r"[\p{Emoji}--\p{ASCII}--[\U0001F1E6-\U0001F1FF]]", regex.V1)
    names = {}
    for code in range(0x80, 0x20000):
        if found.match(chr(code)):
            names[code] = unicodedata.name(chr(code), "").lower().replace(" ", "_").replace(",", "")
    fixed = {ord(sign): name for sign, name in {**lexicon.EMOJI_NAMES, **lexicon.SKIN_TONES}.items()}
    return {code: name for code, name in (names | fixed).items() if name}


@cache
def region_names() -> dict[str, str]:
    """Two letters and the English name of every region that Java knows."""
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH).replace(" ", "_") for code in locale.getISOCountries()}


def ranges(codes: list[int]) -> str:
    """The code points as the inside of a character class."""
    out, first = [], None
    for code, after in zip(codes, [*codes[1:], None]):
        first = code if first is None else first
        if after != code + 1:
            out.append(rf"\x{{{first:x}}}" if first == code else rf"\x{{{first:x}}}-\x{{{code:x}}}")
            first = None
    return "".join(out)


@cache
def patterns() -> tuple[str, str]:
    """Java patterns: what a text with a sequence holds at least, and one sequence."""
    signs = ranges(sorted(sign_names()))
    letters = rf"\x{{{LETTER_A:x}}}-\x{{{LETTER_A + 25:x}}}"
    sign = rf"[{signs}](?:\x{{{SELECTOR:x}}}|[\x{{{TONES[0]:x}}}-\x{{{TONES[1]:x}}}])?"
    tags = rf"\x{{{BLACK_FLAG:x}}}[\x{{e0020}}-\x{{e007e}}]+\x{{e007f}}"
    keycap = rf"[0-9#*]\x{{{SELECTOR:x}}}?\x{{{KEYCAP:x}}}"
    # A look at a few wide ranges spares other text the search through all signs.
    sequence = rf"{keycap}|(?=[{WIDE}])(?:{tags}|[{letters}]{{2}}|{sign}(?:\x{{{JOINER:x}}}{sign})*)"
    return rf"[{WIDE}]", sequence


def literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def sequence_name(sequence: Column) -> Column:
    """The name of one sequence, null if it has none."""
    codes = F.transform(F.regexp_extract_all(sequence, F.lit("(?s)."), F.lit(0)), F.ascii)
    names = sign_names()
    known = literal(sorted(names), "int"), literal([names[c] for c in sorted(names)], "string")
    regions = region_names()
    pairs = literal(sorted(regions), "string"), literal([regions[r] for r in sorted(regions)], "string")

    def looked_up(value: Column, table: tuple[Column, Column]) -> Column:
        return F.get(table[1], (F.array_position(table[0], value) - 1).cast("int"))

    def of_codes(codes: Column) -> Column:
        first, second = F.get(codes, F.lit(0)), F.get(codes, F.lit(1))
        parts = F.filter(codes, lambda c: ~c.isin(SELECTOR, JOINER))
        joined = F.array_join(F.transform(parts, lambda c: looked_up(c, known)), "_")
        pair = F.concat(F.char((first - (LETTER_A - 65)).cast("long")), F.char((second - (LETTER_A - 65)).cast("long")))
        tags = F.array_join(F.transform(F.filter(codes, lambda c: c.between(0xE0020, 0xE007E)), lambda c: F.char((c - 0xE0000).cast("long"))), "")
        tag_names = F.element_at(F.create_map(*[F.lit(x) for kv in TAG_FLAGS.items() for x in kv]), tags)
        return (
            F.when(first < 0x80, F.concat(F.lit("keycap_"), F.char(first.cast("long"))))
            .when(first.between(LETTER_A, LETTER_A + 25), looked_up(pair, pairs))
            .when((first == BLACK_FLAG) & second.between(0xE0020, 0xE007E), tag_names)
            .otherwise(joined)
        )

    return F.get(F.transform(F.array(codes), of_codes), F.lit(0))


def emoji_to_words(text: Column) -> Column:
    """Each sign or sequence of signs becomes its name with a blank on both sides."""
    start, sequence = patterns()
    # What stands before each sequence, and behind the last one.
    between = F.split(text, sequence, -1)
    sequences = F.regexp_extract_all(text, F.lit(sequence), F.lit(0))
    blank = F.lit(" ")

    def named(plain: Column, signs: Column) -> Column:
        name = sequence_name(signs)
        return F.concat(plain, F.when(signs.isNull(), F.lit("")).otherwise(F.coalesce(F.concat(blank, name, blank), signs)))

    words = F.array_join(F.zip_with(between, sequences, named), "")
    # Plain ASCII text, told by its length in bytes, is not searched.
    found = (F.octet_length(text) != F.length(text)) & text.rlike(start)
    return F.when(found, words).otherwise(text)
