"""Names of signs and sequences against a reading of the text code point by code point."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from crowdread.functions import emoji, lexicon


def by_hand(text):
    names, regions = emoji.sign_names(), emoji.region_names()
    out, i = [], 0
    at = lambda k: ord(text[k]) if k < len(text) else 0

    def sign(k):
        """End and name of the sign at k, with its selector or tone."""
        if at(k) not in names:
            return None
        if at(k + 1) == 0xFE0F:
            return k + 2, names[at(k)]
        if 0x1F3FB <= at(k + 1) <= 0x1F3FF:
            return k + 2, f"{names[at(k)]}_{names[at(k + 1)]}"
        return k + 1, names[at(k)]

    while i < len(text):
        end = name = None
        if at(i) == 0x1F3F4 and 0xE0020 <= at(i + 1) <= 0xE007E:
            k = i + 1
            while 0xE0020 <= at(k) <= 0xE007E:
                k += 1
            if at(k) == 0xE007F:
                end, name = k + 1, emoji.TAG_FLAGS.get("".join(chr(ord(c) - 0xE0000) for c in text[i + 1 : k]))
        if end is None and text[i] in "0123456789#*":
            k = i + 2 if at(i + 1) == 0xFE0F else i + 1
            if at(k) == 0x20E3:
                end, name = k + 1, f"keycap_{text[i]}"
        if end is None and 0x1F1E6 <= at(i) <= 0x1F1FF and 0x1F1E6 <= at(i + 1) <= 0x1F1FF:
            end, name = i + 2, regions.get("".join(chr(at(k) - 0x1F1E6 + 65) for k in (i, i + 1)))
        if end is None and sign(i):
            end, name = sign(i)
            while at(end) == 0x200D and sign(end + 1):
                end, more = sign(end + 1)
                name += f"_{more}"
        if end is None:
            out.append(text[i])
            i += 1
        else:
            out.append(text[i:end] if name is None else f" {name} ")
            i = end
    return "".join(out)


def named(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", emoji.emoji_to_words(F.col("t")).alias("v")).orderBy("i").collect()]


def test_every_sign_has_a_name(spark):
    names = emoji.sign_names()
    assert len(names) > 1300 and len(set(names.values())) > 0.99 * len(names)
    signs = [chr(c) for c in sorted(names)]
    assert named(spark, signs) == [f" {names[ord(s)]} " for s in signs]
    assert all(names[ord(s)] == n for s, n in lexicon.EMOJI_NAMES.items())
    assert names[ord("🦖")] == unicodedata.name("🦖").lower().replace(" ", "_")


@pytest.mark.parametrize("text, words", [
    ("ok 🙏👏", "ok  folded_hands  clapping_hands "),
    ("👍🏽!", " thumbs_up_medium_skin_tone !"),
    ("❤️ a", " red_heart  a"),
    ("🇮🇳🇫🇷", " India  France "),
    ("🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", " England "),
    ("1️⃣ of 12", " keycap_1  of 12"),
    ("👩‍💻", f" woman_{unicodedata.name('💻').lower().replace(' ', '_')} "),
    ("naïve 100% #1 *", "naïve 100% #1 *"),
    ("🇽🇽 🇮", "🇽🇽 🇮"),
    ("", ""), (None, None),
])
def test_sequences(spark, text, words):
    assert named(spark, [text]) == [words]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in sorted(emoji.sign_names())] + list("ab 12#*é中\n") * 40
    pool += ["️", "‍", "⃣", "\U000e0067", "\U000e007f", "🏴", "🇮", "🇳", "🇫", "🏽", "👩", "1️⃣"] * 40
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts.append("😀" * 5000 + "x" * 5000)
    assert named(spark, texts) == [by_hand(t) for t in texts]


def test_wide_ranges_hold_every_sign():
    import re

    wide = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), emoji.WIDE) + "]")
    codes = [*emoji.sign_names(), emoji.KEYCAP, emoji.LETTER_A, emoji.LETTER_A + 25, emoji.BLACK_FLAG]
    assert all(wide.match(chr(c)) for c in codes)
