"""The character model of languages against a plain computation, and what it leaves unknown."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdread.operators import language, language_model as lm


def grams(text):
    plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return [f" {w} "[i : i + 3] for w in plain.split() for i in range(len(w))]


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    sounds = {"xa": "ba be bo ra ri sta", "xb": "zhu qué tsi ñor ül wex", "xc": "mna pto gdy szcz łow ąk"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(sounds))
        words = ["".join(rng.choice(sounds[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))]
        rows.append((i, lang, rng.choice([" ", ", ", "\n"]).join(words).capitalize()))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([*corpus(), (900, None, "ignored"), (901, "xa", None), (902, "xa", "12 %")], "id long, lang string, text string")
    return lm.fit_languages(df.repartition(3), "text", "lang", F.col("id") % 5 == 1)


def test_grams_are_those_of_the_words():
    texts = ["Ab cD", None, "", "x", "é-ñ 12 ab", "ab" * 700_000, "  a"]
    for part in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        code, row = lm.grams(part)
        got = [[] for _ in texts]
        for c, r in zip(code.tolist(), row.tolist()):
            got[r].append("".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)))
        assert got == [grams(t) for t in texts]


def test_weights_are_log_shares(model):
    counts = {k: Counter() for k in ("xa", "xb", "xc")}
    for i, lang, text in corpus():
        if i % 5 != 1:
            counts[lang].update(grams(text))
    every = set().union(*counts.values())
    assert model.languages == ("xa", "xb", "xc") and len(model.codes) == len(every)
    for gram in sorted(every)[:40]:
        code = (ord(gram[0]) << 42) | (ord(gram[1]) << 21) | ord(gram[2])
        at = model.codes.tolist().index(code)
        want = [math.log((counts[k][gram] + 0.5) / (counts[k].total() + 0.5 * (len(every) + 1))) for k in model.languages]
        assert model.weights[at].tolist() == pytest.approx(want)


def test_held_out_texts(spark, model):
    rows = corpus(seed=9, n=200)
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    got = df.select("lang", lm.language_of(F.col("text"), model).alias("l")).collect()
    assert sum(r.l == r.lang for r in got) >= 190 and all(r.l in (r.lang, "unknown") for r in got)


def test_what_is_unknown(spark, model):
    texts = [None, "", " 12 !", "kjkj vkvk pwpw qjqj", "ba zhu", "नमस्ते दुनिया", "bhai ye kya hai yaar"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = [r.l for r in df.select("id", lm.language_of(F.col("text"), model).alias("l")).orderBy("id").collect()]
    assert plain[:4] == ["unknown"] * 4 and plain[5] == "unknown"
    full = [r.language for r in language.detect_language(df, "text", model=model).orderBy("id").collect()]
    assert full[5:] == ["hi", "hinglish"] and full[:4] == ["unknown"] * 4  # markers first, then the model, then scripts


def test_nothing_to_fit_to(spark):
    df = spark.createDataFrame([(1, None, "abc")], "id long, lang string, text string")
    assert lm.fit_languages(df, "text", "lang", F.lit(False)) is None
