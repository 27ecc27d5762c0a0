"""Licence scans: a trained paragraph classifier over word n-grams, in DataFrame functions only.

A paragraph is a run of lines of which all but the last are wrapped: not blank, and without a mark that ends a sentence.
Each line is scored by itself, and each paragraph of several lines also joined, so that a notice may be wrapped anywhere.
They are cut into word n-grams (one and two words); a multinomial logistic regression over the n-grams of the notices below,
fitted to these and to half of all lines of the corpus, which weigh together as ``SAMPLE`` lines, gives a score per family and for unknown. All that hold a word
of a notice are scored; others have no n-gram the model knows. Unknown is a calibrated class: a line that no notice confirms speaks of an unknown
licence only if the log odds of all families together are ``PROSE`` standard deviations above the median of the lines left out of the fit (the
deviation is taken from their median and 99th percentile); other lines do not count. A family that passes is confirmed only if a line covers at least half of
the words of a template of that family (joined lines: half of its n-grams, as they have more words), or holds one of its titles whole.

The least score of a family is set by calibration on lines and notices left out of the fit: it is above the score
of each of these that is wrongly taken for the family, and at least 0.5. No line of the corpus is left out: lines are counted by the n-grams of the notices
that they hold, which is all the model sees, and halves are told by hash. Those that the comparison with the notices confirms are no negatives. With n of
them left out of the fit and none above the limit, at most 3 / n of such lines pass the classifier, with a confidence of 95 %.

Null and empty texts have no licences. Repeated lines count each. Every row has the counts of its own text, however often its id or text
is repeated, and rows without doc_id too. Very long lines are scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from crowdread.llm.staging import release, staged

UNKNOWN = "unknown"
# The usual short notices of common licences.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "distributed under the license on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl", "this source code is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "confidential and proprietary unauthorized copying is prohibited copyright"),
)
# Short notices count only as a whole: titles, usual short forms and SPDX names (as spdx license identifier ...).
TITLES = {
    "apache": ("apache license", "apache licence", "apache software license", "apache 2 0", "apache license 2 0"),
    "mit": ("mit license", "mit licence", "the mit license mit"),
    "bsd": ("bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "bsd 3 clause license"),
    "gpl": ("gnu general public license", "gnu general public licence", "gnu gpl", "gpl v2", "gpl v3", "gplv2", "gplv3", "gpl 2 0", "gpl 3 0"),
    "lgpl": (
        "gnu lesser general public license", "gnu lesser general public licence", "gnu library general public license",
        "gnu lgpl", "lgpl v2 1", "lgpl v3", "lgplv2 1", "lgplv3", "lgpl 2 1", "lgpl 3 0",
    ),
    "mpl": ("mozilla public license", "mozilla public licence", "mpl 2 0", "mpl 1 1"),
    "proprietary": ("proprietary and confidential", "confidential and proprietary"),
}
SPDX = {
    "apache": ("apache 2 0",), "mit": ("mit",), "bsd": ("bsd 2 clause", "bsd 3 clause"), "gpl": ("gpl 2 0", "gpl 3 0"),
    "lgpl": ("lgpl 2 1", "lgpl 3 0"), "mpl": ("mpl 2 0",),
}
CC_WORDS = {
    "cc-by": "attribution", "cc-by-nc": "attribution noncommercial", "cc-by-sa": "attribution sharealike", "cc-by-nd": "attribution noderivatives",
    "cc-by-nc-sa": "attribution noncommercial sharealike", "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
ENDING = r"\s.!?:;"
#: Lines that those of the corpus, however many, weigh as in the fit.
SAMPLE = 500
#: How many standard deviations above prose a line has to be to speak of a licence.
PROSE = 6
COVER = 0.5


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def grams_of(words: str) -> Column:
    two = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.concat(F.col(words), two))


def grams_in(words: str) -> set[str]:
    """The n-grams of a notice."""
    parts = words.split()
    return {*parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:]))}


def notices() -> list[tuple[str, str, bool]]:
    """family, words, and whether they count only as a whole."""
    out = [(family, words, False) for family, words in TEMPLATES]
    out += [(family, words, True) for family, own in TITLES.items() for words in own]
    out += [(family, f"spdx license identifier {words}", True) for family, own in SPDX.items() for words in own]
    for family, words in CC_WORDS.items():
        short, split = family.replace("-", " "), words.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")
        for version in CC_VERSIONS:
            out += [(family, f"{x} {version}", True) for x in {short, f"creative commons {words}", f"creative commons {split}"}]
        out += [(family, f"creative commons {x} license", True) for x in {words, split}]
    return sorted(set(out))


@dataclass
class Model:
    """The n-gram vocabulary, the weights per family, the least score of each family that counts, and the share of all
    families together above which a line speaks of a licence."""

    families: list[str]
    vocabulary: CountVectorizerModel
    weights: LogisticRegressionModel
    least: dict[str, float]
    licence: float = 0.5


def units(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, of (a hash of the text), paragraph, line_no and line: every line of a paragraph, without blanks at its ends, and as number -1 all of them joined."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\r]*\n[ \t]*", "\n")
    paragraphs = docs.select("doc_id", F.xxhash64(text).alias("of"), F.posexplode(F.split(plain, rf"(?<![^{ENDING}])\n|\n(?!\S)")).alias("paragraph", "text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    joined = F.array(F.struct(F.lit(-1).alias("line_no"), F.col("text").alias("line")))
    rows = paragraphs.select("doc_id", "of", "paragraph", F.explode(F.when(F.contains("text", F.lit("\n")), F.concat(lines, joined)).otherwise(lines)).alias("unit"))
    return rows.select("doc_id", "of", "paragraph", "unit.line_no", "unit.line")


def with_words(rows: DataFrame) -> DataFrame:
    """The rows that hold a word of a notice, with their words and n-grams."""
    known = sorted({w for _, words, _ in notices() for w in words.split()})
    rows = rows.withColumn("w", words_of(F.col("line"))).filter(F.exists("w", lambda w: w.isin(*known)))
    return rows.withColumn("grams", grams_of("w"))


def covered(own: str, joined: Column) -> Column:
    """Whether a row covers enough of one of the notices ``own``, or holds a title whole."""
    share = lambda of, parts: F.size(F.array_intersect(of, parts)) >= COVER * F.size(parts)
    plain = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    return F.coalesce(F.exists(own, lambda x: F.when(x["whole"], plain.contains(x["words"]))
                               .otherwise(F.when(joined, share(F.col("grams"), x["grams"])).otherwise(share(F.col("w"), x["parts"])))), F.lit(False))


def compared() -> dict[str, list]:
    """The notices of each family as ``covered`` takes them."""
    own: dict[str, list] = {}
    for family, words, whole in notices():
        grams = [] if whole else sorted(grams_in(words))
        own.setdefault(family, []).append((f" {words} ", sorted(set(words.split())), grams, whole))
    return own


NOTICE = "array<struct<words:string,parts:array<string>,grams:array<string>,whole:boolean>>"


def corpus_lines(docs: DataFrame, text: str) -> DataFrame:
    """All lines of the corpus that no notice confirms, counted by what the model sees of them: ``grams`` (those of the notices), ``fitted`` and ``n``.

    Half of the lines, by hash, are for the fit. Here a title is confirmed by its n-grams.
    """
    spark = docs.sparkSession
    vocabulary = sorted({g for _, words, _ in notices() for g in grams_in(words)})
    known = sorted({w for _, words, _ in notices() for w in words.split()})
    lines = units(docs, text).filter("line_no >= 0 AND line <> ''")
    lines = lines.select((F.xxhash64("doc_id", "paragraph", "line_no", "line") % 2 == 0).alias("fitted"), words_of(F.col("line")).alias("w"))
    held = F.sort_array(F.filter(grams_of("w"), lambda g: g.isin(*vocabulary)))
    lines = lines.withColumn("grams", F.when(F.exists("w", lambda w: w.isin(*known)), held).otherwise(F.array().cast("array<string>")))
    groups = lines.groupBy("grams").agg(F.count_if("fitted").alias("inside"), F.count_if(~F.col("fitted")).alias("outside")).withColumn("one", F.lit(1))
    asked = lambda kind: sorted({tuple(sorted(grams_in(x) if kind else set(x.split()))) for _, x, whole in notices() if whole == kind})
    table = spark.createDataFrame([(1, asked(False), asked(True))], "one int, templates array<array<string>>, titles array<array<string>>")
    share = lambda parts: F.size(F.array_intersect("grams", parts)) / F.size(parts)
    # Few lines hold the longest n-gram of a title, without which it is not there.
    maybe = F.exists("grams", lambda g: g.isin(*sorted({max(x, key=len) for x in asked(True)})))
    confirmed = F.exists("templates", lambda x: share(x) >= COVER) | (maybe & F.exists("titles", lambda x: share(x) >= 1))
    halves = F.inline(F.array(F.struct(F.lit(True).alias("fitted"), F.col("inside").alias("n")), F.struct(F.lit(False).alias("fitted"), F.col("outside").alias("n"))))
    rows = groups.join(F.broadcast(table), "one").filter(~confirmed).select("grams", halves).filter("n > 0")
    return staged(rows, "negatives")


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Trains on half of the rows (notices, notices with words of the corpus around, and all lines of no licence), calibrates on the others.

    The lines of the corpus that train weigh together as ``sample`` of them.
    """
    spark = docs.sparkSession
    negatives = corpus_lines(docs, text)
    some = negatives.filter("size(grams) > 0").orderBy(F.xxhash64("grams"), "grams", "fitted").limit(20).collect()
    around = [" ".join([g for g in r.grams if " " not in g][:6]) for r in some] or [""]
    known, mixed = [], ("driving license plate", "she asked for permission to leave", "copyright law is taught in class", "a warrant was issued", "the public domain of ideas")
    for i, (family, words, _) in enumerate(notices()):
        before, after = around[i % len(around)], around[(i + 7) % len(around)]
        known += [(family, words, True), (family, f"{before} {words}", True), (family, f"{words} {after}", False)]
    known = spark.createDataFrame([*known, *((UNKNOWN, x, True) for x in mixed)], "family string, line string, fitted boolean")
    known = known.withColumn("w", words_of(F.col("line"))).select("family", grams_of("w").alias("grams"), "fitted", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight"))
    total = negatives.agg(F.sum("n")).first()[0] or 0
    rows = known.unionByName(negatives.select(F.lit(UNKNOWN).alias("family"), "grams", "fitted", "n", (F.col("n") * min(1.0, sample / max(total, 1))).alias("weight")))
    families = sorted({f for f, _, _ in notices()} | {UNKNOWN})
    rows = rows.withColumn("label", F.array_position(F.lit(families), F.col("family")).cast("double") - 1)
    grams = spark.createDataFrame([(x[1],) for x in notices()], "line string").withColumn("w", words_of(F.col("line"))).withColumn("grams", grams_of("w"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 14).fit(grams)
    learner = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.0005, maxIter=60)
    trained = learner.fit(vocabulary.transform(rows.filter("fitted")))
    model = Model(families, vocabulary, trained, {})
    odds = F.round(F.log(F.col("licence") / (1 - F.col("licence"))), 3)
    left_out = staged(scored(rows.filter("NOT fitted").select("family", "grams", "n"), model).select("family", "guess", "score", "licence", "n"), "left-out")
    wrong = left_out.filter((F.col("guess") != UNKNOWN) & (F.col("guess") != F.col("family"))).groupBy("guess").agg(F.max("score").alias("score"))
    worst = {r.guess: r.score for r in wrong.collect()}
    model.least = {f: max(0.5, worst.get(f, 0.0)) for f in families if f != UNKNOWN}
    # Log odds to three places, so that there are at most 56,000 of them.
    prose = left_out.filter((F.col("family") == UNKNOWN) & F.col("licence").between(1e-12, 1 - 1e-12)).groupBy(odds.alias("odds")).agg(F.sum("n").alias("n"))
    middle = prose.agg(F.percentile("odds", [0.5, 0.99], F.col("n"))).first()[0]
    if middle:
        limit = middle[0] + PROSE * (middle[1] - middle[0]) / 2.326
        model.licence = 1 / (1 + math.exp(-limit))
    release(negatives, left_out)
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``guess``, ``score``, its probability, and ``licence``, that of all families together, to rows with ``grams``."""
    rows = model.weights.transform(model.vocabulary.transform(rows))
    rows = rows.withColumn("shares", vector_to_array("probability")).withColumn("score", F.array_max("shares"))
    guess = F.get(F.lit(model.families), F.array_position("shares", F.col("score")).cast("int") - 1)
    rows = rows.withColumn("guess", guess).withColumn("licence", 1 - F.get("shares", F.lit(model.families.index(UNKNOWN))))
    return rows.drop("x", "rawPrediction", "probability", "prediction", "shares")


def scanned(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, of, paragraph, line_no (in the paragraph; -1: all its lines joined), line, family and score of every line that speaks of a
    licence: its family is confirmed by a notice, or all families together pass their limit and it is unknown."""
    model = fit(docs, text, sample)
    rows = scored(with_words(units(docs, text)), model)
    known = [(family, own, model.least[family]) for family, own in compared().items()]
    known = docs.sparkSession.createDataFrame(known, f"guess string, own {NOTICE}, least double")
    rows = rows.join(F.broadcast(known), "guess", "left")  # as many rows as families
    sure = (F.col("guess") != UNKNOWN) & (F.col("score") > F.col("least")) & covered("own", F.col("line_no") < 0)
    rows = rows.withColumn("family", F.when(sure, F.col("guess")).when(F.col("licence") > model.licence, UNKNOWN))
    return rows.filter("family IS NOT NULL").select("doc_id", "of", "paragraph", "line_no", "line", "family", F.round("score", 6).alias("score"))


def licences(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, n_lines that speak of a licence, n_unknown (those confirmed neither by themselves nor in their
    paragraph), and the families found, in order of name. Each row has the counts of its own text, rows without doc_id too."""
    rows = scanned(docs, text, sample).withColumn("own", F.col("line_no") >= 0).withColumn("open", F.col("family") == UNKNOWN)
    # Sets of line numbers, as rows that repeat a text bring each line again.
    found = rows.groupBy("doc_id", "of", "paragraph").agg(
        F.size(F.collect_set(F.when(F.col("own"), F.col("line_no")))).alias("n"),
        F.size(F.collect_set(F.when(F.col("own") & F.col("open"), F.col("line_no")))).alias("n_open"),
        F.coalesce(F.bool_or(~F.col("own") & ~F.col("open")), F.lit(False)).alias("whole"),
        F.collect_set(F.when(~F.col("open"), F.col("family"))).alias("families"),
    )
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).agg(
        F.sum("n").alias("n_lines"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("n_open"))).alias("n_unknown"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"),
    )
    each = docs.select("doc_id", F.xxhash64(text).alias("of"))
    rows = each.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", zero("n_lines"), zero("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))
