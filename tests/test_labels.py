import itertools

import pytest
from pyspark.sql import functions as F

from crowdread.functions import labels, lexicon, matching, votes
from crowdread.functions.matching import COUNTED, SCANNED, ScannedTerms, TextTerms, minimal_terms, scan_terms
from crowdread.operators import labelling
from crowdread.plans import fixtures
from crowdread.schema import EMOTIONS, SENTIMENTS, VALID_EMOTIONS


def test_matchers_agree(spark, sf):
    df = fixtures.comments(spark, sf).select(F.lower("text").alias("low"))
    df = df.withColumn("scan", scan_terms(F.col("low"), F.concat("low", F.lit(" best"))))
    text, scan, second = TextTerms("low"), ScannedTerms("scan"), ScannedTerms("scan", 1)
    different = [F.count_if(text.any(n) != scan.any(n)) for n in SCANNED]
    different += [F.count_if(text.count(n) != scan.count(n)) for n in COUNTED]
    different.append(F.count_if(~second.any("JOY_WORDS")))
    assert set(df.agg(*different).first()) == {0}


def test_minimal_terms_change_nothing(spark):
    for name in SCANNED:
        terms = lexicon.terms(name)
        kept = minimal_terms(terms)
        assert all(any(k in t for k in kept) for t in terms)


def test_null_text_matches_nothing(spark):
    df = spark.createDataFrame([(None,)], "low string").withColumn("scan", scan_terms(F.col("low")))
    for terms in (TextTerms("low"), ScannedTerms("scan")):
        row = df.select(terms.any("JOY_WORDS").alias("a"), terms.count("POSITIVE_TERMS").alias("n")).first()
        assert (row.a, row.n) == (False, 0)


@pytest.mark.parametrize(
    ("scores", "wanted"),
    [
        ([("Positive", 0.5), ("negative", 0.5)], ("positive", 0.5, 0.5, 0.0)),
        ([("neg", 0.2), ("neu", 0.3), ("pos", 0.3)], ("neutral", 0.3, 0.2, 0.3)),
        ([("positive", 0.12344), ("negative", 0.12336)], ("positive", 0.1234, 0.1234, 0.0)),
    ],
)
def test_dominant_sentiment(spark, scores, wanted):
    df = spark.createDataFrame([(scores,)], "s array<struct<label: string, score: double>>")
    assert tuple(df.select(labels.dominant_sentiment(F.col("s")).alias("v")).first().v) == wanted


def test_groups_sum_and_ties(spark):
    scores = [("grief", 0.2), ("joy", 0.25), ("love", 0.15), ("remorse", 0.2), ("unheard", 0.1)]
    df = spark.createDataFrame([(scores,)], "s array<struct<label: string, score: double>>")
    df = df.withColumn("g", labels.group_emotions(F.col("s")))
    row = df.select(labels.top_label(F.col("g")).alias("top"), *labels.group_columns(F.col("g"))).first()
    assert row.top == "sadness"  # equal sums: first seen
    assert (row.joy, row.sadness, row.neutral, row.fear) == (0.4, 0.4, 0.1, 0.0)


def test_fine_labels():
    members = list(itertools.chain(*lexicon.FINE_EMOTIONS.values()))
    assert len(members) == len(set(members)) == 28


@pytest.mark.parametrize(
    ("text", "label", "score", "wanted"),
    [
        ("nine words are in this text and no more", "irony", 0.9199, False),
        ("nine words are in this text and no more", "irony", 0.92, True),
        ("only eight words are in this short text", "irony", 0.94, False),
        ("only eight words are in this short text", "irony", 0.95, True),
        ("nine words are in this text and no more", "non_irony", 0.99, False),
        ("yeah right thank you", "irony", 0.93, True),
        ("thank you for nine words in this long text", "irony", 0.99, False),
    ],
)
def test_sarcasm(spark, text, label, score, wanted):
    df = spark.createDataFrame([(text, label, score)], "text string, irony_label string, irony_raw double")
    row = labelling.label_sarcasm(df, "text").first()
    assert row.is_sarcastic is wanted
    assert row.sarcasm_score == (score if label == "irony" else round(1 - score, 4))


@pytest.mark.parametrize(
    ("label", "score", "flag", "value"),
    [("toxic", 0.85, True, 0.85), ("toxic", 0.8499, False, 0.8499), ("insult", 0.99, False, 0.01)],
)
def test_toxicity(spark, label, score, flag, value):
    df = spark.createDataFrame([(label, score)], "toxic_label string, toxic_raw double")
    row = labelling.label_toxicity(df).first()
    assert (row.is_toxic, row.toxic_score) == (flag, value)


def test_majority_vote_all_cases(spark):
    cases = list(itertools.product(EMOTIONS, EMOTIONS, EMOTIONS, SENTIMENTS))
    df = spark.createDataFrame(cases, "a string, b string, c string, s string")
    winner = votes.majority_vote(F.col("a"), F.col("b"), F.col("c"), F.col("s"))
    conflict = votes.votes_conflict(F.col("a"), F.col("b"), F.col("c"))
    for row in df.select("*", winner.alias("w"), conflict.alias("x")).collect():
        given = (row.a, row.b, row.c)
        ranked = sorted(dict.fromkeys(given), key=lambda e: -given.count(e))
        allowed = [e for e in ranked if e in VALID_EMOTIONS.get(row.s, EMOTIONS)]
        default = {"positive": "joy", "negative": "anger"}.get(row.s, "neutral")
        assert row.w == (allowed[0] if allowed else default), row
        assert row.x == (len(set(given)) == 3)


def test_weighted_vote(spark):
    cases = list(itertools.product(EMOTIONS, EMOTIONS, SENTIMENTS))
    df = spark.createDataFrame(cases, "m string, k string, s string")
    for row in df.select("*", votes.weighted_vote(F.col("m"), F.col("k"), F.col("s")).alias("w")).collect():
        mood = {"positive": "joy", "negative": "anger"}.get(row.s, "neutral")
        given = (row.m, row.m, mood, row.k)
        ranked = sorted(dict.fromkeys(given), key=lambda e: -given.count(e))
        allowed = [e for e in ranked if e in VALID_EMOTIONS.get(row.s, EMOTIONS)]
        assert row.w == allowed[0], row


def test_score_column_runs_a_plugged_in_model(spark):
    def load():
        return lambda texts: [[("positive", len(t) / 100), ("negative", 0.1)] for t in texts]

    df = spark.createDataFrame([("abc",), (None,), ("x" * 600,)], "text string")
    out = df.select(labelling.score_column(F.col("text"), load, batch=2).alias("s")).collect()
    assert [r.s[0].score for r in out] == [0.03, 0.0, 6.0]  # the whole text


def test_toxicity_model_beats_chance(spark, sf):
    """On rows it was not trained on; the larger table, as toxic rows are few."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    marked = docs.join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    train, held = marked.randomSplit([0.6, 0.4], seed=7)
    scored = labelling.score_toxicity(held, labelling.toxicity_model(train, 1 << 14))
    p = F.when(F.col("toxic_label") == "toxic", F.col("toxic_raw")).otherwise(1 - F.col("toxic_raw"))
    rows = scored.select("toxic", p.alias("p")).collect()
    good, bad = [r.p for r in rows if r.toxic == 0], [r.p for r in rows if r.toxic == 1]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins / (len(good) * len(bad)) > 0.5


def test_merge_defaults(spark):
    comments = spark.createDataFrame([(1, None), (2, 5)], "comment_id bigint, like_count bigint")
    mood = spark.createDataFrame([(2, "positive")], "comment_id bigint, sentiment string")
    rows = {r.comment_id: r for r in labelling.merge_labels(comments, mood).collect()}
    assert (rows[1].sentiment, rows[1].neutral_score, rows[1].like_count) == ("neutral", 1.0, 0)
    assert (rows[2].sentiment, rows[2].is_toxic, rows[2].like_count) == ("positive", False, 5)


def test_scan_holds_few_texts_as_strings(monkeypatch):
    """A batch is searched slice by slice, and every text of it is searched."""
    held = []

    class Texts:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, size):
            return Texts(self.values[at : at + size])

        def to_pylist(self):
            held.append(len(self.values))
            return self.values

    monkeypatch.setattr(matching.F, "arrow_udf", lambda scan, kind: lambda *columns: scan)
    scan = matching.scan_terms(F.lit(""), lists=("RULE_THANKS", "POSITIVE_TERMS"))
    texts = ["thanks a lot", None, "", "nothing"] * 100 + ["thanks"]
    (found,) = scan(iter([(Texts(texts),)]))
    bit = 1 << SCANNED.index("RULE_THANKS")
    assert [row["t0_lists"] for row in found.to_pylist()] == [bit if "thanks" in (t or "") else 0 for t in texts]
    assert max(held) <= matching.SLICE and sum(held) == len(texts)
