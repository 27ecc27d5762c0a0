"""Label columns on comment rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from crowdread.functions import labels
from crowdread.functions.labels import Terms
from crowdread.operators.metrics import best_cut, rank_sum_auc, score_bins
from crowdread.operators.terms import lowered
from crowdread.schema import LABEL_DEFAULTS, SCORES
from crowdread.session import staged

BATCH = 32
MULTILINGUAL_BATCH = 16

Model = Callable[[list[str]], list[list[tuple[str, float]]]]


def score_column(text: Column, load_model: Callable[[], Model], batch: int = BATCH) -> Column:
    """Scores of a plugged-in model as an array of (label, score).

    ``load_model`` runs once per task and returns the model; the model takes a list of at
    most ``batch`` texts. Only the text travels to Python, and whole; a model with an input limit cuts for itself.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas

        model = load_model()
        for texts in batches:
            rows = []
            for start in range(0, len(texts), batch):
                part = [t or "" for t in texts.iloc[start : start + batch]]
                rows += [[{"label": n, "score": s} for n, s in out] for out in model(part)]
            yield pandas.Series(rows)

    return F.pandas_udf(score, SCORES)(text)


def lexicon_scores(terms: Terms) -> Column:
    return labels.lexicon_sentiment(terms)


def label_emotions(df: DataFrame, text: str, terms: Terms | None = None) -> DataFrame:
    """Emotion group columns, ``raw_top`` and ``emotion_model_rule`` from ``emotion_scores``.

    Needs ``sentiment``. Scores are rounded to 4 places before they are summed.
    """
    df, terms = lowered(df, text, terms)
    df = df.withColumn("_fine", labels.rounded(F.col("emotion_scores")))
    df = df.withColumn("_groups", labels.group_emotions(F.col("_fine")))
    emotion = labels.model_emotion(F.col("_groups"), terms, F.col("sentiment"))
    named = {
        "emotion_model_rule": emotion,
        "raw_top": labels.top_label(F.col("_fine")),
        **{e: labels.group_score(F.col("_groups"), e) for e in labels.EMOTIONS},
    }
    return df.withColumns(named).drop("_fine", "_groups", f"_{text}_low")


def label_toxicity(df: DataFrame) -> DataFrame:
    """``is_toxic`` and ``toxic_score`` from ``toxic_label`` and ``toxic_raw``."""
    verdict = labels.toxicity_label(F.col("toxic_label"), F.col("toxic_raw"))
    return _unpack(df, verdict, "is_toxic", "toxic_score")


def label_sarcasm(df: DataFrame, text: str, terms: Terms | None = None) -> DataFrame:
    """``is_sarcastic`` and ``sarcasm_score`` from ``irony_label`` and ``irony_raw``."""
    df, terms = lowered(df, text, terms)
    verdict = labels.sarcasm_label(F.col("irony_label"), F.col("irony_raw"))
    df = _unpack(df, verdict, "is_sarcastic", "sarcasm_score")
    flag = labels.sarcasm_override(terms, F.col(text), F.col("is_sarcastic"), F.col("irony_raw"))
    return df.withColumn("is_sarcastic", flag).drop(f"_{text}_low")


def label_sentiment(df: DataFrame) -> DataFrame:
    """``sentiment`` and the three score columns from ``sentiment_scores``."""
    verdict = labels.dominant_sentiment(F.col("sentiment_scores"))
    return _unpack(
        df, verdict, "sentiment", "positive_score", "negative_score", "neutral_score"
    )


def label_intent(df: DataFrame, text: str, terms: Terms | None = None) -> DataFrame:
    df, terms = lowered(df, text, terms)
    return df.withColumn("intent", labels.classify_intent(terms)).drop(f"_{text}_low")


def _unpack(df: DataFrame, verdict: Column, *fields: str) -> DataFrame:
    df = df.withColumn("_verdict", verdict)
    return df.withColumns({f: F.col("_verdict")[f] for f in fields}).drop("_verdict")


def merge_labels(comments: DataFrame, *label_sets: DataFrame) -> DataFrame:
    """Label sets joined to the comments by ``comment_id``, missing labels set to defaults."""
    for labelled in label_sets:
        comments = comments.join(labelled, "comment_id", "left")
    return with_defaults(comments)


def with_defaults(comments: DataFrame) -> DataFrame:
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in comments.columns else F.lit(value)
        for name, value in LABEL_DEFAULTS.items()
    }
    return comments.withColumns(filled)


def toxicity_model(labelled: DataFrame, features: int = 1 << 16) -> PipelineModel:
    """Text classifier trained on ``text`` and ``toxic``; rare positives weigh more.

    The two classes get equal total weight. A word counts once per text, so that long texts do not drown
    what few words tell, and the penalty leaves only words that tell something. Words are written once for all passes.
    """
    total, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    share = min(max((toxic or 0) / max(total, 1), 1e-6), 1 - 1e-6)
    weight = F.when(F.col("toxic") == 1, F.lit(0.5 / share)).otherwise(F.lit(0.5 / (1 - share)))
    counter = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features, binary=True),
        ]
    ).fit(labelled)
    counted = counter.transform(labelled.withColumn("_weight", weight))
    counted = staged(counted.select("toxic", "_weight", "_counts"), "toxicity-counts")
    learner = Pipeline(
        stages=[
            IDF(inputCol="_counts", outputCol="_features", minDocFreq=2),
            LogisticRegression(
                featuresCol="_features", labelCol="toxic", weightCol="_weight", regParam=0.02, elasticNetParam=1.0, tol=1e-4, maxIter=60,
                probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_guess",
            ),
        ]
    ).fit(counted)
    return PipelineModel(stages=[*counter.stages, *learner.stages])


def score_toxicity(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``toxic_label`` and ``toxic_raw``: the likelier label and its probability."""
    scored = model.transform(df).withColumn("_p", vector_to_array("_probability")[1])
    toxic = F.col("_p") >= 0.5
    return scored.withColumns(
        {
            "toxic_label": F.when(toxic, F.lit("toxic")).otherwise(F.lit("other")),
            "toxic_raw": F.when(toxic, F.col("_p")).otherwise(1 - F.col("_p")),
        }
    ).drop("_words", "_counts", "_features", "_margin", "_probability", "_guess", "_p")


def held_out_toxicity(labelled: DataFrame, fold: Column, features: int = 1 << 16) -> DataFrame:
    """``auc``, ``cut``, ``precision``, ``recall`` and ``f1`` on rows of fold 0, by a model that has seen none of them.

    Rows of fold 1 choose the cut, all others train the model. Scores are written once; only counts per bin
    are gathered.
    """
    rows = labelled.withColumn("_fold", fold)
    scored = score_toxicity(rows, toxicity_model(rows.filter("_fold > 1"), features))
    share = F.when(F.col("toxic_label") == "toxic", F.col("toxic_raw")).otherwise(1 - F.col("toxic_raw"))
    scored = staged(scored.filter("_fold < 2").select("_fold", "toxic", share.alias("share")), "toxicity-scores")
    held, tuned = scored.filter("_fold = 0"), scored.filter("_fold = 1")
    cut = best_cut(score_bins(tuned, "toxic", "share")).first()
    cut = 0.5 if cut is None or cut.cut is None else cut.cut
    auc = rank_sum_auc(score_bins(held, "toxic", "share")).first()
    taken, toxic = F.col("share") >= cut, F.col("toxic") == 1
    hit = F.count_if(taken & toxic)
    return held.agg(
        F.count("*").alias("held_out"),
        F.count_if(toxic).alias("toxic"),
        F.lit(auc.auc if auc else None).cast("double").alias("auc"),
        F.lit(cut).alias("cut"),
        F.coalesce(F.try_divide(hit, F.count_if(taken)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.count_if(toxic)), F.lit(0.0)).alias("recall"),
    )
