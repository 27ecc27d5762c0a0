"""How well predicted labels agree with true ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.functions.labels import emotion_group
from crowdread.functions.votes import eval_vote_keywords, weighted_vote
from crowdread.operators.terms import lowered

BINS = 4096


def accuracy(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    right = F.coalesce((F.col(y) == F.col(p)).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_report(
    df: DataFrame, y: str, p: str, labels: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where a division has no base.

    With ``labels`` exactly those classes are listed. Only the small confusion table is
    regrouped, each of its cells under its true and its predicted class.
    """
    n, zero = F.col("n"), F.lit(0).cast("bigint")

    def entry(label: Column, support: Column, guessed: Column, right: Column) -> Column:
        return F.struct(
            label.alias("label"), support.alias("support"), guessed.alias("guessed"),
            right.alias("right"),
        )

    entries = [
        entry(F.col("y"), n, zero, F.when(F.col("y") == F.col("p"), n).otherwise(zero)),
        entry(F.col("p"), zero, n, zero),
    ]
    entries += [entry(F.lit(v), zero, zero, zero) for v in labels or ()]
    sides = confusion(df, y, p, keys).select(*keys, F.inline(F.array(*entries)))
    if labels is not None:
        sides = sides.filter(F.col("label").isin(*labels))
    sums = sides.groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "guessed", "right")]
    )
    precision = F.coalesce(F.try_divide("right", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("right", "support"), F.lit(0.0))
    rated = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", F.coalesce(f1, F.lit(0.0))).drop("guessed", "right")


def weighted_scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1, classes weighted by support."""
    report = class_report(df, y, p, keys=keys)
    total = F.sum("support")
    return report.groupBy(*keys).agg(
        *[
            F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), total), F.lit(0.0)).alias(m)
            for m in ("precision", "recall", "f1")
        ]
    )


def ensemble_gain(df: DataFrame, y: str, single: str, ensemble: str) -> DataFrame:
    """Accuracy of both predictions and the gain, in percent points."""

    def share(p: str) -> Column:
        return F.avg(F.coalesce((F.col(y) == F.col(p)).cast("double"), F.lit(0.0)))

    return df.agg(
        F.round(share(single) * 100, 1).alias("single"),
        F.round(share(ensemble) * 100, 1).alias("ensemble"),
        F.round((share(ensemble) - share(single)) * 100, 1).alias("ensemble_gain"),
        F.count("*").alias("test_samples"),
    )


def plain_decisions(df: DataFrame) -> DataFrame:
    """Evaluation form: labels alone decide, without threshold or rules.

    Emotion takes the first, and only, fine label that a top-1 model returns.
    """
    return df.withColumns(
        {
            "plain_toxic": F.lower("toxic_label") == "toxic",
            "plain_sarcastic": F.lower("irony_label") == "irony",
            "plain_emotion": emotion_group(F.col("top_fine_label")),
        }
    )


def evaluation_vote(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``weighted_emotion``: the vote in which the model counts twice."""
    df, terms = lowered(df, text)
    words = eval_vote_keywords(terms)
    vote = weighted_vote(F.col(model), words, F.col("sentiment"))
    return df.withColumn("weighted_emotion", vote).drop(f"_{text}_low")


def score_bins(df: DataFrame, truth: str, score: str, bins: int = BINS, keys: Sequence[str] = ()) -> DataFrame:
    """``bin``, ``positives`` and ``negatives``: scores from 0 to 1 in equal bins.

    At most ``bins`` rows per key come out of it, whatever goes in, and bins of parts add up.
    """
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    marked = F.col(truth).cast("int") == 1
    return (
        df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*keys, place.alias("bin"))
        .agg(F.count_if(marked).alias("positives"), F.count_if(~marked).alias("negatives"))
    )


def rank_sum_auc(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``auc``: the chance that a positive scores above a negative, half of it within a bin; null without both."""
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("negatives").over(below), F.lit(0))
    counted = bins.withColumn("_won", F.col("positives") * (before + F.col("negatives") / 2))
    pairs = F.sum("positives") * F.sum("negatives")
    return counted.groupBy(*keys).agg(F.try_divide(F.sum("_won"), pairs).alias("auc"))


def best_cut(bins: DataFrame, count: int = BINS, keys: Sequence[str] = ()) -> DataFrame:
    """``cut``, ``precision``, ``recall`` and ``f1`` of the cut between bins with the best F1, the highest one on a tie."""
    above = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    hit, taken = F.sum("positives").over(above), F.sum(F.col("positives") + F.col("negatives")).over(above)
    rated = bins.withColumns({"_hit": hit, "_taken": taken, "_all": F.sum("positives").over(every)})
    rated = rated.withColumns(
        {
            "cut": F.col("bin") / count,
            "precision": F.col("_hit") / F.col("_taken"),
            "recall": F.coalesce(F.try_divide("_hit", "_all"), F.lit(0.0)),
            "f1": F.try_divide(2 * F.col("_hit"), F.col("_taken") + F.col("_all")),
        }
    )
    found = F.max_by(F.struct("cut", "precision", "recall", "f1"), F.struct("f1", "bin")).alias("_best")
    return rated.groupBy(*keys).agg(found).select(*keys, "_best.*")
