"""Comment rows: empty texts, duplicates, clean text, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdread.functions.text import clean_text, strip
from crowdread.operators.grouping import top_per_group

LONGER_THAN = 3


def likes() -> Column:
    return F.coalesce(F.col("like_count"), F.lit(0))


def filter_empty(comments: DataFrame) -> DataFrame:
    """Rows whose trimmed text is longer than 3 characters."""
    return comments.filter(F.length(strip(F.col("text"))) > LONGER_THAN)


def dedup_comments(comments: DataFrame) -> DataFrame:
    """Within a video, the first of the comments that are equal but for case and margins.

    Rows are grouped by a 256-bit digest, so that no long text is compared in the sort, and
    all but the first copy per map task are dropped before the one shuffle of the texts.
    """
    key = F.lower(strip(F.col("text")))
    keyed = comments.withColumn("_key", key).filter(F.col("_key") != "")
    keyed = keyed.withColumn("_key", F.sha2("_key", 256))
    copies = Window.partitionBy("video_id", "_key").orderBy("pos")
    first = keyed.withColumn("_rank", F.row_number().over(copies)).filter(F.col("_rank") <= 1)
    return first.drop("_key", "_rank")


def parse_comments(comments: DataFrame) -> DataFrame:
    """Empty and duplicate comments dropped, ``clean_text`` added beside the original."""
    kept = dedup_comments(filter_empty(comments))
    return kept.withColumn("clean_text", clean_text(F.col("text")))


def cap_comments(comments: DataFrame, n: int = 200) -> DataFrame:
    """Per video, the n comments with most likes; earlier comments first on a tie."""
    order = [likes().desc(), F.col("pos")]
    return top_per_group(comments, ["video_id"], order, n, rank="_rank").drop("_rank")


def thread_split(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top-level comments, replies)"""
    return comments.filter(~F.col("is_reply")), comments.filter("is_reply")


def reply_counts(comments: DataFrame) -> DataFrame:
    """``reply_count`` on every comment; replies themselves have none."""
    counts = (
        comments.filter(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("comment_id"))
        .agg(F.count("*").alias("reply_count"))
    )
    return comments.join(counts, "comment_id", "left").withColumn(
        "reply_count", F.coalesce("reply_count", F.lit(0))
    )
