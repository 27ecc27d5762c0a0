"""Saved video records: one JSON line per video with its nested comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdread.functions.urls import canonical_url
from crowdread.schema import DUMP

#: An array has fewer than 2^31 entries, so positions of different parts never meet.
PART_BITS = 31
DESCRIPTION_CUT = 500


def read_comment_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(videos, comments). A missing comment list counts as empty.

    A video with a long comment list may be saved as several lines, numbered by ``part``,
    so that no line and no task holds all of a hot video.
    """
    raw = spark.read.schema(DUMP).json(path)
    part = F.coalesce("part", F.lit(0).cast("bigint"))
    videos = normalise_video_meta(first_parts(raw.drop("comments")))
    rows = raw.select(F.col("id").alias("video_id"), part.alias("part"), F.posexplode("comments"))
    parent = F.nullif(F.col("col.parent"), F.lit("root"))
    comments = rows.select(
        F.col("col.id").alias("comment_id"),
        "video_id",
        (F.shiftleft("part", PART_BITS) + F.col("pos")).alias("pos"),
        parent.alias("parent_id"),
        parent.isNotNull().alias("is_reply"),
        F.col("col.author").alias("author"),
        F.coalesce("col.text", F.lit("")).alias("text"),
        F.coalesce("col.like_count", F.lit(0).cast("bigint")).alias("like_count"),
    )
    return videos, comments


def first_parts(lines: DataFrame) -> DataFrame:
    """Of each video the line of the lowest part; lines without an id are videos of their own."""
    fields = [c for c in lines.columns if c not in ("id", "part")]
    part = F.coalesce("part", F.lit(0).cast("bigint"))
    named = lines.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*fields), part).alias("first"))
    unnamed = lines.filter(F.col("id").isNull() & (part == 0))
    return named.select("id", "first.*").unionByName(unnamed.select("id", *fields))


def normalise_video_meta(raw: DataFrame) -> DataFrame:
    """The 13 metadata columns with their defaults."""

    def text(name: str, default: str = ""):
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)

    channel = F.coalesce(F.nullif(F.col("uploader"), F.lit("")), "channel", F.lit("Unknown"))
    return raw.select(
        F.coalesce("id", F.lit("")).alias("video_id"),
        text("title", "Unknown"),
        channel.alias("channel"),
        text("channel_id"),
        *[number(c) for c in ("view_count", "like_count", "comment_count", "duration")],
        text("upload_date"),
        F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CUT).alias("description"),
        text("thumbnail"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        canonical_url(F.col("webpage_url")).alias("url"),
    )
