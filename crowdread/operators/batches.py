"""Batches for an outside labeller, its replies, and the facts handed to a report writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdread.operators.grouping import number_rows, top_per_group
from crowdread.operators.language import mix_text
from crowdread.schema import EMOTIONS, SENTIMENTS
from crowdread.session import staged

BATCH = 20
TEXT_CUT = 200
TIEBREAK_CUT = 150
FENCE = "```"
REPLY = "array<struct<id: bigint, emotion: string, intent: string>>"


def number_batches(comments: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch`` and ``item`` (place in the batch) of every comment of a video, in order."""
    numbered = number_rows(comments, ["video_id"], "pos", out="_ordinal")
    batch, item = F.expr(f"_ordinal div {size}"), F.col("_ordinal") % size
    return numbered.withColumns({"batch": batch, "item": item}).drop("_ordinal")


def pack_batches(
    comments: DataFrame, size: int = BATCH, cut: int = TEXT_CUT, language: bool = True
) -> DataFrame:
    """One row per batch: its lines ``i. [lang] "text"``, size and language mix."""
    comments = comments.withColumn("_cut", F.substring(F.coalesce("text", F.lit("")), 1, cut))
    kept = ["video_id", "pos", "_cut", *(["language"] if language else [])]
    # Numbering reads its rows several times, so the cut texts are written once.
    rows = number_batches(staged(comments.select(*kept), "cut-texts"), size)
    parts = [F.col("item").cast("string"), F.lit(". ")]
    if language:
        parts += [F.lit("["), F.coalesce("language", F.lit("en")), F.lit("] ")]
    line = F.concat(*parts, F.lit('"'), F.col("_cut"), F.lit('"'))
    lines = F.array_sort(F.collect_list(F.struct("item", line.alias("line"))))
    aggregates = [F.count("*").alias("size"), F.transform(lines, lambda r: r["line"]).alias("_lines")]
    if language:
        hinglish = F.count_if(F.col("language") == "hinglish")
        aggregates.append(mix_text(hinglish, F.count("*")).alias("language_mix"))
    packed = rows.groupBy("video_id", "batch").agg(*aggregates)
    return packed.withColumn("lines", F.array_join("_lines", "\n")).drop("_lines")


def pack_conflicts(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Batches of the rows whose votes conflict, in the shorter form for tie-breaks."""
    return pack_batches(df.filter("conflict"), size, TIEBREAK_CUT, language=False)


def reply_array(reply: Column) -> Column:
    """The JSON array inside a reply, without its code fence."""
    raw = F.btrim(reply, F.lit(" \n\r\t"))
    inside = F.get(F.split(raw, FENCE), F.lit(1))
    bare = F.when(raw.contains(FENCE), F.regexp_replace(inside, "^json", "")).otherwise(raw)
    return F.btrim(bare, F.lit(" \n\r\t"))


def parse_label_reply(replies: DataFrame, keys: Sequence[str] = ("video_id", "batch")) -> DataFrame:
    """One row per labelled item of each ``reply``; broken JSON gives no rows.

    An id named twice in a reply counts with its last label.
    """
    text = reply_array(F.col("reply"))
    is_array = text.startswith("[") & text.endswith("]")
    items = replies.select(
        *keys, F.posexplode(F.when(is_array, F.from_json(text, REPLY))).alias("_place", "_item")
    )
    labelled = items.select(
        *keys,
        F.col("_item.id").alias("id"),
        "_place",
        F.coalesce("_item.emotion", F.lit("neutral")).alias("emotion"),
        F.coalesce("_item.intent", F.lit("general")).alias("intent"),
    ).filter("id >= 0")
    last = labelled.groupBy(*keys, "id").agg(
        F.max_by(F.struct("emotion", "intent"), "_place").alias("_last")
    )
    return last.select(*keys, "id", "_last.emotion", "_last.intent")


def apply_labels(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """Emotion and intent of the labelled items; other rows stay as they are.

    ``df`` carries ``batch`` and ``item``; ids past the end of a batch match no row.
    """
    found = labelled.select(
        "video_id", "batch", F.col("id").alias("item"),
        F.col("emotion").alias("_emotion"), F.col("intent").alias("_intent"),
    )
    joined = df.join(found, ["video_id", "batch", "item"], "left")
    return joined.withColumns(
        {
            "dominant_emotion": F.coalesce("_emotion", "dominant_emotion"),
            "intent": F.coalesce("_intent", "intent"),
        }
    ).drop("_emotion", "_intent")


def topic_line(n: int) -> Column:
    """The first n topic labels of a report row."""
    return F.array_join(F.transform(F.slice("topics", 1, n), lambda t: t["label"]), ", ")


def report_facts(report: DataFrame) -> DataFrame:
    """What a report writer is told about a video."""
    return report.select(
        "video_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("channel", F.lit("Unknown")).alias("channel"),
        "approval_score",
        F.to_json("sentiment_counts").alias("sentiments"),
        F.to_json("emotion_counts").alias("emotions"),
        F.to_json("intent_counts").alias("intents"),
        topic_line(6).alias("topics"),
        "toxic_count",
        "total",
    )


def content_gap_evidence(
    df: DataFrame, topics: DataFrame | None = None, questions: int = 30, suggestions: int = 20
) -> DataFrame:
    """Per video the first question and suggestion texts as '- ' lines.

    ``topics`` has ``video_id`` and an array ``topics`` as in the video report.
    """
    asked = df.filter(F.col("intent").isin("question", "suggestion"))
    first = top_per_group(
        asked.select("video_id", "intent", "pos", "text"), ["video_id", "intent"], [F.col("pos")],
        max(questions, suggestions),
    )

    def lines(intent: str, n: int) -> Column:
        wanted = (F.col("intent") == intent) & (F.col("rank") <= n)
        line = F.when(wanted, F.struct("rank", F.concat(F.lit("- "), "text").alias("line")))
        ordered = F.array_sort(F.collect_list(line))
        text = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
        return F.when(F.size(ordered) > 0, text).otherwise(F.lit("None found"))

    evidence = first.groupBy("video_id").agg(
        lines("question", questions).alias("questions"),
        lines("suggestion", suggestions).alias("suggestions"),
    )
    none = F.lit("None found")
    every = df.groupBy("video_id").agg(F.count("*").alias("total")).join(evidence, "video_id", "left")
    out = every.withColumns(
        {"questions": F.coalesce("questions", none), "suggestions": F.coalesce("suggestions", none)}
    )
    if topics is None:
        return out
    return (
        out.join(topics.select("video_id", "topics"), "video_id", "left")
        .withColumn("topics", F.coalesce(topic_line(8), F.lit("")))
    )


def compare_videos(report: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two videos side by side, with differences (second less first).

    ``pairs`` holds ``video_a`` and ``video_b``.
    """
    facts = {"title": "title", "approval_score": "approval", "toxic_count": "toxic"}
    columns = [F.col(k).alias(v) for k, v in facts.items()]
    columns += [F.col("sentiment_counts")[s].alias(s) for s in SENTIMENTS]
    columns += [F.col("emotion_counts")[e].alias(f"emotion_{e}") for e in EMOTIONS]
    names = [*facts.values(), *SENTIMENTS, *(f"emotion_{e}" for e in EMOTIONS)]

    def side(mark: str) -> DataFrame:
        sided = report.select("video_id", *columns)
        return sided.select(
            F.col("video_id").alias(f"video_{mark}"), *[F.col(n).alias(f"{n}_{mark}") for n in names]
        )

    both = pairs.join(side("a"), "video_a").join(side("b"), "video_b")
    deltas = {
        f"{n}_delta": F.round(F.col(f"{n}_b") - F.col(f"{n}_a"), 1) if n == "approval"
        else F.col(f"{n}_b") - F.col(f"{n}_a")
        for n in names if n != "title"
    }
    return both.withColumns(deltas)


