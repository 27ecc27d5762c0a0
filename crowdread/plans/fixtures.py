"""Comment and video views made from the test tables.

Every document gives two comments: a long one, a phrase and the whole document text, and a
short one, the phrase alone. Model outputs are stood in for by arithmetic on the id, so
that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PHRASES = (
    "thank you sir great explanation",
    "why is the sound so low?",
    "great lessons, could you add captions please",
    "total waste of time, the worst i have seen today",
    "this is so sad",
    "wow mind blown",
    "i am scared of exams",
    "kya mast gaana hai bhai, bawaal, right?",
    "no one explains like this, hats off",
    "getting error in import, please help me",
    "yeah right, clearly the best",
    "clickbait fake lies",
    "thanks, i like how calmly each step is shown",
    "see http://x.example.com/a?b=1 and www.example.org now, please explain",
    "   spaced    text  ",
    "ok",
    "",
    "🙏 ❤ great",
    "gross and vile",
    "please continue, you are the best teacher 🙏 👏, worst audio",
)
# Sequences of signs and what they are called.
SEQUENCES = {
    "👍🏽": " thumbs_up_medium_skin_tone ", "❤️": " red_heart ", "🇮🇳": " India ", "🇧🇷🇯🇵": " Brazil  Japan ",
    "7️⃣": " keycap_7 ", "👩‍🚀": " woman_rocket ", "🦖": " t-rex ", "☕!": " hot_beverage !", "🙏👏": " folded_hands  clapping_hands ",
    "7 #": "7 #",
}
FIRST_LABELS = (
    "admiration", "anger", "grief", "fear", "surprise", "disgust", "neutral", "curiosity",
    "oddlabel",
)
SECOND_LABELS = (
    "joy", "annoyance", "remorse", "nervousness", "realization", "embarrassment", "neutral",
)
TITLES = (
    "Python tutorial for beginners", "Election news tonight", "Travel vlog by the sea",
    "Funny prank", "Gym workout plan", "New llm release", "My story",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.split(F.lit("|".join(values)), r"\|"), index.cast("int"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    block = F.expr("doc_id div 20")
    rows = docs.select(
        F.col("source").alias("video_id"),
        "doc_id",
        "lang",
        F.col("text").alias("body"),
        pick(PHRASES, (F.col("doc_id") + block) % 20).alias("phrase"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("form"),
    ).withColumn("comment_id", F.col("doc_id") * 2 + F.col("form"))
    cid, level = F.col("comment_id"), block % 4
    p, n, u = (cid * 13) % 101, (cid * 29) % 101, (cid * 53) % 101
    total = p + n + u + F.lit(1.0)
    return rows.select(
        "comment_id",
        "video_id",
        F.when(level != 0, cid - 40 * level).alias("parent_id"),
        (level != 0).alias("is_reply"),
        "lang",
        F.when(F.col("form") == 0, F.concat("phrase", F.lit(" "), "body"))
        .when(F.col("doc_id") % 7 == 0, F.upper("phrase"))
        .otherwise(F.col("phrase"))
        .alias("text"),
        F.when(cid % 50 != 49, (cid * 37) % 601).alias("like_count"),
        F.round(p / total, 4).alias("positive_score"),
        F.round(n / total, 4).alias("negative_score"),
        F.round((u + 1) / total, 4).alias("neutral_score"),
        pick(FIRST_LABELS, (cid * 11) % 9).alias("emo1"),
        F.round(((cid * 17) % 100) / F.lit(100.0), 4).alias("emo1_score"),
        pick(SECOND_LABELS, (cid * 5) % 7).alias("emo2"),
        F.round((100 - (cid * 17) % 100) * F.lit(0.3) / F.lit(100.0), 4).alias("emo2_score"),
        F.when(cid % 9 < 3, F.lit("toxic")).when(cid % 9 == 3, F.lit("insult"))
        .otherwise(F.lit("other")).alias("toxic_label"),
        F.round(((cid * 31) % 101) / F.lit(100.0), 4).alias("toxic_raw"),
        F.when(cid % 4 < 2, F.lit("irony")).otherwise(F.lit("non_irony")).alias("irony_label"),
        F.round(0.5 + ((cid * 19) % 51) / F.lit(100.0), 4).alias("irony_raw"),
    )


def with_pos(df: DataFrame) -> DataFrame:
    """``pos``, the order of arrival within a video, is the comment id here."""
    return df.withColumn("pos", F.col("comment_id"))


def scored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with their stand-in model outputs in the shape the operators take."""
    df = with_pos(comments(spark, sf_dir))

    def entry(label: Column, score: str) -> Column:
        return F.struct(label.alias("label"), F.col(score).alias("score"))

    return df.withColumns(
        {
            "sentiment_scores": F.array(
                entry(F.lit("positive"), "positive_score"),
                entry(F.lit("negative"), "negative_score"),
                entry(F.lit("neutral"), "neutral_score"),
            ),
            "emotion_scores": F.array(
                entry(F.col("emo1"), "emo1_score"), entry(F.col("emo2"), "emo2_score")
            ),
        }
    ).drop(
        "positive_score", "negative_score", "neutral_score", "emo1", "emo1_score", "emo2",
        "emo2_score",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id")).distinct()
    vn = F.substring("video_id", 4, 9).cast("int")
    digit = (vn % 10).cast("string")
    urls = F.array(
        F.concat(F.lit("https://youtu.be/AbCdEfGh_"), digit, F.lit("?t=3")),
        F.concat(F.lit("https://www.youtube.com/watch?list=PL1&v=AbCdEfGh-"), digit),
        F.concat(F.lit("https://www.youtube.com/shorts/AbCdEfGh0"), digit),
        F.lit("https://www.youtube.com/watch?v=short"),
        F.lit("not a url"),
    )
    return sources.select(
        "video_id",
        vn.alias("vn"),
        pick(TITLES, vn % 7).alias("title"),
        F.concat(F.lit("channel"), (vn % 4).cast("string")).alias("channel"),
        F.element_at(urls, vn % 5 + 1).alias("url"),
    )
