"""Column types and fixed label domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Label domains. Fixed values.
SENTIMENTS = ("positive", "negative", "neutral")
EMOTIONS = ("joy", "anger", "sadness", "surprise", "fear", "disgust", "neutral")
INTENTS = ("praise", "complaint", "question", "suggestion", "general")

# Emotions that may stand beside a sentiment; neutral allows all. Fixed values.
VALID_EMOTIONS = {
    "positive": ("joy", "surprise", "neutral"),
    "negative": ("anger", "sadness", "fear", "disgust", "neutral"),
}

# Segment id -> (name, colour, icon, description). Fixed values.
SEGMENTS = {
    0: ("Super Fans", "#1fd99a", "⭐", "Highly positive, loyal, engaged supporters"),
    1: ("Critics", "#ff5b5b", "🗣️", "Genuinely negative or critical feedback"),
    2: ("Curious Minds", "#6c63ff", "🧐", "Genuinely curious, asking real questions"),
    3: ("Casual Viewers", "#7a7f95", "😐", "Neutral engagement, watching but not deeply invested"),
}

SCORES = T.ArrayType(
    T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
    )
)

RAW_COMMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("like_count", T.LongType()),
    ]
)

# One saved record per video, or several when its comment list was saved in parts.
DUMP = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("uploader", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("view_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
        T.StructField("comment_count", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("upload_date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("thumbnail", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("webpage_url", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("comments", T.ArrayType(RAW_COMMENT)),
    ]
)

# Defaults set on merge for labels that did not arrive. Fixed values.
LABEL_DEFAULTS = {
    "sentiment": "neutral",
    "positive_score": 0.0,
    "negative_score": 0.0,
    "neutral_score": 1.0,
    "dominant_emotion": "neutral",
    "is_toxic": False,
    "toxic_score": 0.0,
    "is_sarcastic": False,
    "sarcasm_score": 0.0,
    "like_count": 0,
}

# Columns of an export, in their order. Fixed values.
EXPORT_COLUMNS = (
    "text", "sentiment", "dominant_emotion", "intent", "is_toxic", "is_sarcastic",
    "like_count", "quality_score", "segment_label", "language",
)
