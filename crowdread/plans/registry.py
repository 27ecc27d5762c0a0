"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdread.functions import audience, labels, text as texts, urls, votes
from crowdread.operators import (
    batches, cleaning, ensemble, labelling, language, language_model, likes, metrics, reports, segments, topics,
)
from crowdread.operators.terms import lowered, scanned
from crowdread.plans import fixtures, incremental, video_report
from crowdread.plans.fixtures import pick, table
from crowdread.schema import EMOTIONS, INTENTS, SEGMENTS, SENTIMENTS
from crowdread.session import shared_dir, staged
from crowdread.sources import dumps, exports, store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPELLINGS = ("pos", "NEG", "neu", "LABEL_0", "label_1", "Label_2", "Positive", "other")
CREATED_AT = "2024-05-01 12:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Inputs shared by several queries.


def raw_comments(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.with_pos(fixtures.comments(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.scored_comments(spark, sf)


def with_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.label_sentiment(scored(spark, sf))


def voted(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.ensemble_emotion(with_sentiment(spark, sf))


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return video_report.analyse_comments(scored(spark, sf))


def stored(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The analysed comments as a written table, which is what a reader browses.

    Filters on labels then reach the scan. On the plan itself they would be pushed below the
    label rules, each of which the optimizer would write out again.
    """
    return staged(analysed(spark, sf).select(*columns), "analysed")


def report(spark: SparkSession, sf: str) -> DataFrame:
    return video_report.video_report(analysed(spark, sf), fixtures.videos(spark, sf))


def segment_input(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, intent and the plain sarcasm flag; enough for the segment rules."""
    df = labelling.label_intent(with_sentiment(spark, sf), "text")
    return df.withColumn("is_sarcastic", F.col("irony_label") == "irony")


def given_topics(spark: SparkSession, sf: str) -> DataFrame:
    df = raw_comments(spark, sf).select("video_id", "comment_id", "text")
    return df.withColumn("topic", (F.col("comment_id") % 8 - 1).cast("int"))


def document_videos(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(video_key(), F.col("lang").alias("title"), F.col("source").alias("channel"))


def labelled_videos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        video_key(),
        F.lit("labelled").alias("title"),
        F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("channel"),
    )


def video_key() -> Column:
    return F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id")


# Sources, sinks, table upkeep.


def saved_dump(spark: SparkSession, sf: str) -> str:
    """The comments as dump lines of 200 comments each."""
    rows = batches.number_batches(raw_comments(spark, sf), 200)
    entry = F.struct(
        "item",
        F.col("comment_id").cast("string").alias("id"),
        F.coalesce(F.col("parent_id").cast("string"), F.lit("root")).alias("parent"),
        F.lit("a").alias("author"),
        "text",
        "like_count",
    )
    lines = rows.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(entry)).alias("comments"))
    path = shared_dir(spark, "dump")
    lines.select(
        F.col("video_id").alias("id"),
        F.when(F.col("batch") == 0, F.concat(F.lit("About "), "video_id")).alias("title"),
        F.lit("https://www.youtube.com/watch?v=AbCdEfGh_00&list=PL1").alias("webpage_url"),
        F.col("batch").alias("part"),
        "comments",
    ).write.json(path)
    return path


@query
def s1_read_comment_dump(spark, sf):
    return dumps.read_comment_dump(spark, saved_dump(spark, sf))[1].drop("author")


@query
def s1_read_comment_dump_videos(spark, sf):
    return dumps.read_comment_dump(spark, saved_dump(spark, sf))[0].drop("tags")


@query
def s2_normalise_video_meta(spark, sf):
    d = F.col("doc_id")
    raw = table(spark, sf, "documents").select(
        F.when(d % 9 != 8, F.concat(F.lit("v"), d.cast("string"))).alias("id"),
        F.when(d % 5 != 0, F.col("source")).alias("title"),
        F.when(d % 3 == 0, F.lit("")).when(d % 3 == 1, F.col("lang")).alias("uploader"),
        F.when(d % 4 != 0, F.col("source")).alias("channel"),
        F.when(d % 2 == 0, F.col("source")).alias("channel_id"),
        F.when(d % 7 != 0, F.col("n_chars")).alias("view_count"),
        F.when(d % 6 != 0, d).alias("like_count"),
        F.lit(None).cast("bigint").alias("comment_count"),
        (d % 600).alias("duration"),
        F.when(d % 2 == 1, F.lit("20240131")).alias("upload_date"),
        F.when(d % 10 != 0, F.col("text")).alias("description"),
        F.lit(None).cast("string").alias("thumbnail"),
        F.when(d % 3 != 0, F.array("lang", "source")).alias("tags"),
        document_url(d).alias("webpage_url"),
    )
    meta = dumps.normalise_video_meta(raw)
    return meta.withColumn("tags", F.array_join("tags", "|"))


def document_url(d: Column) -> Column:
    """Seven address forms around an id made from the document number."""
    vid = F.lpad(d.cast("string"), 11, "0")
    forms = F.array(
        F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=3")),
        F.concat(F.lit("https://www.youtube.com/watch?list=PL1&v="), vid),
        F.concat(F.lit("https://www.youtube.com/shorts/"), vid),
        F.concat(F.lit("https://www.youtube.com/live/"), vid, F.lit("?v=abcdefghijk")),
        F.concat(F.lit("https://youtu.be/"), F.substring(vid, 2, 10)),
        F.concat(F.lit("https://www.youtube.com/embed/"), vid, F.lit("tail")),
        F.lit("not a url"),
    )
    return F.element_at(forms, (d % 7 + 1).cast("int"))


def all_urls(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"),
        document_url(F.col("doc_id")).alias("url"),
    )
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("row_id"), "url"
    )
    return docs.unionByName(pages)


@query
def s3_video_id_from_url(spark, sf):
    return all_urls(spark, sf).select("row_id", urls.video_id_from_url(F.col("url")).alias("video_id"))


@query
def s4_canonical_url(spark, sf):
    return all_urls(spark, sf).select("row_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query
def s5_cap_comments(spark, sf):
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "pos", "like_count")
    return cleaning.cap_comments(slim, 200).drop("pos")


@query
def s6_upsert_videos(spark, sf):
    return tables.upsert_videos(document_videos(spark, sf), labelled_videos(spark, sf))


@query
def s7_replace_video_comments(spark, sf):
    path = shared_dir(spark, "comments")
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "parent_id", "like_count")
    tables.save_comments(slim, path, 1)
    low = F.substring("video_id", 4, 9).cast("int") < 10
    tables.save_comments(slim.filter(low & F.col("parent_id").isNotNull()), path, 2)
    tables.save_comments(slim.filter(F.lit(False)), path, 3)
    return tables.stored_comments(spark, path)


def stored_twice(spark: SparkSession, sf: str) -> str:
    """Comments of all videos, those of one in three anew, compacted and cleared."""
    path = shared_dir(spark, "comments")
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "like_count")
    kept = store.Store(spark, path)
    kept.save(slim, 1, order=["comment_id"])
    kept.save(slim.filter((video_number() % 3 == 0) & (F.col("comment_id") % 2 == 0)), 2, order=["comment_id"])
    kept.compact(3, order=["comment_id"])
    kept.vacuum()
    return path


def video_number() -> Column:
    return F.substring("video_id", 4, 9).cast("int")


@query
def s7_compacted_comments(spark, sf):
    path = stored_twice(spark, sf)
    rows = spark.read.parquet(f"{path}/rows").select("video_id", "comment_id", "like_count")
    return rows.exceptAll(tables.stored_comments(spark, path)).withColumn("stale", F.lit(True)).unionByName(
        tables.stored_comments(spark, path).withColumn("stale", F.lit(False))
    )


@query
def s9_stored_videos(spark, sf):
    return tables.stored_comments(spark, stored_twice(spark, sf), ["src1", "src3", "absent"])


@query
def s9_stored_videos_of_channel(spark, sf):
    wanted = fixtures.videos(spark, sf).filter("channel = 'channel0'")
    return tables.stored_comments(spark, stored_twice(spark, sf), wanted)


@query
def s8_upsert_analyses(spark, sf):
    old = document_videos(spark, sf).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    now = F.lit(CREATED_AT).cast("timestamp_ntz")
    out = tables.upsert_analyses(old, labelled_videos(spark, sf), now)
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query
def s9_load_for_video(spark, sf):
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "like_count")
    return tables.load_for_video(slim, ["src1", "src2", "absent"])


@query
def s9_load_for_videos_of_channel(spark, sf):
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "like_count")
    wanted = fixtures.videos(spark, sf).filter("channel = 'channel0'")
    return tables.load_for_video(slim, wanted)


@query
def s10_skip_analysed(spark, sf):
    return tables.skip_analysed(document_videos(spark, sf), labelled_videos(spark, sf))


@query
def s10_already_analysed(spark, sf):
    return tables.already_analysed(document_videos(spark, sf), labelled_videos(spark, sf))


@query
def s11_recent_analyses(spark, sf):
    stored = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("video_id"),
        F.col("event_type").alias("title"),
        F.col("value").alias("approval_score"),
        F.col("ts").alias("created_at"),
    )
    return tables.recent_analyses(stored).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    )


@query
def s12_export_comments(spark, sf):
    path = shared_dir(spark, "export")
    enriched = analysed(spark, sf)
    exports.export_comments(enriched, path)
    return exports.read_export(spark, path, exports.export_view(enriched).schema)


# Cleaning and threads.


@query
def c1_filter_empty(spark, sf):
    return cleaning.filter_empty(raw_comments(spark, sf)).select("comment_id", "text")


@query
def c2_dedup_comments(spark, sf):
    return cleaning.dedup_comments(raw_comments(spark, sf)).select("comment_id", "video_id", "text")


@query
def c3_clean_text(spark, sf):
    return raw_comments(spark, sf).select("comment_id", texts.clean_text(F.col("text")).alias("clean_text"))


@query
def c4_emoji_to_words(spark, sf):
    return raw_comments(spark, sf).select("comment_id", texts.emoji_to_words(F.col("text")).alias("named"))


@query
def c4_emoji_sequences(spark, sf):
    sign = pick(tuple(fixtures.SEQUENCES), F.col("doc_id") % len(fixtures.SEQUENCES))
    docs = table(spark, sf, "documents").select("doc_id", F.concat("lang", sign, F.col("source")).alias("text"))
    return docs.select("doc_id", texts.emoji_to_words(F.col("text")).alias("named"))


@query
def c5_parse_comments(spark, sf):
    return cleaning.parse_comments(raw_comments(spark, sf)).select("comment_id", "video_id", "text", "clean_text")


@query
def c6_thread_split(spark, sf):
    top, replies = cleaning.thread_split(raw_comments(spark, sf))
    columns = ["comment_id", "video_id", "parent_id"]
    return top.select(*columns, F.lit("top").alias("side")).unionByName(
        replies.select(*columns, F.lit("reply").alias("side"))
    )


@query
def c6_thread_split_conversations(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("is_reply", F.col("turn") > 0)
    top, replies = cleaning.thread_split(turns)
    columns = ["conv_id", "turn"]
    return top.select(*columns, F.lit("top").alias("side")).unionByName(
        replies.select(*columns, F.lit("reply").alias("side"))
    )


@query
def c7_reply_counts(spark, sf):
    slim = raw_comments(spark, sf).select("comment_id", "video_id", "parent_id")
    return cleaning.reply_counts(slim)


@query
def c8_has_emoji(spark, sf):
    return raw_comments(spark, sf).select("comment_id", texts.has_emoji(F.col("text")).alias("has_emoji"))


@query
def c9_working_text(spark, sf):
    df = raw_comments(spark, sf).withColumn("clean_text", texts.clean_text(F.col("text")))
    df = df.withColumn("working_text", texts.working_text(F.col("clean_text"), F.col("text")))
    return df.select(
        "comment_id", "working_text", texts.model_input(F.col("working_text")).alias("model_input")
    )


# Language.


@query
def l1_hinglish_flag(spark, sf):
    df, terms = lowered(raw_comments(spark, sf), "text")
    return df.select("comment_id", language.hinglish_flag(terms).alias("hinglish"))


@query
def l2_detect_language(spark, sf):
    return language.detect_language(raw_comments(spark, sf), "text").select("comment_id", "language")


def judged_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The model's language of every document. One in five is held out, one in five sets the limits."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    fold = F.col("doc_id") % 5
    model = language_model.fit_languages(docs.filter(fold > 0), "text", "lang", fold == 1)
    return docs.select("doc_id", "lang", language_model.language_of(F.col("text"), model).alias("language"))


@query
def l2_language_model(spark, sf):
    return judged_languages(spark, sf).select("doc_id", "language")


@query
def l2_language_facts(spark, sf):
    """On held-out documents: hardly any is told another language, at least nine in ten their own."""
    wrong = F.count_if(~F.col("language").isin(language_model.UNKNOWN) & (F.col("language") != F.col("lang")))
    right = F.count_if(F.col("language") == F.col("lang"))
    rows = judged_languages(spark, sf).filter("doc_id % 5 = 0").rollup("lang").agg(
        F.count("*").alias("held_out"), wrong.alias("wrong"), right.alias("right")
    )
    return rows.select(
        F.coalesce("lang", F.lit("all")).alias("lang"), "held_out",
        (F.col("wrong") <= 0.02 * F.col("held_out")).alias("few_wrong"),
        F.when(F.col("lang").isNull(), F.col("right") >= 0.9 * F.col("held_out")).alias("accurate"),
    )


def with_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.detect_language(scored(spark, sf), "text")


@query
def l3_route_three_way(spark, sf):
    spoken = staged(with_language(spark, sf).select("comment_id", "language"), "languages")
    routes = language.route_three_way(spoken)
    parts = [df.withColumn("route", F.lit(name)) for name, df in routes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def l4_route_two_way(spark, sf):
    df, terms = scanned(with_language(spark, sf), "text", lists=labels.SENTIMENT_LISTS)
    routed = language.route_two_way(labels.lexicon_sentiment(terms), F.col("sentiment_scores"))
    verdict = labelling.label_sentiment(df.withColumn("sentiment_scores", routed))
    return verdict.select("comment_id", "language", "sentiment", "positive_score", "negative_score")


@query
def l5_language_mix(spark, sf):
    return language.language_mix(with_language(spark, sf))


@query
def l6_hinglish_count(spark, sf):
    return language.hinglish_count(with_language(spark, sf))


# Scores to labels.


def letter_model():
    """Loader of a stand-in model: shares of two letters."""

    def load():
        def model(batch):
            out = []
            for t in batch:
                e, o = t.count("e"), t.count("o")
                total = e + o + 1
                out.append([("positive", e / total), ("negative", o / total), ("neutral", 1 / total)])
            return out

        return model

    return load


@query
def n1_score_column(spark, sf):
    df = raw_comments(spark, sf)
    df = df.withColumn("sentiment_scores", labelling.score_column(F.col("text"), letter_model()))
    return labelling.label_sentiment(df).select(
        "comment_id", "sentiment", "positive_score", "negative_score", "neutral_score"
    )


@query
def n2_lexicon_sentiment(spark, sf):
    df, terms = scanned(raw_comments(spark, sf), "text", lists=labels.SENTIMENT_LISTS)
    df = df.withColumn("sentiment_scores", labels.lexicon_sentiment(terms))
    return labelling.label_sentiment(df).select(
        "comment_id", "sentiment", "positive_score", "negative_score", "neutral_score"
    )


@query
def n3_dominant_sentiment(spark, sf):
    return with_sentiment(spark, sf).select(
        "comment_id", "sentiment", "positive_score", "negative_score", "neutral_score"
    )


def with_groups(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).withColumn("fine", labels.rounded(F.col("emotion_scores")))
    return df.withColumn("groups", labels.group_emotions(F.col("fine")))


@query
def n4_group_emotions(spark, sf):
    return with_groups(spark, sf).select("comment_id", *labels.group_columns(F.col("groups")))


@query
def n5_top_emotion(spark, sf):
    return with_groups(spark, sf).select(
        "comment_id",
        labels.top_label(F.col("groups")).alias("top_emotion"),
        labels.top_score(F.col("groups")).alias("top_score"),
        labels.top_label(F.col("fine")).alias("raw_top"),
    )


@query
def n6_rule_emotion(spark, sf):
    df, terms = lowered(with_sentiment(spark, sf), "text")
    return df.select("comment_id", labels.rule_emotion(terms, F.col("sentiment")).alias("emotion"))


@query
def n7_fix_praise_negation(spark, sf):
    df, terms = lowered(with_sentiment(spark, sf), "text")
    df = df.withColumn("emotion", pick(EMOTIONS, F.col("comment_id") % 7))
    fixed = labels.fix_praise_negation(terms, F.col("emotion"), F.col("sentiment"))
    return df.select("comment_id", fixed.alias("emotion"))


@query
def n8_label_emotions(spark, sf):
    df = labelling.label_emotions(with_sentiment(spark, sf), "text")
    return df.select("comment_id", "emotion_model_rule", "raw_top", *EMOTIONS)


@query
def n9_toxicity_label(spark, sf):
    return labelling.label_toxicity(raw_comments(spark, sf)).select("comment_id", "is_toxic", "toxic_score")


@query
def n10_toxicity_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    model = labelling.toxicity_model(marked)
    judged = labelling.label_toxicity(labelling.score_toxicity(docs, model))
    return judged.select("doc_id", "is_toxic", "toxic_score")


@query
def n10_toxicity_held_out(spark, sf):
    """One document in five is held out; the model has to rank and find their toxic ones."""
    marked = table(spark, sf, "documents").select("doc_id", "text")
    marked = marked.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    out = labelling.held_out_toxicity(marked, F.col("doc_id") % 5)
    return out.select("held_out", "toxic", (F.col("auc") >= 0.85).alias("ranks_well"))


@query
def n11_sarcasm_label(spark, sf):
    verdict = labels.sarcasm_label(F.col("irony_label"), F.col("irony_raw"))
    return raw_comments(spark, sf).select("comment_id", verdict.alias("v")).select("comment_id", "v.*")


@query
def n12_sarcasm_override(spark, sf):
    df = labelling.label_sarcasm(raw_comments(spark, sf), "text")
    return df.select("comment_id", "is_sarcastic", "sarcasm_score")


@query
def n13_classify_intent(spark, sf):
    return labelling.label_intent(raw_comments(spark, sf), "text").select("comment_id", "intent")


@query
def n14_title_category(spark, sf):
    title = pick(fixtures.TITLES, F.col("doc_id") % 7)
    whole = F.when(F.col("doc_id") % 2 == 0, title).otherwise(F.col("text"))
    df, terms = lowered(table(spark, sf, "documents").withColumn("title", whole), "title")
    return df.select("doc_id", labels.title_category(terms).alias("category"))


@query
def n15_merge_labels(spark, sf):
    known = table(spark, sf, "labels").withColumn("comment_id", F.col("doc_id") * 2)
    good = F.col("quality") == 1
    mood = known.select(
        "comment_id",
        F.when(good, F.lit("positive")).otherwise(F.lit("negative")).alias("sentiment"),
        F.when(good, F.lit(0.9)).otherwise(F.lit(0.1)).alias("positive_score"),
    )
    toxic = known.filter("toxic = 1").select(
        "comment_id", F.lit(True).alias("is_toxic"), F.lit(0.9).alias("toxic_score")
    )
    slim = raw_comments(spark, sf).select("comment_id", "video_id", "like_count")
    return labelling.merge_labels(slim, mood, toxic)


# Ensemble vote.


@query
def e1_vote_model(spark, sf):
    return scored(spark, sf).select("comment_id", votes.vote_model(F.col("emotion_scores")).alias("vote"))


@query
def e2_vote_sentiment(spark, sf):
    vote = votes.vote_sentiment(F.col("sentiment"), F.col("negative_score"))
    return with_sentiment(spark, sf).select("comment_id", vote.alias("vote"))


@query
def e3_vote_keywords(spark, sf):
    df, terms = lowered(raw_comments(spark, sf), "text")
    return df.select("comment_id", votes.vote_keywords(terms).alias("vote"))


@query
def e4_majority_vote(spark, sf):
    return voted(spark, sf).select("comment_id", *ensemble.VOTES, "dominant_emotion")


@query
def e5_vote_conflicts(spark, sf):
    return ensemble.vote_conflicts(voted(spark, sf)).select("comment_id", *ensemble.VOTES)


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Outside labels for the labelled documents, some of them outside the domain."""
    return table(spark, sf, "labels").select(
        (F.col("doc_id") * 2).alias("comment_id"),
        F.when(F.col("toxic") == 1, F.lit("disgust")).when(F.col("quality") == 1, F.lit("joy"))
        .otherwise(F.lit("oddlabel")).alias("emotion"),
    )


@query
def e6_apply_tiebreaks(spark, sf):
    settled = voted(spark, sf).select("comment_id", "dominant_emotion", "conflict")
    return ensemble.apply_tiebreaks(settled, overrides(spark, sf))


@query
def e7_ensemble_emotion(spark, sf):
    df = ensemble.ensemble_emotion(with_sentiment(spark, sf), overrides(spark, sf))
    return df.select("comment_id", "conflict", "dominant_emotion")


@query
def e8_weighted_vote(spark, sf):
    df = with_sentiment(spark, sf).withColumn("model", labels.emotion_group(F.col("emotion_scores")[0]["label"]))
    return metrics.evaluation_vote(df, "model").select("comment_id", "model", "weighted_emotion")


# Batches for an outside labeller.


@query
def p1_pack_batches(spark, sf):
    df = raw_comments(spark, sf).withColumn("language", F.col("lang"))
    return batches.pack_batches(df)


@query
def p1_pack_conflicts(spark, sf):
    return batches.pack_conflicts(voted(spark, sf))


def replies(numbered: DataFrame) -> DataFrame:
    """Replies in the forms an outside labeller sends: bare, fenced, with text, broken."""
    c = F.col("comment_id")
    item = F.when(c % 13 == 0, F.col("item") + 100).otherwise(F.col("item")).cast("string")
    emotion = F.concat(F.lit(', "emotion": "'), pick(EMOTIONS, c % 7), F.lit('"'))
    intent = F.concat(F.lit(', "intent": "'), pick(INTENTS, c % 5), F.lit('"'))
    entry = F.concat(
        F.lit('{"id": '), item, F.when(c % 11 == 0, F.lit("")).otherwise(emotion),
        F.when(c % 17 == 0, F.lit("")).otherwise(intent), F.lit("}"),
    )
    listed = F.array_sort(F.collect_list(F.struct("item", entry.alias("entry"))))
    packed = numbered.groupBy("video_id", "batch").agg(F.transform(listed, lambda r: r["entry"]).alias("_l"))
    json = F.concat(F.lit("["), F.array_join("_l", ", "), F.lit("]"))
    form = F.col("batch") % 4
    reply = (
        F.when(form == 0, json)
        .when(form == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here you go:\n```\n"), json, F.lit("\n``` thanks")))
        .otherwise(F.concat(F.lit("Sorry, "), json))
    )
    return packed.select("video_id", "batch", reply.alias("reply"))


@query
def p2_parse_label_reply(spark, sf):
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "pos")
    return batches.parse_label_reply(replies(batches.number_batches(slim)))


@query
def p3_apply_labels(spark, sf):
    slim = raw_comments(spark, sf).select("video_id", "comment_id", "pos")
    numbered = staged(batches.number_batches(slim), "numbered")
    labelled = batches.parse_label_reply(replies(numbered))
    before = numbered.withColumns({"dominant_emotion": F.lit("neutral"), "intent": F.lit("praise")})
    return batches.apply_labels(before, labelled).select("comment_id", "dominant_emotion", "intent")


@query
def p4_report_facts(spark, sf):
    return batches.report_facts(report(spark, sf))


@query
def p5_content_gap_evidence(spark, sf):
    return batches.content_gap_evidence(stored(spark, sf, "video_id", "pos", "intent", "text"))


def listed_topics(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topics_per_video(given_topics(spark, sf), "text")


@query
def p4_report_facts_topics(spark, sf):
    whole = video_report.video_report(analysed(spark, sf), fixtures.videos(spark, sf), listed_topics(spark, sf))
    return batches.report_facts(whole).select("video_id", "title", "topics", "total")


@query
def p5_content_gap_evidence_topics(spark, sf):
    rows = stored(spark, sf, "video_id", "pos", "intent", "text")
    return batches.content_gap_evidence(rows, listed_topics(spark, sf)).select("video_id", "total", "topics")


@query
def p6_compare_videos(spark, sf):
    v = fixtures.videos(spark, sf)
    following = v.select(F.col("video_id").alias("video_b"), (F.col("vn") - 1).alias("vn"))
    pairs = v.join(following, "vn").select(F.col("video_id").alias("video_a"), "video_b")
    return batches.compare_videos(staged(report(spark, sf), "reports"), pairs)


# Audience segments, quality.


@query
def g1_help_request(spark, sf):
    df, terms = lowered(raw_comments(spark, sf), "text")
    return df.select("comment_id", terms.any("HELP_REQUESTS").alias("help"))


@query
def g2_genuine_question(spark, sf):
    df, terms = lowered(raw_comments(spark, sf), "text")
    return df.select("comment_id", audience.genuine_question(terms, F.col("text")).alias("asks"))


@query
def g3_correct_sentiment(spark, sf):
    df = segments.correct_sentiment(with_sentiment(spark, sf))
    return df.select("comment_id", "sentiment", "positive_score", "negative_score")


@query
def g4_axis_scores(spark, sf):
    df = segments.axis_scores(segment_input(spark, sf))
    return df.select("comment_id", "positivity", "criticism", "curiosity")


@query
def g5_assign_segment(spark, sf):
    df = segments.assign_segment(segments.axis_scores(segment_input(spark, sf)))
    return df.select("comment_id", "segment")


@query
def g6_segment_audience(spark, sf):
    df = segments.segment_audience(segment_input(spark, sf))
    return df.select(
        "comment_id", "sentiment", "segment", "segment_label", "segment_color", "segment_icon"
    )


@query
def g7_segment_summary(spark, sf):
    return segments.segment_summary(analysed(spark, sf))


@query
def q1_quality_score(spark, sf):
    df = labelling.label_toxicity(segment_input(spark, sf))
    return segments.quality_scores(df).select("comment_id", "quality_score")


# Like prediction.


def like_input(spark: SparkSession, sf: str) -> DataFrame:
    """Training and prediction both read the rows, so they are written once."""
    columns = (
        "video_id", "comment_id", "parent_id", "text", "positive_score", "negative_score",
        "neutral_score", "intent", "is_sarcastic", "is_toxic", "like_count",
    )
    return cleaning.reply_counts(stored(spark, sf, *columns))


@query
def v1_like_features(spark, sf):
    return likes.like_features(like_input(spark, sf)).select("comment_id", *likes.FEATURES)


@query
def v2_train_like_model(spark, sf):
    """Feature importances of the trained model."""
    model = likes.train_like_model(like_input(spark, sf))
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(likes.FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


@query
def v3_predict_likes(spark, sf):
    df = like_input(spark, sf)
    scores = likes.predict_likes(df, likes.train_like_model(df))
    return scores.select("video_id", "comment_id", "predicted_likes", "virality_score")


@query
def v2_like_model_facts(spark, sf):
    """Importances share out one whole among the features, and the model beats the mean of its rows."""
    df = like_input(spark, sf)
    model = likes.train_like_model(df)
    weights = model.stages[-1].featureImportances.toArray()
    liked = F.log1p("like_count")
    rows = likes.predict_likes(df.filter("like_count > 0"), model)
    return rows.agg(
        F.count("*").alias("liked"),
        F.lit(len(weights)).alias("features"),
        F.lit(round(float(weights.sum()), 9)).alias("importance"),
        F.lit(bool((weights >= 0).all())).alias("none_negative"),
        (F.avg(F.pow(liked - F.col("predicted_log_likes"), F.lit(2))) < F.var_pop(liked)).alias("better_than_mean"),
    )


@query
def v3_like_facts(spark, sf):
    """The best comment of a video scores 1, no score is higher, no prediction is negative."""
    return v3_predict_likes(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("comments"),
        F.max("virality_score").alias("best"),
        F.count_if(F.col("predicted_likes") < 0).alias("negative"),
    )


@query
def v6_like_model_kept(spark, sf):
    """A saved and loaded model predicts what the model did that was saved."""
    df = like_input(spark, sf)
    path = shared_dir(spark, "like-model")
    first = likes.predict_likes(df, likes.known_like_model(df, path)).select("comment_id", "predicted_likes", "virality_score")
    again = likes.predict_likes(df, likes.known_like_model(df, path))
    both = again.join(first.withColumnsRenamed({"predicted_likes": "_l", "virality_score": "_v"}), "comment_id")
    same = (F.col("predicted_likes") == F.col("_l")) & (F.col("virality_score") == F.col("_v"))
    return both.groupBy("video_id").agg(F.count("*").alias("comments"), F.count_if(same).alias("same"))


@query
def v2_video_model_facts(spark, sf):
    """One like model per video: importances share out one whole, the rows that count are the liked ones."""
    weights = likes.predict_likes_by_video(like_input(spark, sf))[1]
    return weights.groupBy("video_id").agg(
        F.max("liked").alias("liked"),
        F.count("*").cast("int").alias("features"),
        F.round(F.sum("importance"), 6).alias("importance"),
        F.count_if(F.col("importance") < 0).alias("negative"),
    )


@query
def v3_video_like_facts(spark, sf):
    scores = likes.predict_likes_by_video(like_input(spark, sf))[0]
    return scores.groupBy("video_id").agg(
        F.count("*").alias("comments"),
        F.max("virality_score").alias("best"),
        F.count_if(F.col("predicted_likes") < 0).alias("negative"),
    )


@query
def v4_virality_score(spark, sf):
    df = raw_comments(spark, sf).select(
        "video_id", "comment_id",
        (((F.col("comment_id") * 7) % 50) / 10.0 - F.substring("video_id", 4, 9).cast("int") % 3 * 5.0)
        .alias("predicted_log_likes"),
    )
    return likes.virality_score(df).select("comment_id", "virality_score")


@query
def v5_no_model_default(spark, sf):
    df = likes.no_model_default(raw_comments(spark, sf))
    return df.select("comment_id", "predicted_likes", "virality_score")


@query
def v6_save_load_like_model(spark, sf):
    df = like_input(spark, sf)
    path = shared_dir(spark, "like-model")
    likes.save_like_model(likes.train_like_model(df), path)
    scores = likes.predict_likes(df, likes.load_like_model(path))
    return scores.select("video_id", "comment_id", "predicted_likes", "virality_score")


# Topics.


@query
def t1_topic_terms(spark, sf):
    return topics.topic_terms(raw_comments(spark, sf), "text", ["video_id"])


@query
def t2_vocabulary(spark, sf):
    counts = topics.topic_terms(given_topics(spark, sf), "text", ["video_id", "topic"], ["video_id"], task="_task")
    return topics.vocabulary(counts, ["video_id", "_task"]).drop("_task")


@query
def t3_assign_topics(spark, sf):
    df = cleaning.parse_comments(raw_comments(spark, sf)).select("video_id", "comment_id", "clean_text")
    return topics.assign_topics(df, text="clean_text").select("video_id", "comment_id", "topic")


@query
def t3_assign_topics_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    out = topics.assign_topics(vectors, vectors="embedding", by=["label"], row="vec_id")
    return out.select("vec_id", "label", "topic")


def topic_facts(df: DataFrame, by: str) -> DataFrame:
    """What must hold of any assignment: every row has a topic, none is too small, numbers go by size without gaps."""
    sizes = df.groupBy(by, "topic").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("topic") >= 0, F.struct("topic", "n"))))
    by_group = sizes.groupBy(by).agg(F.sum("n").alias("row_count"), listed.alias("_t"))
    numbers = F.transform("_t", lambda t: t["topic"])
    falling = F.transform("_t", lambda t: -t["n"])
    return by_group.select(
        by, "row_count",
        F.size(F.filter("_t", lambda t: t["n"] < topics.MIN_TOPIC_ROWS)).alias("small_topics"),
        (numbers == F.transform("_t", lambda t, i: i)).alias("numbered"),
        (falling == F.array_sort(falling)).alias("by_size"),
    )


@query
def t3_topic_facts(spark, sf):
    return topic_facts(t3_assign_topics(spark, sf), "video_id")


@query
def t3_topic_facts_vectors(spark, sf):
    return topic_facts(t3_assign_topics_vectors(spark, sf), "label")


@query
def t4_topic_labels(spark, sf):
    out = topics.topic_labels(given_topics(spark, sf), "text")
    return out.withColumn("words", F.array_join("words", ", "))


@query
def t5_topic_sizes(spark, sf):
    return topics.topic_sizes(given_topics(spark, sf))


@query
def t6_too_few_guard(spark, sf):
    """Videos here are the conversations; most have under ten texts."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
        (F.col("turn") % 4).cast("int").alias("topic"),
    )
    return topics.too_few_guard(turns)


# Aggregates and reports.


@query
def r1_approval_score(spark, sf):
    return reports.approval_score(analysed(spark, sf))


@query
def r2_sentiment_counts(spark, sf):
    return reports.sentiment_counts(analysed(spark, sf))


@query
def r3_emotion_counts(spark, sf):
    return reports.emotion_counts(analysed(spark, sf))


@query
def r4_intent_counts(spark, sf):
    return reports.intent_counts(analysed(spark, sf))


@query
def r5_flag_counts(spark, sf):
    return reports.flag_counts(analysed(spark, sf))


@query
def r6_shares(spark, sf):
    return reports.shares(analysed(spark, sf))


@query
def r7_approval_band(spark, sf):
    return reports.approval_bands(analysed(spark, sf))


@query
def r8_intent_by_sentiment(spark, sf):
    return reports.intent_by_sentiment(analysed(spark, sf))


@query
def r9_top_comment_per_emotion(spark, sf):
    columns = ("video_id", "comment_id", "dominant_emotion", "like_count", "text")
    return reports.top_comment_per_emotion(stored(spark, sf, *columns))


@query
def r10_top_comments_per_segment(spark, sf):
    return reports.top_comments_per_segment(analysed(spark, sf))


@query
def r11_filter_comments(spark, sf):
    slim = stored(spark, sf, "comment_id", "sentiment", "intent", "segment_label")
    return reports.filter_comments(slim, sentiment="positive", segment="Super Fans")


@query
def r12_sort_comments(spark, sf):
    return reports.sort_comments(stored(spark, sf, "video_id", "comment_id", "quality_score"), "quality_score").select("comment_id", "quality_score")


@query
def r13_page_comments(spark, sf):
    columns = ("video_id", "comment_id", "like_count", "sentiment", "intent", "segment_label")
    slim = stored(spark, sf, *columns)
    return reports.page_comments(reports.filter_comments(slim, intent="question"))


@query
def r14_top_emotions(spark, sf):
    return reports.top_emotions(analysed(spark, sf))


@query
def r15_topics_by_size(spark, sf):
    labelled = topics.topic_labels(given_topics(spark, sf), "text")
    return reports.topics_by_size(labelled.select("video_id", "label", "count"))


@query
def r16_likes_by_segment(spark, sf):
    return reports.likes_by_segment(analysed(spark, sf))


def flat_report(df: DataFrame) -> DataFrame:
    """The report with its maps as plain columns, as other engines can show it."""
    summary = [
        F.col("segment_summary")[name][field].alias(f"seg{seg}_{field}")
        for seg, (name, *_) in SEGMENTS.items()
        for field in ("count", "avg_likes", "top_comment")
    ]
    return df.select(
        "video_id", "title", "channel", "total", "approval_score", "toxic_count", "sarcasm_count",
        *[F.col("sentiment_counts")[s].alias(s) for s in SENTIMENTS],
        *[F.col("emotion_counts")[e].alias(f"emotion_{e}") for e in EMOTIONS],
        *[F.col("intent_counts")[i].alias(f"intent_{i}") for i in INTENTS],
        *summary,
    )


@query
def r17_video_report(spark, sf):
    return flat_report(report(spark, sf))


@query
def r17_full_report(spark, sf):
    df = video_report.full_report(scored(spark, sf), fixtures.videos(spark, sf))
    return flat_report(df).join(df.select("video_id", F.size("topics").alias("topics")), "video_id")


@query
def r17_report_topics(spark, sf):
    """The full report tells topics exactly where a video has ten comments, largest first, none under five rows."""
    df = video_report.full_report(scored(spark, sf), fixtures.videos(spark, sf))
    sizes = F.transform("topics", lambda t: -t["count"])
    return df.select(
        "video_id", "title", "total",
        (F.col("total") >= F.coalesce(F.aggregate("topics", F.lit(0).cast("long"), lambda n, t: n + t["count"]), F.lit(0))).alias("fits"),
        F.coalesce(F.array_min(F.transform("topics", lambda t: t["count"])) >= topics.MIN_TOPIC_ROWS, F.lit(True)).alias("large"),
        (sizes == F.array_sort(sizes)).alias("by_size"),
    )


@query
def r17_incremental_run(spark, sf):
    """Three runs: some videos, all videos, all videos again; each report tells the run that made it."""
    archive = incremental.Archive(spark, shared_dir(spark, "archive"))
    comments, videos = staged(scored(spark, sf), "comments"), fixtures.videos(spark, sf).select("video_id", "title", "channel")
    some = video_number() < 10
    now = F.lit(CREATED_AT).cast("timestamp_ntz")
    incremental.run(archive, 1, videos.filter(some), comments.filter(some), now, model=False)
    incremental.run(archive, 2, videos, comments, now, model=False)
    incremental.run(archive, 3, videos, comments, now, model=False)
    made = archive.store("reports").keys().select("video_id", F.col("load_no").cast("int").alias("run"))
    rows = archive.store("analysed").current().groupBy("video_id").agg(F.count("*").alias("stored_comments"))
    return flat_report(archive.store("reports").current()).join(made, "video_id").join(rows, "video_id")


# Classification metrics.


@query
def m1_normalise_label(spark, sf):
    given = pick(SPELLINGS, F.col("comment_id") % 8)
    return raw_comments(spark, sf).select("comment_id", labels.normalise_label(given).alias("label"))


def predictions(spark: SparkSession, sf: str, *tasks: str) -> DataFrame:
    """(task, y, p) of the tasks, or of all: stand-in truths against what the operators say.

    Only what the tasks need is worked out.
    """
    pairs = {
        "emotion_single": ("true_emotion", "vote_keywords"),
        "emotion_ensemble": ("true_emotion", "dominant_emotion"),
        "sentiment": ("true_sentiment", "sentiment"),
        "intent": ("true_intent", "intent"),
    }
    tasks = tasks or tuple(pairs)
    df = voted(spark, sf).withColumn("true_emotion", labels.emotion_group(F.col("emotion_scores")[0]["label"]))
    df = df.withColumn("true_sentiment", F.col("sentiment"))
    if "sentiment" in tasks:
        df = segments.correct_sentiment(df)
    if "intent" in tasks:
        df = labelling.label_intent(df, "text").withColumn("true_intent", pick(INTENTS, F.col("comment_id") % 5))
    rows = [
        F.struct(F.lit(task).alias("task"), *(F.col(c).alias(n) for c, n in zip(pairs[task], "yp"))) for task in tasks
    ]
    return df.select(F.inline(F.array(*rows)))


@query
def m2_accuracy(spark, sf):
    return rounded(metrics.accuracy(predictions(spark, sf), "y", "p", ["task"]), "accuracy")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def m3_class_report(spark, sf):
    df = predictions(spark, sf, "emotion_ensemble")
    return rounded(metrics.class_report(df, "y", "p", EMOTIONS), "precision", "recall", "f1")


@query
def m3_class_report_by_task(spark, sf):
    df = metrics.class_report(predictions(spark, sf), "y", "p", keys=["task"])
    return rounded(df, "precision", "recall", "f1")


@query
def m4_weighted_scores(spark, sf):
    df = metrics.weighted_scores(predictions(spark, sf), "y", "p", ["task"])
    return rounded(df, "precision", "recall", "f1")


@query
def m5_ensemble_gain(spark, sf):
    df = voted(spark, sf).withColumn("truth", labels.emotion_group(F.col("emotion_scores")[0]["label"]))
    return metrics.ensemble_gain(df, "truth", "vote_keywords", "dominant_emotion")


@query
def m6_plain_decisions(spark, sf):
    df = raw_comments(spark, sf).withColumn("top_fine_label", F.col("emo1"))
    return metrics.plain_decisions(df).select(
        "comment_id", "plain_toxic", "plain_sarcastic", "plain_emotion"
    )


@query
def m7_write_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    result = rounded(metrics.accuracy(predictions(spark, sf), "y", "p", ["task"]), "accuracy")
    exports.write_metrics(result, path)
    return spark.read.schema(result.schema).json(path)
