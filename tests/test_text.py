import pytest
from pyspark.sql import functions as F

from crowdread.functions import text, urls
from crowdread.operators import cleaning


def rows(spark, *texts, likes=None):
    likes = likes or [0] * len(texts)
    data = [(i, "v1", i, t, n) for i, (t, n) in enumerate(zip(texts, likes))]
    return spark.createDataFrame(data, "comment_id bigint, video_id string, pos bigint, text string, like_count bigint")


def test_filter_empty_edges(spark):
    df = rows(spark, "", "   ", "abc", "abcd", None, "\tabc\n", "\n abcd", " abc　")
    kept = {r.comment_id for r in cleaning.filter_empty(df).collect()}
    assert kept == {3, 6}


def test_dedup_keeps_first_per_video(spark):
    df = rows(spark, "Great Video", " great video\n", "great video http://a.b", "great video http://c.d", "  ")
    other = rows(spark, "great video").withColumns({"video_id": F.lit("v2"), "comment_id": F.lit(99)})
    once = cleaning.dedup_comments(df.unionByName(other))
    assert {r.comment_id for r in once.collect()} == {0, 2, 3, 99}
    assert cleaning.dedup_comments(once).count() == once.count()


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("http://x.y at the start", "at the start"),
        ("in the https://x.y/z?a=1 middle", "in the middle"),
        ("at the end www.example.org", "at the end"),
        ("two  spaces\nand\tmore here ", "two spaces and more here"),
        ("http alone and www too", "http alone and www too"),
        ("so good🔥🔥", "so good fire  fire "),
        ("❤️ thanks", " red_heart  thanks"),
        ("👍🏽 ok", " thumbs_up_medium_skin_tone  ok"),
        ("é accents stay", "é accents stay"),
    ],
)
def test_clean_text(one, given, wanted):
    assert one(text.clean_text(F.col("t")), t=given) == wanted


def test_strip_and_words(one):
    assert one(text.strip(F.col("t")), t="\x1c  a b 　\n") == "a b"
    nine = "a b c d e f g h i"
    assert one(text.has_more_words(F.col("t"), 8), t=nine) is True
    assert one(text.has_more_words(F.col("t"), 9), t=nine + "  \n") is False
    assert one(text.has_more_words(F.col("t"), 0), t="  ") is False


def test_has_emoji(one):
    assert one(text.has_emoji(F.col("t")), t="naïve") is False
    assert one(text.has_emoji(F.col("t")), t="ok 🙏") is True


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://youtu.be/AbCdEfGh_01?t=3", "AbCdEfGh_01"),
        ("https://www.youtube.com/watch?list=PL1&v=AbCdEfGh-01", "AbCdEfGh-01"),
        ("https://www.youtube.com/shorts/AbCdEfGh001", "AbCdEfGh001"),
        ("https://www.youtube.com/embed/AbCdEfGh0012", "AbCdEfGh001"),
        ("https://youtu.be/AbCdEfGh_0", None),
        ("https://youtu.be/AbCdEfGh_01?v=ZZZZZZZZZZZ", "AbCdEfGh_01"),
        ("https://www.youtube.com/live/AbCdEfGh001?v=ZZZZZZZZZZZ", "ZZZZZZZZZZZ"),
        ("not a url", None),
        (None, None),
    ],
)
def test_video_id(one, url, wanted):
    assert one(urls.video_id_from_url(F.col("u")), u=url) == wanted
    plain = f"https://www.youtube.com/watch?v={wanted}" if wanted else url
    assert one(urls.canonical_url(F.col("u")), u=url) == plain


def test_cap_comments(spark):
    df = rows(spark, *"abcdef", likes=[5, None, 5, 9, 0, 1])
    assert {r.comment_id for r in cleaning.cap_comments(df, 3).collect()} == {3, 0, 2}
    assert cleaning.cap_comments(df, 6).count() == 6
    # ties at zero go to the earlier comment, NULL counts as zero
    assert {r.comment_id for r in cleaning.cap_comments(df, 5).collect()} == {0, 1, 2, 3, 5}


def test_reply_counts(spark):
    df = spark.createDataFrame(
        [(1, None), (2, 1), (3, 1), (4, None)], "comment_id bigint, parent_id bigint"
    )
    counts = {r.comment_id: r.reply_count for r in cleaning.reply_counts(df).collect()}
    assert counts == {1: 2, 2: 0, 3: 0, 4: 0}
