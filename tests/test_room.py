"""Tables that are written on the way go when they have been read."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from check_queries import plan_of
from crowdread import session
from crowdread.operators import cleaning, density, topics
from crowdread.plans import incremental, video_report
from crowdread.session import Temporary, staged

SCHEMA = "video_id string, comment_id long, pos long, parent_id long, is_reply boolean, text string, like_count long"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark, name: str(tmp_path / "shared" / f"{name}-{uuid.uuid4().hex}"))
    (tmp_path / "shared").mkdir()
    return tmp_path / "shared"


def left(folder):
    return sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder))


def comments(spark, n=40):
    words = ("exam marks syllabus paper", "sound audio mic volume")
    rows = [(v, i, i, None, False, f"great {words[i % 2]} number {i // 2}", i) for v in "ab" for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def titles(spark):
    return spark.createDataFrame([("a", "title a", "c"), ("b", "title b", "c")], "video_id string, title string, channel string")


def test_kept_tables_belong_to_the_block_around(spark, folder):
    with Temporary() as outer:
        with Temporary() as inner:
            gone, kept = staged(spark.range(3), "gone"), inner.keep(staged(spark.range(4), "kept"))
        assert left(folder) == ["kept"] and kept.count() == 4 and gone is not kept
        last = outer.keep(staged(kept, "last"))
    assert left(folder) == ["last"] and last.count() == 4
    staged(spark.range(1), "free")
    assert left(folder) == ["free", "last"]


def test_a_block_that_breaks_leaves_nothing(spark, folder):
    with pytest.raises(RuntimeError), Temporary():
        staged(spark.range(3), "gone")
        raise RuntimeError
    assert left(folder) == []


def test_topics_leave_only_what_is_read_later(spark, folder, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 12)
    df = comments(spark)
    whole = topics.assign_topics(df, text="text")
    assert left(folder) == ["topics"]
    assert whole.count() == 80 and {r.topic for r in whole.collect()} >= {0, 1}


def test_full_report_writes_what_it_needs(spark, folder):
    report = video_report.full_report(comments(spark), titles(spark))
    assert left(folder) == ["analysed", "topic-terms", "topics"]
    path = next(folder.glob("analysed-*"))
    columns = spark.read.parquet(str(path)).columns
    assert {"text", "working_text"} == {c for c in columns if "text" in c}
    assert sorted(r.video_id for r in report.collect()) == ["a", "b"]


def test_bytes_of_the_report_come_from_the_written_table(spark, folder, monkeypatch):
    """Topics are not worked out once more to learn how many tasks their terms take."""
    asked, plain = [], topics.text_bytes
    monkeypatch.setattr(topics, "text_bytes", lambda df, text: asked.append(plan_of(df)) or plain(df, text))
    video_report.full_report(comments(spark), titles(spark))
    assert len(asked) == 1 and "Join" not in asked[0] and "MapInArrow" not in asked[0]


def test_incremental_runs_leave_only_their_stores(spark, folder, tmp_path):
    archive = incremental.Archive(spark, str(tmp_path / "archive"))
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    assert incremental.run(archive, 1, titles(spark), comments(spark), now, model=False)
    assert left(folder) == []
    assert archive.store("reports").current().count() == 2


def test_texts_are_dealt_once_to_drop_copies(spark):
    plan = plan_of(cleaning.dedup_comments(comments(spark)))
    assert plan.count("Exchange") == 1 and "Partial" in plan.split("WindowGroupLimit", 2)[2].split("\n")[0]
