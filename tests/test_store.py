"""Stored tables: replaced keys, broken and repeated loads, pruned reads, compaction."""

import pytest
from check_queries import plan_of
from pyspark.sql import functions as F

from crowdread.operators import ensemble
from crowdread.sources import tables
from crowdread.sources.store import Store

SCHEMA = "video_id string, comment_id long, text string, tags map<string, int>"


def rows(spark, *groups):
    data = [(v, i, f"{v}-{mark}-{i}", {"a": i}) for v, n, mark in groups for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def held(df):
    return sorted((r.video_id, r.comment_id, r.text) for r in df.collect())


def wanted(*groups):
    return sorted((v, i, f"{v}-{mark}-{i}") for v, n, mark in groups for i in range(n))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), buckets=8)


def test_newest_load_of_a_key_counts(spark, store):
    assert store.save(rows(spark, ("a", 5, "x"), ("b", 3, "x"), ("c", 2, "x")), 1)
    assert store.save(rows(spark, ("b", 2, "y"), ("d", 1, "y"), (None, 4, "y")), 2)
    assert store.save(rows(spark), 3)  # empty: nothing changes
    assert held(store.current()) == wanted(("a", 5, "x"), ("b", 2, "y"), ("c", 2, "x"), ("d", 1, "y"))
    assert {(r.video_id, r.load_no, r.row_count) for r in store.keys().collect()} == {("a", 1, 5), ("b", 2, 2), ("c", 1, 2), ("d", 2, 1)}
    assert store.current().columns == ["video_id", "comment_id", "text", "tags"]


def test_loads_need_not_come_in_order(spark, store):
    store.save(rows(spark, ("a", 2, "new")), 7)
    store.save(rows(spark, ("a", 3, "old"), ("b", 1, "old")), 5)
    assert held(store.current()) == wanted(("a", 2, "new"), ("b", 1, "old"))


def test_broken_and_repeated_loads(spark, store, monkeypatch):
    store.save(rows(spark, ("a", 2, "x")), 1)
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.save(rows(spark, ("a", 9, "broken"), ("z", 1, "broken")), 2)
    assert held(store.current()) == wanted(("a", 2, "x"))
    assert store.save(rows(spark, ("a", 1, "y")), 2)
    assert not store.save(rows(spark, ("a", 50, "again")), 2)
    assert held(store.current()) == wanted(("a", 1, "y"))
    assert not store._commit(2, {"buckets": [], "replaces": [], "schema": ""})  # another writer was first


def test_reads_are_pruned(spark, store):
    videos = [(f"v{i}", 3, "x") for i in range(60)]
    store.save(rows(spark, *videos), 1)
    store.save(rows(spark, ("v3", 1, "y")), 2)
    listed = store.current(["v3", "v4", "absent"])
    assert held(listed) == wanted(("v3", 1, "y"), ("v4", 3, "x"))
    scan = plan_of(listed).split("FileScan parquet")[1]
    assert "bucket_no" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(video_id" in plan_of(listed)
    ids = spark.createDataFrame([("v3",), ("v9",), ("v9",), ("none",)], "video_id string")
    assert held(store.current(ids)) == wanted(("v3", 1, "y"), ("v9", 3, "x"))
    assert held(store.current([])) == []


def test_compaction_and_vacuum(spark, store, tmp_path):
    store.save(rows(spark, *[(f"v{i}", 3, "x") for i in range(30)]), 1)
    store.save(rows(spark, ("v3", 1, "y"), ("w", 2, "y")), 2)
    before = held(store.current())
    touched = store.compact(10)
    assert touched and len(touched) < 8 and held(store.current()) == before
    assert store.compact(10) == [] and store.compact(11) == []  # nothing is left to do
    store.save(rows(spark, ("v3", 4, "z")), 3)  # a load with a smaller number than the compaction still wins
    after = [x for x in before if x[0] != "v3"] + wanted(("v3", 4, "z"))
    assert held(store.current()) == sorted(after)
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert held(store.current()) == sorted(after)
    every = spark.read.parquet(str(tmp_path / "s" / "rows"))
    assert every.filter("text LIKE 'v3-x%'").count() == 0
    store.compact(12)
    store.vacuum()
    assert held(store.current()) == sorted(after) == held(spark.read.parquet(str(tmp_path / "s" / "rows")))


def test_new_columns_and_taken_names(spark, store):
    store.save(rows(spark, ("a", 1, "x")), 1)
    store.save(rows(spark, ("b", 1, "x")).withColumn("more", F.lit(5)), 2)
    assert {(r.video_id, r.more) for r in store.current().collect()} == {("a", None), ("b", 5)}
    with pytest.raises(ValueError):
        store.save(rows(spark, ("a", 1, "x")).withColumn("bucket_no", F.lit(1)), 3)


def test_nothing_stored(spark, store):
    assert store.keys().collect() == [] and store.compact(1) == [] and store.vacuum() == 0
    with pytest.raises(ValueError):
        store.current()
    store.save(rows(spark), 1)
    assert store.current().collect() == [] and store.keys().collect() == []


def test_upsert_keeps_one_row_per_video(spark):
    schema = "video_id string, title string, n map<string, int>"
    old = spark.createDataFrame([("a", "old", None), ("b", "old", None)], schema)
    new = spark.createDataFrame([("a", "one", {"x": 1}), ("a", "two", {"x": 1}), ("c", "new", None)], schema)
    got = sorted((r.video_id, r.title) for r in tables.upsert_videos(old, new).collect())
    assert got == [("a", "two"), ("b", "old"), ("c", "new")]


def test_an_id_twice_in_overrides(spark):
    df = spark.createDataFrame([(1, "joy", True), (2, "joy", False)], "comment_id long, dominant_emotion string, conflict boolean")
    over = spark.createDataFrame([(1, "fear"), (1, "anger"), (2, "fear")], "comment_id long, emotion string")
    got = sorted((r.comment_id, r.dominant_emotion) for r in ensemble.apply_tiebreaks(df, over).collect())
    assert got == [(1, "anger"), (2, "joy")]
