"""Plans that must hold at any size. That no query crosses rows is tested with its result."""

import pytest

import __spark_entry__ as contract
from check_queries import plan_of


@pytest.mark.parametrize(
    "name", ["c2_dedup_comments", "s5_cap_comments", "r9_top_comment_per_emotion", "r10_top_comments_per_segment"]
)
def test_groups_are_cut_before_the_shuffle(spark, sf, name):
    plan = plan_of(contract.queries()[name](spark, sf))
    assert "Partial" in plan.split("WindowGroupLimit", 2)[2].split("\n")[0]


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(contract.queries()["s5_cap_comments"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_label_filter_reaches_the_stored_table(spark, sf):
    plan = plan_of(contract.queries()["r11_filter_comments"](spark, sf))
    assert "EqualTo(sentiment,positive)" in plan.split("PushedFilters")[1]


def test_recent_list_needs_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(contract.queries()["s11_recent_analyses"](spark, sf))


def test_texts_are_cut_before_the_sort_by_video(spark, sf):
    plan = plan_of(contract.queries()["g7_segment_summary"](spark, sf))
    partial = plan.index("partial_max_by")
    assert plan.index("Sort [video_id", partial) < plan.index("substring(text", partial)
