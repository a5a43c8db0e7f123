"""Records, strict export, metrics and content lines: cases that the views don't have."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.functions import posts
from postloom.plans import records
from postloom.sources import jsonl


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("c")).first().c


@pytest.mark.parametrize(("lines", "author", "want"), [
    ("Anna\n3d\n12\nReal words", "anna", "Real words"), ("Like\nReply", "", None), ("", "", None), (None, None, None), ("Bob\nfine", None, "Bob"), ("5 hours of fun", "", "5 hours of fun"),
    ("Follow me home", "", None), ("Just now\n🎉🎉", "", "🎉🎉"),
])
def test_comment_line(spark, lines, author, want):
    assert one(spark, posts.comment_line(posts.lines_of(F.col("t")), F.col("a")), t=lines, a=author) == want


@pytest.mark.parametrize(("text", "author", "want"), [
    ("A long line of twenty letters\nAnna Bell\nThis is the post itself, long\nAll comments\nA comment that is long enough", "Anna Bell", "This is the post itself, long"),
    ("A long line of twenty letters\nrest", "", "A long line of twenty letters"), ("Anna\nNewest\nA comment that is long enough", "Anna", None), ("", "x", None), ("Anna", "Anna", None),
])
def test_dialog_line(spark, text, author, want):
    assert one(spark, posts.dialog_line(F.col("t"), F.col("a")), t=text, a=author) == want


@pytest.mark.parametrize(("name", "ok"), [("Anna", True), ("5 mo", False), ("10:45 PM", False), ("1,2 k likes", False), ("June", False), ("Junebug", True), ("+1", False), ("李明", True), ("!!!", False), (None, False), (" Join ", False)])
def test_page_author(spark, name, ok):
    assert one(spark, posts.valid_page_author(F.col("n")), n=name) is ok


GOOD = {"platform": "facebook", "input_url": "u", "canonical_url": "c", "post_id": "1", "collection_status": "success"}


@pytest.mark.parametrize(("change", "error"), [
    ({}, None), ({"platform": None}, "Internal result platform must be facebook."), ({"post_id": None}, None), ({"like_count": True}, None), ({"like_count": "1"}, "Internal result like_count must be a non-negative integer or null."),
    ({"reply_count": -2}, "Internal result reply_count must be a non-negative integer or null."), ({"input_metadata": {}}, None), ({"input_metadata": None}, "Internal result input_metadata must be an object."),
    ({"search_contexts": {}}, "Internal result search_contexts must be a list."), ({"collection_status": "failed"}, "Failed internal result must include error or failure_category."),
    ({"collection_status": "failed", "error": {"type": "x"}}, None), ({"collection_status": "failed", "error": {}, "failure_category": "x"}, None), ({"collection_status": 5}, "Internal result collection_status is invalid."),
])
def test_internal_rules(spark, change, error):
    v = F.parse_json(F.lit(json.dumps(GOOD | change)))
    assert spark.range(1).select(records.internal_record_error(v).alias("e")).first().e == error


def test_missing_fields(spark):
    v = F.parse_json(F.lit('{"platform": "facebook", "post_id": "1"}'))
    assert spark.range(1).select(records.internal_record_error(v).alias("e")).first().e == "Internal result missing field(s): input_url, canonical_url, collection_status"


def test_export(spark, tmp_path):
    rows = [GOOD | {"author": "Ann", "like_count": 3}, "", GOOD | {"collection_status": "skipped"}, GOOD | {"platform": "x"}, [1], GOOD | {"collection_status": "partial", "comments": [{"comment_content": "a"}, {"comment_content": "a"}]}]
    (tmp_path / "in.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    lines = jsonl.jsonl_numbered(spark, str(tmp_path / "in.jsonl"))
    got = {r.line_number: r for r in records.export_results(lines.select("line_number", "v")).collect()}
    assert sorted(got) == [1, 4, 6] and got[4].error == "Internal result platform must be facebook." and got[4].author is None
    assert (got[1].author, got[1].like_count, got[1].content, got[1].comments) == ("Ann", 3, "", []) and len(got[6].comments) == 1


@pytest.mark.parametrize(("texts", "buttons", "like", "comment"), [
    ([("1.2K 34 5", "action_bar")], (True, True, True), (1200, "action_bar_ordered_summary", None, "known_value"), (34, "action_bar_ordered_summary", None, "known_value")),
    ([("7 2", "action_bar")], (True, True, True), (7, "action_bar_ordered_partial_summary", None, "known_value"), (2, "action_bar_ordered_partial_summary", None, "known_value")),
    ([("7 2", "action_bar")], (True, False, False), (None, None, "ambiguous_unassigned_numeric_text", "unknown"), (None, None, "ambiguous_unassigned_numeric_text", "unknown")),
    ([("Like", "action_bar"), ("0 comments", "x")], (True, False, True), (None, None, "button_found_but_no_numeric_summary", "unknown"), (0, "comment_summary_text", None, "known_zero")),
    ([], (False, False, False), (None, None, "button_not_found", "unknown"), (None, None, "button_not_found", "unknown")),
])
def test_metrics(spark, texts, buttons, like, comment):
    df = spark.createDataFrame([(texts, *buttons, 1 if any(buttons) else None)], "texts array<struct<text:string,position:string>>, like_button boolean, comment_button boolean, share_button boolean, bar int")
    r = records.metric_details(df).first()
    for got, want in ((r.like, like), (r.comment, comment)):
        assert (got["count"], got.source, got.rejection_reason, got.count_state) == want
    known = records.metric_details(df, F.array(F.lit("No comments yet"))).first().comment
    assert known["count"] == (comment[0] if comment[0] is not None else 0)
