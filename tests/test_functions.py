"""Tables of literal cases for the scalar functions, and order-shuffle tests of the relational operators."""

import pytest
from pyspark.sql import functions as F

from postloom.functions import numbers, text, times, url
from postloom.operators import html, relational
from postloom.plans import normalize
from postloom.sources import jsonl, sinks


def values(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_metric_counts(spark):
    cases = ["12", "1,234", "1.2K", "3.5 M", "4万", "2億", "5 minutes", "-5", "1,23", "none", "", None, "4.35K"]
    assert values(spark, cases, numbers.parse_metric_count) == [
        12, 1234, 1200, 3_500_000, 40_000, 200_000_000, 5_000_000, 5, 1, None, None, None, 4350]


def test_urls(spark):
    cases = [
        " https://X.com/Some%20One/status/12/photo/1?s=2 ", "https://x.com/i/web/status/9", "https://x.com/a/status/1x", "ftp://x.com/a/status/1",
        "https://www.facebook.com/groups/posts/123", "https://m.facebook.com/a/posts/pfbid0Ab?x=1", "https://facebook.com/story.php?story_fbid=7&amp;id=8",
        "https://facebook.com/story.php?id=8", "https://facebook.com/a/b/story.php?story_fbid=7", "", None, "https://[bad",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, url string")
    got = [(r.platform, r.post_id, r.canonical_url, r.context_type) for r in url.classify(df).orderBy("i").collect()]
    none = (None,) * 4
    assert got == [
        ("x", "12", "https://x.com/Some%20One/status/12", None), ("x", "9", "https://x.com/i/web/status/9", None), none, none,
        ("facebook", "123", "https://www.facebook.com/groups/posts/123", "profile"),
        ("facebook", "pfbid0Ab", "https://www.facebook.com/a/posts/pfbid0Ab", "profile"),
        ("facebook", "7", "https://www.facebook.com/story.php?story_fbid=7&id=8", None), none, none, none, none, none]


def test_times(spark):
    cases = ["2h", "1y", "just now", "2025-99-99", "2024-02-03T04:05:06+02:00", "yesterday", "2mo", " 3 d ", "", None]
    as_of = F.lit("2024-03-10T12:30:45Z").cast("timestamp")
    assert values(spark, cases, lambda c: times.normalize_time(c, as_of)) == [
        "2024-03-10T10:30:45Z", "2023-03-11", "2024-03-10T12:30:45Z", "2025-99-99", "2024-02-03T02:05:06Z", "", "", "2024-03-07", "", ""]
    cases = ["June 3, 2025 at 4:05 PM", "Jun 3, 2025", "posted 2025-06-03", "Reel 12", None]
    assert values(spark, cases, times.absolute_date_text) == ["2025-06-03T16:05", "2025-06-03", "2025-06-03", None, None]


def test_names_and_failures(spark):
    cases = ["Anna", "+3", "#x", "6w", "12 comments", "May Smith", "Maya", " join ", "!!", None, "2 mo"]
    assert values(spark, cases, text.valid_author_name) == [True, False, False, False, False, False, True, False, False, False, False]
    cases = ["generated", "Login page unavailable", "the URL is not supported", "net::ERR", "", None, "container lost"]
    assert [r.category for r in values(spark, cases, text.categorize_failure)] == [
        "rate_limited", "unavailable", "invalid_url", "network_error", "unknown_error", "unknown_error", "extraction_error"]


def test_strict_types_of_variants(spark):
    cases = ["1", "true", "12.0", '"7"', "-1", "null"]
    df = spark.createDataFrame([(i, f'{{"n": {c}}}') for i, c in enumerate(cases)], "i int, line string")
    p = jsonl.parse_lines(df, "count").orderBy("i").select(normalize.whole_of(F.col("v"), "$.n"), normalize.text_of(F.col("v"), "$.n"))
    assert [tuple(r) for r in p.collect()] == [(1, None), (None, None), (None, None), (None, "7"), (-1, None), (None, None)]


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"platform": "x", "post_id": "1"}\n\n[1]\n{"bad"\n')
    assert jsonl.jsonl(spark, str(f), "skip").count() == 1
    assert jsonl.jsonl(spark, str(f), "count").count() == 3
    with pytest.raises(Exception, match="invalid JSON line"):
        jsonl.jsonl(spark, str(f)).select("v").collect()
    assert jsonl.jsonl(spark, str(tmp_path / "none")).count() == 0
    f.write_text('{"platform": "x", "post_id": "1", "k": 1}\n\n{"platform": "x", "post_id": "1", "k": 2}\n')
    assert [r.line_number for r in jsonl.jsonl_numbered(spark, str(f)).orderBy("line_number").collect()] == [1, 3]
    assert jsonl.history(spark, str(f)).select(normalize.whole_of(F.col("v"), "$.k")).first()[0] == 2
    f.write_text('["https://a.b/c", {"canonical_url": "u", "m": 1}]')
    assert [r.url for r in jsonl.batch_input(spark, str(f)).orderBy("pos").collect()] == ["https://a.b/c", "u"]
    f.write_text('[" a ", "b", "a", ""]')
    assert jsonl.keyword_file(spark, str(f)).first()[0] == ["a", "b"]
    out = str(tmp_path / "table")
    for n in (3, 5):
        sinks.swap_in(spark.range(n), out, "parquet")
        assert spark.read.parquet(out).count() == n
    posts = spark.createDataFrame([("failed", "b", None), ("failed", "a", ["c"]), (None, None, ["c", "d"])], "collection_status string, failure_category string, comments array<string>")
    assert "| failed | 2 |" in sinks.report(posts) and "Comments: 3" in sinks.report(posts)


def test_page_facts(spark):
    page = """<html><head><title>(2) A - B | Facebook</title><meta property="og:title" content="T"></head><body>
      <div role="article"><div data-ad-preview="message">Hello <b>you</b></div><a href="/p" aria-label="3 comments">x</a><span hidden>no</span></div></body></html>"""
    r = html.page_facts(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert (r[0].og_title, r[0].messages, r[0].links[0].href, r[0].role_article, r[0].engagement_controls) == ("T", ["Hello you"], "/p", 1, 1)
    assert "no" not in r[0].body_text.split() and r[1].body_text == ""


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_matter(spark, parts):
    rows = [(i, f"k{i % 5}", i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "pos long, key string, v long").repartition(parts, "v")
    first = {r.key: r.pos for r in relational.dedupe_first(df, ["key"], "pos").collect()}
    assert first == {f"k{i}": i for i in range(5)}
    assert sorted((r.pos, r["rank"]) for r in relational.with_global_rank(df, ["pos"]).collect()) == [(i, i + 1) for i in range(100)]
    assert sorted(r.pos for r in relational.running_limit(df, "key", ["pos"], 21).collect()) == sorted([*range(0, 100, 5), 1])


def test_ranks_over_many_blocks(spark, tmp_path):
    """Ranks are counted after a write, with carried columns, over blocks far smaller than the input and a hot key."""
    df = spark.range(20_000).select(
        F.xxhash64("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("word"), "id")
    relational.with_global_rank(df, ["word", "pos"], rows=300).write.parquet(f"{tmp_path}/all")
    relational.rank_per_key(df, ["word"], "pos", rows=300).write.parquet(f"{tmp_path}/each")
    rows = sorted((r.word, r.pos, r.id) for r in df.collect())
    assert sorted((r["rank"], r.id) for r in spark.read.parquet(f"{tmp_path}/all").collect()) == [(k, r[2]) for k, r in enumerate(rows, 1)]
    seen, want = {}, []
    for word, _, i in rows:
        seen[word] = seen.get(word, 0) + 1
        want.append((i, seen[word]))
    assert sorted((r.id, r["rank"]) for r in spark.read.parquet(f"{tmp_path}/each").collect()) == sorted(want)


def test_csv_begins_with_the_mark(spark, tmp_path):
    row = ("An \"A\"", "line\nbreak, comma", "", 1, None, 0, [("c", "t", "a")])
    schema = ("author string, content string, publish_time string, like_count long, share_count long, comment_count long,"
              " comments array<struct<comment_content:string,comment_time:string,comment_author:string>>")
    sinks.write_csv(spark.createDataFrame([row], schema).coalesce(1), f"{tmp_path}/out")
    raw = next(tmp_path.glob("out/*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfauthor,")
    import csv
    import io
    got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"))))
    assert got[1][:2] == list(row[:2]) and got[1][2:6] == ["", "1", "", "0"]


def test_numbered_lines_name_the_bad_one(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="line 3: invalid JSON line"):
        jsonl.jsonl_numbered(spark, f"{tmp_path}/a.jsonl").select("line_number", F.col("v").cast("string")).collect()


def test_breaker_minds_processed_items_only(spark):
    rows = [(1, k, bad, done) for k, (bad, done) in enumerate([(True, True), (False, False), (True, True), (False, True), (False, True)])]
    df = spark.createDataFrame(rows, "run int, pos int, bad boolean, done boolean")
    got = {r.pos: r.stopped for r in relational.login_breaker(df, "run", "pos", F.col("bad"), processed=F.col("done")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True}
    assert not any(r.stopped for r in relational.login_breaker(df, "run", "pos", F.col("bad")).collect())


def test_platforms_and_attempts(spark):
    df = spark.createDataFrame([(0, [" X", "", "facebook", "x"]), (1, ["X", "other"]), (2, [])], "k int, w array<string>")
    assert {r.k: r.p for r in df.select("k", relational.platforms_in_order(F.col("w")).alias("p")).collect()} == {0: ["x", "facebook"], 1: None, 2: []}
    log = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 4, False), ("b", 5, True)], "item string, pos int, failed boolean")
    got = relational.attempts(log, "item", "pos", F.lit(True), 2).collect()
    assert sorted((r.item, r.pos, r.attempt) for r in got) == [("a", 1, 1), ("a", 2, 2), ("b", 4, 1)]


@pytest.mark.parametrize(("label", "name"), [("Actions for this post by Maya Stone", "Maya Stone"), ("Maya’s Post", "Maya"), ("'s Post", None), ("Join's Post", None), (None, None), ("other", None)])
def test_author_of_label(spark, label, name):
    assert spark.createDataFrame([(label,)], "x string").select(text.author_of_label(F.col("x")).alias("n")).first().n == name
