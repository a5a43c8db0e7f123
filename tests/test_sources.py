"""Numbered lines in splits, versioned tables, imports as one change, history by micro-batches, captured search pages."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.operators import cards
from postloom.plans import imports
from postloom.sources import jsonl, search_pages
from postloom.sources.versions import BUCKETS, Conflict, VersionedTables, bucket_of
from postloom.streaming import incremental

ROWS = "k string, n int"


def upsert(old, rows):
    return old.join(rows.select("k"), "k", "left_anti").unionByName(rows)


def test_numbered_lines(spark, tmp_path):
    """Many splits, blank lines, both kinds of line ends, two files."""
    a = [f'{{"n": {i}, "pad": "{"x" * (i % 90)}"}}' if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(a).encode())
    (tmp_path / "b.jsonl").write_bytes(b'{"n": 1}\n\n{"n": 3}\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = jsonl.numbered_lines(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r.file.rsplit("/", 1)[1], r.line_number): r.line for r in df.collect()}
        assert got == {**{("a.jsonl", i): x for i, x in enumerate(a, 1)}, ("b.jsonl", 1): '{"n": 1}', ("b.jsonl", 2): "", ("b.jsonl", 3): '{"n": 3}'}
        assert [r.line_number for r in jsonl.jsonl_numbered(spark, str(tmp_path / "b.jsonl")).orderBy("line_number").collect()] == [1, 3]
        a[4321] = '{"n": '
        (tmp_path / "a.jsonl").write_bytes("\r\n".join(a).encode())
        with pytest.raises(Exception, match="line 4322: invalid JSON line"):
            jsonl.jsonl(spark, str(tmp_path / "a.jsonl")).collect()
        assert jsonl.jsonl(spark, str(tmp_path / "a.jsonl"), "count").where("reject_reason is not null").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_changes_touch_their_buckets(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    first = tables.begin()
    first.merge("t", ROWS, ["k"], spark.createDataFrame([(f"k{i}", i) for i in range(2000)], ROWS), upsert)
    assert tables.latest() == 0 and tables.read("t", ROWS).count() == 0  # nothing is visible yet
    assert first.commit() == 1
    before = tables.entry(1)["tables"]["t"]["folders"]
    some = spark.createDataFrame([(f"k{i}", -1) for i in range(10)], ROWS)
    change = tables.begin()
    touched = change.merge("t", ROWS, ["k"], some, upsert)
    assert set(touched) == {r[0] for r in some.select(bucket_of(["k"], BUCKETS)).collect()} and len(touched) <= 10
    change.commit()
    after = tables.entry(2)["tables"]["t"]["folders"]
    assert {b for b in after if after[b] != before[b]} == set(map(str, touched))
    rows = {r.k: r.n for r in tables.read("t", ROWS).collect()}
    assert len(rows) == 2000 and sum(n == -1 for n in rows.values()) == 10
    assert tables.read("t", ROWS, version=1).where("n = -1").count() == 0  # a pinned version stays
    assert tables.old_folders(2) == {before[str(b)] for b in touched}


def test_two_writers(spark, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}")
    a, b = tables.begin(), tables.begin()
    for change, n in ((a, 1), (b, 2)):
        change.merge("t", ROWS, ["k"], spark.createDataFrame([("x", n)], ROWS), upsert)
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert [tuple(r) for r in tables.read("t", ROWS).collect()] == [("x", 1)] and tables.versions() == [1]


def lines(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return jsonl.parse_lines(spark.createDataFrame(rows, "pos int, line string"), "count").select("pos", "v", "reject_reason")


def record(post, likes, author="Ann Bell", **more):
    return {"platform": "x", "post_id": post, "canonical_url": f"https://x.com/a/status/{post}", "author": {"name": author, "handle": "@ann"}, "content": "text",
            "like_count": likes, "collection_status": "success", **more}


def test_import(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    records = [record("1", 5), record("2", 6), record("1", 7), "{", "[1]", record("", 1), {"platform": "myspace", "post_id": "3"}, record("4", 1, schema_version="1.0") | {"author": {"handle": "@ann", "profile_url": "https://x.com/ann"}}]
    assert imports.import_lines(spark, tables, lines(spark, records), imports.Run(keywords=("a", " b ", ""))) == {
        "run_id": 1, "records_read": 8, "imported_count": 4, "failed_count": 4, "posts_inserted": 3, "posts_updated": 1, "authors_inserted": 1, "authors_updated": 3,
        "keyword_links_inserted": 6, "keyword_links_ignored": 2}
    again = imports.import_lines(spark, tables, lines(spark, [record("1", 9, author="New Name"), record("5", 1)]), imports.Run(keywords=("a",)))
    assert again == {"run_id": 2, "records_read": 2, "imported_count": 2, "failed_count": 0, "posts_inserted": 1, "posts_updated": 1, "authors_inserted": 0, "authors_updated": 2,
                     "keyword_links_inserted": 1, "keyword_links_ignored": 1}
    posts = {r.post_id: r for r in tables.read("posts", imports.POSTS).collect()}
    assert (posts["1"].like_count, posts["1"].collection_run_id, posts["2"].collection_run_id) == (9, 2, 1)
    assert sorted(p.id for p in posts.values()) == [1, 2, 3, 4] and {p.author_id for p in posts.values()} == {1}
    assert imports.import_lines(spark, tables, lines(spark, []), imports.Run())["records_read"] == 0 and tables.read("collection_runs", imports.RUNS).count() == 3


def test_import_is_one_change(spark, tmp_path, monkeypatch):
    """A failure between tables leaves all of them as they were."""
    tables = VersionedTables(spark, str(tmp_path))
    imports.import_lines(spark, tables, lines(spark, [record("1", 5)]), imports.Run(keywords=("a",)))
    whole = type(tables.begin()).merge

    def failing(self, table, *rest, **more):
        if table == "post_keywords":
            raise OSError("disk full")
        return whole(self, table, *rest, **more)

    monkeypatch.setattr(type(tables.begin()), "merge", failing)
    with pytest.raises(OSError, match="disk full"):
        imports.import_lines(spark, tables, lines(spark, [record("1", 6), record("2", 1)]), imports.Run(keywords=("b",)))
    assert tables.latest() == 1 and [r.like_count for r in tables.read("posts", imports.POSTS).collect()] == [5]
    assert tables.read("collection_runs", imports.RUNS).count() == 1


def test_history_by_batches(spark, tmp_path):
    """Micro-batches rewrite their buckets, and a batch number that was committed is left out when it comes again."""
    schema = "platform string, post_id string, canonical_url string, status string, pos int"
    source, path = str(tmp_path / "in"), str(tmp_path / "history")
    spark.createDataFrame([("x", str(i), f"u{i}", None, i) for i in range(300)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    incremental.upsert_history(stream, path, str(tmp_path / "state"), "run1").awaitTermination()
    spark.createDataFrame([("x", "7", None, "failed", 1), ("x", "7", "v7", None, 2), ("x", "900", "u", "success", 3)], schema).write.mode("append").parquet(source)
    incremental.upsert_history(stream, path, str(tmp_path / "state"), "run2").awaitTermination()
    tables = VersionedTables(spark, path)
    got = {r.post_id: r for r in incremental.read_history(spark, path).collect()}
    assert len(got) == 301 and tuple(got["7"]) == ("x", "7", "v7", "run1", "run2", "failed") and got["900"].first_run == "run2" and got["8"].last_run == "run1"
    old, new = (tables.entry(v)["tables"]["history"]["folders"] for v in (1, 2))
    assert sum(new[b] != old.get(b) for b in new) <= 2
    incremental.upsert_history(stream, path, str(tmp_path / "state2"), "run3").awaitTermination()  # batch 0 again: it has been seen
    assert tables.latest() == 2 and incremental.read_history(spark, path).where("last_run = 'run3'").count() == 0


def test_windowed_counts_and_stage(spark, tmp_path):
    rows = [("https://x.com/a/status/1", "2024-01-01 10:10:00"), ("https://x.com/a/status/2", "2024-01-01 10:50:00"), ("nothing", "2024-01-01 10:50:00"), ("https://x.com/a/status/3", "2024-01-01 11:00:00")]
    spark.createDataFrame(rows, "url string, at string").select("url", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "at").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.start), r["count"]) for r in spark.table("windowed").collect()) == [("2024-01-01 10:00:00", 2), ("2024-01-01 11:00:00", 1)]
    made = []
    for _ in range(2):
        df = incremental.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1 and df.count() == 3


def page(keyword, number, urls, **more):
    return (keyword, number, 10, more.get("has_next", True), more.get("failed", False), [(f"t{u}", u, None) for u in urls])


def test_search_pages(spark, tmp_path):
    """Batch and stream give the same rows, filters leave pages out, paging stops as it must."""
    search_pages.register(spark)
    path = str(tmp_path / "pages")
    full = lambda k: [f"{k}{i}" for i in range(10)]
    stored = [page("río/a", 1, full("a")), page("río/a", 2, full("b")), page("río/a", 3, ["c1"]), page("río/a", 4, full("d")), page("k-2", 1, full("e"), has_next=False), page("k-2", 2, full("f")),
              page("bad", 1, full("g")), page("bad", 2, full("h"), failed=True), page("bad", 3, full("i")), page("none", 1, [])]
    spark.createDataFrame(stored, search_pages.PAGE).repartition(3).write.format("search_pages").mode("append").save(path)
    rows = spark.read.format("search_pages").load(path)
    assert rows.count() == 82 and rows.where("keyword = 'none'").first().position is None
    got = {k: [r.url for r in search_pages.search_results(rows).where(F.col("keyword") == k).orderBy("rank").collect()] for k in ("río/a", "k-2", "bad", "none")}
    assert got == {"río/a": full("a") + full("b") + ["c1"], "k-2": full("e"), "bad": full("g"), "none": []}
    assert search_pages.search_results(rows, 15).where("keyword = 'río/a'").count() == 15
    few = spark.read.format("search_pages").option("keywords", '["bad", "río/a"]').option("maxPage", 1).load(path)
    assert few.rdd.getNumPartitions() == 2 and few.count() == 20 and rows.rdd.getNumPartitions() == 10
    assert rows.where("keyword = 'bad' and page_number < 2").count() == 10 and rows.count() == 82  # a filter stays with its own query
    for wrong, error in ((0, ValueError), (101, ValueError), ("5", TypeError), (True, TypeError)):
        with pytest.raises(error):
            search_pages.most_results(wrong)

    def drain():
        q = spark.readStream.format("search_pages").load(path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert drain() == sorted(map(repr, rows.collect()))
    spark.createDataFrame([page("none", 1, ["late"])], search_pages.PAGE).write.format("search_pages").mode("append").save(path)
    assert drain() == sorted(map(repr, spark.read.format("search_pages").load(path).collect()))
    assert [r.url for r in search_pages.search_results(spark.read.format("search_pages").load(path)).where("keyword = 'none'").collect()] == ["late"]  # the last capture counts


def test_cards(spark):
    cards.register(spark)
    html = """<div class="gsc-webResult gsc-result"><a class="gs-title">no address</a><a class="gs-title b" href=" /1 ">One <b>two</b></a><p class=gs-snippet hidden>x</p><p class=gs-snippet>s</div>
      <div class="gsc-result">other</div><div class="gsc-result gsc-webResult"><a href="/2">no title</a></div><div class="gsc-webResult gsc-result"><a class=gs-title href=/3></a>"""
    assert list(cards.cards(html)) == [("One two", "/1", "s"), ("", "/3", None)]
    spark.createDataFrame([(1, html, "k"), (2, None, "k")], "page int, html string, extra string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT * FROM result_cards(TABLE(some_pages) PARTITION BY page)")
    assert got.columns == ["page", "extra", "card", "title", "url", "snippet"] and [tuple(r) for r in got.orderBy("card").collect()] == [(1, "k", 1, "One two", "/1", "s"), (1, "k", 2, "", "/3", None)]
    with pytest.raises(Exception, match="column html"):
        spark.sql("SELECT * FROM result_cards(TABLE(SELECT 1 AS a) PARTITION BY a)").collect()
