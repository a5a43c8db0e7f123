"""What the page queries do per row: normalising a text once, not once a word of its title or once a rule."""

import re

import pytest
from pyspark.sql import functions as F

from postloom.functions import numbers as num
from postloom.functions import text as txt
from postloom.functions import times
from postloom.operators import elements as el
from postloom.operators import ranking

TEXTS = ["Green river walk … with Anna", "green-river, ‘walks’ of ANNA...", "“Río”  Ünï 42 it's it’s end\x1c.", "", "  \n ", None, "walk\nwalk walking", "的 河流 walk", "a bb ccc ccc"]


def plain(s):
    s = s.lower().replace("‘", "'").replace("’", "'")
    return " ".join(re.sub(r"[^\w']|_", lambda m: "_" if m[0] == "_" else " ", s).split())


def overlap(text, title):
    a, b = plain(title or ""), None if text is None else plain(text)
    words = [w for w in a.split(" ") if len(w) > 2]
    if not a or b is None:
        return 0.0
    return 1.0 if a in b else sum(w in b.split(" ") for w in words) / len(words) if words else 0.0


def test_overlap_against_plain_python(spark):
    df = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "text string, title string")
    for r in df.select("*", txt.title_overlap(F.col("text"), F.col("title")).alias("o"), txt.normalize_match_text(F.col("text")).alias("n")).collect():
        assert r.n == (None if r.text is None else plain(r.text))
        assert r.o == pytest.approx(overlap(r.text, r.title)), r


def regexes(df, column):
    return df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().lower().count("regexp_replace(")


def test_a_text_is_normalised_once(spark):
    df = spark.createDataFrame([("a", "b", 1.0, "c")], "text string, title string, o double, author string")
    assert regexes(df, txt.title_overlap(F.col("text"), F.col("title"))) == 2
    score = ranking.score_article(F.col("text"), F.col("o"), F.col("author"), F.lit(True), F.lit(True))["score"]
    assert regexes(df, score) == 2


def test_whole_texts_make_their_rows_once(spark):
    schema = "page int, pre int, start int, stop int, text string"
    elements = spark.createDataFrame([(1, 0, 0, 6, "abcdef"), (1, 1, 1, 3, None), (1, 2, 4, 6, "ef"), (2, 0, 0, 2, "xy"), (2, 1, 0, 0, "")], schema)
    whole = el.with_text(elements.where("pre > 0"), elements)
    assert whole.columns == elements.columns
    assert sorted((r.page, r.pre, r.text) for r in whole.collect()) == [(1, 1, "bc"), (1, 2, "ef"), (2, 1, "")]
    assert "Union" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_a_count_is_looked_for_once(spark):
    df = spark.createDataFrame([("1,204 comments",), ("shares: 3 K",), ("none",), (None,)], "t string")
    found = num.semantic_metric(F.col("t"), "comment")
    assert df.select(found.alias("x"))._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract(") == 4
    assert [r.x for r in df.select(found.alias("x")).collect()] == [1204, None, None, None]


def test_only_texts_that_begin_like_dates_are_read_as_dates(spark):
    texts = ["june 3, 2025", "SEP 5, 2024", "ſep 5, 2024", "Sept 5, 2024", "May 7, 2024 at 4:05 pm", "2024-02-03", "+2024-02-03", "12 mins", "Yesterday", "", " May 7, 2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    read = lambda f: F.date_format(F.try_to_timestamp("t", F.lit(f)), "yyyy-MM-dd'T'HH:mm" if "h" in f else "yyyy-MM-dd")
    plainly = F.coalesce(*(read(f) for f in ("MMMM d, yyyy 'at' h:mm a", "MMM d, yyyy 'at' h:mm a", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")))
    assert [r.same for r in df.select(times._absolute(F.col("t")).eqNullSafe(plainly).alias("same")).collect()] == [True] * len(texts)
    assert "rlike" in df.select(times._absolute(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString().lower()


def test_plain_tags_are_read_as_the_library_reads_them(monkeypatch):
    """Pages of odd and plain pieces give the same tree by either way, and a plain page needs the library's tokenizer for nothing."""
    import random

    from postloom.operators import html

    class Whole(html.PageTree):
        def _read(self, page):
            self.feed(page)

    pieces = ["<div>", "</div>", "<p>", "</p>", '<a href="x&amp;y&copy=2">', "<a href='q'>", "</a>", "<br/>", "<br />", '<img src="a>b"/>', "<td>", "<table>", "</table>", "text", "a < b", " & ", "&lt", "<!-- <p> -->",
              "<script>if(a<b)</script>", "<SCRIPT>x</script>", "<title>T &amp; <b>x</b></title>", "<title>open", "<textarea><p></textarea>", "<title/>", "<svg>", "<path/>", "</svg>", "<", "</", "</p x>", '<p a="1"b="2">',
              '<p a="1" A="2">', "<p\n hidden >", "<x-y>", '<p a= "1">', '<p a="un', "<li>", "</ul>", '<div style="opacity: 0" aria-hidden="true">', "<object>", "</object>", "<template>", "</template>", "\r\n", "&#65;"]
    rng = random.Random(4)
    for _ in range(2000):
        page = "".join(rng.choices(pieces, k=rng.randint(1, 20)))
        a, b = Whole(page), html.PageTree(page)
        assert all(getattr(a, x) == getattr(b, x) for x in ("tags", "attrs", "depth", "parent", "last", "hidden", "start", "stop", "text", "titles")), page
    plain = '<div class="a"><a href="/1">One <b>two</b></a><p hidden>x</p><br/></div>'
    want = Whole(plain).text
    monkeypatch.setattr(html.PageTree, "parse_starttag", None)
    monkeypatch.setattr(html.PageTree, "parse_endtag", None)
    assert html.PageTree(plain).text == want == "One two"


def test_result_pages_are_dealt_over_all_tasks(spark):
    """The function reads pages where they are made: before, its own shuffle merged them into as few tasks as their bytes filled."""
    import __spark_entry__

    plan = __spark_entry__.queries()["result_cards"](spark, "/root/testdata/sf0.001")
    assert plan.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_file_name_is_made_once(spark):
    df = spark.createDataFrame([("a b//c",), ("",), (None,), ("\n",), ("é" * 3 + "x" * 90,), ("unknown",), ("x" * 100,)], "t string")
    name = df.select(txt.safe_filename(F.col("t")).alias("n"))
    assert name._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9._-]+") == 1
    assert [r.n for r in name.collect()] == ["a_b_c", "unknown", "unknown", "_", "_" + "x" * 79, "unknown", "x" * 80]
    assert [r.n for r in df.select(F.transform(F.array("t"), lambda x: txt.safe_filename(x))[0].alias("n")).collect()] == [r.n for r in name.collect()]
    inside = df.select(F.transform(F.array("t"), lambda x: txt.safe_filename(x)).alias("n"))
    assert inside._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9._-]+") == 1
