"""Parsing of pages: implied end tags, hidden parts, linear time; and operators on elements against walks of the tree."""

import random
import time

import duckdb
import pyarrow as pa
import pytest

from postloom.catalog import ORACLE_SQL, QUERIES
from postloom.operators import elements as el
from postloom.operators import html
from postloom.operators.html import PageTree
from postloom.plans import post_pages as pp
from pyspark.sql import functions as F


@pytest.mark.parametrize(("page", "text"), [
    ("<p hidden>secret<p>shown", "shown"), ("<li aria-hidden='true'>a<li>b", "b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<table><tr><td style='display:none'>1<td>2<tr hidden><td>3<tr><td>4</table>5", "2\n4\n5"), ("<dl><dt>a<dd hidden>b<dt>c</dl>", "a\nc"),
    ("<select><option hidden>a<option>b</select>", "b"), ("<p>a<div>b</div>c", "a\nb\nc"), ("<b>a<p>b</b>c", "ab".replace("b", "\nb\nc")), ("a</div></p>b", "ab"),
    ("<head><title>t</title><div>x", "x"), ("a <b> b</b> <i>c</i>d", "a b cd"), ("<svg><path/><path/></svg>x", "x"), ("<table><tr><td><p>a</table>b", "a\nb"),
    ("<div><span hidden>no</div>yes", "yes"), ("a&nbsp;&amp;b<br>c<!-- d --><script>e</script>", "a &b\nc"), ("", ""),
])
def test_visible(page, text):
    assert PageTree(page).text == text


def test_linear():
    """Unclosed tags, deep pages and long tables take time in proportion."""
    def seconds(page):
        began = time.perf_counter()
        PageTree(page)
        return time.perf_counter() - began

    for unit in ("<p>x", "<b>x", "<div>x", "<li>x", "<i hidden>x", "<tr><td>x", "</p>", "<title>"):
        seconds(unit * 2000)
        assert seconds(unit * 40_000) < 40 * max(0.02, seconds(unit * 4000)), unit


def random_page(rng):
    tags = ["div", "p", "a", "b", "li", "ul", "span", "td", "tr", "table"]
    out = []
    for _ in range(rng.randrange(60)):
        kind = rng.randrange(4)
        if kind < 2:
            extra = rng.choice(["", "", " hidden", ' role="article"', ' data-ad-preview="message"', ' role="button"', ' href="/u"', ' data-ad-rendering-role="like_button"',
                                ' data-ad-rendering-role="share_button"'])
            out.append(f"<{rng.choice(tags)}{extra}>")
        elif kind == 2:
            out.append(f"</{rng.choice(tags)}>")
        else:
            out.append(rng.choice(["word ", "x", " y z"]))
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    return [random_page(rng) for _ in range(150)] + [None, "", "plain text " * 100]


@pytest.fixture(scope="module")
def elements(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string").repartition(3)
    return html.page_elements(df, "page", "html").persist()


def climb(tree, i):
    out = []
    while i >= 0:
        out.append(i)
        i = tree.parent[i]
    return out


def test_encoding(elements, pages):
    got = {(r.page, r.pre): r for r in elements.collect()}
    for k, page in enumerate(pages):
        tree = PageTree(page or "")
        n = len(tree.tags)
        for i in range(n):
            r = got.pop((k, i))
            below = [j for j in range(n) if i in climb(tree, j)]
            assert r.last == max(below) and len(below) == r.last - i + 1 and r.depth == len(climb(tree, i)) - 1
            assert (r.text if r.text is not None else tree.text[r.start : r.stop]) == tree.visible(i) or i == 0
    assert not got


def test_counts_and_covers(elements, pages):
    of = {"buttons": el.role_button(), "messages": el.message(), "all_": F.lit(True)}
    counted = {(r.page, r.pre): (r.buttons, r.messages, r.all_) for r in el.subtree_counts(elements, of, F.col("tag").isin("div", "ul", "#page")).collect()}
    inside = {(r.page, r.pre): r.off for r in el.with_inside(elements, {"off": F.col("hidden")}).collect()}
    for k, page in enumerate(pages):
        tree = PageTree(page or "")
        up = [climb(tree, j) for j in range(len(tree.tags))]
        for i, tag in enumerate(tree.tags):
            assert inside[k, i] == any(tree.hidden[j] for j in up[i])
            if tag in ("div", "ul", "#page"):
                below = [j for j in range(len(up)) if i in up[j] and j != i]
                assert counted.pop((k, i)) == (sum(tree.attrs[j].get("role") == "button" for j in below), sum(tree.attrs[j].get("data-ad-preview") == "message" for j in below), len(below))
    assert not counted


def test_common_ancestor(elements, pages):
    marked = elements.where(el.any_of(map(el.button, el.BUTTONS)))
    got = {r.page: r.pre for r in el.common_ancestor(elements, marked.select("page", "pre", "last")).collect()}
    for k, page in enumerate(pages):
        tree = PageTree(page or "")
        ups = [climb(tree, i) for i, a in enumerate(tree.attrs) if "data-ad-rendering-role" in a]
        if ups:
            assert got.pop(k) == next(i for i in ups[0] if all(i in u for u in ups)), k
    assert not got


def test_whole_texts(elements, pages):
    deep = el.with_text(elements.where("pre > 0"), elements).collect()
    assert all(r.text == PageTree(pages[r.page] or "").visible(r.pre) for r in deep)


def test_strategies(spark):
    """One page a stage of the search for a post's container, and pages without one."""
    text = "A long green river walk with many words about it and more of them still"
    title = f"<title>Anna - {text}... | Facebook</title>"
    message = f'<div data-ad-preview="message">{text}</div>'
    bar = '<div role="button"><i data-ad-rendering-role="like_button">Like</i></div>'
    cases = {
        "smallest_semantic_target_container": ("x", f'<div role="article"><article>{message}<a href="/p/posts/7">1</a></article></div>'),
        "dialog_author_action_context": ("x", f"<div role=dialog aria-label=\"Anna Bell's Post\">{message}{bar}<time>1 h</time></div>"),
        "single_semantic_post_container": ("https://www.facebook.com/p/posts/7", f'<article>{message}<a href="/u">u</a></article>'),
        "title_text_match": ("x", f'{title}<div role="article">{text} <a aria-label=t>Anna</a>{bar}</div><div role="article">other</div>'),
        "message_ancestor_title_match": ("x", f"{title}<div><h1>Anna</h1><time>1 h</time>{message}{bar}</div>"),
        None: ("x", f"{title}<div>{message}{message}</div>"),
    }
    rows = [(i, url, "7", page) for i, (url, page) in enumerate(cases.values())]
    e = html.page_elements(spark.createDataFrame(rows, "page int, url string, post_id string, html string"), "page", "html", ("url", "post_id")).persist()
    got = {r.page: r for r in pp.target_containers(e).collect()}
    assert [got[i].strategy for i in range(len(rows))] == list(cases)
    assert got[len(rows) - 1].reason == "ambiguous_message_matches" and got[0].pre == 2 and (got[0].containers, got[0].matched) == (2, 2)
    bars = {r.page: r for r in pp.action_bars(e, e.where("tag = '#page'").select("page", F.col("pre").alias("first"), F.col("last").alias("end"))).collect()}
    assert bars[1].like_button and not bars[1].share_button and bars[1].texts[0].position == "action_bar" and bars[5].texts[0].position == "target_container_without_action_bar"


def test_references():
    """By default references as browsers resolve them; of a list, those with a semicolon, in texts, titles and attributes."""
    page = '<title>a&amp;b &quot;c&quot; d&amp</title><a href="?x=1&lt=2&amp;y">e&amp;lt; f&am</a>'
    tree, some = PageTree(page), PageTree(page, ("lt", "gt", "amp"))
    assert (tree.title(), tree.text) == ('a&b "c" d&', "e&lt; f&am")
    assert (some.title(), some.text, some.attrs[2]) == ("a&b &quot;c&quot; d&amp", "e&lt; f&am", {"href": "?x=1&lt=2&y"})


@pytest.mark.parametrize("name", ["page_elements", "page_facts", "page_title"])
def test_cut_references(spark, tmp_path, name):
    """Captured pages whose titles are cut within a reference, against SQL."""
    page = "<html><head><title>a &amp; &quot;b&quot; c&amp</title></head><body><article><h1>a &amp; &quot;b&quot; c&am</h1><p>d &lt;e&gt; f&amp</p></article></body></html>"
    spark.createDataFrame([(1, "https://a.example/1", page)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))


def test_parts():
    """A batch of pages is parsed in slices of bounded size, each row once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(3001)), pa.array(["<p>" + "x" * (k % 7 * 300) for k in range(3000)] + ["y" * 3_000_000])], ["key", "html"])
    parts = list(html._parts(batch))
    assert [k for p in parts for k in p.column("key").to_pylist()] == list(range(3001)) and len(parts) > 2
    assert all(sum(map(len, p.column("html").to_pylist()[:-1])) < html.CHARS for p in parts)
    assert not list(html._parts(batch.slice(0, 0)))
