"""The post of a page: its container, messages and their ancestors, action bar and publish time, on the table of elements.

All take elements of `html.page_elements(..., keep=("url", "post_id"))`, as a written table. A page's post is searched for in stages
(a container with a link to it, a dialog by its author, the only container of a permalink, an article by its
title, an ancestor of the message that has the title); all containers of a page are judged in one aggregate, ambiguity included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as txt
from postloom.functions.text import let
from postloom.functions.times import parse_publish_time
from postloom.operators import elements as el
from postloom.operators import ranking

#: Messages of a page that are compared with its title, and outermost ancestors of one that are judged.
MESSAGES, ANCESTORS = 20, 12
#: Texts of an action bar's surroundings, their length, and how far siblings and ancestors are gone through.
AROUND, PREVIEW, NEAR = 20, 240, 3
#: A publish time's text has so many characters at most.
TIME_TEXT = 80


def line(c: Column) -> Column:
    """A text of several lines as one."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def titles(elements: DataFrame) -> DataFrame:
    """(page, author, content) of each page's title, and both as texts to compare with."""
    context = txt.title_context(el.attr("title"))
    t = elements.where("pre = 0").withColumn("context", context).select(el.PAGE, F.col("context.author").alias("author"), F.col("context.content").alias("content"))
    return t.withColumns({"plain_author": txt.normalize_match_text(F.col("author")), "plain_content": txt.normalize_match_text(F.col("content"))})


def container_metrics(elements: DataFrame) -> DataFrame:
    """The containers of every page with counts of what lies in them, depth (the root's is 0) and length of text."""
    signed = el.time_sign()
    named = any_label_author()
    of = {"target_links": el.target_link(F.col("post_id")), "messages": el.message(), "authors": el.profile_link(), "role_articles": el.role_article(),
          "time_signs": signed, "named": named, "dialogs": el.dialog(), "markers": el.any_of(map(el.button, el.BUTTONS)),
          **{f"has_{k}": c for k, c in el.presence().items()}}
    c = el.subtree_counts(elements, of, el.any_of(el.containers().values()))
    return c.withColumns({
        "descendants": (F.col("last") - F.col("pre")).cast("bigint"), "is_article": el.role_article(), "is_dialog": el.dialog(), "selectors": reduce(lambda a, b: a + b, (x.cast("int") for x in el.containers().values())),
        "place": F.when(el.role_article(), 0).when(el.article(), 1).otherwise(2), "level": F.col("depth") - 1, "n_text": F.col("stop") - F.col("start"),
        "present": reduce(lambda a, b: a + b, ((F.col(f"has_{k}") > 0).cast("int") for k in el.presence()))})


def any_label_author() -> Column:
    """An element that names who wrote the post: a heading, or the label of its actions."""
    return el.any_of((el.heading() & txt.author_of_label(line(F.col("text"))).isNotNull(),
                      el.label_has("actions for this post by") & txt.author_of_label(el.attr("aria-label")).isNotNull()))


def messages(elements: DataFrame) -> DataFrame:
    """The first messages of every page against its title: (page, pre, number, n_text, overlap, with_title, with_author)."""
    number = F.row_number().over(Window.partitionBy(el.PAGE).orderBy("pre"))
    m = elements.where(el.message()).withColumn("number", number).where(F.col("number") <= MESSAGES)
    m = el.with_text(m, elements).join(titles(elements), el.PAGE)
    m = m.withColumn("plain", txt.normalize_match_text(F.col("text")))
    holds = lambda c: F.coalesce((c != "") & F.contains(F.col("plain"), c), F.lit(False))
    return m.select(el.PAGE, "pre", "number", (F.col("stop") - F.col("start")).alias("n_text"), txt.plain_overlap(F.col("plain"), F.col("plain_content")).alias("overlap"),
                    holds(F.col("plain_content")).alias("with_title"), holds(F.col("plain_author")).alias("with_author"))


def message_ancestors(elements: DataFrame, of: DataFrame) -> DataFrame:
    """Ancestors of messages (page, pre, number) with counts, overlap with the title, score, reasons and validity."""
    signed = el.time_sign() & el.any_of((el.attr("aria-label") != "", el.attr("title") != "", F.col("stop") > F.col("start")))
    counts = {"messages": el.message(), "time_signs": signed, **{b: el.button(b) for b in el.BUTTONS}}
    upper = el.subtree_counts(elements, counts, F.col("depth").between(1, ANCESTORS) & (F.col("last") > F.col("pre"))).where("messages > 0")
    upper = upper.withColumn("descendants", (F.col("last") - F.col("pre")).cast("bigint"))
    a = el.ancestors(upper, of.select(el.PAGE, F.col("pre").alias("of_pre"), "number"), ANCESTORS)
    a = el.with_text(a, elements).join(titles(elements), el.PAGE)
    author = F.col("plain_author")
    a = a.withColumn("plain", txt.normalize_match_text(F.col("text")))
    a = a.withColumns({"overlap": txt.plain_overlap(F.col("plain"), F.col("plain_content")), "n_text": F.length("text"),
                       "with_author": F.coalesce((author != "") & F.contains("plain", author), F.lit(False)),
                       "markers": reduce(lambda x, y: x + y, ((F.col(b) > 0).cast("int") for b in el.BUTTONS))})
    score = ranking.score_ancestor(F.col("n_text"), F.col("overlap"), F.col("with_author"), F.col("messages"), F.least("time_signs", F.lit(5)),
                                   F.col("markers"), F.col("descendants"), F.col("tag"))
    return a.withColumn("score", score).select(
        el.PAGE, "pre", "number", "depth", "tag", "messages", "time_signs", "markers", "descendants", "n_text", "overlap", "with_author", "score.*")


def title_message(elements: DataFrame) -> DataFrame:
    """One row a page with messages: the one that matches the title, unless a second comes near, and why none was taken."""
    fits = (F.col("overlap") >= 0.65) & F.col("with_title") & (F.col("n_text") >= 20)
    ranked = F.sort_array(F.collect_list(F.when(fits, F.struct("overlap", "n_text", (-F.col("number")).alias("minus"), "pre"))), asc=False)
    m = messages(elements).groupBy(el.PAGE).agg(F.count("*").alias("messages"), ranked.alias("ranked"))
    margin = F.when(F.size("ranked") > 1, F.col("ranked")[0]["overlap"] - F.col("ranked")[1]["overlap"])
    clear = (F.size("ranked") == 1) | (margin >= 0.2)
    best = F.get("ranked", F.lit(0))
    return m.select(el.PAGE, "messages", F.size("ranked").alias("matching"), margin.alias("margin"), F.when(clear, best["pre"]).alias("pre"),
                    F.when(clear, -best["minus"]).alias("number"))


def best_message_ancestors(elements: DataFrame) -> DataFrame:
    """(page, pre, score, reasons, reason): the best valid ancestor of each page's title message, or why there is none."""
    chosen = title_message(elements)
    a = message_ancestors(elements, chosen.where("pre is not null"))
    key = F.struct("score", "depth", (-F.col("descendants")).alias("d"), (-F.col("n_text")).alias("n"))
    best = a.groupBy(el.PAGE).agg(F.count("*").alias("candidates"), F.count_if("valid").alias("valid"),
                                  F.max_by(F.struct("pre", "score", "reasons"), F.when(F.col("valid"), key)).alias("best"))
    both = chosen.select(el.PAGE, "messages", "matching", "margin").join(best, el.PAGE, "left")
    found = F.when(F.col("valid") > 0, F.col("best"))
    reason = ranking.ancestor_rejection(F.col("messages"), F.col("matching"), F.col("margin"), F.coalesce("valid", F.lit(0)), F.coalesce("candidates", F.lit(0)))
    return both.select(el.PAGE, found["pre"].alias("pre"), found["score"].alias("score"), found["reasons"].alias("reasons"), reason.alias("reason"))


def target_containers(elements: DataFrame) -> DataFrame:
    """One row a page: (page, pre, strategy, score, reason, containers, matched); pre is null where no stage found the post.

    containers counts those with a link to the post (once a selector, as matched does), matched those that also show anything of a post.
    """
    c = el.with_text(container_metrics(elements), elements).join(titles(elements), el.PAGE)
    text = F.col("text")
    c = c.withColumn("plain", txt.normalize_match_text(text)).withColumn("overlap", txt.plain_overlap(F.col("plain"), F.col("plain_content")))
    own_label = txt.author_of_label(el.attr("aria-label")).isNotNull().cast("int")
    dialog = ranking.score_dialog(F.col("n_text"), F.col("overlap"), F.col("named") + own_label, F.col("messages"), F.col("time_signs"), F.col("markers"),
                                  F.col("descendants"), F.col("dialogs"))
    article = ranking.score_article(text, F.col("overlap"), F.coalesce("author", F.lit(None).cast("string")), F.col("time_signs") > 0, F.col("markers") > 0, F.col("plain"))
    c = c.withColumns({"dialog": dialog, "article": article["score"]})
    linked = F.col("target_links") > 0
    minus = lambda name: (-F.col(name)).alias(f"minus_{name}")
    by_link = F.when(linked & (F.col("messages") == 1), F.struct(
        (F.col("authors") >= 1).alias("a"), "level", (~F.col("is_dialog")).alias("page"), minus("descendants"), minus("n_text"), minus("place"), minus("pre")))
    by_author = F.when(F.col("is_dialog") & F.col("dialog.valid"), F.struct(F.col("dialog.score").alias("score"), "overlap", minus("descendants"), minus("pre")))
    strong = F.col("present") >= 2
    by_title = F.when(F.col("is_article") & F.col("content").isNotNull(), F.struct(F.col("article").alias("score"), minus("pre"), "overlap"))
    pages = c.groupBy(el.PAGE).agg(
        F.max(by_link).alias("link"), F.max(by_author).alias("author"), F.max(by_title).alias("title"),
        F.sum(F.when(strong, F.col("selectors")).otherwise(0)).alias("strong"), F.min(F.when(strong, F.col("pre"))).alias("single"),
        F.sort_array(F.collect_list(F.when(F.col("is_article"), F.col("article"))), asc=False).alias("scores"),
        F.sum(F.when(linked, F.col("selectors")).otherwise(0)).alias("containers"),
        F.sum(F.when(linked & (F.col("present") > 0), F.col("selectors")).otherwise(0)).alias("matched"))
    root = elements.where("pre = 0").select(el.PAGE, txt.single_permalink(F.col("url"), F.col("post_id")).alias("permalink"))
    d = root.join(pages, el.PAGE, "left").join(best_message_ancestors(elements).withColumnRenamed("score", "up_score"), el.PAGE, "left")
    lead = F.col("title.score") - F.coalesce(F.get("scores", F.lit(1)), F.lit(0))
    titled = (F.col("title.score") >= 8) & (F.col("title.overlap") >= 0.65) & (lead >= 3)
    stages = [
        (F.col("link").isNotNull(), -F.col("link.minus_pre"), F.lit("smallest_semantic_target_container"), F.lit(None)),
        (F.col("author").isNotNull(), -F.col("author.minus_pre"), F.lit("dialog_author_action_context"), F.col("author.score")),
        (F.col("permalink") & (F.col("strong") == 1), F.col("single"), F.lit("single_semantic_post_container"), F.lit(None)),
        (titled, -F.col("title.minus_pre"), F.when(F.col("title.overlap") >= 0.9, "title_text_match").otherwise("article_score"), F.col("title.score")),
        (F.col("pre").isNotNull(), F.col("pre"), F.lit("message_ancestor_title_match"), F.col("up_score")),
    ]
    picked = F.coalesce(*(F.when(ok, F.struct(pre.cast("int").alias("pre"), s.alias("strategy"), score.cast("bigint").alias("score"))) for ok, pre, s, score in stages))
    return d.withColumn("picked", picked).select(
        el.PAGE, "picked.*", F.when(F.col("picked").isNull(), F.coalesce("reason", F.lit("no_message_candidates"))).alias("reason"), F.coalesce("containers", F.lit(0)).alias("containers"),
        F.coalesce("matched", F.lit(0)).alias("matched"))


def container_ranges(elements: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page, first, end) of the chosen elements (page, pre)."""
    return elements.join(chosen.select(el.PAGE, "pre"), [el.PAGE, "pre"]).select(el.PAGE, F.col("pre").alias("first"), F.col("last").alias("end"))


# The shapes of a publish time's text, and parts of a page that have none.
TIME_SHAPES = (
    r"^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}( at [0-9]{1,2}:[0-9]{2} [AP]M)?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"(?i)^yesterday$",
    r"(?i)^[0-9]+\s*(s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|weeks?)$",
)


def publish_time_candidates(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts in containers (page, first, end) that read as publish times, each once, with its best place: (page, text, iso, kept, strategy,
    in_link, before_message, descendants, pre, best).

    Parts that are hidden, or lie in a message, in controls or in navigation, don't count.
    """
    no_times = el.any_of((el.message(), el.label_has("like", "comment", "share"), el.attr("role") == "navigation", el.attr("aria-label") == "Close"))
    e = el.with_inside(elements, {"in_hidden": F.col("hidden"), "in_other": no_times, "in_link": F.col("tag") == "a"})
    e = e.withColumn("is_message", el.message())
    labels = elements.where(el.attr("id").isNotNull()).select(el.PAGE, el.attr("id").alias("id"), F.col("pre").alias("label_pre"), line(F.col("text")).alias("label_text"))
    e = el.within(e, ranges)
    first_message = F.min(F.when(F.col("is_message"), F.col("pre"))).over(Window.partitionBy(el.PAGE, "first"))
    e = e.withColumn("before_message", F.coalesce(F.col("pre") < first_message, F.lit(False))).where("not in_hidden and not in_other")
    trimmed = lambda c: txt.collapse(c)
    own = e.select("*", F.posexplode(F.array(*(F.struct(F.lit(s).alias("strategy"), c.alias("found")) for s, c in (
        ("visible_descendant_strict_match", line(F.col("text"))), ("aria_label_strict_match", trimmed(el.attr("aria-label"))),
        ("title_strict_match", trimmed(el.attr("title"))))))).alias("option", "o")).select("*", "o.*")
    # texts of labels elsewhere, joined in the order in which they are named
    named = e.where(el.attr("aria-labelledby").isNotNull()).select("*", F.posexplode(F.split(trimmed(el.attr("aria-labelledby")), " ")).alias("nth", "id"))
    named = named.join(labels.groupBy(el.PAGE, "id").agg(F.min_by("label_text", "label_pre").alias("label_text")), [el.PAGE, "id"])
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "label_text"))), lambda x: x["label_text"]), " ")
    labelled = named.groupBy(el.PAGE, "pre").agg(words.alias("found"))
    labelled = e.join(labelled, [el.PAGE, "pre"]).withColumns({"strategy": F.lit("aria_labelledby_strict_match"), "option": F.lit(3)})
    columns = [el.PAGE, "pre", "last", "option", "strategy", "found", "in_link", "before_message"]
    found = own.select(columns).unionByName(labelled.select(columns))
    shaped = reduce(lambda a, b: a | b, (F.col("found").rlike(s) for s in TIME_SHAPES))
    found = found.where(F.length("found").between(1, TIME_TEXT) & shaped).withColumn("time", parse_publish_time(F.col("found"))).where("time is not null")
    # descendants of an element: pre-order numbers between it and its last
    key = F.struct(F.col("time.iso").isNotNull().alias("absolute"), "in_link", "before_message", (F.col("pre") - F.col("last")).alias("d"), (-F.length("found")).alias("n"),
                   (-F.col("pre")).alias("p"), (-F.col("option")).alias("o"))
    each = found.groupBy(el.PAGE, F.col("found").alias("text")).agg(F.max(key).alias("key"), F.max_by(F.struct("time", "strategy", "pre", "last"), key).alias("b"))
    best = F.row_number().over(Window.partitionBy(el.PAGE).orderBy(F.desc("key")))
    return each.select(el.PAGE, "text", F.col("b.time.iso").alias("iso"), F.col("b.time.kept").alias("kept"), "b.strategy", "key.in_link", "key.before_message",
                       (F.col("b.last") - F.col("b.pre")).alias("descendants"), "b.pre", (best == 1).alias("best"))


def publish_times(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """(page, iso, kept, source) of containers: the best strict candidate, else the first <time>, else the first absolute, then relative one of links,
    labels and short inline parts."""
    e = el.within(elements, ranges)
    parsed = parse_publish_time(line(F.col("text")), el.attr("aria-label"), el.attr("title"))
    loose = el.any_of((F.col("tag").isin("span", "b", "strong", "time"), attr_any("aria-label", "title"), el.attr("role") == "link",
                       el.link() & el.any_of(F.contains(el.attr("href"), F.lit(x)) for x in ("story_fbid", "/posts/", "permalink.php"))))
    e = e.withColumns({"time": parsed, "loose": loose})
    time_tag = F.min_by("time", F.when(F.col("tag") == "time", F.col("pre")))
    key = F.when(F.col("loose") & F.col("time").isNotNull(), F.struct(F.col("time.iso").isNull().alias("relative"), "pre"))
    rest = e.groupBy(el.PAGE).agg(time_tag.alias("tag"), F.min_by("time", key).alias("loose"), F.max(key).isNotNull().alias("any"))
    strict = publish_time_candidates(elements, ranges).where("best").select(el.PAGE, F.struct("iso", "kept").alias("strict"))
    d = ranges.select(el.PAGE).join(strict, el.PAGE, "left").join(rest, el.PAGE, "left")
    has_tag = F.col("tag").isNotNull()
    loose = F.when(F.col("any"), F.col("loose"))
    source = F.when(F.col("strict").isNotNull(), "strict").when(has_tag, "time").when(loose.isNotNull(), "loose")
    return d.withColumn("t", F.coalesce("strict", "tag", loose)).select(el.PAGE, "t.iso", "t.kept", source.alias("source"))


def attr_any(*names: str) -> Column:
    return el.any_of(el.attr(n).isNotNull() for n in names)


def action_bars(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a container: which buttons it has, the bar that holds them, and at most AROUND texts in and around the bar, the nearest first.

    (page, like_button, comment_button, share_button, bar, bar_depth, texts array<struct<text, position>>)
    """
    marks = el.within(elements.where(el.any_of(map(el.button, el.BUTTONS))), ranges)
    first = marks.select(el.PAGE, "pre", F.col("attrs")["data-ad-rendering-role"].alias("role")).groupBy(el.PAGE, "role").agg(F.min("pre").alias("mark"))
    around = elements.where(el.role_button()).select(el.PAGE, "pre", "last", "depth", el.attr("aria-label").alias("label"))
    f = first.withColumnRenamed(el.PAGE, "_page")
    nodes = around.join(f, (F.col(el.PAGE) == F.col("_page")) & (F.col("pre") <= F.col("mark")) & (F.col("last") >= F.col("mark")))
    nodes = nodes.groupBy(el.PAGE, "role").agg(F.max_by(F.struct("pre", "last", "depth", "label"), "pre").alias("b")).select(el.PAGE, "role", "b.*")
    shared = el.common_ancestor(elements, nodes.select(el.PAGE, "pre", "last"))
    bar = elements.join(shared, [el.PAGE, "pre"]).select(el.PAGE, F.col("pre").alias("bar"), F.col("last").alias("bar_last"), F.col("depth").alias("bar_depth"),
                                                          F.col("parent").alias("bar_parent"))
    page = ranges.join(bar, el.PAGE)
    ordered = _around_bar(elements, page, nodes)
    plain = ranges.join(bar.select(el.PAGE), el.PAGE, "left_anti")
    whole = elements.join(plain.select(el.PAGE, F.col("first").alias("pre")), [el.PAGE, "pre"])
    whole = el.with_text(whole, elements).select(el.PAGE, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("order"), "text", F.lit("target_container_without_action_bar").alias("position"))
    texts = ordered.unionByName(whole).withColumn("text", F.trim(F.substring(line(F.trim(F.col("text"))), 1, PREVIEW))).where("text <> ''")
    texts = texts.groupBy(el.PAGE, "position", "text").agg(F.min("order").alias("order")).groupBy(el.PAGE).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("order", "text", "position"))), 1, AROUND).alias("t"))
    has = nodes.groupBy(el.PAGE).agg(*(F.bool_or(F.col("role") == b).alias(b) for b in el.BUTTONS), F.max("depth").alias("deepest"))
    d = ranges.select(el.PAGE).join(has, el.PAGE, "left").join(bar, el.PAGE, "left").join(texts, el.PAGE, "left")
    inside = lambda xs: F.transform(xs, lambda x: F.struct(x["text"].alias("text"), x["position"].alias("position")))
    return d.select(el.PAGE, *(F.coalesce(b, F.lit(False)).alias(b) for b in el.BUTTONS), "bar", (F.col("deepest") - F.col("bar_depth")).alias("bar_depth"),
                    F.coalesce(inside("t"), F.array().cast("array<struct<text:string,position:string>>")).alias("texts"))


def _around_bar(elements: DataFrame, page: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page, order, text, position) of the bar, its buttons' labels, its neighbours and those of its ancestors, inside the container."""
    position = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    order = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("order")
    p = page.withColumnRenamed(el.PAGE, "_page")
    same = F.col(el.PAGE) == F.col("_page")
    held = (F.col("pre") >= F.col("first")) & (F.col("pre") <= F.col("end"))
    # the bar's ancestors up to NEAR levels, and the children of them (the bar's siblings among them)
    up = elements.join(p, same & held & (F.col("pre") < F.col("bar")) & (F.col("last") >= F.col("bar")) & (F.col("depth") >= F.col("bar_depth") - NEAR))
    up = el.with_text(up.withColumn("up", F.col("bar_depth") - F.col("depth")).drop("_page"), elements)
    of_up = up.select(F.col(el.PAGE).alias("_page"), F.col("pre").alias("of"), "up", "bar", "bar_last", "first", "end")
    children = elements.join(of_up, same & (F.col("parent") == F.col("of"))).drop("_page")
    children = children.withColumn("child", F.row_number().over(Window.partitionBy(el.PAGE, "of").orderBy("pre")) - 1)
    others = el.with_text(children.where(~((F.col("pre") <= F.col("bar")) & (F.col("last") >= F.col("bar")))), elements)
    # siblings also where the bar's parent lies outside the container: then they do too, so those inside are among the children
    near = others.where("up = 1").withColumn("before", F.col("pre") < F.col("bar"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy(el.PAGE, "before").orderBy(F.when(F.col("before"), -F.col("pre")).otherwise(F.col("pre"))))).where(F.col("nth") <= NEAR)
    own = el.with_text(elements.join(p, same & held & (F.col("pre") == F.col("bar"))).drop("_page"), elements)
    roles = F.create_map(*(F.lit(x) for i, b in enumerate(el.BUTTONS) for x in (b, i)))
    parts = [
        own.select(el.PAGE, order(F.lit(0), F.lit(0)), "text", F.lit("action_bar").alias("position")),
        nodes.select(el.PAGE, order(F.lit(1), roles[F.col("role")]), txt.collapse(F.col("label")).alias("text"), position(F.col("role"), "_button_aria_label").alias("position")),
        near.select(el.PAGE, order(F.when(F.col("before"), 2).otherwise(3), F.col("nth")), "text",
                    position(F.when(F.col("before"), "previous").otherwise("next"), "_sibling_", F.col("nth")).alias("position")),
        others.select(el.PAGE, order(F.col("up") * 2 + 2, F.col("child")), "text", position("ancestor_", F.col("up"), "_child_", F.col("child")).alias("position")),
        up.select(el.PAGE, order(F.col("up") * 2 + 3, F.lit(0)), "text", position("ancestor_", F.col("up")).alias("position")),
    ]
    return reduce(DataFrame.unionByName, parts)
