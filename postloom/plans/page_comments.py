"""The comments of a post's page as a table, on the elements of `html.page_elements`.

A comment is an element labelled as a comment or reply inside the post's container. All that may tell its author, time, content and id is gathered in one aggregate
over what lies in it, in pre-order and as many of each kind as the format looks at; then the first that fits is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import posts
from postloom.functions import text as txt
from postloom.functions import url
from postloom.functions.times import is_relative, parse_publish_time
from postloom.operators import elements as el
from postloom.plans.post_pages import line

# How many links and labels of a comment, texts of a kind, and links to its post are looked at.
LINKS, TEXTS, TO_POST = 8, 20, 5


def is_comment() -> Column:
    return el.any_of((el.label_has("comment by", "reply by"), el.role_article() & el.label_has("comment", "reply")))


def _first(items: Column, fits) -> Column:
    return F.get(F.filter(items, fits), F.lit(0))


def page_comments(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """(page, number, pre, comment_content, comment_time, comment_author, comment_id) of containers (page, first, end); elements that link to the post itself, or have
    no content, are no comments."""
    marked = el.within(elements.where(is_comment()), ranges)
    marked = el.with_text(marked.drop("first", "end"), elements)
    own = marked.select(F.col(el.PAGE).alias("_page"), F.col("pre").alias("of"), F.col("last").alias("of_last"), "post_id", F.col("text").alias("whole"))
    inside = elements.drop("post_id").join(own, (F.col(el.PAGE) == F.col("_page")) & (F.col("pre") > F.col("of")) & (F.col("pre") <= F.col("of_last"))).drop("_page", "of_last", "whole")
    href, auto = F.coalesce(el.attr("href"), F.lit("")), F.coalesce(el.attr("dir") == "auto", F.lit(False))
    link = (F.col("tag") == "a") & (el.attr("href").isNotNull() | F.coalesce(el.attr("role") == "link", F.lit(False)))
    message = F.when(F.coalesce(el.attr("data-ad-preview") == "message", F.lit(False)), 0).when(F.coalesce(el.attr("data-ad-comet-preview") == "message", F.lit(False)), 1).when(
        auto & (F.col("tag") == "div"), 2).when(auto & (F.col("tag") == "span"), 3)
    label = F.when((F.col("tag") == "a") & el.attr("aria-label").isNotNull(), 0).when((F.col("tag") == "abbr") & el.attr("title").isNotNull(), 1).when((F.col("tag") == "span") & el.attr("aria-label").isNotNull(), 2)
    kinds = inside.withColumns({
        "href": href, "is_link": link, "to_post": link & F.contains(href, F.col("post_id")), "to_comment": (F.col("tag") == "a") & F.contains(href, F.lit("comment_id=")), "message": message, "label": label,
        "named": F.coalesce(F.nullif(el.attr("aria-label"), F.lit("")), F.nullif(el.attr("title"), F.lit("")), line(F.col("text")))})
    kinds = el.with_text(kinds.where("is_link or to_comment or message is not null or label is not null"), elements)
    gather = lambda when, *fields: F.array_sort(F.collect_list(F.when(when, F.struct("pre", *fields))))
    found = kinds.groupBy(el.PAGE, "of").agg(
        gather(F.col("is_link"), "text", "href").alias("links"), gather(F.col("to_post"), "href").alias("to_post"), gather(F.col("to_comment"), "text", "href").alias("to_comment"),
        *(gather(F.col("message") == k, "text").alias(f"message_{k}") for k in range(4)), *(gather(F.col("label") == k, "named").alias(f"label_{k}") for k in range(3)))
    d = own.withColumnRenamed("_page", el.PAGE).drop("of_last").join(found, [el.PAGE, "of"], "left")
    some = lambda name, n: F.slice(F.coalesce(F.col(name), F.array()), 1, n)
    of_post = F.exists(some("to_post", TO_POST), lambda x: ~F.contains(x["href"], F.lit("comment_id=")))

    def is_author(x: Column) -> Column:
        plain = txt.collapse(x["text"])
        here = F.contains(x["href"], F.lit("facebook.com")) | F.startswith(x["href"], F.lit("/"))
        return (plain != "") & ~txt.no_comment_author(plain, is_relative(plain)) & ~F.contains(x["href"], F.lit("comment_id=")) & here

    d = d.where(~F.coalesce(of_post, F.lit(False))).withColumn("comment_author", F.coalesce(txt.collapse(_first(some("links", LINKS), is_author)["text"]), F.lit("")))
    name = txt.normalize_match_text(F.col("comment_author"))
    fits = lambda x: ~((name != "") & (txt.normalize_match_text(x["text"]) == name)) & ~is_relative(x["text"]) & txt.looks_like_comment(x["text"])
    content = F.coalesce(*(txt.strip(_first(some(f"message_{k}", TEXTS), fits)["text"]) for k in range(4)), posts.comment_line(posts.lines_of(F.col("whole")), F.col("comment_author")))
    told = F.coalesce(*(_first(F.transform(some(f"label_{k}", LINKS), lambda x: parse_publish_time(x["named"])), lambda t: t.isNotNull()) for k in range(3)))
    time = F.coalesce(txt.strip(_first(some("to_comment", LINKS), lambda x: is_relative(x["text"]))["text"]), told["iso"], told["kept"], F.lit(""))
    ids = F.transform(some("to_comment", LINKS), lambda x: url.comment_id(x["href"]))
    d = d.withColumns({"comment_content": content, "comment_time": time, "comment_id": F.coalesce(_first(ids, lambda i: F.coalesce(i != "", F.lit(False))), F.lit(""))})
    d = d.where((F.col("comment_content") != "") & ~((name != "") & (txt.normalize_match_text(F.col("comment_content")) == name)))
    number = F.row_number().over(Window.partitionBy(el.PAGE).orderBy("of"))
    return d.select(el.PAGE, number.alias("number"), F.col("of").alias("pre"), "comment_content", "comment_time", "comment_author", "comment_id")


def comment_ids(comments: DataFrame) -> DataFrame:
    """(page, comment_id): each id of a page's comments once."""
    return comments.where("comment_id <> ''").select(el.PAGE, "comment_id").distinct()
