"""Work on elements of pages in interval encoding (`html.page_elements`): b lies in a if a.pre < b.pre <= a.last.

Counts of descendants are differences of one running sum in pre-order, and "lies in such an element" is a running maximum of
`last`; both are one window by page, however deep pages nest, and no ancestor is walked. Joins are by page and place. A page is the unit of
work: its elements, never those of several pages, are sorted in one task.

Selectors are conditions on (tag, attrs). Elements should be a written table (`stored`) where they are read more than once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = "page"


def attr(name: str) -> Column:
    return F.col("attrs").getItem(name)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, map(_holds, conditions))


def label_has(*words: str) -> Column:
    """Whether aria-label holds one of the words, in any letter case."""
    low = F.lower(attr("aria-label"))
    return any_of(F.contains(low, F.lit(w)) for w in words)


# Roles of buttons, parameters of links to comments, and parts of links that lead to no profile.
BUTTONS = ("like_button", "comment_button", "share_button")
COMMENT_LINK = ("comment_id=", "comment_id%3D", "reply_comment_id=")
NOT_PROFILE = ("story.php", "permalink.php", "/posts/", "/watch/", "/reel/")


# Selectors of the parts of pages: fixed values are the attributes and roles by which pages mark them.
def message() -> Column:
    return any_of((attr("data-ad-preview") == "message", attr("data-ad-comet-preview") == "message"))


def role_article() -> Column:
    return _holds(attr("role") == "article")


def article() -> Column:
    return F.col("tag") == "article"


def dialog() -> Column:
    return _holds(attr("role") == "dialog")


def link() -> Column:
    return (F.col("tag") == "a") & attr("href").isNotNull()


def role_button() -> Column:
    return _holds(attr("role") == "button")


def time() -> Column:
    return any_of((F.col("tag") == "time", (F.col("tag") == "a") & attr("aria-label").isNotNull()))


def time_sign() -> Column:
    return any_of((time(), attr("aria-labelledby").isNotNull(), attr("title").isNotNull())) & (F.col("pre") > 0)


def heading() -> Column:
    return any_of((F.col("tag").isin("h1", "h2", "h3"), attr("role") == "heading"))


def containers() -> dict[str, Column]:
    return {"role_article": role_article(), "article": article(), "dialog": dialog()}


def button(role: str) -> Column:
    return _holds(attr("data-ad-rendering-role") == role)


def target_link(post_id: Column) -> Column:
    """A link to the post that isn't a link to one of its comments."""
    href = attr("href")
    return link() & F.contains(href, post_id) & ~any_of(F.contains(href, F.lit(x)) for x in COMMENT_LINK)


def profile_link() -> Column:
    """A link with a text to something on the site that is no post."""
    href = attr("href")
    path = F.regexp_replace(href, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    here = any_of((F.contains(href, F.lit("facebook.com")), F.startswith(href, F.lit("/")), path.rlike("/groups/[^/]+/user/[^/]+")))
    has_text = F.col("stop") > F.col("start")
    return link() & has_text & here & ~any_of(F.contains(href, F.lit(x)) for x in NOT_PROFILE)


def presence() -> dict[str, Column]:
    """What a post shows of itself: six selectors."""
    return {"author": any_of((link(), (F.col("tag") == "a") & (attr("role") == "link"))), "content": message(), "publish_time": time(),
            "like_metric": label_has("reaction", "like"), "comment_metric": label_has("comment"), "share_metric": label_has("share")}


def subtree_counts(elements: DataFrame, of: dict[str, Column], where: Column) -> DataFrame:
    """The elements where `where` holds, each with the counts `of` its descendants (not itself) that satisfy a condition.

    Each of them stands twice in the order, where it opens and where it closes; its count is how far the running sum
    rises between. One shuffle, by page: of elements that satisfy a condition only the place, of others nothing.
    """
    rest = [n for n in elements.columns if n not in (PAGE, "pre")]
    marks = elements.select(PAGE, "pre", _holds(where).alias("_where"), *(_holds(c).alias(f"_{k}") for k, c in of.items()),
                            F.when(_holds(where), F.struct(*rest)).alias("_kept"))
    marks = marks.where(reduce(lambda a, b: a | b, (F.col(f"_{k}") for k in of), F.col("_where")))
    end = F.struct(F.col("_kept.last").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["_kept"].dataType).alias("kept"))
    start = F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.col("_kept").alias("kept"))
    sides = marks.select(PAGE, "pre", "_where", *(f"_{k}" for k in of), F.explode(F.when(F.col("_where"), F.array(start, end)).otherwise(F.array(start))).alias("_s"))
    sides = sides.select("*", F.col("_s.at").alias("_at"), F.col("_s.side").alias("_side"), F.col("_s.kept").alias("_kept")).drop("_s")
    sums = Window.partitionBy(PAGE).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sides.withColumns({f"_{k}": F.sum(((F.col("_side") == 0) & F.col(f"_{k}")).cast("long")).over(sums) for k in of})
    both = running.where("_where").groupBy(PAGE, "pre").agg(
        F.any_value("_kept", F.lit(True)).alias("_kept"), *((F.max(f"_{k}") - F.min(f"_{k}")).alias(k) for k in of))
    return both.select(PAGE, "pre", "_kept.*", *of)


def with_inside(elements: DataFrame, of: dict[str, Column]) -> DataFrame:
    """Adds for each condition whether the element or one that it lies in satisfies it: an interval cover in pre-order."""
    order = Window.partitionBy(PAGE).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return elements.withColumns({k: _holds(F.max(F.when(c, F.col("last"))).over(order) >= F.col("pre")) for k, c in of.items()})


def with_text(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """rows (of elements' columns) with their whole texts; only rows whose text isn't short meet their page's. rows are made once."""
    page_text = elements.where("pre = 0").select(F.col(PAGE).alias("_page"), F.col("text").alias("_text"))
    both = rows.join(page_text, (F.col(PAGE) == F.col("_page")) & F.col("text").isNull(), "left")
    whole = F.substring("_text", F.col("start") + 1, F.col("stop") - F.col("start"))
    return both.withColumn("text", F.coalesce("text", whole)).drop("_page", "_text")


def within(elements: DataFrame, outer: DataFrame) -> DataFrame:
    """Elements inside outer (page, first, end), at most a few rows a page: pairs of a page that are inside one another."""
    o = outer.withColumnRenamed(PAGE, "_page")
    return elements.join(o, (F.col(PAGE) == F.col("_page")) & (F.col("pre") > F.col("first")) & (F.col("pre") <= F.col("end"))).drop("_page")


def ancestors(elements: DataFrame, of: DataFrame, depth: int) -> DataFrame:
    """Ancestors down to a depth (outermost 1) of rows (page, of_pre, ...): elements' columns and those of the rows."""
    o = of.withColumnRenamed(PAGE, "_page")
    return elements.where(F.col("depth").between(1, depth)).join(
        o, (F.col(PAGE) == F.col("_page")) & (F.col("pre") < F.col("of_pre")) & (F.col("last") >= F.col("of_pre"))).drop("_page")


def common_ancestor(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page, pre) of the deepest element that holds all of a page's nodes (page, pre, last); a node holds itself.

    Of the first and the last node in pre-order: the first if the last lies in it, else the parent of the least deep element
    after the first up to the last.
    """
    ends = nodes.groupBy(PAGE).agg(F.min("pre").alias("first"), F.max("pre").alias("end"), F.min_by("last", "pre").alias("first_last"))
    apart = ends.where("end > first_last").select(PAGE, "first", "end")
    between = within(elements.select(PAGE, "pre", "depth", "parent"), apart)
    top = between.groupBy(PAGE).agg(F.min_by("parent", F.struct("depth", "pre")).alias("pre"))
    return ends.where("end <= first_last").select(PAGE, F.col("first").alias("pre")).unionByName(top)
