"""Texts of posts and comments: the line that carries the content, names of authors, page metadata, and reasons of summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import text as txt
from postloom.functions.numbers import parse_metric_count
from postloom.functions.text import let
from postloom.functions.times import is_relative

# Lines of a comment or dialog without content, headings that end a dialog's post, and texts of
# pages that show no post.
COMMENT_LINES = ("like", "reply", "share", "comment", "edited", "top fan", "follow", "see more", "view more replies", "write a reply", "anonymous participant")
COMMENTS_BEGIN = ("newest", "all comments", "most relevant", "write an answer…", "write an answer...", "write a comment")
GENERIC_PAGES = ("facebook helps you connect", "log in or sign up", "create an account or log into facebook", "see posts, photos and more on facebook")


def short_metric(low: Column) -> Column:
    return parse_metric_count(low).isNotNull() & (F.length(low) <= 8)


def lines_of(text: Column) -> Column:
    """The lines of a text that aren't blank, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), txt.strip), lambda x: x != "")


def comment_line(lines: Column, author: Column) -> Column:
    """The first line that can be a comment's content: not its author, a time, a control or a short count."""
    name = F.lower(txt.collapse(F.coalesce(author, F.lit(""))))

    def content(line: Column) -> Column:
        return let(F.lower(txt.collapse(line)), lambda low: ~(
            ((name != "") & (low == name)) | is_relative(low) | low.isin(*COMMENT_LINES) | short_metric(low)) & txt.looks_like_comment(line))

    return F.get(F.filter(lines, content), F.lit(0))


def dialog_line(text: Column, author: Column) -> Column:
    """The first line of a dialog's text that reads as a post, after the author's line and before the comments begin."""
    name = txt.strip(F.coalesce(author, F.lit("")))

    def after_author(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: (name != "") & F.contains(x, name)), True).cast("int")  # from 1; 0: none
        return F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))

    def before_comments(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.lower(txt.collapse(x)).isin(*COMMENTS_BEGIN)), True).cast("int")
        return F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)

    content = lambda x: ~txt.dialog_noise(x, parse_metric_count(F.lower(txt.collapse(x)))) & txt.looks_like_post(x)
    return F.get(F.filter(let(let(lines_of(text), after_author), before_comments), content), F.lit(0))


def valid_page_author(name: Column) -> Column:
    """Whether a link's text can be the author of a page's post: as other names, and no day or time of day."""
    return txt.can_be_name(name, txt.UI_NAMES, "today|yesterday|just now", r"[0-9]{1,2}:[0-9]{2}\s*(am|pm)?")


def metadata_is_specific(title: Column, description: Column) -> Column:
    """Whether a page's metadata tell of a post rather than of the site."""
    both = F.lower(txt.strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))))
    return (both != "") & ~txt.has_any(both, GENERIC_PAGES)


def metadata_author(title: Column) -> Column:
    """The name in 'Name on Facebook'; another title is the name, unless it names the site."""
    t = F.coalesce(title, F.lit(""))
    before = txt.optional_string(F.split_part(t, F.lit(" on Facebook"), F.lit(1)))
    return F.when(F.lower(t).contains(" on facebook"), before).when((t != "") & ~F.lower(t).contains("facebook"), txt.strip(t))


def x_warning(results: Column, unique: Column, failed: Column) -> Column:
    """What a summary of X is warned of: the first of no results, no supported posts, failures."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.when(n(results) == 0, "zero_x_search_results").when(n(unique) == 0, "x_search_results_without_supported_post_urls").when(n(failed) > 0, "x_extraction_failed_for_some_posts")


def failure_reason(platform: Column, message: Column) -> Column:
    """Why a platform's collection failed as a whole."""
    m = F.coalesce(message, F.lit(""))
    return (F.when((platform == "x") & m.contains("All X search keywords failed"), "google_pse_request_failed")
            .when(m.rlike("[Nn]o supported"), "no_supported_post_urls").otherwise("platform_failed"))
