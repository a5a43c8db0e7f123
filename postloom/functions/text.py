"""Unicode-aware string helpers and text rules, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record formats: words, phrases and marks that rules compare with.
UI_NAMES = ("join", "like", "comment", "share", "most relevant")
TIME_UNITS = r"s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|week|weeks"
NAME_TIME_UNITS = TIME_UNITS + r"|mo|month|months|y|yr|yrs|year|years"
MONTHS = (
    "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|"
    "november|december"
)
STATUSES = ("success", "partial", "failed", "skipped")
MISSING_AUTHOR = "Missing core field(s): author."

_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body) -> Column:
    """Evaluate value once a row and hand it to body, however often body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def optional_string(c: Column) -> Column:
    """Stripped, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, f"{_WHITE}+", " "))


def preserve_lines(c: Column) -> Column:
    """White space goes at each line's end and at both ends of the whole; line breaks stay."""
    return strip(F.array_join(F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, f"{_WHITE}+$", "")), "\n"))


#: What can't be a name, by rule: whole texts in any letter case.
NO_NAME = {
    "counter of more": r"\+\p{Nd}+",
    "tag": r"#.*",
    "age": rf"\p{{Nd}}+\s*({NAME_TIME_UNITS})",
    "metric": r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?\s*(k|m|b|万|亿)?\s*(comments?|shares?|reactions?|likes?)",
    "date": rf"({MONTHS})(?![\p{{L}}\p{{N}}_]).*",
    "marks only": r"[^\p{L}\p{N}_]*",
}


def can_be_name(name: Column, words: tuple[str, ...], *more: str) -> Column:
    """Whether a text is a possible name: none of the words, and no whole match of NO_NAME or of more patterns; null counts as no."""
    rule = "(?i)^(?:" + "|".join((*NO_NAME.values(), *more)) + ")$"
    return let(collapse(name), lambda n: F.coalesce(~(F.lower(n).isin(*words) | n.rlike(rule)), F.lit(False)))


def valid_author_name(name: Column) -> Column:
    """Whether a text can be an author's name rather than a label, counter, time or metric; null counts as no."""
    return can_be_name(name, UI_NAMES)


def normalize_match_text(c: Column) -> Column:
    """Lower case, plain quotes, punctuation as spaces, single spaces: for comparing texts."""
    plain = F.replace(F.replace(F.lower(c), F.lit("‘"), F.lit("'")), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_']+", " "))


def title_overlap(text: Column, title: Column) -> Column:
    """1 where the normalised title is in the text, else the share of its words of over two letters that are.

    Either text is normalised once a row, however many words the title has.
    """
    both = F.struct(normalize_match_text(title).alias("a"), normalize_match_text(text).alias("b"))
    return let(both, lambda x: plain_overlap(x["b"], x["a"]))


def plain_overlap(b: Column, a: Column) -> Column:
    """title_overlap of a text and a title that are normalised already."""
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(F.contains(b, a), 1.0).otherwise(_share(a, b))


def _share(a: Column, b: Column) -> Column:
    """The share of a's words of over two letters that are words of b; both are single-spaced. 0 without such words."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    words = F.filter(F.split(a, " "), lambda w: F.length(w) > 2)
    return let(F.struct(words.alias("words"), spaced(b).alias("b")), lambda x: F.when(F.size(x["words"]) == 0, 0.0).otherwise(
        F.size(F.filter(x["words"], lambda w: F.contains(x["b"], spaced(w)))) / F.size(x["words"])))


def title_context(title: Column) -> Column:
    """struct<author, content> of a page title: counter and site suffix go; author and content part at ' - '."""
    t = strip(F.regexp_replace(strip(F.regexp_replace(title, r"^\([0-9]+\)\s*", "")), r"(?i)\s*\|\s*Facebook\s*$", ""))
    parts = F.split(t, " - ", 2)
    content = strip(F.regexp_replace(F.when(F.size(parts) > 1, parts[1]).otherwise(t), r"\.\.\.$", ""))
    content = optional_string(F.regexp_replace(content, "…$", ""))
    return F.struct(F.when(F.size(parts) > 1, optional_string(parts[0])).alias("author"), content.alias("content"))


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


# Phrases that mark interface texts, login walls and missing posts.
POST_BLOCKED = (
    "all reactions:", "active", "no comments yet", "be the first to comment", "view more comments", "most relevant",
    "write a comment", "see more on facebook", "log in to comment",
)
COMMENT_BLOCKED = (
    "view more comments", "see more comments", "view more replies", "most relevant", "write a comment", "write a reply",
    "anonymous participant", "follow", "log in", "sign up",
)
LOGIN_WALL = {
    "facebook": ("see more on facebook", "you must log in", "log in to continue", "登录", "创建新账户"),
    "x": ("log in", "sign up", "sign in"),
}
UNAVAILABLE = {
    "facebook": ("this content isn't available", "this page isn't available", "this content is no longer available",
                 "此内容目前无法显示", "链接可能已失效"),
    "x": ("this post is unavailable", "something went wrong", "account suspended", "this account has been suspended"),
}
COMMENTS_OFF = ("turned off commenting for this post", "comments are turned off", "commenting has been turned off")
NO_COMMENTS = ("no comments yet", "be the first to comment", "no comments")
# Phrases that open further comments, user-interface words of comments and dialogs, and labels of posts.
EXPAND_COMMENTS = ("view more comments", "see more comments", "view previous comments", "more comments", "view more replies")
COMMENT_WORDS = ("like", "reply", "share", "comment", "follow", "see more", "edited", "view more replies", "write a reply")
DIALOG_WORDS = ("facebook", "join", "like", "react", "reply", "share", "send", "comment", "shared with public group")
PERMALINK_MARKS = ("/posts/", "story_fbid=", "permalink.php")
TRY_AGAIN_MARKS = ("timeout", "timed out", "page crash", "navigation")
TRY_AGAIN_TYPES = ("PlaywrightTimeoutError", "PlaywrightError")
NEVER_AGAIN_TYPES = ("FacebookLoginRequiredError", "FacebookPostUnavailableError", "FacebookPostNotFoundError", "ValueError")


def looks_like_post(text: Column) -> Column:
    low = F.lower(collapse(text))
    return F.coalesce((F.length(low) >= 20) & ~has_any(low, POST_BLOCKED), F.lit(False))


def looks_like_comment(text: Column) -> Column:
    low = F.lower(collapse(text))
    timed = low.isin("just now", "now") | low.rlike(rf"^\s*(?:[0-9]+\s*)?({TIME_UNITS}|y|yr|yrs|year|years)\s*$")
    return F.coalesce((F.length(low) >= 2) & ~timed & ~has_any(low, COMMENT_BLOCKED), F.lit(False))


def page_state(text: Column, platform: str) -> Column:
    """'login_wall' before 'unavailable' before 'ok', by marker phrases."""
    low = F.lower(collapse(text))
    return F.when(has_any(low, LOGIN_WALL[platform]), "login_wall").when(has_any(low, UNAVAILABLE[platform]), "unavailable").otherwise("ok")


def comment_empty_state(text: Column) -> Column:
    """'disabled', 'none' (a known zero) or null."""
    low = F.lower(collapse(text))
    return F.when(has_any(low, COMMENTS_OFF), "disabled").when(has_any(low, NO_COMMENTS), "none")


def redact_inputs(html: Column) -> Column:
    """Mask the values of password and login inputs, in quotes of either kind."""
    for attribute in (r"type=[\"']?password[\"']?", r"(?:name|autocomplete)=[\"']?(?:email|username|current-password|password)[\"']?"):
        html = F.regexp_replace(html, rf"(?i)(<input\b[^>]*{attribute}[^>]*\bvalue=)([\"']).*?\2", "$1$2[REDACTED]$2")
    return html


def safe_filename(c: Column, mark: str = "_", most: int = 80) -> Column:
    # nullif would put the replacement into the plan twice, and each line would be replaced twice
    name = F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", mark), 1, most)
    return F.coalesce(F.regexp_replace(name, r"\A\z", "unknown"), F.lit("unknown"))


def categorize_failure(text: Column) -> Column:
    """struct<category, retryable> by the first phrase that the lower-cased text has; the order is the rule."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda *xs: reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in xs))
    kind = (
        F.when(any_of("unavailable", "not available", "does not exist"), "unavailable")
        .when(any_of("login", "authentication state", "storage state"), "login_required")
        .when(any_of("rate", "too many"), "rate_limited")
        .when(any_of("timeout", "timed out"), "navigation_timeout")
        .when(any_of("network", "net::", "connection"), "network_error")
        .when(any_of("unsupported", "invalid") | (any_of("url") & any_of("supported")), "invalid_url")
        .when(any_of("validation"), "validation_error")
        .when(any_of("extract", "container", "field"), "extraction_error")
        .otherwise("unknown_error")
    )
    return F.struct(kind.alias("category"), kind.isin("rate_limited", "navigation_timeout", "network_error", "extraction_error").alias("retryable"))


def failure_text(error_type: Column, message: Column, plain: Column, skip_reason: Column) -> Column:
    """What the failure cascade reads: 'type: message' of a structured error, else the first plain text there is."""
    structured = F.concat(F.coalesce(error_type, F.lit("")), F.lit(": "), F.coalesce(message, F.lit("")))
    return F.when(error_type.isNotNull() | message.isNotNull(), structured).otherwise(F.coalesce(plain, skip_reason, F.lit("")))


def normalize_error(error_type: Column, message: Column) -> Column:
    t, m = optional_string(error_type), optional_string(message)
    return F.when(t.isNotNull() & m.isNotNull(), F.concat_ws(": ", t, m)).otherwise(F.coalesce(m, t))


def format_cell(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def expands_comments(text: Column) -> Column:
    return F.coalesce(has_any(F.lower(collapse(text)), EXPAND_COMMENTS), F.lit(False))


def no_comment_author(text: Column, relative: Column) -> Column:
    """Whether text can't be who wrote a comment: blank, a word of the page, or a relative time (as relative says)."""
    low = F.lower(collapse(text))
    return F.coalesce((low == "") | relative | low.isin(*COMMENT_WORDS), F.lit(True))


def dialog_noise(text: Column, metric: Column) -> Column:
    """Whether a dialog's line carries no content; metric is its count, if it has one."""
    low = F.lower(collapse(text))
    return F.coalesce((F.length(low) <= 1) | low.isin(*DIALOG_WORDS) | (metric.isNotNull() & (F.length(low) <= 8)), F.lit(True))


def author_of_label(label: Column) -> Column:
    """The name in "Actions for this post by ..." or "...'s Post", if it is a valid one."""
    plain = F.trim(label)
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(plain, r"(?is)actions for this post by\s+(.+)$", 1)), F.lit("")),
                      F.nullif(F.trim(F.regexp_extract(plain, r"(?s)^(.*)['\u2019]s Post$", 1)), F.lit("")))
    return F.when(valid_author_name(name), name)


def single_permalink(url: Column, post_id: Column) -> Column:
    return F.coalesce(url.contains(post_id) & has_any(url, PERMALINK_MARKS), F.lit(False))


def try_again(kind: Column, message: Column) -> Column:
    """Whether an attempt that failed with an exception of this kind and message is worth another."""
    return F.when(kind.isin(*NEVER_AGAIN_TYPES), False).when(kind.isin(*TRY_AGAIN_TYPES), True).otherwise(
        F.coalesce(has_any(F.lower(message), TRY_AGAIN_MARKS), F.lit(False)))


def extraction_status(from_page: Column, author: Column, content: Column, time: Column, group_identity: Column) -> Column:
    """(status, error): success if the page gave author, content and time, or content and the group's identity; the error of
    a partial one names what is missing. Null if there is nothing at all."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    a, c, t = map(given, (author, content, time))
    g = group_identity & c
    status = F.when(from_page & ((a & c & t) | g), "success").otherwise("partial")
    names = F.concat_ws(", ", F.when(~a, "author"), F.when(~c, "content"), F.when(~t & ~g, "publish_time"))
    error = F.when(status == "partial", F.concat(F.lit("Missing core field(s): "), names, F.lit(".")))
    return F.when(a | c | t, F.struct(status.alias("status"), error.alias("error")))
