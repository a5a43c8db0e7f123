"""Counts in texts: '1.2K', '3 万', '12 comments', '5 of 20'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_NUMBER = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
_SUFFIX = r"(\s*[KkMmBb万亿億])?"
# What a suffix multiplies by.
MULTIPLIERS = {"k": 1e3, "m": 1e6, "b": 1e9, "万": 1e4, "亿": 1e8, "億": 1e8}


def parse_metric_count(text: Column, strict: bool = False) -> Column:
    """The first number of a text times its suffix, as a whole number; null without a digit.

    A suffix needs no word end, as the records were made so ('5 minutes' is 5 000 000); strict asks for one.
    """
    pattern = _NUMBER + (_SUFFIX[:-2] + r"(?![\p{L}]))?" if strict else _SUFFIX)
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    suffix = F.lower(F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\s", "")))
    factor = let(suffix, lambda mark: F.coalesce(*(F.when(mark == k, v) for k, v in MULTIPLIERS.items()), F.lit(1.0)))
    return F.when(text.rlike("[0-9]"), (F.nullif(number, F.lit("")).try_cast("double") * factor).try_cast("bigint"))


def semantic_metric(text: Column, kind: str) -> Column:
    """A count beside the words of its kind ('like', 'comment' or 'share'), before or after them."""
    words = {"like": "reactions?|likes?", "comment": "comments?", "share": "shares?"}[kind]
    number = r"[0-9][0-9,\s]*(?:\.[0-9]+)?\s*[KkMmBb万亿億]?"
    before = F.regexp_extract(text, rf"(?i)({number})\s*(?:{words})\b", 1)
    after = F.regexp_extract(text, rf"(?i)\b(?:{words})\s*[:：]?\s*({number})", 1)
    return let(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))), lambda found: parse_metric_count(found))


def ordered_action_counts(text: Column, buttons: Column) -> Column:
    """array of like, comment and share counts of an action bar: three bare numbers, or two and no shares."""
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?\s*[KkMmBb万亿億]?)"), 1)
    ok = (buttons == 3) & (F.length(text) <= 40) & ~text.rlike(r"(?i)(like|reaction|comment|share)")
    parsed = F.transform(numbers, lambda n: parse_metric_count(n))
    none = F.lit(None).cast("bigint")
    counts = let(parsed, lambda p: F.when(F.size(p) == 3, p).when(F.size(p) == 2, F.concat(p, F.array(none))))
    return F.when(ok, counts)


def comment_progress(text: Column) -> Column:
    """struct<current, total> of 'n of m'; null without one."""
    pattern = r"(?i)([0-9][0-9,]*)\s+of\s+([0-9][0-9,]*)"
    part = lambda k: F.regexp_replace(F.regexp_extract(text, pattern, k), ",", "").try_cast("bigint")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("current"), part(2).alias("total")))


def first_metric(*texts: Column) -> Column:
    return F.coalesce(*map(parse_metric_count, texts))


def count_or_none(value: Column) -> Column:
    """A count of a VARIANT: whole numbers from zero on; truth values, fractions and texts are null."""
    whole = F.schema_of_variant(value) == "BIGINT"
    n = F.try_variant_get(value, "$", "bigint")
    return F.when(whole & (n >= 0), n)
