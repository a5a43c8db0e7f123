"""Scores of page parts and the best candidate of a group: additive rules, lexicographic picks, margins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import has_any, let, normalize_match_text

# Texts of recommendations, which no main post has.
RECOMMENDED = ("sponsored", "suggested for you", "people you may know")


def _score(rules: list[tuple[Column, int, str | None]]) -> Column:
    """struct<score, reasons> of (condition, points, reason) rules; a null condition doesn't hold."""
    points = [F.when(c, p).otherwise(0) for c, p, _ in rules]
    reasons = F.array_compact(F.array(*(F.when(c, r) for c, _, r in rules if r)))
    return F.struct(reduce(lambda a, b: a + b, points).cast("bigint").alias("score"), reasons.alias("reasons"))


def score_article(text: Column, overlap: Column, author: Column, timed: Column, markers: Column, plain: Column | None = None) -> Column:
    """Points of an article for being the page's main post; plain is its normalised text, if that is at hand."""
    both = F.struct((normalize_match_text(text) if plain is None else plain).alias("low"), normalize_match_text(author).alias("author"))
    return let(both, lambda x: _article(F.length(text), x["low"], overlap, x["author"], timed, markers))


def _article(n: Column, low: Column, overlap: Column, author: Column, timed: Column, markers: Column) -> Column:
    return _score([
        (overlap >= 0.9, 8, "strong_title_text_match"), ((overlap >= 0.65) & (overlap < 0.9), 5, "partial_title_text_match"),
        (F.contains(low, author), 2, "title_author_match"), (timed, 2, "timestamp_candidate_present"),
        (markers, 2, "interaction_markers_present"), (n.between(80, 5000), 1, "reasonable_text_length"),
        (n < 40, -4, "too_short_for_main_post"), (has_any(low, RECOMMENDED), -4, "recommendation_or_navigation_text"),
    ])


def score_ancestor(n: Column, overlap: Column, author: Column, messages: Column, times: Column, markers: Column, descendants: Column, tag: Column) -> Column:
    """struct<score, reasons, valid> of an ancestor of a message; markers counts the kinds of buttons, 0 to 3."""
    page = F.lower(tag).isin("html", "body")
    s = _score([
        (overlap >= 0.9, 8, "strong_message_title_match"), ((overlap >= 0.65) & (overlap < 0.9), 5, "partial_message_title_match"),
        (messages == 1, 3, "single_message_container"), (messages != 1, -8, "multiple_or_missing_messages"), (author, 3, "title_author_match"),
        (times > 0, 3, "timestamp_candidate_present"), (markers == 1, 1, None), (markers == 2, 2, None), (markers >= 3, 3, None),
        (n.between(80, 6000), 1, "reasonable_text_length"), (n < 40, -4, "too_short_for_main_post"),
        ((descendants > 2500) | (n > 8000) | page, -4, "too_broad_for_single_post"),
    ])
    signal = author | (times > 0) | (markers > 0)
    valid = (s["score"] >= 12) & (messages == 1) & signal & (descendants <= 2500) & (n <= 8000) & ~page
    return F.struct(s["score"].alias("score"), s["reasons"].alias("reasons"), valid.alias("valid"))


def score_dialog(n: Column, overlap: Column, authors: Column, messages: Column, times: Column, markers: Column, descendants: Column, dialogs: Column) -> Column:
    """struct<score, valid> of a dialog."""
    s = _score([
        (authors > 0, 5, None), (overlap >= 0.65, 5, None), (messages >= 1, 3, None), (times > 0, 2, None),
        (markers == 1, 1, None), (markers == 2, 2, None), (markers >= 3, 3, None), (n < 40, -4, None),
        ((descendants > 3000) | (n > 8000), -3, None),
    ])
    valid = ((authors > 0) & ((overlap >= 0.65) | (dialogs <= 1)) & ((messages >= 1) | (markers > 0)) & (times > 0)
             & (s["score"] >= 9) & (descendants <= 3000))
    return F.struct(s["score"].alias("score"), valid.alias("valid"))


def best(df: DataFrame, group: str, order: list[Column], index: str) -> DataFrame:
    """The row of each group that is largest in order, the first by index among equals: one aggregate."""
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), (-F.col(index)).alias("at"))
    rest = F.struct(*(c for c in df.columns if c != group))
    return df.groupBy(group).agg(F.max_by(rest, key).alias("_best")).select(group, "_best.*")


def with_margin(df: DataFrame, group: str, score: str, least: float) -> DataFrame:
    """The best row of each group if it leads the second by least or more, or stands alone."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "candidate")
    d = df.withColumns({"_n": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_n = 1")
    return d.where(F.col("_next").isNull() | (F.col(score) - F.col("_next") >= least)).drop("_n", "_next")


def ancestor_rejection(messages: Column, matching: Column, margin: Column, valid: Column, candidates: Column) -> Column:
    """Why no ancestor was taken; null where one was."""
    return (
        F.when(messages == 0, "no_message_candidates").when(matching == 0, "no_message_matches_title")
        .when((matching > 1) & (margin < 0.2), "ambiguous_message_matches").when((candidates > 0) & (valid == 0), "no_valid_message_ancestor")
    )


def match_strategy(matched: Column, single: Column, links: Column) -> Column:
    return (F.when(matched > 0, "smallest_semantic_target_container").when(single, "single_semantic_post_container")
            .when(links > 0, "target_link_without_semantic_container"))


def no_progress_rounds(df: DataFrame, group: str, order: str, value: str, limit: int) -> DataFrame:
    """Rounds (group, order, value) up to the one that ends `limit` rounds in a row without growth."""
    w = Window.partitionBy(group).orderBy(order)
    grew = F.coalesce(F.col(value) > F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    d = df.withColumn("_island", F.sum(grew.cast("int")).over(w))
    d = d.withColumn("_still", F.row_number().over(Window.partitionBy(group, "_island").orderBy(order)) - 1)
    ended = F.coalesce(F.max((F.col("_still") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_ended", ended).where("_ended = 0").drop("_island", "_still", "_ended")
