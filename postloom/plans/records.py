"""Records of a batch that failed or were skipped, retry fields, strict export with its failures, and metrics of action bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import numbers as num
from postloom.functions import text as txt
from postloom.functions.text import let
from postloom.plans import normalize as nz

# Fields of an internal result and of the final ones, in order; counts of an internal result; metrics of a record of X.
INTERNAL_FIELDS = ("platform", "input_url", "canonical_url", "post_id", "collection_status")
INTERNAL_COUNTS = ("like_count", "share_count", "comment_count", "reply_count")
FINAL_FIELDS = ("author", "content", "publish_time", "like_count", "share_count", "comment_count", "comments")
COMMENT_FIELDS = ("comment_content", "comment_time", "comment_author")
X_METRICS = ("comment_count", "like_count", "share_count", "repost_count", "view_count")
_ITEM = ("post_id", "input_url", "canonical_url")


def failed_records(items: DataFrame, platform: str, as_of: Column) -> DataFrame:
    """Records of items (post_id, input_url, canonical_url, error_type, error_message, metadata) that failed: Facebook's with a structured error and the
    item's metadata, X's with a text and empty fields."""
    head = [F.lit(platform).alias("platform"), *_ITEM, F.lit("failed").alias("collection_status"), as_of.alias("collected_at")]
    if platform == "facebook":
        return items.select(*head, F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message")).alias("error"), F.col("metadata").alias("input_metadata"))
    nothing = F.lit(None).cast("string")
    return items.select(
        *head, F.concat_ws(": ", "error_type", "error_message").alias("error"), F.struct(nothing.alias("name"), nothing.alias("handle")).alias("author"),
        nothing.alias("content"), nothing.alias("publish_time"), *(F.lit(None).cast("bigint").alias(m) for m in X_METRICS),
        F.array().cast("array<struct<comment_content:string,comment_time:string,comment_author:string>>").alias("comments"))


def skipped_records(items: DataFrame, reason: Column, as_of: Column) -> DataFrame:
    return items.select(F.lit("facebook").alias("platform"), *_ITEM, F.lit("skipped").alias("collection_status"), reason.alias("skip_reason"), as_of.alias("collected_at"),
                        F.col("metadata").alias("input_metadata"))


def with_retry_fields(records: DataFrame, attempts: Column) -> DataFrame:
    """Adds attempt_count, failure_category, retryable and last_error to failed records, whichever form their error has."""
    structured = dict(records.dtypes)["error"].startswith("struct")
    kind, message = (F.col("error.type"), F.col("error.message")) if structured else (F.lit(None).cast("string"),) * 2
    text = txt.failure_text(kind, message, F.lit(None).cast("string") if structured else F.col("error"), F.lit(None).cast("string"))
    d = records.withColumn("_c", txt.categorize_failure(text))
    return d.withColumns({"attempt_count": attempts.cast("bigint"), "failure_category": F.col("_c.category"), "retryable": F.col("_c.retryable"),
                          "last_error": message if structured else F.col("error")}).drop("_c")


def with_input_metadata(records: DataFrame, items: DataFrame) -> DataFrame:
    """Records of success with what their items came with: input_metadata and batch_input_url, joined by input_url; items have each URL once."""
    more = items.select("input_url", F.col("metadata").alias("input_metadata"), F.col("original_url").alias("batch_input_url"))
    return records.join(more, "input_url", "left")


def _kind(v: Column, path: str) -> Column:
    """The kind of a VARIANT's field: null where there is none, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _truthy(v: Column, path: str) -> Column:
    kind, text = _kind(v, path), F.try_variant_get(v, path, "string")
    return F.coalesce(kind.isNotNull() & (kind != "VOID") & ~text.isin("", "false", "0", "{}", "[]", "0.0"), F.lit(False))


def internal_record_error(v: Column) -> Column:
    """The first rule that an internal record (VARIANT) breaks, else null. A truth value counts as a whole number, as the format allows it."""
    missing = F.array_compact(F.array(*(F.when(_kind(v, f"$.{k}").isNull(), F.lit(k)) for k in INTERNAL_FIELDS)))
    out = F.when(F.size(missing) > 0, F.concat(F.lit("Internal result missing field(s): "), F.array_join(missing, ", ")))
    out = out.when(~nz.text_of(v, "$.platform").eqNullSafe(F.lit("facebook")), "Internal result platform must be facebook.")
    out = out.when(~F.coalesce(nz.text_of(v, "$.collection_status").isin(*txt.STATUSES), F.lit(False)), "Internal result collection_status is invalid.")
    for k in INTERNAL_COUNTS:
        kind = _kind(v, f"$.{k}")
        wrong = kind.isNotNull() & (kind != "VOID") & ~(kind.isin("BIGINT", "BOOLEAN") & (F.coalesce(nz.whole_of(v, f"$.{k}"), F.lit(0)) >= 0))
        out = out.when(wrong, f"Internal result {k} must be a non-negative integer or null.")
    metadata, contexts = _kind(v, "$.input_metadata"), _kind(v, "$.search_contexts")
    out = out.when(metadata.isNotNull() & ~metadata.startswith("OBJECT"), "Internal result input_metadata must be an object.")
    out = out.when(contexts.isNotNull() & ~contexts.startswith("ARRAY"), "Internal result search_contexts must be a list.")
    lacking = (nz.text_of(v, "$.collection_status") == "failed") & ~_truthy(v, "$.error") & ~_truthy(v, "$.failure_category")
    return out.when(lacking, "Failed internal result must include error or failure_category.")


def final_line_error(line: Column, v: Column) -> Column:
    """The first rule that a final record breaks, else null: exact keys in their order (from the line, as VARIANT keeps none), types and signs,
    and the same of its comments."""
    ordered = lambda c, names: F.coalesce(F.json_object_keys(c) == F.array(*map(F.lit, names)), F.lit(False))
    out = F.when(~ordered(line, FINAL_FIELDS), "Final result fields do not match the fixed Facebook schema.")
    out = out.when(~F.coalesce(_kind(v, "$.comments").startswith("ARRAY"), F.lit(False)), "Final result comments must be a list.")
    for k in FINAL_FIELDS[:3]:
        out = out.when(nz.text_of(v, f"$.{k}").isNull(), f"Final result {k} must be a string.")
    for k in FINAL_FIELDS[3:6]:
        kind = _kind(v, f"$.{k}")
        out = out.when((kind != "VOID") & ~(kind.isin("BIGINT", "BOOLEAN") & (F.coalesce(nz.whole_of(v, f"$.{k}"), F.lit(0)) >= 0)), f"Final result {k} must be a non-negative integer or null.")
    comments = F.from_json(F.get_json_object(line, "$.comments"), "array<string>")
    first = F.when(~F.forall(comments, lambda c: ordered(c, COMMENT_FIELDS)), "Final comment fields do not match the fixed Facebook comment schema.")
    items = F.try_variant_get(v, "$.comments", "array<variant>")
    for k in COMMENT_FIELDS:
        first = first.when(F.exists(items, lambda c: nz.text_of(c, f"$.{k}").isNull()), f"Final comment {k} must be a string.")  # noqa: B023  read at once
    return F.coalesce(out, first)


def export_results(lines: DataFrame) -> DataFrame:
    """(line_number, error, author, ..., comments) of internal results (line_number, v): records of success or in part as final ones, and records that break a rule with
    the rule. Others (failed or skipped, but valid) are left out. Write rows without an error, report the others."""
    raw = nz.raw_columns(lines.withColumn("error_text", internal_record_error(F.col("v"))))
    kept = raw.where(F.col("error_text").isNotNull() | F.col("collection_status").isin("success", "partial"))
    final = nz.final_posts(kept, ["line_number", "error_text"])
    blank = lambda c: F.when(F.col("error_text").isNull(), F.col(c)).alias(c)
    return final.select("line_number", F.col("error_text").alias("error"), *map(blank, FINAL_FIELDS))


METRICS = {"like": "like_button", "comment": "comment_button", "share": "share_button"}


def metric_candidates(texts: Column, buttons: Column) -> Column:
    """Texts around an action bar (array of struct<text, position>) with the counts that each gives: by its words, or as bare numbers in the bar's order."""
    def of(t: Column) -> Column:
        ordered = F.when(t["position"] == "action_bar", num.ordered_action_counts(t["text"], buttons))
        return let(F.struct(ordered.alias("ordered"), *(num.semantic_metric(t["text"], m).alias(m) for m in METRICS)), lambda x: given(t, x))

    def given(t: Column, x: Column) -> Column:
        ordered = x["ordered"]
        counts = {m: F.when(ordered.isNotNull(), F.get(ordered, F.lit(k))).otherwise(x[m]) for k, m in enumerate(METRICS)}
        by = F.when(ordered.isNotNull(), F.when(F.get(ordered, F.lit(2)).isNotNull(), "action_bar_ordered_summary").otherwise("action_bar_ordered_partial_summary"))
        nothing = ~(counts["like"].isNotNull() | counts["comment"].isNotNull() | counts["share"].isNotNull())
        return F.struct(t["text"].alias("text"), *(c.alias(m) for m, c in counts.items()), by.alias("by"), F.when(nothing, "no_semantic_metric_text").alias("rejection_reason"))

    return F.transform(texts, of)


def metric_of(candidates: Column, metric: str, bar: Column, button: Column) -> Column:
    """struct<count, source, raw_text, rejection_reason, count_state> of a metric: the first candidate with a count, else why there is none."""
    source = {"like": "reaction_summary_text", "comment": "comment_summary_text", "share": "share_summary_text"}[metric]
    hit = F.get(F.filter(candidates, lambda c: c[metric].isNotNull()), F.lit(0))
    unassigned = F.exists(candidates, lambda c: c["text"].rlike(r"\p{Nd}") & c["rejection_reason"].isNotNull())
    reason = F.when(unassigned, "ambiguous_unassigned_numeric_text").when(button, "button_found_but_no_numeric_summary").otherwise("button_not_found")
    found = hit[metric].isNotNull()
    state = F.when(hit[metric] == 0, "known_zero").when(found, "known_value").otherwise("unknown")
    return F.struct(hit[metric].alias("count"), F.when(found, F.coalesce(hit["by"], F.lit(source))).alias("source"), F.when(found, hit["text"]).alias("raw_text"),
                    F.when(~found, reason).alias("rejection_reason"), state.alias("count_state"))


def metric_details(bars: DataFrame, no_comments: Column | None = None) -> DataFrame:
    """bars (`post_pages.action_bars`) with like, comment and share metrics; a comment count that isn't known is zero where no_comments, the
    markers of a post without comments, isn't empty."""
    buttons = sum((F.col(b).cast("int") for b in METRICS.values()), F.lit(0))
    d = bars.withColumn("candidates", metric_candidates(F.col("texts"), buttons))
    metrics = {m: metric_of(F.col("candidates"), m, F.col("bar").isNotNull(), F.col(b)) for m, b in METRICS.items()}
    d = d.withColumns(metrics)
    if no_comments is not None:
        zero = F.struct(F.lit(0).cast("bigint").alias("count"), F.lit("comment_empty_state").alias("source"), F.array_join(no_comments, " | ").alias("raw_text"),
                        F.lit(None).cast("string").alias("rejection_reason"), F.lit("known_zero").alias("count_state"))
        d = d.withColumn("comment", F.when(F.col("comment.count").isNull() & (F.size(no_comments) > 0), zero).otherwise(F.col("comment")))
    return d
