"""Queries over failure records, strict export and metrics of action bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import posts
from postloom.plans import post_pages as pp
from postloom.plans import queries_pages as qp
from postloom.plans import records, views
from postloom.plans.queries import AS_OF, classified, query
from postloom.sources import jsonl

_KINDS = """CASE WHEN contains(t, 'unavailable') THEN 'unavailable' WHEN contains(t, 'login') THEN 'login_required' WHEN contains(t, 'rate') OR contains(t, 'too many') THEN 'rate_limited'
  WHEN contains(t, 'timeout') OR contains(t, 'timed out') THEN 'navigation_timeout' WHEN contains(t, 'net::') OR contains(t, 'network') THEN 'network_error' WHEN contains(t, 'unsupported') OR contains(t, 'invalid') THEN 'invalid_url'
  WHEN contains(t, 'validation') THEN 'validation_error' WHEN contains(t, 'extract') OR contains(t, 'container') OR contains(t, 'field') THEN 'extraction_error' ELSE 'unknown_error' END"""


def _items(spark, d, platform):
    c = classified(spark, d).where((F.col("platform") == platform) & (F.col("status") == "failed"))
    return c.select("pos", "post_id", F.trim("url").alias("input_url"), "canonical_url", "error_type", "error_message", F.create_map(F.lit("keyword"), F.col("keyword")).alias("metadata"))


def _failures(d):
    return d.select("platform", "post_id", "canonical_url", "collection_status", "collected_at", "error", "attempt_count", "failure_category", "retryable", "last_error")


@query(f""", fr AS (SELECT *, CASE WHEN platform = 'x' THEN error_type || ': ' || error_message ELSE error_message END AS last_error, lower(error_type || ': ' || error_message) AS t FROM c WHERE platform IS NOT NULL AND status = 'failed')
SELECT platform, post_id, canonical_url, 'failed' AS collection_status, '{AS_OF}' AS collected_at, error_type || ': ' || error_message AS error, CAST(1 + length(post_id) % 3 AS BIGINT) AS attempt_count,
  {_KINDS} AS failure_category, {_KINDS} IN ('rate_limited', 'navigation_timeout', 'network_error', 'extraction_error') AS retryable, last_error FROM fr""")
def failed_records(spark, d):
    """Failure records of both platforms with their retry fields; errors as one text."""
    out = []
    for platform in ("facebook", "x"):
        r = records.with_retry_fields(records.failed_records(_items(spark, d, platform), platform, F.lit(AS_OF)), 1 + F.length("post_id") % 3)
        out.append(_failures(r.withColumn("error", F.concat_ws(": ", "error.type", "error.message")) if platform == "facebook" else r))
    return out[0].unionByName(out[1])


@query(f"""SELECT platform, post_id, trim(url) AS input_url, 'skipped' AS collection_status, CASE WHEN pos % 2 = 0 THEN 'resume_already_processed' ELSE 'history_success' END AS skip_reason, '{AS_OF}' AS collected_at, keyword
FROM c WHERE platform = 'facebook' AND status = 'skipped'""")
def skipped_records(spark, d):
    c = classified(spark, d).where("platform = 'facebook' and status = 'skipped'")
    items = c.select("pos", "post_id", F.trim("url").alias("input_url"), "canonical_url", F.create_map(F.lit("keyword"), F.col("keyword")).alias("metadata"))
    reason = F.when(F.col("pos") % 2 == 0, "resume_already_processed").otherwise("history_success")
    r = records.skipped_records(items, reason, F.lit(AS_OF))
    return r.select("platform", "post_id", "input_url", "collection_status", "skip_reason", "collected_at", F.col("input_metadata")["keyword"].alias("keyword"))


@query(""", it AS (SELECT trim(url) AS input_url, arg_min(keyword, pos) AS keyword, arg_min(url, pos) AS original FROM c WHERE platform = 'facebook' GROUP BY 1)
SELECT pos, it.keyword AS input_keyword, it.original AS batch_input_url FROM c LEFT JOIN it ON it.input_url = trim(c.url) WHERE platform = 'facebook' AND status = 'success'""")
def enrich_input_metadata(spark, d):
    fb = classified(spark, d).where("platform = 'facebook'").select("pos", "status", "keyword", "url", F.trim("url").alias("input_url"))
    first = fb.groupBy("input_url").agg(F.min_by("keyword", "pos").alias("keyword"), F.min_by("url", "pos").alias("original_url"))
    items = first.select("input_url", "original_url", F.create_map(F.lit("keyword"), F.col("keyword")).alias("metadata"))
    done = records.with_input_metadata(fb.where("status = 'success'").select("pos", "input_url"), items)
    return done.select("pos", F.col("input_metadata")["keyword"].alias("input_keyword"), "batch_input_url")


#: Internal results as lines, a rule broken in most.
_INTERNAL = """concat('{{"platform":"', CASE WHEN pos % 17 = 1 THEN 'x' ELSE 'facebook' END, '","input_url":"u","post_id":"', CAST(pos AS {0}), '"', CASE WHEN pos % 17 = 2 THEN '' ELSE ',"canonical_url":null' END,
  ',"collection_status":"', CASE WHEN pos % 17 = 3 THEN 'done' WHEN pos % 17 > 11 THEN 'failed' WHEN pos % 17 = 11 THEN 'skipped' WHEN pos % 2 = 0 THEN 'partial' ELSE 'success' END, '"',
  CASE pos % 17 WHEN 4 THEN ',"like_count":-1' WHEN 5 THEN ',"share_count":1.5' WHEN 6 THEN ',"comment_count":"3"' WHEN 7 THEN ',"reply_count":true,"input_metadata":[]' WHEN 8 THEN ',"search_contexts":{{}}'
    WHEN 9 THEN ',"like_count":null,"share_count":0,"search_contexts":[]' WHEN 12 THEN ',"error":{{}}' WHEN 13 THEN ',"error":{{"type":"E"}}' WHEN 14 THEN ',"error":"","failure_category":"unknown_error"'
    WHEN 15 THEN ',"error":null' ELSE concat(',"like_count":', CAST(pos AS {0})) END, ',"author":{{"name":" Ann ', CAST(pos % 9 AS {0}), ' "}},"content":"c","publish_time":"2024-03-0', CAST(1 + pos % 9 AS {0}), '"}}')"""


@query(f""", ex AS (SELECT pos, json({_INTERNAL.format('VARCHAR')}) AS j FROM c),
er AS (SELECT pos, j, json_extract_string(j, '$.collection_status') AS st, CASE WHEN json_type(j, '$.canonical_url') IS NULL THEN 'Internal result missing field(s): canonical_url'
  WHEN json_extract_string(j, '$.platform') <> 'facebook' THEN 'Internal result platform must be facebook.' WHEN json_extract_string(j, '$.collection_status') NOT IN ('success', 'partial', 'failed', 'skipped') THEN 'Internal result collection_status is invalid.'
  WHEN json_type(j, '$.like_count') NOT IN ('NULL', 'UBIGINT', 'BOOLEAN') THEN 'Internal result like_count must be a non-negative integer or null.' WHEN json_type(j, '$.share_count') NOT IN ('NULL', 'UBIGINT', 'BOOLEAN') THEN 'Internal result share_count must be a non-negative integer or null.'
  WHEN json_type(j, '$.comment_count') NOT IN ('NULL', 'UBIGINT', 'BOOLEAN') THEN 'Internal result comment_count must be a non-negative integer or null.' WHEN json_type(j, '$.reply_count') NOT IN ('NULL', 'UBIGINT', 'BOOLEAN') THEN 'Internal result reply_count must be a non-negative integer or null.'
  WHEN json_type(j, '$.input_metadata') <> 'OBJECT' THEN 'Internal result input_metadata must be an object.' WHEN json_type(j, '$.search_contexts') <> 'ARRAY' THEN 'Internal result search_contexts must be a list.'
  WHEN json_extract_string(j, '$.collection_status') = 'failed' AND coalesce(json_extract(j, '$.error'), '""') IN ('""', '{{}}', 'null') AND coalesce(json_extract_string(j, '$.failure_category'), '') = '' THEN 'Failed internal result must include error or failure_category.' END AS error FROM ex)
SELECT pos AS line_number, error, CASE WHEN error IS NULL THEN trim(json_extract_string(j, '$.author.name')) END AS author, CASE WHEN error IS NULL THEN json_extract_string(j, '$.publish_time') END AS publish_time,
  CASE WHEN error IS NULL AND json_type(j, '$.like_count') = 'UBIGINT' THEN CAST(json_extract(j, '$.like_count') AS BIGINT) END AS like_count FROM er WHERE error IS NOT NULL OR st IN ('success', 'partial')""")
def export_results(spark, d):
    """The strict export: final rows, and each rejected line with its rule."""
    lines = views.search(spark, d).select(F.col("pos").alias("line_number"), F.expr(_INTERNAL.format("STRING")).alias("line"))
    out = records.export_results(jsonl.parse_lines(lines, "skip").select("line_number", "v"))
    return out.select("line_number", "error", "author", "publish_time", "like_count")


_FINAL = """concat('{{', CASE WHEN pos % 13 = 1 THEN '"content":"c","author":"a"' WHEN pos % 13 = 2 THEN '"author":null,"content":"c"' ELSE '"author":"a","content":"c"' END, ',"publish_time":"","like_count":',
  CASE WHEN pos % 13 = 3 THEN '-1' WHEN pos % 13 = 4 THEN '"1"' ELSE CAST(pos AS {0}) END, ',"share_count":null,"comment_count":', CASE WHEN pos % 13 = 5 THEN '2.5' ELSE '0' END, ',"comments":',
  CASE pos % 13 WHEN 6 THEN '{{}}' WHEN 7 THEN '[{{"comment_content":"x","comment_author":"","comment_time":""}}]' WHEN 8 THEN '[{{"comment_content":"x","comment_time":1,"comment_author":""}}]'
    WHEN 9 THEN '[{{"comment_content":"x","comment_time":"","comment_author":"y"}}]' ELSE '[]' END, CASE WHEN pos % 13 = 10 THEN ',"more":1' ELSE '' END, '}}')"""


@query("""SELECT pos, CASE pos % 13 WHEN 1 THEN 'Final result fields do not match the fixed Facebook schema.' WHEN 10 THEN 'Final result fields do not match the fixed Facebook schema.' WHEN 2 THEN 'Final result author must be a string.'
  WHEN 3 THEN 'Final result like_count must be a non-negative integer or null.' WHEN 4 THEN 'Final result like_count must be a non-negative integer or null.' WHEN 5 THEN 'Final result comment_count must be a non-negative integer or null.'
  WHEN 6 THEN 'Final result comments must be a list.' WHEN 7 THEN 'Final comment fields do not match the fixed Facebook comment schema.' WHEN 8 THEN 'Final comment comment_time must be a string.' END AS error FROM c""")
def validate_final_lines(spark, d):
    """Final records as lines: exact keys in order, types, signs and comments."""
    lines = views.search(spark, d).select("pos", F.expr(_FINAL.format("STRING")).alias("line"))
    parsed = jsonl.parse_lines(lines, "skip")
    return parsed.select("pos", records.final_line_error(F.col("line"), F.col("v")).alias("error"))


def _count(c: str, words: str) -> str:
    number = "[0-9][0-9,\\s]*(?:\\.[0-9]+)?\\s*[KkMmBb]?"
    text = f"coalesce(nullif(regexp_extract({c}, '(?i)({number})\\s*(?:{words})\\b', 1), ''), nullif(regexp_extract({c}, '(?i)\\b(?:{words})\\s*[:]?\\s*({number})', 1), ''))"
    return f"CAST(CAST(replace(regexp_extract({text}, '([0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) * CASE lower(regexp_extract({text}, '^[^0-9]*[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\s*([KkMmBb])', 1)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END AS BIGINT)"


_WORDS = {"like": "reactions?|likes?", "comment": "comments?", "share": "shares?"}
_BARS = qp._BARS[: qp._BARS.rindex("SELECT rg.page")]
_METRICS = (
    ", mc AS (SELECT page, r, trim(substr(text, 1, 240)) AS text, " + ", ".join(f"{_count('trim(substr(text, 1, 240))', w)} AS {m}_n" for m, w in _WORDS.items()) + " FROM top WHERE r <= 20), "
    + "ms_ AS (SELECT rg.page, bool_or(coalesce(bt.btn = 'like_button', false)) AS like_b, bool_or(coalesce(bt.btn = 'comment_button', false)) AS comment_b, bool_or(coalesce(bt.btn = 'share_button', false)) AS share_b FROM rg LEFT JOIN bt ON bt.page = rg.page GROUP BY rg.page), "
    + "mq AS (SELECT page, coalesce(bool_or(regexp_matches(text, '[0-9]') AND like_n IS NULL AND comment_n IS NULL AND share_n IS NULL), false) AS unassigned, "
    + ", ".join(f"min(r) FILTER ({m}_n IS NOT NULL) AS {m}_r" for m in _WORDS) + " FROM mc GROUP BY page) SELECT ms_.page, "
    + ", ".join(
        f"(SELECT {m}_n FROM mc WHERE mc.page = ms_.page AND r = {m}_r) AS {m}_count, (SELECT text FROM mc WHERE mc.page = ms_.page AND r = {m}_r) AS {m}_text, CASE WHEN {m}_r IS NOT NULL THEN NULL WHEN unassigned THEN 'ambiguous_unassigned_numeric_text' "
        f"WHEN {m}_b THEN 'button_found_but_no_numeric_summary' ELSE 'button_not_found' END AS {m}_reason" for m in _WORDS)
    + " FROM ms_ LEFT JOIN mq USING (page)")


@qp.query(qp._H_POSTS, qp._ATTRS + _BARS + _METRICS)
def metric_details(spark, d):
    """Like, comment and share counts of post pages from the texts around their action bars, or why there is none."""
    e = qp.post_elements(spark, d)
    m = records.metric_details(pp.action_bars(e, qp._ranges(e)))
    return m.select("page", *(c for k in records.METRICS for c in (F.col(f"{k}.count").alias(f"{k}_count"), F.col(f"{k}.raw_text").alias(f"{k}_text"), F.col(f"{k}.rejection_reason").alias(f"{k}_reason"))))


_TALK = """concat_ws(chr(10), CASE WHEN pos % 4 > 0 THEN author END, CASE WHEN pos % 3 = 0 THEN 'Like' END, CASE WHEN pos % 5 = 0 THEN ' 3d ' END, CASE WHEN pos % 2 = 0 THEN '1.2K' END,
  CASE WHEN pos % 7 = 0 THEN 'View more comments' END, CASE WHEN pos % 6 = 0 THEN 'All comments' END, CASE WHEN pos % 8 > 0 THEN snippet END, 'Reply')"""
_TALK_SQL = f""", tk AS (SELECT pos, author, string_split({_TALK}, chr(10)) AS ls FROM c), t0 AS (SELECT pos, author, i, trim(ls[i]) AS line, lower(trim(regexp_replace(ls[i], '\\s+', ' ', 'g'))) AS low FROM tk, unnest(range(1, len(ls) + 1)) AS r(i) WHERE trim(ls[i]) <> ''),
t1 AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS k FROM t0)"""


@query(_TALK_SQL + """, cm AS (SELECT pos, arg_min(line, k) AS content FROM t1 WHERE low <> lower(trim(regexp_replace(coalesce(author, ''), '\\s+', ' ', 'g')))
  AND low NOT IN ('like', 'reply', '3d', '1.2k', 'view more comments', '6w', '+3') AND length(low) > 1 GROUP BY 1),
au AS (SELECT pos, min(k) AS a FROM t1 WHERE trim(coalesce(author, '')) <> '' AND contains(line, trim(author)) GROUP BY 1), be AS (SELECT t1.pos, min(k) AS b FROM t1 LEFT JOIN au USING (pos) WHERE k > coalesce(a, 0) AND low IN ('all comments', 'most relevant') GROUP BY 1),
dl AS (SELECT t1.pos, arg_min(line, k) AS post FROM t1 LEFT JOIN au USING (pos) LEFT JOIN be USING (pos) WHERE k > coalesce(a, 0) AND k < coalesce(b, 100) AND length(low) >= 20 GROUP BY 1)
SELECT c.pos, cm.content, dl.post FROM c LEFT JOIN cm USING (pos) LEFT JOIN dl USING (pos)""")
def content_lines(spark, d):
    """The line that carries a comment's content, and that of a dialog's post."""
    v = views.search(spark, d).withColumn("talk", F.expr(_TALK))
    return v.select("pos", posts.comment_line(posts.lines_of(F.col("talk")), F.col("author")).alias("content"), posts.dialog_line(F.col("talk"), F.col("author")).alias("post"))


_NAMES = """CASE pos % 13 WHEN 0 THEN 'Today' WHEN 1 THEN '10:45 pm' WHEN 2 THEN 'May 5' WHEN 3 THEN 'Maya 5' WHEN 4 THEN concat(CAST(pos AS {0}), ' mo') WHEN 5 THEN '1,204 reactions' WHEN 6 THEN '#x' WHEN 7 THEN '+12' WHEN 8 THEN '  ' WHEN 9 THEN 'Most   relevant'
  WHEN 10 THEN '???' ELSE author END"""


@query(f""", nm AS (SELECT pos, trim(regexp_replace({_NAMES.format('VARCHAR')}, '\\s+', ' ', 'g')) AS n FROM c)
SELECT pos, coalesce(n <> '' AND lower(n) NOT IN ('join', 'like', 'comment', 'share', 'most relevant', 'today') AND NOT regexp_matches(n, '^#|^\\+[0-9]+$|^[0-9]+ ?(mo|w)$|reactions$|comments$|^[0-9]+:[0-9]+') AND NOT regexp_matches(n, '^May( |$)')
  AND regexp_matches(n, '[A-Za-z0-9]'), false) AS valid FROM nm""")
def valid_page_authors(spark, d):
    return views.search(spark, d).select("pos", posts.valid_page_author(F.expr(_NAMES.format("STRING"))).alias("valid"))


_META = "CASE pos % 5 WHEN 0 THEN 'Anna Bell on Facebook' WHEN 1 THEN ' River walks ' WHEN 2 THEN 'Facebook' WHEN 3 THEN 'Log in or sign up to view' ELSE NULL END"


@query(f""", me AS (SELECT pos, {_META} AS t, CASE WHEN pos % 7 = 0 THEN NULL ELSE snippet END AS s FROM c)
SELECT pos, CASE WHEN pos % 5 = 3 THEN false WHEN t IS NULL AND s IS NULL THEN false ELSE true END AS specific, CASE pos % 5 WHEN 0 THEN 'Anna Bell' WHEN 1 THEN 'River walks' WHEN 3 THEN 'Log in or sign up to view' END AS author FROM me""")
def page_metadata_facts(spark, d):
    v = views.search(spark, d).select("pos", F.expr(_META).alias("t"), F.when(F.col("pos") % 7 != 0, F.col("snippet")).alias("s"))
    return v.select("pos", posts.metadata_is_specific(F.col("t"), F.col("s")).alias("specific"), posts.metadata_author(F.col("t")).alias("author"))


@query("""SELECT keyword, user_id, CASE WHEN count(url) = 0 THEN 'zero_x_search_results' WHEN count(DISTINCT post_id) FILTER (platform = 'x') = 0 THEN 'x_search_results_without_supported_post_urls'
  WHEN count(*) FILTER (platform = 'x' AND status = 'failed') > 0 THEN 'x_extraction_failed_for_some_posts' END AS warning,
  CASE min(pos) % 4 WHEN 0 THEN 'google_pse_request_failed' WHEN 1 THEN 'no_supported_post_urls' ELSE 'platform_failed' END AS reason FROM c GROUP BY 1, 2""")
def x_warnings(spark, d):
    x = F.col("platform") == "x"
    a = classified(spark, d).groupBy("keyword", "user_id").agg(F.count("url").alias("n"), F.count_distinct(F.when(x, F.col("post_id"))).alias("u"), F.count(F.when(x & (F.col("status") == "failed"), 1)).alias("f"), F.min("pos").alias("pos"))
    message = F.expr("CASE pos % 4 WHEN 0 THEN 'All X search keywords failed' WHEN 1 THEN 'No supported posts' WHEN 2 THEN 'boom' END")
    return a.select("keyword", "user_id", posts.x_warning(F.col("n"), F.col("u"), F.col("f")).alias("warning"), posts.failure_reason(F.lit("x"), message).alias("reason"))
