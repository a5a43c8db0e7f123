"""Queries over runs: batches, summaries, attempts, paging, imports, validation and the texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import numbers as num
from postloom.functions import text as txt
from postloom.functions import times, url
from postloom.operators import relational as rel
from postloom.plans import normalize, views
from postloom.plans.queries import classified, query


def _lit_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("SELECT pos, status FROM c WHERE status IN ('success', 'partial')")
def status_filter(spark, d):
    return views.search(spark, d).where(F.col("status").isin("success", "partial")).select("pos", "status")


@query("SELECT pos, post_id FROM (SELECT * FROM c WHERE platform = 'x' QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY pos) = 1) t ORDER BY pos LIMIT 150")
def dedupe_x_batch(spark, d):
    x = classified(spark, d).where("platform = 'x'").select("pos", "post_id")
    return rel.dedupe_up_to(x, ["post_id"], "pos", 150)


@query("SELECT keyword, count(*) FILTER (platform = 'x') AS supported, count(DISTINCT CASE WHEN platform = 'x' THEN post_id END) AS unique_posts FROM c GROUP BY 1")
def dedupe_x_results(spark, d):
    x = F.col("platform") == "x"
    return classified(spark, d).groupBy("keyword").agg(F.count(F.when(x, 1)).alias("supported"), F.count_distinct(F.when(x, F.col("post_id"))).alias("unique_posts"))


@query("SELECT pos, url FROM c WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY trim(url) ORDER BY pos) = 1")
def dedupe_urls(spark, d):
    v = views.search(spark, d).select("pos", "url", F.trim("url").alias("plain")).where("plain <> ''")
    return rel.dedupe_first(v, ["plain"], "pos").select("pos", "url")


@query("SELECT user_id % 9 AS template, pos, platform, post_id FROM c WHERE platform = 'facebook' QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY user_id % 9, pos) = 1")
def dedupe_preflight(spark, d):
    v = classified(spark, d).where("platform = 'facebook'").select((F.col("user_id") % 9).alias("template"), "pos", "platform", "post_id")
    v = v.withColumn("at", F.struct("template", "pos"))
    return rel.dedupe_first(v, ["platform", "post_id"], "at").drop("at")


_WORDS_SQL = """, w AS (SELECT pos, list_transform(string_split(concat_ws(',', CASE WHEN pos % 3 = 0 THEN ' X' END, CASE WHEN pos % 2 = 0 THEN 'Facebook ' END, '', CASE WHEN pos % 5 = 0 THEN 'x' END,
  CASE WHEN pos % 7 = 0 THEN 'other' END), ','), lambda p: lower(trim(p))) AS words FROM c),
p AS (SELECT pos, CASE WHEN list_contains(words, 'other') THEN NULL ELSE concat_ws('>', CASE WHEN pos % 3 = 0 THEN 'x' END, CASE WHEN pos % 2 = 0 THEN 'facebook' END,
  CASE WHEN pos % 3 > 0 AND pos % 5 = 0 THEN 'x' END) END AS platforms FROM w)"""


def _platforms(spark, d):
    words = F.expr("""split(concat_ws(',', CASE WHEN pos % 3 = 0 THEN ' X' END, CASE WHEN pos % 2 = 0 THEN 'Facebook ' END, '', CASE WHEN pos % 5 = 0 THEN 'x' END,
      CASE WHEN pos % 7 = 0 THEN 'other' END), ',')""")
    return views.search(spark, d).select("pos", rel.platforms_in_order(words).alias("platforms"))


@query(_WORDS_SQL + " SELECT * FROM p")
def dedupe_platforms(spark, d):
    return _platforms(spark, d).select("pos", F.array_join("platforms", ">").alias("platforms"))


@query(_WORDS_SQL + """ SELECT pos, concat_ws('>', CASE WHEN contains(platforms, 'facebook') THEN 'facebook' END, CASE WHEN regexp_matches(platforms, '(^|>)x') THEN 'x' END) AS ordered
  FROM p WHERE platforms IS NOT NULL""")
def platform_order(spark, d):
    wanted = F.array(F.lit("facebook"))
    return _platforms(spark, d).where("platforms is not null").select("pos", F.array_join(rel.ordered_platforms(wanted, F.col("platforms")), ">").alias("ordered"))


@query(""", r AS (SELECT CASE WHEN status = 'skipped' THEN CASE WHEN platform IS NULL THEN 'unsupported_url' ELSE 'resume_already_processed' END ELSE error_type END AS reason FROM c)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def failure_types(spark, d):
    skip = F.when(F.col("platform").isNull(), "unsupported_url").otherwise("resume_already_processed")
    reason = F.when(F.col("status") == "skipped", skip).otherwise(F.col("error_type"))
    return classified(spark, d).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT keyword) AS keyword_count, count(DISTINCT keyword) FILTER (url IS NOT NULL) AS keyword_success_count, count(*) AS search_result_count,
  count(*) FILTER (platform = 'x') AS supported_x_post_url_count, count(DISTINCT CASE WHEN platform = 'x' THEN post_id END) AS unique_url_count,
  count(*) FILTER (platform = 'x' AND status IN ('success', 'partial')) AS extracted_success_count, count(*) FILTER (platform = 'x' AND status = 'failed') AS failed_count,
  count(*) FILTER (platform = 'x' AND status = 'skipped') AS skipped_count, count(*) FILTER (platform = 'x') > 0 AS batch_started FROM c""")
def x_summary(spark, d):
    x, s = F.col("platform") == "x", F.col("status")
    n = lambda c: F.count(F.when(c, 1))
    return classified(spark, d).agg(
        F.count_distinct("keyword").alias("keyword_count"), F.count_distinct(F.when(F.col("url").isNotNull(), F.col("keyword"))).alias("keyword_success_count"),
        F.count("*").alias("search_result_count"), n(x).alias("supported_x_post_url_count"), F.count_distinct(F.when(x, F.col("post_id"))).alias("unique_url_count"),
        n(x & s.isin("success", "partial")).alias("extracted_success_count"), n(x & (s == "failed")).alias("failed_count"),
        n(x & (s == "skipped")).alias("skipped_count"), (n(x) > 0).alias("batch_started"))


@query("""SELECT p.platform, CASE WHEN count(k.pos) = 0 THEN 'no_candidates' ELSE 'completed' END AS status, count(k.pos) AS accepted_count,
  count(*) FILTER (k.status IN ('success', 'partial')) + count(*) FILTER (k.status = 'failed') + count(*) FILTER (k.status = 'skipped') AS attempted_count,
  count(*) FILTER (k.status IN ('success', 'partial')) AS success_count, count(*) FILTER (k.status = 'failed') AS failed_count, count(*) FILTER (k.status = 'skipped') AS skipped_count,
  CASE WHEN count(k.pos) = 0 THEN 'no_supported_post_urls' END AS warning
  FROM (VALUES ('x'), ('facebook'), ('threads')) p(platform) LEFT JOIN c k ON k.platform = p.platform GROUP BY 1""")
def collect_summary(spark, d):
    s = F.col("status")
    n = lambda c: F.count(F.when(c, 1))
    done = classified(spark, d).where("platform is not null").groupBy("platform").agg(
        F.count("*").alias("accepted_count"), n(s.isin("success", "partial")).alias("success_count"), n(s == "failed").alias("failed_count"), n(s == "skipped").alias("skipped_count"))
    asked = spark.createDataFrame([("x",), ("facebook",), ("threads",)], "platform string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = F.col("accepted_count") == 0
    counts = ("accepted_count", "success_count", "failed_count", "skipped_count")
    return asked.join(done, "platform", "left").select("platform", *map(zero, counts)).select(
        "platform", F.when(none, "no_candidates").otherwise("completed").alias("status"), *counts,
        (F.col("success_count") + F.col("failed_count") + F.col("skipped_count")).alias("attempted_count"), F.when(none, "no_supported_post_urls").alias("warning"))


@query(""", kinds AS (SELECT CASE WHEN p = '/login' OR p LIKE '/login/%' THEN 'login' WHEN p LIKE '/watch/%' OR (p = '/watch' AND regexp_matches(q, '(^|&)v=.')) THEN 'watch'
  WHEN contains(p, '/videos/') THEN 'video' WHEN p LIKE '/reel/%' OR p LIKE '/reels/%' THEN 'reel' WHEN contains(p, '/groups/') THEN 'group'
  WHEN contains(p, '/posts/') THEN 'standard_post' WHEN regexp_matches(p, '/(story|permalink)\\.php$') THEN 'story_or_permalink' ELSE 'unknown' END AS kind
  FROM (SELECT lower(path) AS p, q FROM m WHERE host <> '' AND (status = 'failed' OR NOT is_fb)) t) SELECT kind, count(*) AS n FROM kinds GROUP BY 1""")
def rejected_type_breakdown(spark, d):
    v = url.with_url_parts(views.search(spark, d), "url").where("_scheme in ('http', 'https') and _host <> ''")
    fb = F.col("_host").isin("facebook.com", "www.facebook.com", "m.facebook.com", "web.facebook.com")
    v = v.where((F.col("status") == "failed") | ~fb)
    return v.groupBy(url.destination_type(F.col("_path"), F.col("_query")).alias("kind")).agg(F.count("*").alias("n"))


_PAGES_SQL = """, g AS (SELECT keyword || '-' || (pos // 8) AS keyword, pos % 8 + 1 AS page_number, CAST(10 AS BIGINT) AS requested, CASE WHEN pos % 11 = 3 THEN pos % 10 ELSE 10 END AS received,
  pos % 13 <> 5 AS has_next, pos % 17 = 6 AS failed FROM c) """


def _pages(spark, d) -> DataFrame:
    return views.search(spark, d).selectExpr(
        "concat(keyword, '-', pos div 8) AS keyword", "pos % 8 + 1 AS page_number", "10L AS requested", "CASE WHEN pos % 11 = 3 THEN pos % 10 ELSE 10 END AS received",
        "pos % 13 <> 5 AS has_next", "pos % 17 = 6 AS failed")


@query(_PAGES_SQL + "SELECT keyword, page_number, sum(requested)::BIGINT AS requested, sum(received)::BIGINT AS received FROM g GROUP BY 1, 2")
def page_log_stats(spark, d):
    return _pages(spark, d).groupBy("keyword", "page_number").agg(F.sum("requested").alias("requested"), F.sum("received").alias("received"))


@query(_PAGES_SQL + """SELECT keyword, page_number, received FROM g a WHERE NOT failed AND NOT EXISTS (SELECT 1 FROM g b WHERE b.keyword = a.keyword AND b.page_number < a.page_number
  AND (b.failed OR NOT b.has_next OR b.received < b.requested))""")
def page_plan_limit(spark, d):
    return rel.stop_paging(_pages(spark, d)).select("keyword", "page_number", "received")


_TRIES_SQL = """, a AS (SELECT user_id AS item, pos, error_type IS NOT NULL AS failed, error_message FROM c),
b AS (SELECT *, failed AND coalesce(regexp_matches(lower(error_message), 'timeout|timed out|page crash|navigation'), false) AS again FROM a),
e AS (SELECT *, row_number() OVER w AS attempt, coalesce(max(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM b WINDOW w AS (PARTITION BY item ORDER BY pos)) """


@query(_TRIES_SQL + "SELECT item, pos, attempt FROM e WHERE ended = 0 AND attempt <= 2")
def attempt_number(spark, d):
    log = views.search(spark, d).select(F.col("user_id").alias("item"), "pos", F.col("error_type").isNotNull().alias("failed"), "error_type", "error_message")
    out = rel.attempts(log, "item", "pos", txt.try_again(F.col("error_type"), F.col("error_message")), 2)
    return out.select("item", "pos", F.col("attempt").cast("bigint").alias("attempt"))


@query("""SELECT pos, CASE WHEN pos % 6 = 0 THEN false WHEN pos % 6 = 1 THEN true ELSE coalesce(regexp_matches(lower(error_message), 'timeout|timed out|page crash|navigation'), false) END AS again FROM c""")
def is_retryable_exc(spark, d):
    kind = F.expr("CASE pos % 6 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'PlaywrightError' WHEN 2 THEN 'OSError' END")
    return views.search(spark, d).select("pos", txt.try_again(kind, F.col("error_message")).alias("again"))


@query("SELECT user_id, arg_max(v, struct_pack(n := length(v), p := -pos)) AS longest FROM (SELECT user_id, pos, coalesce(title, snippet) AS v FROM c) t GROUP BY 1")
def longest_text(spark, d):
    v = views.search(spark, d).select("user_id", "pos", F.coalesce("title", "snippet").alias("v"))
    return v.groupBy("user_id").agg(F.max_by("v", F.struct(F.length("v"), -F.col("pos"))).alias("longest"))


@query("""SELECT pos, accepted FROM (SELECT pos, platform = 'facebook' AND status <> 'failed' AS ok, coalesce(ok, false) AS accepted, row_number() OVER (PARTITION BY coalesce(ok, false) ORDER BY pos) AS n FROM c) t
  WHERE n <= CASE WHEN accepted THEN 50 ELSE 20 END""")
def reject_cap(spark, d):
    ok = F.coalesce((F.col("platform") == "facebook") & (F.col("status") != "failed"), F.lit(False))
    return rel.first_per_flag(classified(spark, d).select("pos", ok.alias("accepted")), "accepted", "pos", {True: 50, False: 20})


@query("""SELECT pos, platform, post_id, like_count AS reposts, NULL::VARCHAR AS group_name FROM c WHERE platform = 'x' UNION ALL
  SELECT pos, platform, post_id, NULL, context_type FROM c WHERE platform = 'facebook'""")
def append_platforms(spark, d):
    c = classified(spark, d)
    x = c.where("platform = 'x'").select("pos", "platform", "post_id", F.col("like_count").alias("reposts"))
    fb = c.where("platform = 'facebook'").select("pos", "platform", "post_id", F.col("context_type").alias("group_name"))
    return x.unionByName(fb, allowMissingColumns=True)


@query("SELECT pos, coalesce(canonical_url = trim(url) OR post_id = CAST(5000 + pos % 499 AS VARCHAR), false) AS met FROM c")
def identity_intersect(spark, d):
    own = F.array_compact(F.array("canonical_url", "post_id"))
    seen = F.array_compact(F.array(F.trim("url"), (5000 + F.col("pos") % 499).cast("string")))
    return classified(spark, d).select("pos", F.arrays_overlap(own, seen).alias("met"))


@query("""SELECT keyword, user_id, i AS place, url FROM (SELECT keyword, user_id, pos, url, row_number() OVER (PARTITION BY keyword, user_id ORDER BY pos) AS i FROM c) t""")
def keyword_result_flatten(spark, d):
    payload = views.search(spark, d).groupBy("keyword", "user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("results"))
    return payload.select("keyword", "user_id", F.posexplode("results").alias("i", "r")).select("keyword", "user_id", (F.col("i") + 1).cast("bigint").alias("place"), "r.url")


_RUNS_SQL = """, o AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS run_id FROM (SELECT DISTINCT user_id FROM c WHERE half = 'old') t),
n AS (SELECT user_id, row_number() OVER (ORDER BY user_id) + (SELECT coalesce(max(run_id), 0) FROM o) AS run_id FROM (SELECT DISTINCT user_id FROM c WHERE half = 'new' AND platform IS NOT NULL) t) """


def _runs(spark, d):
    v = classified(spark, d)
    old = rel.with_ids(v.where("half = 'old'").select("user_id").distinct(), "user_id", "run_id")
    return v, rel.with_ids(v.where("half = 'new' and platform is not null").select("user_id").distinct(), "user_id", "run_id", old)


@query(_RUNS_SQL + "SELECT * FROM n")
def run_insert(spark, d):
    return _runs(spark, d)[1]


@query(_RUNS_SQL + "SELECT c.pos, n.run_id AS collection_run_id FROM c JOIN n USING (user_id) WHERE half = 'new' AND platform IS NOT NULL")
def post_run_fk(spark, d):
    v, runs = _runs(spark, d)
    return v.where("half = 'new' and platform is not null").join(runs, "user_id").select("pos", F.col("run_id").alias("collection_run_id"))


@query(""", a AS (SELECT pos, nullif(trim(author), '') AS name FROM c), f AS (SELECT name, min(pos) AS first FROM a WHERE name IS NOT NULL GROUP BY 1),
i AS (SELECT name, row_number() OVER (ORDER BY first) AS author_id FROM f) SELECT a.pos, i.author_id FROM a LEFT JOIN i USING (name)""")
def post_author_fk(spark, d):
    v = views.search(spark, d).select("pos", F.struct(F.lit(None).cast("string").alias("profile_url"), F.lit(None).cast("string").alias("handle"),
                                                      F.col("author").alias("name"), F.lit("unknown").alias("type")).alias("author"))
    v = v.select("pos", normalize.author_key(F.col("author")).alias("key"))
    known = rel.with_ids(v.where("key is not null").groupBy("key").agg(F.min("pos").alias("first")), "first", "author_id")
    return v.join(known.select("key", "author_id"), "key", "left").select("pos", "author_id")


@query("""SELECT pos, CASE WHEN author IS NULL THEN 'Final result author must be a string.' WHEN title IS NULL THEN 'Final result content must be a string.'
  WHEN time_text IS NULL THEN 'Final result publish_time must be a string.' WHEN like_count < 0 THEN 'Final result like_count must be a non-negative integer or null.'
  WHEN error_type IS NULL AND pos % 4 = 0 THEN 'Final comment comment_author must be a string.' END AS error FROM c""")
def validate_final(spark, d):
    v = views.search(spark, d)
    comments = F.array(F.struct(F.col("snippet").alias("comment_content"), F.lit("").alias("comment_time"),
                                F.when(F.col("error_type").isNotNull() | (F.col("pos") % 4 != 0), "A").alias("comment_author")))
    texts = {"author": F.col("author"), "content": F.col("title"), "publish_time": F.col("time_text")}
    return v.select("pos", normalize.final_error(texts, {"like_count": F.col("like_count")}, comments).alias("error"))


@query("""SELECT pos, CASE WHEN a OR c OR t THEN CASE WHEN page AND ((a AND c AND t) OR g) THEN 'success' ELSE 'partial' END END AS status,
  CASE WHEN (a OR c OR t) AND NOT (page AND ((a AND c AND t) OR g)) THEN 'Missing core field(s): ' || concat_ws(', ', CASE WHEN NOT a THEN 'author' END, CASE WHEN NOT c THEN 'content' END,
    CASE WHEN NOT t AND NOT g THEN 'publish_time' END) || '.' END AS error
  FROM (SELECT pos, coalesce(author <> '', false) AS a, coalesce(title <> '', false) AS c, coalesce(time_text <> '', false) AS t, pos % 5 > 0 AS page,
    coalesce(context_type = 'group', false) AND coalesce(title <> '', false) AS g FROM c) x""")
def extraction_status(spark, d):
    group = F.coalesce(F.col("context_type") == "group", F.lit(False))
    out = txt.extraction_status(F.col("pos") % 5 > 0, F.col("author"), F.col("title"), F.col("time_text"), group)
    return classified(spark, d).select("pos", out.alias("s")).select("pos", "s.status", "s.error")


@query("SELECT pos, coalesce(author <> '' OR title <> '' OR time_text <> '', false) AS any_field FROM c")
def has_any_core_field(spark, d):
    given = lambda k: F.coalesce(F.col(k) != "", F.lit(False))
    return views.search(spark, d).select("pos", (given("author") | given("title") | given("time_text")).alias("any_field"))


@query("SELECT pos, pos % 10 = 0 OR status IN ('failed', 'partial') AS save FROM c")
def should_save_bundle(spark, d):
    return views.search(spark, d).select("pos", ((F.col("pos") % 10 == 0) | F.col("status").isin("failed", "partial")).alias("save"))


@query("SELECT pos, coalesce(contains(url, post_id) AND (contains(url, '/posts/') OR contains(url, 'story_fbid=') OR contains(url, 'permalink.php')), false) AS single FROM c")
def is_single_permalink(spark, d):
    return classified(spark, d).select("pos", txt.single_permalink(F.col("url"), F.col("post_id")).alias("single"))


#: Lines of real variety: of documents and conversations, and each phrase of the page in some of them.
_LINES_SQL = """, l AS (SELECT CAST(doc_id AS BIGINT) AS id, x FROM documents, unnest(string_split(text, chr(10))) AS u(x) UNION ALL
  SELECT CAST(pos AS BIGINT), CASE pos % 8 WHEN 0 THEN author WHEN 1 THEN ' View  MORE comments ' || pos WHEN 2 THEN metric WHEN 3 THEN time_text WHEN 4 THEN 'Reply' WHEN 5 THEN 'Shared with  Public group'
    WHEN 6 THEN 'view previous comments' ELSE 'x' END FROM c),
f AS (SELECT id, x, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS low FROM l) """


def _line_lists(spark: SparkSession, d: str) -> DataFrame:
    """(id, xs): the lines of every text, and of every event one, as lists; null lines and texts are left out."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.split("text", "\n").alias("xs"))
    return docs.union(_event_lines(spark, d).where("x is not null").select("id", F.array("x").alias("xs")))


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    return views.search(spark, d).selectExpr("CAST(pos AS BIGINT) AS id", """CASE pos % 8 WHEN 0 THEN author WHEN 1 THEN concat(' View  MORE comments ', pos) WHEN 2 THEN metric
      WHEN 3 THEN time_text WHEN 4 THEN 'Reply' WHEN 5 THEN 'Shared with  Public group' WHEN 6 THEN 'view previous comments' ELSE 'x' END AS x""")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("id"), F.explode(F.split("text", "\n")).alias("x"))
    return docs.union(_event_lines(spark, d))


@query(_LINES_SQL + "SELECT id, count(*) AS lines, count(*) FILTER (regexp_matches(low, '" + "|".join(txt.EXPAND_COMMENTS) + "')) AS hits FROM f GROUP BY 1")
def is_comment_expand_text(spark, d):
    hit = txt.expands_comments(F.col("x"))
    return _lines(spark, d).groupBy("id").agg(F.count("*").alias("lines"), F.count(F.when(hit, 1)).alias("hits"))


@query(_LINES_SQL + f"""SELECT id, count(*) AS lines, count(*) FILTER (x IS NULL OR low IN ('', 'just now', 'now', {_lit_list(txt.COMMENT_WORDS)})
  OR regexp_matches(low, '^([0-9]+\\s*)?({txt.TIME_UNITS}|y|yr|yrs|year|years)$')) AS bad FROM f GROUP BY 1""")
def invalid_comment_author(spark, d):
    bad = txt.no_comment_author(F.col("x"), F.coalesce(times.is_relative(F.col("x")), F.lit(False)))
    return _lines(spark, d).groupBy("id").agg(F.count("*").alias("lines"), F.count(F.when(bad, 1)).alias("bad"))


@query(_LINES_SQL + f"""SELECT id, count(*) AS lines, count(*) FILTER (x IS NULL OR length(low) <= 1 OR low IN ({_lit_list(txt.DIALOG_WORDS)})
  OR (length(low) <= 8 AND regexp_matches(low, '[0-9]'))) AS noise FROM f GROUP BY 1""")
def dialog_noise(spark, d):
    noise = txt.dialog_noise(F.col("x"), num.parse_metric_count(F.lower(txt.collapse(F.col("x")))))
    return _lines(spark, d).groupBy("id").agg(F.count("*").alias("lines"), F.count(F.when(noise, 1)).alias("noise"))


@query("""SELECT pos, CASE WHEN author IN ('Anna Bell', 'Maya') THEN author END AS name FROM c""")
def author_from_label(spark, d):
    label = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("ACTIONS for this post by  "), F.col("author"))).otherwise(F.concat(F.lit(" "), F.col("author"), F.lit("'s Post ")))
    return views.search(spark, d).select("pos", txt.author_of_label(label).alias("name"))
