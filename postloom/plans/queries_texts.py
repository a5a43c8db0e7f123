"""Queries of URL, count, time and text functions over URLs of search results, lines of documents and dates of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import numbers as num
from postloom.functions import text as txt
from postloom.functions import times, url
from postloom.plans import views
from postloom.plans.queries import query
from postloom.plans.queries_runs import _LINES_SQL, _line_lists, _lines

#: Profile, member and group URLs of the search view's users and groups, beside the URLs of the results.
_LINKS_SQL = """, links AS (SELECT pos, url AS link FROM c WHERE url IS NOT NULL UNION ALL SELECT pos, CASE pos % 6 WHEN 0 THEN 'https://www.facebook.com/groups/g' || (pos % 31) || '/user/' || user_id || '/?x=1'
  WHEN 1 THEN 'https://m.facebook.com/user' || user_id || '/' WHEN 2 THEN 'https://www.facebook.com/login/?next=' || pos WHEN 3 THEN 'https://www.facebook.com/watch/?v=' || pos
  WHEN 4 THEN 'https://www.facebook.com/groups/g' || (pos % 31) || '?comment_id=' || pos ELSE 'https://www.facebook.com/groups/g' || (pos % 31) || '/posts/' || pos || '?a=1&comment_id=' || user_id || '#x' END FROM c),
l AS (SELECT pos, link, lower(regexp_extract(link, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM links) """


def _links(spark, d):
    v = views.search(spark, d)
    more = F.expr("""CASE pos % 6 WHEN 0 THEN concat('https://www.facebook.com/groups/g', pos % 31, '/user/', user_id, '/?x=1')
      WHEN 1 THEN concat('https://m.facebook.com/user', user_id, '/') WHEN 2 THEN concat('https://www.facebook.com/login/?next=', pos) WHEN 3 THEN concat('https://www.facebook.com/watch/?v=', pos)
      WHEN 4 THEN concat('https://www.facebook.com/groups/g', pos % 31, '?comment_id=', pos) ELSE concat('https://www.facebook.com/groups/g', pos % 31, '/posts/', pos, '?a=1&comment_id=', user_id, '#x') END""")
    both = v.where("url is not null").select("pos", F.col("url").alias("link")).union(v.select("pos", more))
    return both.select("pos", "link", F.lower(F.regexp_extract("link", "^https?://([^/?#]+)", 1)).alias("host"),
                       F.regexp_extract("link", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))


_WORDS = ", ".join(f"'{w}'" for w in sorted(url.RESERVED_PROFILE_WORDS))


@query(_LINKS_SQL + f"""SELECT pos, link, regexp_matches(path, '^/?groups/[^/]+/user/[^/]+') AS member,
  host IN ('', 'facebook.com', 'www.facebook.com', 'm.facebook.com') AND (regexp_matches(path, '^/?groups/[^/]+/user/[^/]+')
    OR (regexp_extract(path, '^/*([^/]*)', 1) <> '' AND regexp_extract(path, '^/*([^/]*)', 1) NOT IN ({_WORDS}))) AS profile,
  regexp_replace('https://www.facebook.com/' || CASE WHEN regexp_matches(path, '^/?groups/[^/]+/user/[^/]+') THEN regexp_extract(path, '(groups/[^/]+/user/[^/]+)', 1)
    ELSE trim(path, '/') END, '/+$', '') AS normalized, path = '/login' OR starts_with(path, '/login/') AS login FROM l""")
def profile_urls(spark, d):
    path = F.col("path")
    return _links(spark, d).select("pos", "link", url.is_group_user_path(path).alias("member"), url.is_profile_url(F.col("host"), path).alias("profile"),
                                   url.normalize_profile_url(path).alias("normalized"), url.is_login_path(path).alias("login"))


_GROUP_WORDS = ", ".join(f"'{w}'" for w in sorted(url.RESERVED_GROUP_WORDS))


@query(_LINKS_SQL + f"""SELECT pos, link, CASE WHEN contains(link, '/groups/') THEN 'https://www.facebook.com/groups/' || split_part(split_part(split_part(split_part(link, '/groups/', 2), '/', 1), '?', 1), '#', 1) END AS group_root,
  CASE WHEN contains(link, '/groups/') AND split_part(split_part(split_part(split_part(link, '/groups/', 2), '/', 2), '?', 1), '#', 1) NOT IN ({_GROUP_WORDS})
    THEN 'https://www.facebook.com/groups/' || split_part(split_part(split_part(split_part(link, '/groups/', 2), '/', 1), '?', 1), '#', 1) END AS strict_root FROM l""")
def group_urls(spark, d):
    u = F.col("link")
    return _links(spark, d).select("pos", "link", url.group_url(u).alias("group_root"), url.group_url(u, strict=True).alias("strict_root"))


@query(_LINKS_SQL + """SELECT pos, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN rtrim(split_part(split_part(link, '?', 1), '#', 1), '/') END AS plain FROM l""")
def strip_query_fragment(spark, d):
    return _links(spark, d).select("pos", "link", url.strip_query_fragment(F.col("link")).alias("plain"))


@query(_LINKS_SQL + """SELECT pos, link, nullif(split_part(split_part(split_part(replace(link, '?comment_id=', '&comment_id='), '&comment_id=', 2), '&', 1), '#', 1), '') AS comment FROM l""")
def extract_comment_id(spark, d):
    return _links(spark, d).select("pos", "link", url.comment_id(F.col("link")).alias("comment"))


@query("""SELECT pos, coalesce(TRY_CAST(replace(regexp_extract(a, '([0-9]+(,[0-9]{3})*)', 1), ',', '') AS BIGINT), TRY_CAST(regexp_extract(b, '([0-9]+)', 1) AS BIGINT)) AS metric
  FROM (SELECT pos, CASE WHEN metric IN ('1,234 likes', 'no count', '') THEN metric END AS a, snippet AS b FROM c) t""")
def x_metric(spark, d):
    v = views.search(spark, d)
    first = F.when(F.col("metric").isin("1,234 likes", "no count", ""), F.col("metric"))
    return v.select("pos", num.first_metric(first, F.col("snippet")).alias("metric"))


@query(_LINES_SQL + f"""SELECT id, count(*) AS lines, count(*) FILTER (low IN ('just now', 'now') OR regexp_matches(low, '^([0-9]+\\s*)?({txt.TIME_UNITS}|y|yr|yrs|year|years)$')) AS relative FROM f GROUP BY 1""")
def is_relative_text(spark, d):
    return _lines(spark, d).groupBy("id").agg(F.count("*").alias("lines"), F.count(F.when(times.is_relative(F.col("x")), 1)).alias("relative"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T16:05'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def parse_abs_fb_date(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "MMMM d, yyyy")).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.lit("posted on "), F.date_format(day, "MMM d, yyyy"), F.lit("  by A"))).otherwise(
        F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(" at 4:05 PM")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", times.absolute_date_text(shown).alias("iso"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 0 HOUR WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + INTERVAL 2 HOUR END AS at FROM orders""")
def mysql_datetime(spark, d):
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    shown = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T04:00:00+02:00"))).otherwise(F.concat(day, F.lit(" soon")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", times.store_datetime(shown).alias("at"))


@query(_LINES_SQL + """SELECT id, sha256(string_agg(coalesce(nullif(left(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), 80), ''), 'unknown'), '/' ORDER BY x)) AS names FROM f WHERE x IS NOT NULL GROUP BY 1""")
def safe_filename(spark, d):
    """Lines stay one row a text until their names are joined. Texts are dealt by number: their bytes alone would fill a few tasks."""
    lists = _line_lists(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    names = F.transform(F.sort_array(F.flatten(F.collect_list("xs"))), lambda x: txt.safe_filename(x))
    return lists.groupBy("id").agg(F.sha2(F.array_join(names, "/"), 256).alias("names"))


@query(_LINES_SQL + """SELECT id, count(*) FILTER (regexp_matches(low, 'turned off commenting for this post|comments are turned off|commenting has been turned off')) AS disabled,
  count(*) FILTER (regexp_matches(low, 'no comments yet|be the first to comment|no comments') AND NOT regexp_matches(low, 'turned off commenting for this post|comments are turned off|commenting has been turned off')) AS none
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN low || ' No comments yet'  WHEN id % 7 = 0 THEN low || ' Comments are turned off' ELSE low END AS x0, lower(x0) AS low FROM (SELECT id, low FROM f) g) h GROUP BY 1""")
def comment_empty_state(spark, d):
    x = F.coalesce(F.col("x"), F.lit(None).cast("string"))
    shown = F.when(F.col("id") % 3 == 0, F.concat(x, F.lit(" No comments yet"))).when(F.col("id") % 7 == 0, F.concat(x, F.lit(" Comments are turned off"))).otherwise(x)
    state = txt.comment_empty_state(shown)
    n = lambda s: F.count(F.when(state == s, 1))
    return _lines(spark, d).groupBy("id").agg(n("disabled").alias("disabled"), n("none").alias("none"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS clean, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\f\\v]+(\\r\\n|\\r|\\n|$)', '\\1', 'g'), chr(9) || chr(10) || chr(13) || ' ')) AS lines
  FROM documents""")
def clean_texts(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(txt.collapse(t), 256).alias("clean"), F.sha2(txt.preserve_lines(t), 256).alias("lines"))


@query("SELECT pos, CASE WHEN platform IS NOT NULL THEN 'yes' ELSE 'no' END AS cell FROM c")
def format_cell(spark, d):
    return url.classify(views.search(spark, d)).select("pos", txt.format_cell(F.col("platform").isNotNull()).alias("cell"))
