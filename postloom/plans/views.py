"""Input views derived from the star-schema tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "CAST(1000 + event_id % 997 AS STRING)"
_FB = "CAST(5000 + event_id % 499 AS STRING)"
_N = "CAST(event_id % {} AS STRING)".format

SEARCH = {
    "pos": "event_id",
    "keyword": "event_type",
    "user_id": "user_id",
    "url": f"""CASE event_id % 10
        WHEN 0 THEN concat('https://twitter.com/user', {_N(97)}, '/status/', {_ID}, '?s=20')
        WHEN 1 THEN concat('https://x.com/i/web/status/', {_ID})
        WHEN 2 THEN concat('https://m.facebook.com/page', {_N(53)}, '/posts/', {_FB}, '?ref=share')
        WHEN 3 THEN concat('https://www.facebook.com/groups/g', {_N(31)}, '/permalink/', {_FB}, '/?comment_id=7#top')
        WHEN 4 THEN concat('https://facebook.com/story.php?story_fbid=', {_FB}, '&amp;id=', {_N(89)}, '&fbclid=abc')
        WHEN 5 THEN concat('http://web.facebook.com/acct', {_N(41)}, '/posts/pfbid0', {_N(499)})
        WHEN 6 THEN concat('https://x.com/user', {_N(97)})
        WHEN 7 THEN concat('https://www.facebook.com/reel/', {_N(499)})
        WHEN 8 THEN concat('ftp://x.com/a/status/', {_ID})
        ELSE CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  https://X.com/Some%20One/status/', {_ID}, '/photo/1 ')
            WHEN 2 THEN NULL ELSE 'https://news.example.org/posts/1' END END""",
    "title": "CASE WHEN event_id % 3 = 0 THEN concat('(', {0}, ') Anna Bell - Green river walk ', {0}, '... | Facebook') WHEN event_id % 3 = 1 THEN concat('River notes ', {0}) ELSE NULL END".format(_N(7)),
    "snippet": f"concat('A green river walk with Anna Bell, part ', {_N(5)}, ' of the notes')",
    "metric": f"""CASE event_id % 9 WHEN 0 THEN '1,234 likes' WHEN 1 THEN '1.2K' WHEN 2 THEN '3.5 M views' WHEN 3 THEN '4万'
        WHEN 4 THEN '5 minutes' WHEN 5 THEN 'no count' WHEN 6 THEN '' WHEN 7 THEN concat({_N(40)}, ' comments ', {_N(9)}, ' shares')
        ELSE concat('Viewing ', {_N(12)}, ' of ', {_N(300)}) END""",
    "time_text": f"""CASE event_id % 12 WHEN 0 THEN '2h' WHEN 1 THEN concat({_N(30)}, ' days') WHEN 2 THEN '1y' WHEN 3 THEN 'just now'
        WHEN 4 THEN 'yesterday' WHEN 5 THEN '' WHEN 6 THEN '2025-99-99' WHEN 7 THEN '2024-02-03T04:05:06Z'
        WHEN 8 THEN '2024-02-03T04:05:06+02:00' WHEN 9 THEN '2mo' WHEN 10 THEN 'w' ELSE NULL END""",
    "author": """CASE event_id % 11 WHEN 0 THEN 'Anna Bell' WHEN 1 THEN '+3' WHEN 2 THEN '#tag' WHEN 3 THEN '6w' WHEN 4 THEN '12 comments'
        WHEN 5 THEN 'May Smith' WHEN 6 THEN 'Maya' WHEN 7 THEN NULL WHEN 8 THEN 'Join' WHEN 9 THEN ' Most  Relevant ' ELSE '!!' END""",
    "like_count": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN -3 ELSE event_id % 1000 END",
    "status": "CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'success' END",
    "error_type": "CASE WHEN event_id % 5 = 2 THEN 'FetchError' ELSE NULL END",
    "error_message": """CASE WHEN event_id % 5 <> 2 THEN NULL ELSE CASE event_id % 9 WHEN 0 THEN 'This content is unavailable'
        WHEN 1 THEN 'login wall found' WHEN 2 THEN 'too many requests' WHEN 3 THEN 'Timeout 30000ms' WHEN 4 THEN 'net::ERR_RESET'
        WHEN 5 THEN 'Unsupported page' WHEN 6 THEN 'validation of text' WHEN 7 THEN 'no container' ELSE 'odd' END END""",
    # earlier and later rows; some posts are only among the later ones
    "half": "CASE WHEN event_id % 2 = 0 AND event_id % 997 % 3 > 0 AND event_id % 499 % 3 > 0 THEN 'old' ELSE 'new' END",
}
#: The moment of collection of every row of the views.
AS_OF = "2024-03-10T12:30:45Z"

SEARCH_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SEARCH.items()) + " FROM events"

#: DuckDB: v is the view; c adds the classification by plain regular expressions.
CLASSIFIED_SQL = f"""v AS ({SEARCH_SQL}),
u AS (SELECT *, trim(replace(url, '&amp;', '&')) AS cu FROM v),
h AS (SELECT *, lower(regexp_extract(cu, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(cu, '^https?://[^/?#]+([^?#]*)', 1) AS path,
      regexp_extract(cu, '\\?([^#]*)', 1) AS q FROM u),
m AS (SELECT *, host IN ('x.com', 'www.x.com', 'twitter.com', 'www.twitter.com', 'mobile.twitter.com') AS is_x,
      host IN ('facebook.com', 'www.facebook.com', 'm.facebook.com', 'web.facebook.com') AS is_fb,
      regexp_extract(path, '^/i/web/status/([0-9]+)(/|$)', 1) AS xi, regexp_extract(path, '^/([^/]+)/status/([0-9]+)(/|$)', 1) AS xh,
      regexp_extract(path, '^/([^/]+)/status/([0-9]+)(/|$)', 2) AS xs, regexp_extract(path, '^/groups/([^/]+)/(posts|permalink)/([0-9]+|pfbid[0-9A-Za-z]+)(/|$)', 1) AS gg,
      regexp_extract(path, '^/groups/([^/]+)/(posts|permalink)/([0-9]+|pfbid[0-9A-Za-z]+)(/|$)', 3) AS gp,
      regexp_extract(path, '^/([^/]+)/posts/([0-9]+|pfbid[0-9A-Za-z]+)(/|$)', 1) AS pa, regexp_extract(path, '^/([^/]+)/posts/([0-9]+|pfbid[0-9A-Za-z]+)(/|$)', 2) AS pp,
      regexp_extract(path, '^/(story|permalink)\\.php$', 1) AS sp, regexp_extract(q, '(^|&)story_fbid=([0-9A-Za-z]+)(&|$)', 2) AS sf,
      regexp_extract(q, '(^|&)id=([^&]+)', 2) AS si FROM h),
k AS (SELECT *, CASE WHEN is_x AND xi <> '' THEN xi WHEN is_x AND xs <> '' THEN xs WHEN is_fb AND gp <> '' THEN gp WHEN is_fb AND pp <> '' THEN pp
      WHEN is_fb AND sp <> '' AND sf <> '' THEN sf END AS post_id FROM m),
c AS (SELECT pos, keyword, user_id, url, title, snippet, metric, time_text, author, like_count, status, error_type, error_message, half, post_id,
      CASE WHEN post_id IS NULL THEN NULL WHEN is_x THEN 'x' ELSE 'facebook' END AS platform,
      CASE WHEN post_id IS NULL THEN NULL WHEN is_x AND xi <> '' THEN 'https://x.com/i/web/status/' || xi WHEN is_x THEN 'https://x.com/' || xh || '/status/' || xs
        WHEN gp <> '' THEN 'https://www.facebook.com/groups/' || gg || '/posts/' || gp WHEN pp <> '' THEN 'https://www.facebook.com/' || pa || '/posts/' || pp
        ELSE 'https://www.facebook.com/' || sp || '.php?story_fbid=' || sf || CASE WHEN si <> '' THEN '&id=' || si ELSE '' END END AS canonical_url,
      CASE WHEN post_id IS NULL OR is_x THEN NULL WHEN gp <> '' THEN 'group' WHEN pp <> '' THEN 'profile' END AS context_type FROM k)"""


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{e} AS {n}" for n, e in SEARCH.items()))
