"""Queries over captured search pages: the data source and the table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import cards
from postloom.operators import relational as rel
from postloom.plans import summaries, views
from postloom.plans.queries import classified, query
from postloom.sources import search_pages
from postloom.sources.folders import new_folder

#: Captured pages of the view: a keyword is an event type and a part of the users, a page ten results of it; some pages are short, some
#: failed, some have no next.
_KEYWORD = "concat(keyword, '/', CAST(user_id % 20 AS {}))"
_PAGES_SQL = f""", sq AS (SELECT {_KEYWORD.format('VARCHAR')} AS kw, pos, title, url, snippet, row_number() OVER (PARTITION BY {_KEYWORD.format('VARCHAR')} ORDER BY pos) - 1 AS n FROM c),
sg AS (SELECT kw, n // 10 + 1 AS page_number, count(*) FILTER (pos % 53 > 0) AS received, bool_or(pos % 97 = 3) AS failed, NOT bool_or(pos % 89 = 5) AS has_next FROM sq WHERE n < 100 GROUP BY 1, 2),
sk AS (SELECT *, coalesce(max(CASE WHEN received < 10 OR NOT has_next OR failed THEN 1 ELSE 0 END) OVER (PARTITION BY kw ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sg),
st AS (SELECT * FROM sk WHERE s = 0 AND NOT failed) """


def _captured(spark, d):
    """(keyword, page_number, requested, has_next, failed, results): the pages to store."""
    v = views.search(spark, d).withColumn("kw", F.expr(_KEYWORD.format("STRING"))).select("kw", "pos", "title", "url", "snippet")
    # ten pages of ten a keyword: what a page plan asks for
    first = rel.rank_per_key(v, ["kw"], "pos").where(F.col("rank") <= search_pages.MOST_RESULTS)
    page = rel.page_of_rank(F.col("rank")).cast("bigint")
    kept = F.when(F.col("pos") % 53 > 0, F.struct("pos", F.struct("title", "url", "snippet").alias("r")))
    pages = first.groupBy(F.col("kw").alias("keyword"), page.alias("page_number")).agg(
        F.lit(10).cast("bigint").alias("requested"), (~F.bool_or(F.col("pos") % 89 == 5)).alias("has_next"), F.bool_or(F.col("pos") % 97 == 3).alias("failed"),
        F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["r"]).alias("results"))
    return pages


def captured_pages(spark, d) -> str:
    """The folder of the view's captured pages, written through the source."""
    search_pages.register(spark)
    folder = new_folder(spark, "search-pages")
    _captured(spark, d).repartition(8, "keyword").write.format("search_pages").mode("append").save(folder)
    return folder


@query(_PAGES_SQL + """SELECT kw AS keyword, row_number() OVER (PARTITION BY kw ORDER BY pos) AS rank, CAST(page_number AS BIGINT) AS page_number, title, url, snippet
FROM sq JOIN st USING (kw) WHERE n // 10 + 1 = page_number AND pos % 53 > 0""")
def paged_search(spark, d):
    """Pages stored and read through the source, with the rules by which paging stops."""
    rows = spark.read.format("search_pages").load(captured_pages(spark, d))
    return search_pages.search_results(rows).withColumn("rank", F.col("rank").cast("bigint"))


@query(_PAGES_SQL + "SELECT kw AS keyword, CAST(count(*) AS BIGINT) AS pages, CAST(sum(received) AS BIGINT) AS received FROM st GROUP BY 1")
def search_page_logs(spark, d):
    rows = spark.read.format("search_pages").load(captured_pages(spark, d))
    return search_pages.taken_pages(rows).groupBy("keyword").agg(F.count("*").alias("pages"), F.sum("received").alias("received"))


@query(""", cq AS (SELECT *, (row_number() OVER (PARTITION BY user_id, half ORDER BY pos) - 1) // 10 + 1 AS page_number FROM c)
SELECT user_id, half, page_number, CAST(row_number() OVER (PARTITION BY user_id, half, page_number ORDER BY pos) AS BIGINT) AS card, 'Result ' || pos AS title, trim(replace(url, '&amp;', '&')) AS url,
  CASE WHEN pos % 4 > 0 THEN 'about ' || pos END AS snippet FROM cq WHERE trim(replace(url, '&amp;', '&')) <> '' AND pos % 6 > 0""")
def result_cards(spark, d):
    """Cards of result pages, by the table function in SQL; a page's HTML is built from ten rows of a user."""
    cards.register(spark)
    href = F.replace(F.coalesce("url", F.lit("")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit('<a class="gs-title" href=" ">none</a><a class="gs-title" href="'), href, F.lit('">Result <b>'), F.col("pos"), F.lit("</b></a>"))
    parts = [F.lit('<div class="gsc-webResult gsc-result other"><div>'), F.when(F.col("pos") % 6 > 0, link).otherwise("<a>x</a>"), F.lit('<p class="gs-snippet" hidden>no</p>'),
             F.when(F.col("pos") % 4 > 0, F.concat(F.lit('<div class="gs-bidi gs-snippet">about  '), F.col("pos"), F.lit("</div>"))).otherwise(""), F.lit("</div></div>")]
    v = rel.rank_per_key(views.search(spark, d).select("user_id", "half", "pos", "url"), ["user_id", "half"], "pos")
    page = rel.page_of_rank(F.col("rank")).cast("bigint")
    key = ["user_id", "half", "page_number"]
    # dealt by number: pages are small but laborious, and would be merged into a few tasks; the function takes each where it is made
    parts_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_page = v.select("user_id", "half", page.alias("page_number"), F.struct("pos", F.concat(*parts).alias("h")).alias("card")).repartition(parts_of, *key)
    html = F.array_join(F.transform(F.array_sort(F.collect_list("card")), lambda c: c["h"]), "")
    pages = of_page.groupBy(*key).agg(html.alias("html"))
    found = spark.sql("SELECT * FROM result_cards(TABLE(SELECT user_id, half, page_number, html FROM {pages}))", pages=pages)
    return found.withColumn("card", F.col("card").cast("bigint"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages""")
def page_cards(spark, d):
    """Items of the lists of captured pages as cards."""
    cards.register(spark)
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    return spark.sql("SELECT page_id, url, title FROM result_cards(TABLE(SELECT page_id, html FROM {pages}) PARTITION BY (page_id), 'li', 'a', 'p')", pages=pages)


@query(_PAGES_SQL + """SELECT kw AS keyword, CAST(50 AS BIGINT) AS requested_count, CAST(least(50, sum(received)) AS BIGINT) AS result_count, string_agg(page_number || ':' || received, ' ' ORDER BY page_number) AS logs
FROM st WHERE page_number <= 5 GROUP BY 1""")
def search_payloads(spark, d):
    """One envelope a keyword, for at most 50 results."""
    p = search_pages.payloads(spark.read.format("search_pages").load(captured_pages(spark, d)), 50)
    logs = F.array_join(F.transform("page_logs", lambda x: F.concat_ws(":", x["page_number"], x["received"])), " ")
    return p.select("keyword", "requested_count", "result_count", logs.alias("logs"))


# The forms in which a keyword is searched for.
SEARCH_FORMS = (
    "{keyword}", "{keyword} Facebook", "{keyword} official Facebook", "{keyword} update Facebook", "{keyword} event Facebook", "site:facebook.com {keyword}",
    'site:facebook.com "{keyword}"', 'site:facebook.com "{keyword}" "story_fbid"', 'site:facebook.com "{keyword}" "permalink.php"',
)


@query("""SELECT keyword, CAST(unnest(range(1, 10)) AS BIGINT) AS place, unnest([keyword, keyword || ' Facebook', keyword || ' official Facebook', keyword || ' update Facebook', keyword || ' event Facebook', 'site:facebook.com ' || keyword,
  'site:facebook.com "' || keyword || '"', 'site:facebook.com "' || keyword || '" "story_fbid"', 'site:facebook.com "' || keyword || '" "permalink.php"']) AS search FROM (SELECT DISTINCT keyword FROM c)""")
def query_expansion(spark, d):
    """The searches of every keyword, each once and ten at most."""
    forms = F.slice(F.array_distinct(F.array(*(F.replace(F.lit(f), F.lit("{keyword}"), F.col("keyword")) for f in SEARCH_FORMS))), 1, 10)
    k = views.search(spark, d).select("keyword").distinct()
    return k.select("keyword", F.posexplode(forms).alias("at", "search")).select("keyword", (F.col("at") + 1).cast("bigint").alias("place"), "search")


@query(""", mi AS (SELECT * FROM c WHERE platform = 'facebook' QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY pos) = 1)
SELECT (SELECT count(DISTINCT keyword) FROM c) AS keyword_count, (SELECT count(DISTINCT keyword) FROM c) AS keyword_success_count, CAST(0 AS BIGINT) AS search_result_count, count(*) AS batch_input_count, CAST(0 AS BIGINT) AS duplicate_count,
  count(*) FILTER (status = 'failed') AS batch_failed_count, CASE WHEN count(*) > 0 THEN 'success' ELSE 'no_accepted_urls' END AS pipeline_status FROM mi""")
def manifest_replay(spark, d):
    """The summary of a run over stored items: its failures don't change how it ended."""
    c = classified(spark, d)
    items = rel.dedupe_first(c.where("platform = 'facebook'").select("platform", "post_id", "pos", "status"), ["platform", "post_id"], "pos")
    keywords = [r.keyword for r in c.select("keyword").distinct().collect()]  # a run's few keywords
    s = summaries.replay(spark, items, keywords, new_folder(spark, "replayed"))
    return s.select("keyword_count", "keyword_success_count", "search_result_count", "batch_input_count", "duplicate_count", "batch_failed_count", "pipeline_status")


@query("SELECT DISTINCT keyword, 'manifest' AS search_status, CAST(NULL AS BIGINT) AS search_result_count, CAST(NULL AS BIGINT) AS accepted_before_global_dedup, CAST(NULL AS BIGINT) AS rejected_count FROM c")
def replayed_keywords(spark, d):
    return summaries.replayed_keywords(views.search(spark, d).select("keyword").distinct())
