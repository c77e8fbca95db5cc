"""Crawls over stored responses, and the page source.

The web is made of the pages: page n is at host n modulo 3, begins with an article of its own that links to pages 2n + 1 and 2n + 2, and keeps
its html below that, without links. Some pages redirect, fail or are no html; one host's robots rules forbid addresses; even pages have
a stored version of some age. Every 25th page and the next are seeds of a crawl.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import crawler as C
from ..session import shared_folder, written
from ..sources import responses as R
from .base import table

POLICY = C.CrawlPolicy(max_pages=12, max_depth=2, same_origin=True, refresh_after_s=2500, revalidate_leaves=True)
NOW = "2026-01-02 00:00:00"


def _address(n):
    return F.concat(F.lit("https://s"), n % 3, F.lit(".example/p/"), n)


def _web(spark, d):
    pages, n = table(spark, d, "pages"), F.col("page_id")
    link = lambda k: F.concat(F.lit('<a href="'), _address(k), F.lit('">next</a>'))
    own = F.concat(F.lit("<article><p>Page "), n, F.lit(" of the crawl.</p>"), link(2 * n + 1), link(2 * n + 2), F.lit("</article>"))
    html = F.concat(own, F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)<a(?=\s)", "<b"))
    return pages.select(
        _address(n).alias("url"),
        F.when(n % 10 == 4, 301).when(n % 17 == 5, 404).otherwise(200).alias("status"),
        F.when(n % 10 == 4, F.concat(F.lit("/p/"), n + 3)).alias("location"),
        F.when(n % 19 == 7, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.encode(html, "UTF-8").alias("body"),
        F.concat(F.when(n % 8 == 0, "e").otherwise("x"), n).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


def _crawled(spark, d):
    folder = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    pages, n = table(spark, d, "pages").select("page_id"), F.col("page_id")
    R.store_responses(_web(spark, d), f"{folder}/responses", 8)
    at = F.date_format(F.expr(f"timestamp'{NOW}' - make_interval(0, 0, 0, 0, 0, 0, (page_id % 5) * 1000)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    documents = pages.filter("page_id % 2 = 0").select(
        F.concat(F.lit("d"), n).alias("document_id"), _address(n).alias("url"), F.concat(F.lit("h"), n).alias("content_hash"), at.alias("fetched_at"),
        F.when(n % 4 == 0, F.concat(F.lit("e"), n)).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )
    first = pages.filter("page_id % 25 = 0")
    seeds = first.select(n.alias("crawl_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("position")).select("crawl_id", _address(F.col("crawl_id") + F.col("position")).alias("url"), "position")
    robots = spark.createDataFrame([(f"https|s{k}.example|443", 200 if k == 1 else 404, "User-agent: *\nDisallow: /p/9" if k == 1 else "") for k in range(3)], "origin string, status int, body string")
    robots = robots.withColumn("expires_at", F.lit("2100-01-01").cast("timestamp"))
    responses = written(R.read_responses(spark, f"{folder}/responses", 8), "responses")  # read by each hop of each level
    renewable = F.expr("try_cast(substring(document_id, 2) AS int) % 3 <> 0")
    return C.crawl(spark, folder, seeds, responses, documents, F.lit(NOW).cast("timestamp"), POLICY, robots, touch_ok=renewable)


SHOWN = ("crawl_id", "url", "final_url", "depth", "visit", "document_id", "error", *C.FLAGS, *C.COUNTS)


def crawl(spark, d):
    return _crawled(spark, d).outcomes.select(*SHOWN)


def crawl_answer(spark, d):
    return C.crawl_totals(_crawled(spark, d).outcomes, "crawl_id")


def page_source(spark, d):
    """Pages from the response source: every seventh answer failed, every 13th is no html, every third is in another encoding."""
    folder = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    n = F.col("page_id")
    wide = n % 3 == 1
    R.store_responses(
        table(spark, d, "pages").select(
            F.concat(F.col("url"), F.lit("#"), n).alias("url"), F.when(n % 7 == 3, 503).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"),
            F.when(n % 13 == 0, "image/png").when(wide, "TEXT/HTML; charset=UTF-16LE").otherwise("text/html").alias("content_type"),
            F.when(wide, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8")).alias("body"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        ),
        folder,
    )
    pages = R.html_pages(R.read_responses(spark, folder).filter("status = 200"))
    return pages.select("url", U.host(F.col("url")).alias("host"), F.length("html").alias("n_chars"), F.sha2("html", 256).alias("sha256"))


def _sql_address(n: str) -> str:
    return f"('https://s' || ({n}) % 3 || '.example/p/' || ({n}))"


_ASKED = "NOT ({n} % 3 = 1 AND starts_with(({n})::VARCHAR, '9'))"
_RESULT = """CASE WHEN NOT {ok} THEN 'blocked by robots.txt' WHEN {n} NOT IN (SELECT page_id FROM pages) THEN 'no answer'
       WHEN {n} % 10 <> 4 AND {n} % 17 = 5 THEN 'HTTP 404' WHEN {n} % 10 <> 4 AND {n} % 19 = 7 THEN 'unsupported content type' END"""


def _result(n: str) -> str:
    return _RESULT.format(n=n, ok=_ASKED.format(n=n))


#: Every address that a crawl may reach, with what a plain fetch of it ends in: f is the page it leads to.
_CRAWL = f"""WITH RECURSIVE ids AS (SELECT page_id AS n FROM pages UNION SELECT 2 * page_id + k FROM pages, (SELECT unnest([1, 2]) AS k)),
  a AS (SELECT n, {_result("n")} AS e0, CASE WHEN {_result("n")} IS NULL AND n % 10 = 4 THEN n + 3 ELSE n END AS f FROM ids),
  r AS (SELECT n, f, coalesce(e0, CASE WHEN f <> n THEN {_result("f")} END) AS error FROM a),
  seeds AS (SELECT page_id AS crawl_id, page_id + k AS n, k AS position FROM pages, (SELECT unnest([0, 1]) AS k) WHERE page_id % 25 = 0),
  walk AS (SELECT crawl_id, n, 0 AS depth, [position] AS path FROM seeds UNION ALL
           SELECT w.crawl_id, 2 * r.f + k, w.depth + 1, list_append(w.path, k) FROM walk w JOIN r USING (n), (SELECT unnest([1, 2]) AS k)
           WHERE w.depth < 2 AND r.error IS NULL AND (2 * r.f + k) % 3 IN (w.crawl_id % 3, (w.crawl_id + 1) % 3)),
  best AS (SELECT crawl_id, n, min(depth) AS depth, min({{'d': depth, 'p': path}}) AS o FROM walk GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY o)::INT AS visit FROM best),
  v AS (SELECT p.*, f, error, p.depth >= 2 AS leaf, n % 2 = 0 AND n % 5 <= 2 AND n IN (SELECT page_id FROM pages) AS fresh, n % 4 = 0 AND n IN (SELECT page_id FROM pages) AS valid,
        f % 2 = 0 AND f % 5 <= 2 AS late, {_ASKED.format(n="n")} AS asked FROM placed p JOIN r USING (n) WHERE visit <= 12),
  s AS (SELECT *, leaf AND fresh AS skip, leaf AND NOT fresh AND valid AS cond FROM v),
  t AS (SELECT *, cond AND asked AND n % 8 = 0 AND n % 10 <> 4 AND n % 17 <> 5 AS same FROM s),
  u AS (SELECT *, same AND n % 3 <> 0 AS renewed FROM t),
  w AS (SELECT *, NOT skip AND NOT renewed AND error IS NULL AS whole FROM u),
  outcomes AS (SELECT crawl_id, {_sql_address("n")} AS url, CASE WHEN skip OR renewed THEN {_sql_address("n")} ELSE {_sql_address("f")} END AS final_url, depth, visit,
    CASE WHEN skip AND asked OR renewed THEN 'd' || n WHEN whole AND late THEN 'd' || f WHEN whole THEN sha256({_sql_address("f")}) END AS document_id,
    CASE WHEN skip THEN CASE WHEN NOT asked THEN 'blocked by robots.txt' END WHEN NOT renewed THEN error END AS error,
    whole AND NOT late AS indexed, (skip AND asked) OR (whole AND late) AS freshness_skipped, skip AND asked AS network_skipped, renewed AS revalidated,
    cond::INT AS conditional_gets, (NOT skip AND (NOT cond OR (same AND NOT renewed)))::INT AS unconditional_gets,
    (whole AND NOT late)::INT AS extractions, (whole AND NOT late)::INT AS index_writes, same::INT AS touches FROM w)"""

QUERIES = {
    "crawl": (crawl, f"{_CRAWL} SELECT * FROM outcomes"),
    "crawl_answer": (
        crawl_answer,
        f"""{_CRAWL} SELECT crawl_id, count(*) AS pages_visited, count(*) FILTER (indexed) AS pages_indexed, count(*) FILTER (freshness_skipped) AS pages_skipped_fresh,
  count(*) FILTER (freshness_skipped AND network_skipped) AS pages_network_skipped_fresh, count(*) FILTER (revalidated) AS pages_revalidated_not_modified FROM outcomes GROUP BY crawl_id""",
    ),
    "page_source": (
        page_source,
        r"""SELECT url || '#' || page_id AS url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, length(html)::INT AS n_chars, sha256(html) AS sha256 FROM pages
WHERE page_id % 7 <> 3 AND page_id % 13 <> 0 AND html IS NOT NULL AND octet_length(encode(html)) <= 5000000""",
    ),
}
