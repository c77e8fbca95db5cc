"""Crawl and refresh queries. Pages link to twice their number and the next, by
number of the pages in id order; the newest event of a user is its stored
version, its age measured at the newest event of all."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import crawl as C
from ..session import ensure_checkpoints
from .base import table
from .tables import _STORED, _stored

PAGES, DEPTH = 100, 3
WINDOW = 3600 * 4
BODY = 262_144


def _edges(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("src"))
    two = p.select("src", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    return two.select("src", (2 * F.col("src") + F.col("position")).alias("dst"), "position").join(p.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst", "position")


def _seeds(spark, d):
    return table(spark, d, "pages").filter("page_id IN (0, 1, 2)").select(F.col("page_id").alias("url"), F.col("page_id").alias("position"))


def crawl_frontier(spark, d):
    ensure_checkpoints(spark)
    edges = _edges(spark, d).select("src", "dst", "position")
    return C.crawl_frontier(_seeds(spark, d), edges, PAGES, DEPTH).select(F.col("url").alias("page_id"), "depth", "visit")


def _now(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("now"))


def _aged(spark, d):
    """Stored versions as a service keeps them: ISO times, every ninth without a zone."""
    s = _stored(spark, d).crossJoin(F.broadcast(_now(spark, d)))  # now is one row
    iso = F.concat(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("document_id") % 9 == 0, F.lit("")).otherwise(F.lit("Z")))
    return s.withColumn("iso", iso)


def freshness(spark, d):
    a = _aged(spark, d)
    age = C.age_seconds(F.col("iso"), F.to_timestamp_ltz(F.date_format("now", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    rows = a.withColumn("age_s", age)
    return rows.select("document_id", "age_s", C.is_fresh(F.col("age_s"), F.lit(WINDOW)).alias("fresh"))


def _plan_input(spark, d):
    a = freshness(spark, d).join(_stored(spark, d).select("document_id", "etag", "last_modified"), "document_id")
    n = F.col("document_id")
    return a.select(
        n.alias("url"),
        (n % 2).cast("int").alias("depth"),
        F.lit(1).alias("max_depth"),
        F.lit(WINDOW).alias("refresh_after_s"),
        (n % 4 != 0).alias("revalidate_leaves"),
        "age_s",
        "etag",
        "last_modified",
        (n % 3 != 0).alias("returns_304"),
        (n % 5 != 0).alias("touch_ok"),
        F.lit(BODY).alias("body_bytes"),
    )


def refresh_plan(spark, d):
    return C.refresh_plan(_plan_input(spark, d)).withColumnRenamed("url", "document_id")


def refresh_savings(spark, d):
    p = _plan_input(spark, d)
    plain = C.refresh_plan(p.withColumn("revalidate_leaves", F.lit(False)))
    return C.savings(plain, C.refresh_plan(p))


def crawl_summary(spark, d):
    return C.crawl_summary(C.refresh_plan(_plan_input(spark, d)), "action")


def cycle_gaps(spark, d):
    """Days as cycles: they start with their first event and end with their last."""
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("cycle")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    cycles = e.select("cycle", F.col("a").cast("timestamp").alias("started_at"), F.col("b").cast("timestamp").alias("ended_at"))
    return C.cycle_gaps(cycles, 60)


def events_windowed(spark, d):
    """An extension: hourly counts and sums per type, as the stream version gives them."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def star_revenue(spark, d):
    """Platform baseline: revenue by region and priority of filtered orders."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").filter("l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 30").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = t("customer").select("c_custkey", "c_nationkey")
    place = F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))  # 25 rows
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "o_orderpriority").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count("*").alias("n_lines"))


def top_customers(spark, d):
    """Platform baseline: the five best customers of each segment by order value."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "o_custkey")
    return o.join(c, "o_custkey").withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


_AGE = f"""{_STORED},
  a AS (SELECT document_id, etag, CASE WHEN document_id % 9 <> 0 THEN round(greatest(0.0::DOUBLE, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(fetched_at)) / 1e6::DOUBLE), 3) END AS age_s FROM s),
  f AS (SELECT *, coalesce(age_s < {WINDOW}, false) AS fresh FROM a),
  g AS (SELECT *, document_id % 4 <> 0 AND document_id % 2 >= 1 AS leaf, document_id % 3 <> 0 AS r304, document_id % 5 <> 0 AS tok FROM f)"""


def _plan_sql(name: str, leaf: str) -> str:
    return f"""
  h_{name} AS (SELECT *, CASE WHEN {leaf} AND fresh THEN 'skip' WHEN {leaf} AND age_s IS NOT NULL AND etag IS NOT NULL THEN 'conditional' ELSE 'full' END AS action FROM g),
  i_{name} AS (SELECT *, action = 'conditional' AND r304 AS nm, action = 'full' OR (action = 'conditional' AND NOT (r304 AND tok)) AS whole FROM h_{name}),
  {name} AS (SELECT document_id, action, (action = 'conditional')::INT AS conditional_gets, (action = 'full' OR (nm AND NOT tok))::INT AS unconditional_gets,
    CASE WHEN whole THEN {BODY} ELSE 0 END::BIGINT AS body_bytes, (whole AND NOT fresh)::INT AS extractions, (whole AND NOT fresh)::INT AS index_writes, nm::INT AS touches,
    action = 'skip' OR (whole AND fresh) AS freshness_skipped, action = 'skip' AS network_skipped, nm AND tok AS revalidated, whole AND NOT fresh AS indexed FROM i_{name})"""


def _saved(c: str) -> str:
    return f"CASE WHEN (SELECT sum({c}) FROM plain) > 0 THEN round(100.0::DOUBLE * ((SELECT sum({c}) FROM plain) - (SELECT sum({c}) FROM best)) / (SELECT sum({c}) FROM plain), 3) END AS {c}_saved"


QUERIES = {
    "crawl_frontier": (
        crawl_frontier,
        f"""WITH RECURSIVE e AS (SELECT p.page_id AS src, 2 * p.page_id + k AS dst, k AS position FROM pages p, (SELECT unnest([1, 2]) AS k) WHERE 2 * p.page_id + k IN (SELECT page_id FROM pages)),
  walk AS (SELECT page_id, 0 AS depth, [page_id] AS path FROM pages WHERE page_id IN (0, 1, 2) UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM walk JOIN e ON src = page_id WHERE depth < {DEPTH}),
  best AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id),
  o AS (SELECT page_id, depth, row_number() OVER (ORDER BY depth, page_id)::INT AS visit FROM best)
SELECT page_id, depth, visit FROM o WHERE visit <= {PAGES}""",
    ),
    "freshness": (freshness, f"WITH {_AGE} SELECT document_id, age_s, fresh FROM f"),
    "refresh_plan": (refresh_plan, f"WITH {_AGE}, {_plan_sql('best', 'leaf')} SELECT * FROM best"),
    "refresh_savings": (
        refresh_savings,
        f"WITH {_AGE}, {_plan_sql('best', 'leaf')}, {_plan_sql('plain', 'false')} SELECT {', '.join(map(_saved, C.COUNTERS))}",
    ),
    "crawl_summary": (
        crawl_summary,
        f"WITH {_AGE}, {_plan_sql('best', 'leaf')} SELECT action, count(*) AS visited, count(*) FILTER (indexed) AS indexed, count(*) FILTER (freshness_skipped) AS fresh_skipped, count(*) FILTER (freshness_skipped AND network_skipped) AS network_skipped, count(*) FILTER (revalidated) AS revalidated FROM best GROUP BY action",
    ),
    "cycle_gaps": (
        cycle_gaps,
        """WITH c AS (SELECT ts::DATE AS cycle, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), g AS (SELECT cycle, a, b, round((epoch_us(a) - lag(epoch_us(b)) OVER (ORDER BY a, cycle)) / 1e6::DOUBLE, 3) AS gap_s FROM c)
SELECT cycle, a AS started_at, b AS ended_at, gap_s, coalesce(gap_s >= 60, true) AS kept FROM g""",
    ),
    "events_windowed": (events_windowed, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "star_revenue": (
        star_revenue,
        "SELECT r_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 30 GROUP BY ALL",
    ),
    "top_customers": (
        top_customers,
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC, o_custkey)::INT AS rank FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) USING (o_custkey)) WHERE rank <= 5",
    ),
}
