"""Crawl planning: bounded breadth-first frontiers, freshness and refresh actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import latest_by_key

ZONED = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_pages: int = 25, max_depth: int = 1, allowed: DataFrame | None = None, followed: Column | None = None) -> DataFrame:
    """Breadth-first visits: url, depth, visit (the order). `seeds`: url,
    position; `links`: src, dst, position. Urls count once, at their first place
    in the order (depth, visit of the parent, position); failures count against
    the page budget as well. `allowed` (url) restricts links, not seeds;
    `followed` is a condition on a page's url for its links to count.

    The loop runs once a level (at most four by the domain of max_depth); a
    level's frontier is a join, an anti join and a rank. Lineage is cut by a
    checkpoint a level.
    """
    if not 1 <= max_pages <= 100 or not 0 <= max_depth <= 3:
        raise ValueError("max_pages must be within 1 and 100, max_depth within 0 and 3")
    level = seeds.select("url", F.lit(0).alias("p"), "position")
    visited = None
    for depth in range(max_depth + 1):
        first = latest_by_key(level, ["url"], [F.col("p"), F.col("position")])
        start = 0 if visited is None else visited.count()  # at most max_pages
        # The budget keeps at most max_pages rows before they are numbered.
        found = first.orderBy("p", "position", "url").limit(max_pages - start)
        found = found.withColumn("visit", F.row_number().over(W.orderBy("p", "position", "url")) + start)
        found = found.select("url", F.lit(depth).alias("depth"), "visit").checkpoint()
        visited = found if visited is None else visited.union(found)
        if depth == max_depth or found.isEmpty() or start + found.count() >= max_pages:
            break
        pages = found if followed is None else found.filter(followed)
        out = links.join(F.broadcast(pages.select(F.col("url").alias("src"), F.col("visit").alias("p"))), "src")  # at most max_pages rows
        if allowed is not None:
            out = out.join(allowed.select(F.col("url").alias("dst")), "dst", "left_semi")
        level = out.select(F.col("dst").alias("url"), "p", "position").join(F.broadcast(visited.select("url")), "url", "left_anti")
    return visited


def age_seconds(fetched_at: Column, now: Column) -> Column:
    """Age of an ISO time with a zone, not below 0, to milliseconds; null for
    anything that isn't such a time."""
    ok = F.regexp_like(fetched_at, F.lit(ZONED))
    micros = F.unix_micros(now) - F.unix_micros(F.when(ok, F.try_to_timestamp(fetched_at)))
    return F.when(micros.isNotNull(), F.round(F.greatest(F.lit(0.0), micros / 1e6), 3))


def stored_version(requests: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Each url with its newest stored version: document_id, content_hash, age_s,
    etag, last_modified; all null where there is none or it is malformed."""
    newest = latest_by_key(documents, ["url"], [F.desc("fetched_at"), F.desc("document_id")])
    age = age_seconds(F.col("fetched_at"), now)
    whole = (F.length("document_id") > 0) & (F.length("content_hash") > 0) & age.isNotNull()
    hit = newest.filter(whole).select(
        "url", "document_id", "content_hash", age.alias("age_s"), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("etag", "last_modified"))
    )
    return requests.join(hit, "url", "left")


def is_fresh(age_s: Column, window_s: Column) -> Column:
    return F.coalesce((window_s > 0) & (age_s < window_s), F.lit(False))


def refresh_plan(pages: DataFrame) -> DataFrame:
    """What a crawl does with each page and what that costs. `pages`: url, depth,
    max_depth, refresh_after_s, revalidate_leaves, age_s, etag, last_modified,
    returns_304, touch_ok, body_bytes.

    A fresh leaf under revalidation isn't fetched at all; a stale one with a
    validator is asked conditionally; 304 with a touch ends there, a touch that
    fails leads to a full fetch. Whatever is fetched whole is then skipped if its
    stored version is fresh, else extracted and indexed.
    """
    leaf = F.col("revalidate_leaves") & (F.col("refresh_after_s") > 0) & (F.col("depth") >= F.col("max_depth"))
    known, fresh = F.col("age_s").isNotNull(), is_fresh(F.col("age_s"), F.col("refresh_after_s"))
    validator = known & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull())
    rows = pages.withColumn("leaf", leaf).withColumn("fresh", fresh)
    rows = rows.withColumn("action", F.when(F.col("leaf") & F.col("fresh"), "skip").when(F.col("leaf") & validator, "conditional").otherwise("full"))
    asked = F.col("action") == "conditional"
    rows = rows.withColumn("not_modified", asked & F.col("returns_304"))
    rows = rows.withColumn("revalidated", F.col("not_modified") & F.col("touch_ok"))
    rows = rows.withColumn("whole", (F.col("action") == "full") | (asked & ~F.col("revalidated")))
    rows = rows.withColumn("fresh_after_fetch", F.col("whole") & F.col("fresh"))
    n = lambda c: c.cast("int")
    second = F.col("not_modified") & ~F.col("touch_ok")
    return rows.select(
        "url",
        "action",
        n(asked).alias("conditional_gets"),
        n((F.col("action") == "full") | second).alias("unconditional_gets"),
        F.when(F.col("whole"), F.col("body_bytes")).otherwise(F.lit(0)).cast("long").alias("body_bytes"),
        n(F.col("whole") & ~F.col("fresh_after_fetch")).alias("extractions"),
        n(F.col("whole") & ~F.col("fresh_after_fetch")).alias("index_writes"),
        n(F.col("not_modified")).alias("touches"),
        ((F.col("action") == "skip") | F.col("fresh_after_fetch")).alias("freshness_skipped"),
        (F.col("action") == "skip").alias("network_skipped"),
        F.col("revalidated").alias("revalidated"),
        (F.col("whole") & ~F.col("fresh_after_fetch")).alias("indexed"),
    )


COUNTERS = ("conditional_gets", "unconditional_gets", "body_bytes", "extractions", "index_writes")


def savings(baseline: DataFrame, optimised: DataFrame) -> DataFrame:
    """Reduction of each counter in percent; null where the baseline has none."""
    a = baseline.agg(*(F.sum(c).alias(f"a_{c}") for c in COUNTERS))
    b = optimised.agg(*(F.sum(c).alias(f"b_{c}") for c in COUNTERS))
    cut = lambda c: F.when(F.col(f"a_{c}") > 0, F.round(100.0 * (F.col(f"a_{c}") - F.col(f"b_{c}")) / F.col(f"a_{c}"), 3))
    return a.crossJoin(b).select(*(cut(c).alias(f"{c}_saved") for c in COUNTERS))  # one row each


def crawl_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    both = F.col("freshness_skipped") & F.col("network_skipped")
    sums = [F.count("*").alias("visited"), F.count_if(F.col("indexed")).alias("indexed"), F.count_if(F.col("freshness_skipped")).alias("fresh_skipped"), F.count_if(both).alias("network_skipped"), F.count_if(F.col("revalidated")).alias("revalidated")]
    return outcomes.groupBy(*by).agg(*sums) if by else outcomes.agg(*sums)


def cycle_gaps(cycles: DataFrame, interval_s: int) -> DataFrame:
    """Cycles (cycle, started_at, ended_at) with the gap since the one before and
    whether a fixed delay after completion was kept."""
    gap = (F.unix_micros(F.col("started_at")) - F.unix_micros(F.lag("ended_at").over(W.orderBy("started_at", "cycle")))) / 1e6
    return cycles.withColumn("gap_s", F.round(gap, 3)).withColumn("kept", F.coalesce(F.col("gap_s") >= interval_s, F.lit(True)))


def redirect_targets(starts: DataFrame, redirects: DataFrame, most: int = 5) -> DataFrame:
    """Follows redirects (src, dst) for at most `most` hops: url, final_url, hops, ok."""
    if not 0 <= most <= 20:
        raise ValueError("most must be within 0 and 20")
    at = starts.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"))
    r = redirects.select(F.col("src").alias("final_url"), F.col("dst").alias("__to"))
    for _ in range(most):
        at = at.join(r, "final_url", "left").select("url", F.coalesce("__to", "final_url").alias("final_url"), (F.col("hops") + F.col("__to").isNotNull().cast("int")).alias("hops"))
    left = at.join(r, "final_url", "left")
    return left.select("url", "final_url", "hops", F.col("__to").isNull().alias("ok"))
