"""Crawling: many bounded breadth-first crawls at once, with refresh, admission and indexing.

A level of all crawls is one pass of joins: stored versions as of now, admission, fetches, versions as of now once more by the
address that redirects led to, extraction, links. Each level is written below the crawl's folder and committed, so that a
crawl that stops is resumed at its next level by calling it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import url as U
from ..sources.markup import MOST_BYTES, page_links
from ..sources.responses import MOST_HOPS, fetch
from ..sources.robots import robots_decisions
from .commits import Commits
from .crawl import is_fresh, stored_version
from .indexing import index_pages
from .joins import small
from .tables import latest_by_key


class CrawlPolicy(NamedTuple):
    max_pages: int = 25  # of a crawl, failures included
    max_depth: int = 1
    same_origin: bool = True
    refresh_after_s: int = 0
    revalidate_leaves: bool = False
    agent: str = "lodestone"
    max_hops: int = MOST_HOPS
    most_bytes: int = MOST_BYTES


class Crawled(NamedTuple):
    outcomes: DataFrame
    documents: DataFrame
    passages: DataFrame


FLAGS = ("indexed", "freshness_skipped", "network_skipped", "revalidated")
COUNTS = ("conditional_gets", "unconditional_gets", "extractions", "index_writes", "touches")


def admission(robots: DataFrame | None, dns: DataFrame | None, agent: str, now: Column) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `refusal` to rows with a url: static checks, addresses (literals, and what hosts resolve to where `dns`
    is given), then robots rules where `robots` is given."""
    from .holdout import resolved_admission

    def ask(urls: DataFrame) -> DataFrame:
        host = U.host(F.col("url"))
        if dns is not None:
            rows = resolved_admission(urls, dns).drop("host", "admitted")
        else:
            address = F.when(U.forbidden_ip(host), "address")
            rows = urls.withColumn("refusal", F.coalesce(U.refusal(F.col("url")), F.when(~U.valid_port(F.col("url")), "port"), address))
        if robots is None:
            return rows
        return robots_decisions(rows, robots, agent, now).withColumn("refusal", F.coalesce("refusal", F.when(~F.col("robots_ok"), "blocked by robots.txt"))).drop("robots_ok")

    return ask


def crawl(spark: SparkSession, folder: str, seeds: DataFrame, responses: DataFrame, documents: DataFrame, now: Column, policy: CrawlPolicy = CrawlPolicy(), robots: DataFrame | None = None, dns: DataFrame | None = None, touch_ok: Column | None = None) -> Crawled:
    """`seeds`: crawl_id, url, position; `documents`: stored versions (document_id, url, content_hash, fetched_at, etag,
    last_modified). `touch_ok`, of a stored version's columns, says whether its metadata can be renewed.

    Outcomes: crawl_id, url, final_url, depth, visit, document_id, content_hash, passages, age_s, error, FLAGS, COUNTS, body_bytes. A fresh
    page at the last depth is admitted, then skipped without a fetch, where leaves are revalidated; a stale one with a validator is
    asked conditionally, and fetched whole if its metadata can't be renewed. What was fetched is skipped if the
    address it came from at last has a fresh version; else it is extracted and indexed. Links count from whatever page was fetched."""
    if policy.max_pages < 1 or policy.max_depth < 0:
        raise ValueError("max_pages must be positive, max_depth not negative")
    ask = admission(robots, dns, policy.agent, now)
    commits = Commits(spark, f"{folder}/levels")
    done, state = commits.latest()
    levels: list[str] = state.get("levels", [])
    origins = seeds.select("crawl_id", U.origin(F.col("url")).alias("o")).select("crawl_id", "o.*").distinct()
    read = lambda name, part: spark.read.parquet(f"{folder}/parts/{name}/{part}")
    for depth in range(len(levels), policy.max_depth + 1):
        if depth == 0:
            level = seeds.select("crawl_id", U.normalize(F.col("url")).alias("url"), F.lit(0).alias("p"), "position")
        else:
            level = read(levels[-1], "links")
        level = latest_by_key(level, ["crawl_id", "url"], [F.col("p"), F.col("position")])
        if levels:
            visited = reduce(DataFrame.unionByName, (read(n, "outcomes").select("crawl_id", "url") for n in levels))
            level = level.join(visited, ["crawl_id", "url"], "left_anti")
            level = level.join(visited.groupBy("crawl_id").agg(F.count("*").cast("int").alias("before")), "crawl_id")
        else:
            level = level.withColumn("before", F.lit(0))
        # The rank filter keeps at most max_pages rows a crawl before the shuffle.
        level = level.withColumn("n", F.row_number().over(W.partitionBy("crawl_id").orderBy("p", "position", "url"))).filter(F.col("n") <= policy.max_pages)
        level = level.filter(F.col("n") + F.col("before") <= policy.max_pages).select("crawl_id", "url", (F.col("n") + F.col("before")).alias("visit"))
        name = f"{depth}-{uuid.uuid4().hex}"
        _level(spark, f"{folder}/parts/{name}", level, depth, responses, documents, now, policy, ask, origins, touch_ok)
        if not commits.offer(depth, {"levels": [*levels, name]}):
            raise RuntimeError("another crawl works in this folder")
        levels = [*levels, name]
    parts = [reduce(DataFrame.unionByName, (read(n, part) for n in levels)) for part in ("outcomes", "documents", "passages")]
    return Crawled(parts[0], latest_by_key(parts[1], ["document_id"], [F.col("url")]), parts[2].dropDuplicates(["passage_id"]))


def _level(spark, at, level, depth, responses, documents, now, policy, ask, origins, touch_ok) -> None:
    """Writes a level's outcomes, documents, passages and links."""
    window = policy.refresh_after_s
    leaf = policy.revalidate_leaves and window > 0 and depth >= policy.max_depth
    none = lambda kind: F.lit(None).cast(kind)
    level.write.parquet(f"{at}/level")
    level = spark.read.parquet(f"{at}/level")
    urls = level.select("url").distinct()
    # What happens to an address is the same in every crawl of the level.
    known = stored_version(urls, documents, now)
    known = known.withColumn("touch_ok", F.coalesce(touch_ok, F.lit(False)) if touch_ok is not None else F.lit(True))
    fresh = is_fresh(F.col("age_s"), F.lit(window)) if leaf else F.lit(False)
    known.withColumn("fresh_leaf", fresh).write.parquet(f"{at}/known")
    known = spark.read.parquet(f"{at}/known")
    skipped = ask(known.filter("fresh_leaf").select("url")).select("url", "refusal")
    asked = known.filter("NOT fresh_leaf")
    # Validators are sent for leaves alone.
    etag, modified = (F.col(c) if leaf else none("string") for c in ("etag", "last_modified"))
    asked = asked.select("url", etag.alias("if_none_match"), modified.alias("if_modified_since"), "touch_ok")
    conditional = (F.col("if_none_match").isNotNull() | F.col("if_modified_since").isNotNull()).cast("int")
    first = fetch(asked, responses, ask, policy.max_hops, policy.most_bytes).join(asked.select("url", conditional.alias("conditional_gets"), "touch_ok"), "url")
    first.write.parquet(f"{at}/first")
    first = spark.read.parquet(f"{at}/first")
    renewed = F.col("not_modified") & F.col("touch_ok")
    unrenewed = first.filter(F.col("not_modified") & ~F.col("touch_ok"))
    unrenewed = unrenewed if leaf and not unrenewed.isEmpty() else first.limit(0)
    again = fetch(unrenewed.select("url", none("string").alias("if_none_match"), none("string").alias("if_modified_since")), responses, ask, policy.max_hops, policy.most_bytes)
    again = again.join(first.select("url", "conditional_gets"), "url").withColumns({"unconditional_gets": F.lit(1), "touches": F.lit(1)})
    whole = first.filter(~F.col("not_modified")).drop("touch_ok").withColumns({"unconditional_gets": 1 - F.col("conditional_gets"), "touches": F.lit(0)})
    got = whole.unionByName(again)
    got.write.parquet(f"{at}/fetched")
    got = spark.read.parquet(f"{at}/fetched")
    # As of now once more, by the address that was reached.
    if window > 0:
        late = stored_version(got.filter("error IS NULL").select(F.col("final_url").alias("url")).distinct(), documents, now)
        late = late.filter(is_fresh(F.col("age_s"), F.lit(window))).select(F.col("url").alias("final_url"), F.col("document_id").alias("v_id"), F.col("content_hash").alias("v_hash"), F.col("age_s").alias("v_age"))
        got = got.join(late, "final_url", "left")
    else:
        got = got.withColumns({"v_id": none("string"), "v_hash": none("string"), "v_age": none("double")})
    extracted = got.filter("error IS NULL AND v_age IS NULL").select(F.col("final_url").alias("url"), "html").dropDuplicates(["url"])
    docs, passages, indexed = index_pages(extracted)
    docs.write.parquet(f"{at}/documents")
    passages.write.parquet(f"{at}/passages")
    indexed = indexed.select(F.col("url").alias("final_url"), F.col("document_id").alias("i_id"), F.col("content_hash").alias("i_hash"), F.col("indexed").alias("i_ok"), F.col("passages").alias("i_n"), F.col("error").alias("i_error"))
    got.join(indexed, "final_url", "left").write.parquet(f"{at}/answers")  # outcomes and links both read it
    got = spark.read.parquet(f"{at}/answers")
    worked = F.col("error").isNull() & F.col("v_age").isNull()
    same = known.select("url", "document_id", "content_hash", "age_s")
    zero = {c: F.lit(0) for c in COUNTS}
    off = {c: F.lit(False) for c in FLAGS}
    text = {c: none("string") for c in ("document_id", "content_hash", "error")}
    plain = text | off | zero | {"age_s": none("double"), "passages": F.lit(0).cast("long"), "body_bytes": F.lit(0).cast("long")}
    names = ["url", "final_url", *plain]
    ok = F.col("refusal").isNull()
    rows_skipped = skipped.join(same.withColumnsRenamed({c: f"k_{c}" for c in same.columns if c != "url"}), "url").select("url", F.col("url").alias("final_url"), *(v.alias(c) for c, v in (plain | {
        "document_id": F.when(ok, F.col("k_document_id")).cast("string"), "content_hash": F.when(ok, F.col("k_content_hash")), "age_s": F.when(ok, F.col("k_age_s")),
        "error": F.col("refusal"), "freshness_skipped": ok, "network_skipped": ok}).items()))
    rows_renewed = first.filter(renewed).join(same.withColumnsRenamed({c: f"k_{c}" for c in same.columns if c != "url"}), "url").select("url", "final_url", *(v.alias(c) for c, v in (plain | {
        "document_id": F.col("k_document_id").cast("string"), "content_hash": F.col("k_content_hash"), "revalidated": F.lit(True), "conditional_gets": F.lit(1), "touches": F.lit(1)}).items()))
    rows_got = got.select("url", "final_url", *(v.alias(c) for c, v in (plain | {
        "document_id": F.coalesce(F.col("v_id").cast("string"), "i_id"), "content_hash": F.coalesce("v_hash", "i_hash"), "age_s": F.col("v_age"), "error": F.coalesce("error", "i_error"),
        "indexed": F.coalesce("i_ok", F.lit(False)), "freshness_skipped": F.col("v_age").isNotNull(), "passages": F.coalesce("i_n", F.lit(0)).cast("long"), "body_bytes": F.col("body_bytes"),
        "conditional_gets": F.col("conditional_gets"), "unconditional_gets": F.col("unconditional_gets"), "touches": F.col("touches"),
        "extractions": worked.cast("int"), "index_writes": (worked & F.coalesce("i_ok", F.lit(False))).cast("int")}).items()))
    outcomes = rows_skipped.unionByName(rows_renewed).unionByName(rows_got).select(*names)
    level.join(outcomes, "url").withColumn("depth", F.lit(depth)).write.parquet(f"{at}/outcomes")
    links = page_links(got.filter("html IS NOT NULL").select(F.col("final_url").alias("url"), "html").dropDuplicates(["url"]) if depth < policy.max_depth else got.select(F.col("final_url").alias("url"), "html").limit(0))
    # Stored, so that what is asked of a link's parts isn't worked into the expressions that make the link.
    links.write.parquet(f"{at}/found")
    links = spark.read.parquet(f"{at}/found")
    pages = level.join(got.filter("html IS NOT NULL").select("url", F.col("final_url").alias("from")), "url").select("crawl_id", F.col("visit").alias("p"), "from")
    found = links.join(pages, links.url == pages["from"]).select("crawl_id", "p", "position", F.col("link").alias("url"))
    if policy.same_origin:
        o = U.origin(F.col("url"))
        found = found.withColumns({c: o[c] for c in ("scheme", "host", "port")}).join(small(origins), ["crawl_id", "scheme", "host", "port"], "left_semi")
    found.select("crawl_id", "url", "p", "position").write.parquet(f"{at}/links")


def crawl_totals(outcomes: DataFrame, *by: str) -> DataFrame:
    """The counters of a crawl's answer, by crawl or in all."""
    sums = [F.count("*").alias("pages_visited"), F.count_if("indexed").alias("pages_indexed"), F.count_if("freshness_skipped").alias("pages_skipped_fresh"), F.count_if(F.col("freshness_skipped") & F.col("network_skipped")).alias("pages_network_skipped_fresh"), F.count_if("revalidated").alias("pages_revalidated_not_modified")]
    return outcomes.groupBy(*by).agg(*sums) if by else outcomes.agg(*sums)
