"""Holdout, identity, JSON and name resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import holdout as H
from .base import table
from .urls import _host, _pages


def documents_json(spark, d):
    return table(spark, d, "documents").select("doc_id", H.canonical_json("doc_id", "lang", "n_chars", "source").alias("json"))


def canonical_rows(spark, d):
    """Rows with structs in an array and in a map, whose fields are not in the order of their names."""
    n = F.col("event_id")
    part = F.struct(F.col("user_id").alias("user"), F.when(n % 3 != 0, n).alias("event"))
    nested = F.struct(F.array(part, part).alias("parts"), F.create_map(F.lit("z"), part, F.lit("b"), part).alias("named"))
    rows = table(spark, d, "events").select("event_id", F.when(n % 5 != 0, nested).alias("nested"), F.col("event_type").alias("kind"))
    return rows.select("event_id", H.canonical_rows(rows, "nested", "kind", "event_id").alias("sha256"))


def canonical_hash(spark, d):
    return table(spark, d, "labels").select("doc_id", H.canonical_hash("doc_id", "quality", "toxic").alias("sha256"))


def holdout_freeze(spark, d):
    """The benchmark's passages against conversations, which have a few of their ids."""
    known = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    return H.holdout_freeze(table(spark, d, "benchmark").select("item_id", "text"), known, "item_id", "text")


def identity_check(spark, d):
    """Documents against those that have a vector of the same id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return H.identity_report(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), ["id"])


def fixture_items(spark, d):
    """Every page is a result of the query of its id modulo 10; even pages are fixtures."""
    results = _pages(spark, d).select((F.col("page_id") % 10).alias("query_id"), "url", F.expr("int(page_id div 10)").alias("rank"))
    fixtures = _pages(spark, d).filter("page_id % 2 = 0").select("url", F.concat(F.lit("p"), "page_id").alias("item"))
    return H.fixture_items(results, fixtures)


def resolved_admission(spark, d):
    """Hosts with a length divisible by 3 resolve to a private address beside a public one, those divisible
    by 7 to nothing; every ninth page's port is none."""
    u = F.col("url")
    target = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("https://"), U.host(u), F.lit(":70000/"))).otherwise(u)
    hosts = _pages(spark, d).select(U.host(u).alias("host")).distinct().filter(F.length("host") % 7 != 0)
    dns = hosts.select("host", F.lit("93.184.216.34").alias("address")).union(hosts.filter(F.length("host") % 3 == 0).select("host", F.lit("10.1.2.3")))
    rows = _pages(spark, d).select("page_id", target.alias("url"))
    return H.resolved_admission(rows, dns).select("page_id", "refusal", "admitted")


def corpus_concat(spark, d):
    """Documents and benchmark passages as one corpus: rows and characters by origin."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select("text", F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"))
    return docs.unionByName(items).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("id").alias("last"))


_ROW = """sha256('{"item_id":' || item_id || ',"text":' || to_json(text) || '}')"""

QUERIES = {
    "documents_json": (documents_json, """SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})::VARCHAR AS json FROM documents"""),
    "canonical_rows": (
        canonical_rows,
        """WITH p AS (SELECT event_id, event_type, '{"event":' || CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR ELSE 'null' END || ',"user":' || coalesce(user_id::VARCHAR, 'null') || '}' AS part FROM events)
SELECT event_id, sha256('{"event_id":' || event_id || ',"kind":' || coalesce('"' || event_type || '"', 'null') || ',"nested":' ||
  CASE WHEN event_id % 5 <> 0 THEN '{"named":{"b":' || part || ',"z":' || part || '},"parts":[' || part || ',' || part || ']}' ELSE 'null' END || '}') AS sha256 FROM p""",
    ),
    "canonical_hash": (canonical_hash, """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}') AS sha256 FROM labels"""),
    "holdout_freeze": (
        holdout_freeze,
        f"""WITH h AS (SELECT item_id, text, {_ROW} AS r FROM benchmark), c AS (SELECT conv_id * 1000 + turn AS item_id, text FROM conversations), k AS (SELECT item_id, text, {_ROW} AS r FROM c),
  x AS (SELECT (SELECT count(*) FROM h) AS n_holdout, (SELECT (sum(('0x' || substring(r, 1, 15))::BIGINT) % 1152921504606846976)::BIGINT FROM h) AS holdout_checksum, (SELECT count(*) FROM k) AS n_known,
        (SELECT (sum(('0x' || substring(r, 1, 15))::BIGINT) % 1152921504606846976)::BIGINT FROM k) AS known_checksum, (SELECT count(*) FROM h WHERE item_id IN (SELECT item_id FROM k)) AS shared_ids, (SELECT count(*) FROM h WHERE text IN (SELECT text FROM k)) AS shared_contents)
SELECT *, shared_ids = 0 AND shared_contents = 0 AND n_holdout > 0 AS frozen FROM x""",
    ),
    "identity_check": (
        identity_check,
        """WITH u AS (SELECT doc_id AS id, 1 AS l, 0 AS v FROM documents UNION ALL SELECT vec_id, 0, 1 FROM embeddings), g AS (SELECT id, max(l) AS l, max(v) AS v FROM u GROUP BY id)
SELECT sum(l)::BIGINT AS n_lexical, sum(v)::BIGINT AS n_vector, count(*) FILTER (l <> v) AS n_apart, count(*) FILTER (l <> v) = 0 AS agree FROM g""",
    ),
    "fixture_items": (
        fixture_items,
        "SELECT page_id % 10 AS query_id, coalesce(item, p.url) AS item, (page_id // 10)::INT AS rank FROM pages p LEFT JOIN (SELECT url, min('p' || page_id) AS item FROM pages WHERE page_id % 2 = 0 GROUP BY url) f ON p.url = f.url",
    ),
    "resolved_admission": (
        resolved_admission,
        f"""WITH t AS (SELECT page_id, length({_host("url")}) AS n FROM pages), w AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'port' WHEN n % 7 = 0 THEN 'not resolved' WHEN n % 3 = 0 THEN 'address' END AS refusal FROM t)
SELECT page_id, refusal, refusal IS NULL AS admitted FROM w""",
    ),
    "corpus_concat": (
        corpus_concat,
        "SELECT 'documents' AS origin, count(*) AS n, sum(length(text))::BIGINT AS chars, max(doc_id) AS last FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT, max(item_id) FROM benchmark",
    ),
}
