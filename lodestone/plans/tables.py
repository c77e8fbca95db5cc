"""Table maintenance, log and contamination queries.

New versions are simulated by id: documents whose id is divisible by 7 have a
changed text, those divisible by 50 a second row under a new id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import operations as O
from ..operators import tables as T
from ..operators.joins import small
from ..session import shared_folder
from .base import sql_collapse, table


def _old(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), X.content_hash(F.col("text")).alias("content_hash"), F.lit("old").alias("version"))


def _new(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 7 = 0 OR doc_id % 50 = 0")
    changed = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("document_id"), F.concat("text", F.lit(" again")).alias("text"))
    added = docs.filter("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000_000).alias("document_id"), "text")
    return changed.union(added).select("document_id", X.content_hash(F.col("text")).alias("content_hash"), F.lit("new").alias("version"))


def upsert_documents(spark, d):
    return T.upsert(_old(spark, d), _new(spark, d), ["document_id"])


def _passages(spark, d):
    """Two stored passages a document, of its old text; changed documents have two of the new as well."""
    both = _old(spark, d).union(_new(spark, d))
    return both.select("document_id", "content_hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))


def stale_chunk_cleanup(spark, d):
    return T.without_stale(_passages(spark, d), T.upsert(_old(spark, d), _new(spark, d), ["document_id"])).select("document_id", "content_hash", "ordinal")


def stale_chunks(spark, d):
    return T.stale(_passages(spark, d), T.upsert(_old(spark, d), _new(spark, d), ["document_id"])).select("document_id", "content_hash", "ordinal")


def _stored(spark, d):
    """The newest event of each user as its stored page version."""
    e = T.latest_by_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return e.select(
        F.col("user_id").alias("document_id"),
        F.col("ts").alias("fetched_at"),
        F.lit(200).alias("http_status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), "event_id")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


def touch_documents(spark, d):
    """Answers a day later: 304 for users divisible by 3, with a new validator where also by 2."""
    s = _stored(spark, d)
    status = F.when(F.col("document_id") % 3 == 0, 304).otherwise(200)
    answers = s.select("document_id", status.alias("http_status"), (F.col("fetched_at") + F.expr("INTERVAL 1 DAY")).alias("fetched_at"), F.when(F.col("document_id") % 2 == 0, F.lit("renewed")).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    return T.touch(s, answers)


def latest_by_key(spark, d):
    return T.latest_by_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type", "value")


def cache_lookup(spark, d):
    """Events write cache entries that live for an hour; at the newest event's time each user asks."""
    e = table(spark, d, "events")
    key = T.cache_key("extract", F.col("user_id").cast("string"), F.lit(""))
    entries = T.cache_entries(e, key, F.col("event_id"), F.col("ts"), 3600 * 24)
    now = e.agg(F.max("ts").alias("now"))
    asked = e.select(key.alias("key"), "user_id").distinct()
    live = entries.crossJoin(F.broadcast(now)).filter("expires_at > now").drop("now")  # now is one row
    return T.cache_lookup(asked, live, F.lit("1900-01-01").cast("timestamp_ntz")).select("user_id", "key", "value", "hit")


def batch_outcomes(spark, d):
    """One row per page; pages too small to hold text are errors."""
    p = table(spark, d, "pages").withColumn("value", F.sha2("html", 256))
    error = F.when(F.octet_length("html") < 1000, F.lit("no indexable content"))
    return O.outcomes(p, "page_id", "value", error)


def _log(spark, d):
    """The events as a request log."""
    t, v, n = F.col("event_type"), F.col("value"), F.col("event_id")
    return table(spark, d, "events").select(
        t.alias("kind"),
        F.when(n % 10 == 3, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        (n % 4 == 0).alias("degraded"),
        (n % 2 == 0).alias("rerank_enabled"),
        (n % 6 == 0).alias("rerank_used"),
        F.when(n % 8 == 2, F.lit("no capacity left")).when(n % 8 == 4, F.lit("model failed")).alias("rerank_reason"),
        F.when(n % 9 == 0, F.lit(-1.0)).otherwise(v).alias("queue_ms"),
        F.when(n % 5 == 0, v).alias("inference_ms"),
    )


def request_metrics(spark, d):
    return O.request_metrics(_log(spark, d))


def request_metrics_by_kind(spark, d):
    return O.request_metrics(_log(spark, d), "kind")


def event_props(spark, d):
    """Properties decoded with an explicit schema; what can't be decoded is null."""
    e = table(spark, d, "events")
    p = F.from_json("props", "k int, page string", {"mode": "PERMISSIVE"})
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), p.isNotNull().alias("decoded"))


def measured_write(spark, d):
    """Totals of a table, from the pass that writes it."""
    e = table(spark, d, "events")
    sums = [F.count("*").alias("n_rows"), F.count_if(F.expr("value > 50")).alias("n_large"), F.sum("event_id").alias("ids"), F.max("event_id").alias("last_id")]
    found = O.measured_write(e, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", *sums)
    return spark.createDataFrame([found], "n_rows bigint, n_large bigint, ids bigint, last_id bigint")


#: Words of a document that are compared with the beginning of a passage.
ANCHOR = 4


def contamination_check(spark, d):
    """Benchmark passages that stand word for word in documents: item_id, n_docs,
    first_doc. Runs of four words anchor the passages; whole runs confirm."""
    words = F.split(X.collapse(F.col("text")), " ")
    items = table(spark, d, "benchmark").select("item_id", words.alias("w")).filter("w[0] <> ''")
    run = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    width = F.least(F.size("w"), F.lit(ANCHOR))
    items = items.select("item_id", F.array_join("w", " ").alias("item"), F.size("w").alias("n"), width.alias("m"), F.array_join(F.slice("w", F.lit(1), width), " ").alias("anchor"))
    widths = [r.m for r in items.select("m").distinct().collect()]  # at most ANCHOR
    docs, found = table(spark, d, "documents").select("doc_id", words.alias("w")), None
    for m in widths:
        # A place is a short row, and lives only if its run of words begins a passage.
        runs = docs.filter(F.size("w") >= m).select("doc_id", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {m - 1}), i -> array_join(slice(w, i, {m}), ' '))")).alias("i", "anchor"))
        hits = runs.join(small(items.filter(F.col("m") == m)), "anchor").select("doc_id", "item_id", "item", "n", "i")
        found = hits if found is None else found.union(hits)
    met = found.join(docs, "doc_id").filter(run("w", F.col("i") + 1, F.col("n")) == F.col("item")) if found is not None else None
    if met is None:
        return table(spark, d, "benchmark").select("item_id", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("first_doc"))
    found = met.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    every = table(spark, d, "benchmark").select("item_id")
    return every.join(found, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "first_doc")


_OLD = f"old AS (SELECT doc_id AS document_id, sha256({sql_collapse('text')}) AS content_hash, 'old' AS version FROM documents)"
_NEW = f"""new AS (SELECT document_id, sha256({sql_collapse("text")}) AS content_hash, 'new' AS version FROM (
  SELECT doc_id AS document_id, text || ' again' AS text FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 50 = 0))"""
_NOW = "now_docs AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new))"
_PASSAGES = "p AS (SELECT document_id, content_hash, unnest([0, 1])::INT AS ordinal FROM (SELECT * FROM old UNION ALL SELECT * FROM new))"
_VERSIONS = f"WITH {_OLD}, {_NEW}, {_NOW}, {_PASSAGES}"
_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"
_STORED = f"{_LATEST}, s AS (SELECT user_id AS document_id, ts AS fetched_at, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS etag FROM l)"
_LOG = """r AS (SELECT event_type AS kind, event_id % 10 <> 3 AS ok, event_id % 4 = 0 AS degraded, event_id % 2 = 0 AS en, event_id % 6 = 0 AS us,
  CASE WHEN event_id % 8 = 2 THEN 'no capacity left' WHEN event_id % 8 = 4 THEN 'model failed' END AS why,
  CASE WHEN event_id % 9 = 0 THEN -1.0 ELSE value END AS q, CASE WHEN event_id % 5 = 0 THEN value END AS i FROM events)"""
_SUMS = """count(*) AS requests, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS backend_errors, count(*) FILTER (ok AND degraded) AS degraded,
  count(*) FILTER (ok AND en) AS rerank_enabled, count(*) FILTER (ok AND us) AS rerank_used, count(*) FILTER (ok AND why IS NOT NULL) AS rerank_degraded,
  count(*) FILTER (ok AND why LIKE '%capacity%') AS capacity_fallbacks, count(*) FILTER (ok AND why NOT LIKE '%capacity%') AS other_degradations,
  count(q) FILTER (ok AND q >= 0) AS queue_ms_count, round(coalesce(sum(q) FILTER (ok AND q >= 0), 0), 6) AS queue_ms_sum, coalesce(max(q) FILTER (ok AND q >= 0), 0) AS queue_ms_max,
  count(i) FILTER (ok AND i >= 0) AS inference_ms_count, round(coalesce(sum(i) FILTER (ok AND i >= 0), 0), 6) AS inference_ms_sum, coalesce(max(i) FILTER (ok AND i >= 0), 0) AS inference_ms_max"""

QUERIES = {
    "upsert_documents": (upsert_documents, f"{_VERSIONS} SELECT * FROM now_docs"),
    "stale_chunk_cleanup": (stale_chunk_cleanup, f"{_VERSIONS} SELECT p.* FROM p JOIN now_docs USING (document_id) WHERE p.content_hash = now_docs.content_hash"),
    "stale_chunks": (stale_chunks, f"{_VERSIONS} SELECT p.* FROM p JOIN now_docs USING (document_id) WHERE p.content_hash <> now_docs.content_hash"),
    "touch_documents": (
        touch_documents,
        f"WITH {_STORED} SELECT document_id, CASE WHEN document_id % 3 = 0 THEN fetched_at + INTERVAL 1 DAY ELSE fetched_at END AS fetched_at, CASE WHEN document_id % 3 = 0 THEN 304 ELSE 200 END AS http_status, CASE WHEN document_id % 6 = 0 THEN 'renewed' ELSE etag END AS etag, NULL::VARCHAR AS last_modified FROM s",
    ),
    "measured_write": (measured_write, "SELECT count(*) AS n_rows, count(*) FILTER (value > 50) AS n_large, sum(event_id)::BIGINT AS ids, max(event_id)::BIGINT AS last_id FROM events"),
    "latest_by_key": (latest_by_key, f"WITH {_LATEST} SELECT user_id, event_id, ts, event_type, value FROM l"),
    "cache_lookup": (
        cache_lookup,
        f"WITH {_LATEST} SELECT user_id, 'extract:' || sha256(user_id || '|') AS key, CASE WHEN live THEN event_id END AS value, live AS hit FROM (SELECT *, ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events) AS live FROM l)",
    ),
    "batch_outcomes": (
        batch_outcomes,
        "SELECT page_id, n >= 1000 AS ok, CASE WHEN n >= 1000 THEN sha256(html) END AS value, CASE WHEN n < 1000 THEN 'no indexable content' END AS error FROM (SELECT *, octet_length(encode(html)) AS n FROM pages)",
    ),
    "request_metrics": (request_metrics, f"WITH {_LOG} SELECT {_SUMS} FROM r"),
    "request_metrics_by_kind": (request_metrics_by_kind, f"WITH {_LOG} SELECT kind, {_SUMS} FROM r GROUP BY kind"),
    "event_props": (event_props, "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS decoded FROM events"),
    "contamination_check": (
        contamination_check,
        f"""WITH b AS (SELECT item_id, ' ' || {sql_collapse("text")} || ' ' AS t FROM benchmark), c AS (SELECT doc_id, ' ' || {sql_collapse("text")} || ' ' AS t FROM documents),
  f AS (SELECT item_id, doc_id FROM b JOIN c ON contains(c.t, b.t) WHERE trim(b.t) <> '')
SELECT item_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id""",
    ),
}
