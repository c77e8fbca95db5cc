"""Retrieval queries. Query batches: the benchmark passages, and, for vectors,
every vector whose id is divisible by 20, against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators.stored_index import StoredIndex
from ..session import shared_folder
from ..sources import answers as A
from .base import sql_compact, sql_tokens, table

DIM = 64
PER_DOCUMENT = 4  # consecutive vectors are the passages of one document


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.substring_index(t, "\n", 1).alias("title"), t.alias("text"))


TEXT_ONLY = {"text": 1.0}


def _lexical(spark, d, limit):
    return R.lexical_search(_queries(spark, d), _chunks(spark, d), limit, boosts=TEXT_ONLY)


def bm25_topk(spark, d):
    return _lexical(spark, d, 5).select("query_id", F.col("document_id").alias("doc_id"), "score", "rank")


def bm25_fields(spark, d):
    """Titles (first lines) and texts, best field of terms plus best field of exact phrases."""
    options = {"boosts": {"title": 4.0, "text": 1.0}, "phrases": {"title": 7.0, "text": 2.0}}
    found = R.lexical_search(_queries(spark, d), _chunks(spark, d), 10, **options)
    return found.select("query_id", F.col("document_id").alias("doc_id"), "score", "rank")


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.filter(R.valid_vector(F.col("v"), DIM))


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("id % 20 = 0")


def valid_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", R.valid_vector(F.col("embedding"), DIM).alias("valid"))


def vector_storage_check(spark, d):
    from ..operators.tables import vector_storage

    return vector_storage(table(spark, d, "embeddings"), DIM)


def knn_topk(spark, d):
    found = R.vector_search(_vector_queries(spark, d), _vectors(spark, d), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _dense(spark, d, limit):
    return R.dense_search(_vector_queries(spark, d), _vectors(spark, d), limit, F.expr(f"id div {PER_DOCUMENT}"))


def collapse_by_document(spark, d):
    return _dense(spark, d, 10).select("query_id", "document_id", F.col("id").alias("vec_id"), "score", "rank")


def hash_guard(spark, d):
    """Dense hits of current versions: a passage's version is its id modulo 2, a
    document's its id modulo 3, but at most 1."""
    hits = _dense(spark, d, 10).withColumn("content_hash", F.concat(F.lit("v"), F.expr("id % 2")))
    docs = _vectors(spark, d).select(F.expr(f"id div {PER_DOCUMENT}").alias("document_id")).distinct()
    docs = docs.withColumn("content_hash", F.concat(F.lit("v"), F.expr("least(document_id % 3, 1)")))
    return R.current_only(hits, docs).select("query_id", "document_id", F.col("id").alias("vec_id"), "content_hash", "rank")


def _overlap_ranking(spark, d, limit):
    """A second lexical ranking, by titles alone."""
    return R.lexical_search(_queries(spark, d), _chunks(spark, d), limit, boosts={"title": 1.0})


def rrf_fusion(spark, d):
    one, two = _lexical(spark, d, 20), _overlap_ranking(spark, d, 20)
    both = one.select("query_id", F.lit(0).alias("ranking"), "document_id", "rank").union(two.select("query_id", F.lit(1).alias("ranking"), "document_id", "rank"))
    return R.reciprocal_rank_fusion(both, 10).select("query_id", F.col("document_id").alias("doc_id"), "score", "best_rank", "rank")


def hybrid_search(spark, d):
    """Benchmark passages as queries; a query's vector is that of the same id, a
    document's that of its id. Queries without one are degraded."""
    found = _hybrid(spark, d, 10)
    return found.select("query_id", F.col("document_id").alias("doc_id"), "rank", "score", "lexical_rank", "dense_rank", "mode_used", "degraded")


def protected_rerank(spark, d):
    hits = _lexical(spark, d, 12).join(_queries(spark, d), "query_id").join(_chunks(spark, d).select("document_id", "text"), "document_id")
    scored = hits.withColumn("rerank_score", R.overlap_score(F.col("query"), F.col("text")))
    return R.protected_order(scored).select("query_id", F.col("document_id").alias("doc_id"), "rank", "rerank_score", "new_rank")


_BOTH_FIELDS = {"boosts": {"title": 4.0, "text": 1.0}, "phrases": {"title": 7.0, "text": 2.0}}


def _index_path(spark, d, what):
    """A name for the index of a folder's documents as its files are now."""
    files = table(spark, d, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    print_ = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    return f"{shared_folder(spark)}/indexes/{what}-{print_}"


def _index(spark, d) -> StoredIndex:
    """The index that an earlier query has left, else a new one."""
    path, chunks = _index_path(spark, d, "documents-2"), _chunks(spark, d)
    if StoredIndex.exists(spark, path):
        found = StoredIndex(spark, path)
        if found.state["segments"]:
            return found
    return StoredIndex.create(spark, path, chunks.select("document_id", "ordinal").schema, ["title", "text"]).add(chunks)


def index_documents(spark, d):
    """Writes the index of titles and texts, if it isn't there, and says what it holds by field."""
    index = _index(spark, d)
    words = index._read("dictionary").groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    texts = index.texts().groupBy("field").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_tokens"))
    return texts.join(words, "field")


def indexed_search(spark, d):
    """The same as bm25_fields, from an index that an earlier query has left."""
    found = _index(spark, d).search(_queries(spark, d), 10, **_BOTH_FIELDS)
    return found.select("query_id", F.col("document_id").alias("doc_id"), "score", "rank")


def index_update(spark, d):
    """A search after changes: documents with an id divisible by 5 are removed, and of the others those divisible by 7 become their
    first line alone."""
    path, chunks = _index_path(spark, d, f"update-{uuid.uuid4().hex}"), _chunks(spark, d)
    index = StoredIndex.create(spark, path, chunks.select("document_id", "ordinal").schema, ["title", "text"]).add(chunks)
    index = index.remove(chunks.filter("document_id % 5 = 0")).add(chunks.filter("document_id % 7 = 0 AND document_id % 5 <> 0").withColumn("text", F.col("title")))
    found = index.search(_queries(spark, d), 10, **_BOTH_FIELDS)
    return found.select("query_id", F.col("document_id").alias("doc_id"), "score", "rank")


def _hybrid(spark, d, limit):
    vectors = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    asked = _queries(spark, d).filter("query_id % 3 <> 0").select(F.col("query_id").alias("id"))
    q = _vectors(spark, d).join(asked, "id", "left_semi")
    return R.search(_queries(spark, d), _chunks(spark, d), limit, "hybrid", q, vectors, F.col("id"), fallback=False, boosts=TEXT_ONLY)  # a failure is no result here


def rerank_control(spark, d):
    """Five hits a query of the hybrid search, reranked by overlap; the scorer fails for queries divisible by 7."""
    first = _hybrid(spark, d, R.first_stage_limit(5))
    pairs = first.select("query_id", "document_id").join(_queries(spark, d), "query_id").join(_chunks(spark, d).select("document_id", "text"), "document_id")
    scores = pairs.select("query_id", "document_id", F.when(F.col("query_id") % 7 != 0, R.overlap_score(F.col("query"), F.col("text"))).alias("rerank_score"))
    found = R.rerank_control(first, scores, 5)
    return found.select("query_id", F.col("document_id").alias("doc_id"), "position", "score", "rerank_used", "rerank_degraded", "rerank_reason")


def result_envelope(spark, d):
    """Hits as a caller gets them; documents with an id divisible by 11 have no url and drop out."""
    hits = _lexical(spark, d, 10).join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "text"), "document_id")
    url = F.when(F.col("document_id") % 11 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), "document_id"))
    return hits.withColumn("url", url).filter("url IS NOT NULL").select("query_id", F.coalesce(F.split("text", "\n")[0], F.lit("")).alias("title"), "url", X.compact(F.col("text")).alias("description"), F.col("rank").alias("position"))


def answer_sink(spark, d):
    """Answers of five hits, written to the line sink and read back; hits lack a url, title or position by their document's id, and
    every ninth query's answer is an error."""
    n = F.col("document_id")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "text")
    hits = _lexical(spark, d, 5).join(texts, "document_id").select(
        "query_id", "rank",
        F.when(n % 5 != 0, F.split("text", "\n")[0]).alias("title"),
        F.when(n % 11 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), n)).alias("url"),
        X.compact(F.col("text")).alias("description"),
        F.when(n % 3 != 0, F.col("rank") + 10).alias("position"),
    )
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    found = A.answers(asked, hits, F.when(F.col("query_id") % 9 == 0, "search failed"))
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    A.write_lines(found.select(F.to_json(F.struct("query_id", "answer")).alias("value")), folder)
    read = A.read_lines(spark, folder).select(F.from_json("value", "query_id bigint, answer string").alias("v")).select("v.query_id", F.from_json("v.answer", A.ANSWER).alias("a"))
    return read.select("query_id", "a.success", "a.error", F.explode_outer("a.data.web").alias("w")).select("query_id", "success", "error", "w.title", "w.url", "w.description", "w.position")


_QUANT = "(CASE WHEN dl < 40 THEN dl::DOUBLE ELSE 24 + floor((dl - 24) / pow(2, greatest(floor(log2(dl - 24 + 0.5)) - 3, 0))) * pow(2, greatest(floor(log2(dl - 24 + 0.5)) - 3, 0)) END)"


def _field_sql(name: str, field: str) -> str:
    """CTEs with term scores s_<name> and phrase scores p_<name> of a field."""
    return f"""
  d_{name} AS (SELECT doc_id, {sql_tokens(field)} AS toks FROM documents),
  n_{name} AS (SELECT doc_id, toks, len(toks) AS dl FROM d_{name} WHERE len(toks) > 0),
  st_{name} AS (SELECT count(*)::DOUBLE AS n_docs, sum(dl)::DOUBLE / count(*) AS avg_len FROM n_{name}),
  tf_{name} AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(toks) AS term FROM n_{name}) GROUP BY ALL),
  w_{name} AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf_{name}, st_{name} GROUP BY term, n_docs),
  s_{name} AS (SELECT query_id, doc_id, sum(qtf * idf * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * {_QUANT} / avg_len))) AS score
               FROM qt JOIN tf_{name} USING (term) JOIN w_{name} USING (term), st_{name} GROUP BY query_id, doc_id),
  i_{name} AS (SELECT query_id, sum(qtf * idf) AS idf_sum FROM qt JOIN w_{name} USING (term) GROUP BY query_id),
  c_{name} AS (SELECT query_id, doc_id, dl, idf_sum, len(list_filter(range(1, greatest(1, dl - len(qtoks) + 1) + 1), lambda i: toks[i:i + len(qtoks) - 1] = qtoks)) AS tf
               FROM q JOIN i_{name} USING (query_id) JOIN s_{name} USING (query_id) JOIN n_{name} USING (doc_id)
               WHERE len(list_filter(list_distinct(qtoks), lambda t: list_contains(toks, t))) = len(list_distinct(qtoks))),
  p_{name} AS (SELECT query_id, doc_id, idf_sum * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * {_QUANT} / avg_len)) AS score FROM c_{name}, st_{name} WHERE tf > 0)"""


_Q = f"""
  q AS (SELECT item_id AS query_id, {sql_tokens("text")} AS qtoks FROM benchmark WHERE len({sql_tokens("text")}) > 0),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(qtoks) AS term FROM q) GROUP BY ALL)"""


def _top(source: str, limit: int, out: str) -> str:
    return f"""
  {out} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {source}) WHERE rank <= {limit})"""


_TEXT = f"WITH {_Q}, {_field_sql('x', 'text')}, h AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s_x)"
_BOTH = f"""WITH {_Q}, {_field_sql("x", "text")}, {_field_sql("t", "split_part(text, chr(10), 1)")},
  u AS (SELECT query_id, doc_id, 't' AS c, score * 4 AS score FROM s_t UNION ALL SELECT query_id, doc_id, 't', score FROM s_x
        UNION ALL SELECT query_id, doc_id, 'p', score * 7 FROM p_t UNION ALL SELECT query_id, doc_id, 'p', score * 2 FROM p_x),
  h AS (SELECT query_id, doc_id, round(coalesce(max(score) FILTER (c = 't'), 0) + coalesce(max(score) FILTER (c = 'p'), 0), 6) AS score FROM u GROUP BY ALL)"""
_TITLE = f"{_TEXT}, {_field_sql('t', 'split_part(text, chr(10), 1)')}, g AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s_t)"

_KNN = """
  v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  a AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) + 0 AS score FROM v q, v WHERE q.vec_id % 20 = 0)"""
_POOL = f"""{_KNN},
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM a),
  c AS (SELECT query_id, vec_id, vec_id // 4 AS document_id, score FROM b WHERE n <= 500),
  e AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, vec_id) AS m FROM c),
  f AS (SELECT query_id, document_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INT AS rank FROM e WHERE m = 1),
  dense AS (SELECT * FROM f WHERE rank <= 10)"""


def _rrf(one: str, two: str, limit: int) -> str:
    return f"""
  rr AS (SELECT query_id, doc_id, min(rank) FILTER (k = 0) AS r0, min(rank) FILTER (k = 1) AS r1
         FROM (SELECT query_id, doc_id, rank, 0 AS k FROM {one} UNION ALL SELECT query_id, doc_id, rank, 1 FROM {two}) GROUP BY ALL),
  rs AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 12) AS score, least(r0, r1) AS best_rank FROM rr),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id)::INT AS rank FROM rs) WHERE rank <= {limit})"""


_FUSED = f"""{_TEXT}, {_top("h", 10, "lex")},
  v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  da AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.e, v.e), 6) + 0 AS score
         FROM v q JOIN benchmark b ON b.item_id = q.vec_id, v WHERE b.item_id % 3 <> 0 AND v.vec_id IN (SELECT doc_id FROM documents)),
  {_top("da", 10, "den")}, {_rrf("lex", "den", 10)}"""
_HYBRID = f"""{_FUSED}
SELECT query_id, doc_id, rank, score, r0 AS lexical_rank, r1 AS dense_rank,
       CASE WHEN query_id IN (SELECT query_id FROM den) THEN 'hybrid' ELSE 'bm25' END AS mode_used,
       query_id NOT IN (SELECT query_id FROM den) AS degraded FROM fused"""

QUERIES = {
    "bm25_topk": (bm25_topk, f"{_TEXT}, {_top('h', 5, 'top')} SELECT * FROM top"),
    "bm25_fields": (bm25_fields, f"{_BOTH}, {_top('h', 10, 'top')} SELECT * FROM top"),
    "index_documents": (
        index_documents,
        f"""WITH f AS (SELECT 'text' AS field, {sql_tokens("text")} AS toks FROM documents UNION ALL SELECT 'title', {sql_tokens("split_part(text, chr(10), 1)")} FROM documents),
  t AS (SELECT field, term, count(*) AS df FROM (SELECT field, unnest(list_distinct(toks)) AS term FROM f) GROUP BY ALL),
  w AS (SELECT field, count(*) AS n_terms, sum(df)::BIGINT AS n_postings FROM t GROUP BY field)
SELECT field, count(*) AS n_chunks, sum(len(toks))::BIGINT AS n_tokens, n_terms, n_postings FROM f JOIN w USING (field) WHERE len(toks) > 0 GROUP BY ALL""",
    ),
    "indexed_search": (indexed_search, f"{_BOTH}, {_top('h', 10, 'top')} SELECT * FROM top"),
    "index_update": (
        index_update,
        f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
{_BOTH.removeprefix("WITH").replace("FROM documents", "FROM changed")}, {_top("h", 10, "top")} SELECT * FROM top""",
    ),
    "valid_vectors": (
        valid_vectors,
        f"SELECT vec_id, coalesce(len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS valid FROM embeddings",
    ),
    "vector_storage_check": (
        vector_storage_check,
        f"SELECT count(*) AS n_vectors, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, count(*) FILTER (len(embedding) <> {DIM} OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_invalid FROM embeddings",
    ),
    "knn_topk": (knn_topk, f"WITH {_KNN} SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM a) WHERE rank <= 10"),
    "collapse_by_document": (collapse_by_document, f"WITH {_POOL} SELECT query_id, document_id, vec_id, score, rank FROM dense"),
    "hash_guard": (
        hash_guard,
        f"WITH {_POOL} SELECT query_id, document_id, vec_id, 'v' || (vec_id % 2) AS content_hash, rank FROM dense WHERE vec_id % 2 = least(document_id % 3, 1)",
    ),
    "rrf_fusion": (rrf_fusion, f"{_TITLE}, {_top('h', 20, 'lex')}, {_top('g', 20, 'ttl')}, {_rrf('lex', 'ttl', 10)} SELECT query_id, doc_id, score, best_rank, rank FROM fused"),
    "hybrid_search": (hybrid_search, _HYBRID),
    "protected_rerank": (
        protected_rerank,
        f"""{_TEXT}, {_top("h", 12, "lex")},
  z AS (SELECT query_id, doc_id, rank, round(len(list_filter(list_distinct(qtoks), lambda t: list_contains(toks, t)))::DOUBLE / greatest(len(list_distinct(qtoks)), 1), 6) AS rerank_score
        FROM lex JOIN q USING (query_id) JOIN d_x USING (doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 5 THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END, CASE WHEN rank <= 10 THEN -rerank_score END, rank)::INT AS new_rank FROM z""",
    ),
    "rerank_control": (
        rerank_control,
        f"""{_FUSED},
  z AS (SELECT query_id, doc_id, rank, score, query_id NOT IN (SELECT query_id FROM den) AS deg,
        round(len(list_filter(list_distinct(qtoks), lambda t: list_contains(toks, t)))::DOUBLE / greatest(len(list_distinct(qtoks)), 1), 6) AS z FROM fused JOIN q USING (query_id) JOIN d_x USING (doc_id)),
  y AS (SELECT *, CASE WHEN deg THEN 'the first stage is degraded' WHEN query_id % 7 = 0 THEN 'the scorer failed' END AS why FROM z),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN why IS NULL AND rank > 5 THEN 1 ELSE 0 END, CASE WHEN why IS NULL THEN -z END, rank)::INT AS position FROM y)
SELECT query_id, doc_id, position, score, why IS NULL AS rerank_used, why IS NOT NULL AS rerank_degraded, why AS rerank_reason FROM p WHERE position <= 5""",
    ),
    "result_envelope": (
        result_envelope,
        f"""{_TEXT}, {_top("h", 10, "lex")}
SELECT query_id, split_part(text, chr(10), 1) AS title, 'https://' || source || '.example/' || doc_id AS url, {sql_compact("text")} AS description, rank AS position
FROM lex JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0""",
    ),
    "answer_sink": (
        answer_sink,
        f"""{_TEXT}, {_top("h", 5, "lex")},
  web AS (SELECT query_id, CASE WHEN doc_id % 5 <> 0 THEN coalesce(split_part(text, chr(10), 1), '') ELSE '' END AS title, 'https://' || source || '.example/' || doc_id AS url,
          {sql_compact("text")} AS description, CASE WHEN doc_id % 3 <> 0 THEN rank + 10 ELSE rank END AS position
          FROM lex JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0 AND query_id % 9 <> 0)
SELECT item_id AS query_id, item_id % 9 <> 0 AS success, CASE WHEN item_id % 9 = 0 THEN 'search failed' END AS error, title, url, description, position
FROM benchmark LEFT JOIN web ON query_id = item_id""",
    ),
}
