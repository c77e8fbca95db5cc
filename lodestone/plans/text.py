"""Text and passage queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import passages as P
from .base import sql_approx_tokens, sql_collapse, sql_compact, sql_tokens, table

BUDGET, MOST = 200, 3


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def exact_duplicates(spark, d):
    hashed = content_hash(spark, d)
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def term_statistics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_freq"))


def corpus_statistics(spark, d):
    n = F.size(X.tokens(F.col("text")))
    docs = table(spark, d, "documents").select(n.alias("n")).filter("n > 0")
    return docs.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.sum("n") / F.count("*"), 6).alias("avg_len"))


def compact_description(spark, d):
    return table(spark, d, "documents").select("doc_id", X.compact(F.col("text")).alias("description"))


def clean_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_markdown(F.col("text")).alias("markdown"))


def passage_text(spark, d):
    t = _turns(spark, d)
    return t.select("conv_id", "turn", X.passage_text("passage: ", F.col("role"), F.col("text")).alias("passage"))


def passages(spark, d):
    return P.passage_table(table(spark, d, "documents"), "doc_id").withColumn("section_path", X.section_path(F.col("section_path")))


def passages_lateral(spark, d):
    """The same as `passages`, by the table function and a lateral join."""
    P.register_passages(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = spark.sql("SELECT doc_id, p.* FROM {docs}, LATERAL passages(text) p", docs=docs)
    return made.withColumn("section_path", X.section_path(F.col("section_path")))


def _asked(spark, d):
    first = F.first("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return _turns(spark, d).withColumn("query", first)


def _ranked_by_words(spark, d):
    return P.ranked_passages(_asked(spark, d), "conv_id", "turn", "query", "role")


def _ranked(spark, d):
    # The registered SQL divides by the token estimate, where the operator's own measure is words.
    return P.ranked_passages(_asked(spark, d), "conv_id", "turn", "query", "role", size=X.approx_tokens(F.col("text")))


def passage_ranking(spark, d):
    ranked = _ranked(spark, d)
    return ranked.select("conv_id", "turn", "matches", "heading_matches", "score", "rank")


def passage_ranking_words(spark, d):
    """The ranking with the operator's own measure of density, occurrences by words."""
    return _ranked_by_words(spark, d).select("conv_id", "turn", "matches", "heading_matches", "score", "rank")


def context_window(spark, d):
    chosen = P.within_budget(_turns(spark, d), "conv_id", "turn", BUDGET, MOST)
    return P.contexts(chosen, "conv_id", "turn")


def query_context(spark, d):
    """Contexts of the passages that rank best for each conversation's first turn."""
    ranked = _ranked(spark, d)
    return P.contexts(P.within_budget(ranked, "conv_id", "rank", BUDGET, MOST), "conv_id", "turn")


def query_context_words(spark, d):
    """As `query_context`, of the passages that rank best by words."""
    return P.contexts(P.within_budget(_ranked_by_words(spark, d), "conv_id", "rank", BUDGET, MOST), "conv_id", "turn")


_RANKED = f"""
  a AS (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations),
  b AS (SELECT *, lower(text) AS body, lower(coalesce(role, '')) AS head,
               list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_.-]+'), lambda x: length(x) > 1)) AS terms FROM a),
  c AS (SELECT *, coalesce(list_sum(list_transform(terms, lambda t: (length(body) - length(replace(body, t, ''))) // length(t))), 0)::BIGINT AS matches,
               len(list_filter(terms, lambda t: contains(head, t)))::INT AS heading_matches FROM b),
  r AS (SELECT *, round(4.0::DOUBLE * heading_matches + matches + 100.0::DOUBLE * (matches::DOUBLE / greatest(1, {sql_approx_tokens("text")})), 6) AS score FROM c),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::INT AS rank FROM r)"""
_RANKED_BY_WORDS = _RANKED.replace(f"greatest(1, {sql_approx_tokens('text')})", r"greatest(1, len(regexp_extract_all(body, '[\p{L}\p{N}_.-]+')))")


def _budget_sql(source: str, order: str) -> str:
    clip = "(CASE WHEN length(rtrim(substring(text, 1, 3 * room))) > 3 * room - 4 THEN rtrim(substring(text, 1, greatest(0, 3 * room - 4))) ELSE rtrim(substring(text, 1, 3 * room)) END || ' …')"
    return f"""
  t AS (SELECT *, {sql_approx_tokens("text")} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS i FROM {source}),
  u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) + 3 * (i - 1) AS used FROM t),
  v AS (SELECT *, ({BUDGET} - (used - n))::BIGINT AS room FROM u WHERE i <= {MOST}),
  w AS (SELECT conv_id, turn, CASE WHEN used <= {BUDGET} THEN text
               WHEN (i = 1 OR used - n - 3 <= {BUDGET}) AND room > 0 AND length(rtrim(substring(text, 1, 3 * room))) > 0 THEN {clip} END AS piece FROM v),
  x AS (SELECT conv_id, string_agg(piece, E'\\n\\n---\\n\\n' ORDER BY turn) AS context, count(*) AS n_passages FROM w WHERE piece IS NOT NULL GROUP BY conv_id)
SELECT conv_id, context, n_passages, {sql_approx_tokens("context")} AS n_tokens FROM x"""


QUERIES = {
    "approx_tokens": (approx_tokens, f"SELECT doc_id, {sql_approx_tokens('text')} AS tokens FROM documents"),
    "content_hash": (content_hash, f"SELECT doc_id, sha256({sql_collapse('text')}) AS content_hash FROM documents"),
    "exact_duplicates": (
        exact_duplicates,
        f"SELECT sha256({sql_collapse('text')}) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "term_statistics": (
        term_statistics,
        f"SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term",
    ),
    "corpus_statistics": (
        corpus_statistics,
        f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(sum(n) / count(*), 6) AS avg_len FROM (SELECT len({sql_tokens('text')}) AS n FROM documents) WHERE n > 0",
    ),
    "compact_description": (compact_description, f"SELECT doc_id, {sql_compact('text')} AS description FROM documents"),
    "clean_markdown": (
        clean_markdown,
        r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+\n', E'\n', 'g'), '\n{4,}', E'\n\n\n', 'g'), '^\s+', ''), '\s+$', '') AS markdown FROM documents",
    ),
    "passage_text": (
        passage_text,
        "SELECT conv_id, turn, 'passage: ' || array_to_string(list_filter([trim(coalesce(role, '')), trim(coalesce(text, ''))], lambda x: x <> ''), E'\\n') AS passage FROM conversations",
    ),
    "passages": (passages, None),
    "passages_lateral": (passages_lateral, None),
    "passage_ranking": (passage_ranking, f"WITH {_RANKED} SELECT conv_id, turn, matches, heading_matches, score, rank FROM ranked"),
    "context_window": (context_window, "WITH " + _budget_sql("conversations", "turn")),
    "query_context": (query_context, f"WITH {_RANKED}, " + _budget_sql("ranked", "rank")),
    "passage_ranking_words": (passage_ranking_words, f"WITH {_RANKED_BY_WORDS} SELECT conv_id, turn, matches, heading_matches, score, rank FROM ranked"),
    "query_context_words": (query_context_words, f"WITH {_RANKED_BY_WORDS}, " + _budget_sql("ranked", "rank")),
}
