"""Retrieval for tables of queries: BM25, exact vector search, collapse, hash
guard, reciprocal-rank fusion and membership-preserving rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import tokens
from ..session import written
from .joins import small, top_k

K1, B = 1.2, 0.75
TERM_BOOSTS = {"title": 4.0, "section_path": 2.0, "text": 1.0}
PHRASE_BOOSTS = {"title": 7.0, "section_path": 4.0, "text": 2.0}
RRF_K = 60
POOL, PROTECTED = 10, 5


def _positive(**values: int) -> None:
    for name, v in values.items():
        if v <= 0:
            raise ValueError(f"{name} must be positive, not {v}")


# --- BM25 ---------------------------------------------------------------------


def quantised(length: Column) -> Column:
    """A field length as an index keeps it: exact below 40, then 24 plus the rest
    cut to its four leading bits."""
    rest = (length - 24).cast("long")
    bits = F.greatest(F.floor(F.log2(rest.cast("double") + 0.5)).cast("int") - 3, F.lit(0))
    step = F.pow(F.lit(2.0), bits)
    return F.when(length < 40, length.cast("double")).otherwise(24.0 + F.floor(rest / step) * step)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * quantised(length) / average))


class LexicalIndex(NamedTuple):
    """What a lexical search reads, by field: `texts` (key, dl, toks), `postings` (term, key, dl, tf) where they
    are stored, and the number of chunks that have the field with their mean length."""

    key: list[str]
    texts: dict[str, DataFrame]
    postings: dict[str, DataFrame]
    stats: dict[str, tuple[int, float]]


def lexical_index(chunks: DataFrame, key: list[str], fields, postings: bool = False) -> LexicalIndex:
    """Tokenises each field once. With `postings` these are stored too, ranged by term, so that a search
    reads the row groups of the terms it has and no texts but those that may hold a phrase."""
    texts, stored, stats = {}, {}, {}
    for field in fields:
        toks = chunks.select(*key, tokens(F.col(field)).alias("toks")).filter(F.size("toks") > 0)
        texts[field] = written(toks.select(*key, F.size("toks").alias("dl"), "toks"), f"texts-{field}")
        n, total = texts[field].agg(F.count("*"), F.sum("dl")).first()
        stats[field] = n, (total or 0) / max(n, 1)
        if postings:
            rows = _postings(texts[field], key).repartitionByRange("term").sortWithinPartitions("term")
            stored[field] = written(rows, f"postings-{field}")
    return LexicalIndex(list(key), texts, stored, stats)


def _postings(texts: DataFrame, key: list[str], wanted: DataFrame | None = None) -> DataFrame:
    rows = texts.select(F.explode("toks").alias("term"), *key, "dl")
    rows = rows if wanted is None else rows.join(wanted, "term")  # other tokens are dropped before anything is shuffled
    return rows.groupBy("term", *key, "dl").agg(F.count("*").alias("tf"))


def _clauses(queries: DataFrame, index: LexicalIndex, field: str, phrase: bool) -> tuple[DataFrame, DataFrame | None]:
    """Term and phrase scores of one field: (query_id, *key, score)."""
    key, texts, (n_docs, average) = index.key, index.texts[field], index.stats[field]
    length = F.lit(average)
    q = queries.select("query_id", tokens(F.col("query")).alias("qtoks")).filter(F.size("qtoks") > 0)
    terms = q.select("query_id", F.explode("qtoks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = small(terms.select("term").distinct())
    if field in index.postings:
        postings = index.postings[field].join(wanted, "term")
    else:
        postings = written(_postings(texts, key, wanted), f"postings-{field}")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = written(terms.join(df.select("term", idf(F.lit(n_docs), F.col("df")).alias("idf")), "term"), f"weights-{field}")
    hits = postings.join(small(weights), "term")
    part = F.col("qtf") * F.col("idf") * saturated(F.col("tf"), F.col("dl"), length)
    scored = hits.groupBy("query_id", *key).agg(F.sum(part).alias("score"), F.count("*").alias("met"))
    if not phrase:
        return scored.select("query_id", *key, "score"), None
    # A phrase can only stand where all of its terms do: few texts are looked at.
    whole = q.select("query_id", "qtoks", F.size(F.array_distinct("qtoks")).alias("need"))
    idfs = weights.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf")).alias("idf_sum"))
    scored = written(scored, f"scores-{field}")
    near = scored.join(small(whole.join(idfs, "query_id")), "query_id").filter("met = need")
    near = near.join(texts.join(small(near.select(*key).distinct()), key, "left_semi"), key)
    runs = F.expr("size(filter(sequence(1, greatest(1, size(toks) - size(qtoks) + 1)), i -> slice(toks, i, size(qtoks)) = qtoks))")
    near = near.withColumn("tf", runs).filter("tf > 0")
    return scored.select("query_id", *key, "score"), near.select("query_id", *key, (F.col("idf_sum") * saturated(F.col("tf"), F.col("dl"), length)).alias("score"))


def bm25(queries: DataFrame, chunks: DataFrame | LexicalIndex, key: list[str], boosts: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """(query_id, *key, score): the best field of the term clause plus the best
    field of the exact-phrase clause, rounded to 6 decimals. `queries` has
    query_id and query; `chunks` may be an index of them. Statistics are of all chunks that have the field."""
    boosts = TERM_BOOSTS if boosts is None else boosts
    phrases = {} if phrases is None else phrases
    index = chunks if isinstance(chunks, LexicalIndex) else lexical_index(chunks, key, boosts)
    parts = []
    for field, boost in boosts.items():
        term, phrase = _clauses(queries, index, field, field in phrases)
        parts.append(term.select("query_id", *key, F.lit("t").alias("clause"), (F.col("score") * boost).alias("score")))
        if phrase is not None:
            parts.append(phrase.select("query_id", *key, F.lit("p").alias("clause"), (F.col("score") * phrases[field]).alias("score")))
    if len(parts) == 1:
        return parts[0].select("query_id", *key, F.round("score", 6).alias("score"))
    both = reduce(DataFrame.union, parts).groupBy("query_id", *key)
    best = both.agg(*(F.max(F.when(F.col("clause") == c, F.col("score"))).alias(c) for c in "tp"))
    total = F.coalesce("t", F.lit(0.0)) + F.coalesce("p", F.lit(0.0))
    return best.select("query_id", *key, F.round(total, 6).alias("score"))


def collapse(hits: DataFrame, document: str, tie: list[str]) -> DataFrame:
    """The best hit of each (query, document)."""
    return top_k(hits, ["query_id", document], [F.desc("score"), *tie], 1, "__n").drop("__n")


#: Chunks and token bytes of a packed block, and queries of a block that meets it: scores of 512 x 128 at a time.
BLOCK_CHUNKS, BLOCK_TOKENS, BLOCK_QUERIES = 512, 200_000, 128
BLOCK_WEIGHTS = 200_000  # terms of queries that are broadcast: some 10 MB


def tokenised(chunks: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(*key, toks_0, toks_1, ...): the tokens of each field with blanks between them, a row a chunk: one value is stored and
    sent to Python much faster than an array."""
    return chunks.select(*key, *(F.array_join(tokens(F.col(f)), " ").alias(f"toks_{k}") for k, f in enumerate(fields)))


def split_tokens(toks: Column) -> Column:
    """Tokens with blanks between them as an array; null for none."""
    return F.when(toks != "", F.split(toks, " "))


def n_tokens(toks: Column) -> Column:
    return F.when(toks != "", F.length(toks) - F.length(F.replace(toks, F.lit(" "), F.lit(""))) + 1).otherwise(0)


def field_stats(rows: DataFrame, fields: list[str]) -> dict[str, list[int]]:
    """[chunks that have the field, their tokens] by field, of tokenised chunks."""
    size = [n_tokens(F.col(f"toks_{k}")) for k in range(len(fields))]
    found = rows.agg(*(x for n in size for x in (F.count_if(n > 0), F.coalesce(F.sum(n), F.lit(0))))).first()
    return {f: [found[2 * k], found[2 * k + 1]] for k, f in enumerate(fields)}


def _together(index: LexicalIndex, fields: list[str]) -> DataFrame:
    """The index's chunks as `tokenised` has them."""
    parts = [index.texts[f].select(*index.key, F.array_join("toks", " ").alias(f"toks_{k}")) for k, f in enumerate(fields)]
    return reduce(lambda a, b: a.join(b, index.key, "full"), parts)


def _term_weights(queries: DataFrame, toks: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, w): the term's frequency in the query times its idf in the field whose tokens these are."""
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    terms = q.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = small(terms.select("term").distinct())
    df = toks.toDF("toks").select(F.explode(F.array_distinct(split_tokens(F.col("toks")))).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(n_docs), F.col("df"))).alias("w"))


def _ipc(batch) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _chunk_blocks(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows as Arrow blocks of at most BLOCK_CHUNKS of them; a block ends where its tokens are many."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sizes = sum(pc.fill_null(pc.count_substring(b.column(c), " "), 0).to_numpy() + 1 for c in lists)
            at, held = 0, 0.0
            for k, n in enumerate(sizes):
                if k > at and (k - at >= BLOCK_CHUNKS or held + n > BLOCK_TOKENS):
                    yield pa.RecordBatch.from_arrays([pa.array([_ipc(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, k))) for c in b.columns], names=b.schema.names))], pa.binary())], names=["chunks"])
                    at, held = k, 0.0
                held += n
            if b.num_rows > at:
                yield pa.RecordBatch.from_arrays([pa.array([_ipc(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, b.num_rows))) for c in b.columns], names=b.schema.names))], pa.binary())], names=["chunks"])

    return rows.mapInArrow(run, "chunks binary")


def _block_scores(starts, ids, w, k1_norm) -> np.ndarray:
    """Chunks by queries: sums of w[term] * saturated frequency over a chunk's tokens, which `ids` names (-1: not asked for)."""
    out = np.zeros((len(starts) - 1, w.shape[1]))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    met = ids >= 0
    pairs, tf = np.unique(row[met] * len(w) + ids[met], return_counts=True)
    r, t = pairs // max(len(w), 1), pairs % max(len(w), 1)
    weight = tf / (tf + k1_norm[r])
    for at in np.searchsorted(r, np.arange(0, len(out), 32)):  # some rows at a time: a row of w for each of their terms
        to = np.searchsorted(r, r[at] // 32 * 32 + 32) if at < len(r) else at
        if to > at:
            rows, first = np.unique(r[at:to], return_index=True)
            out[rows] = np.add.reduceat(w[t[at:to]] * weight[at:to, None], first, axis=0)
    return out


def _phrase_counts(starts, ids, n_terms, phrases) -> Iterator[tuple]:
    """(number of a phrase, chunks that it stands in, how often). Only places of its term that is rarest here are looked at."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    seen = np.bincount(ids[ids >= 0], minlength=n_terms)
    for k, phrase in enumerate(phrases):
        if not len(phrase) or phrase.min() < 0 or not seen[phrase].all():
            continue
        at = int(np.argmin(seen[phrase]))
        place = np.flatnonzero(ids == phrase[at]) - at
        place = place[(place >= 0) & (place + len(phrase) <= len(ids))]
        place = place[row[place] == row[place + len(phrase) - 1]]
        for n, term in enumerate(phrase):
            if not len(place):
                break
            place = place[ids[place + n] == term]
        if len(place):
            yield k, *np.unique(row[place], return_counts=True)


def lexical_search(queries: DataFrame, chunks: DataFrame | LexicalIndex, limit: int, document: str = "document_id", ordinal: str = "ordinal", boosts: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """Collapsed top documents of each query by BM25: query_id, document, ordinal, score, rank."""
    _positive(limit=limit)
    boosts = TERM_BOOSTS if boosts is None else boosts
    key, fields = [document, ordinal], list(boosts)
    if isinstance(chunks, LexicalIndex):
        rows, stats = _together(chunks, fields), chunks.stats
    else:
        rows = written(tokenised(chunks, key, fields), "texts")
        stats = {f: (n, total / max(n, 1)) for f, (n, total) in field_stats(rows, fields).items()}
    weights = [_term_weights(queries, rows.select(f"toks_{k}"), stats[f][0]).withColumn("field", F.lit(k)) for k, f in enumerate(fields)]
    weights = written(reduce(DataFrame.union, weights), "weights")
    return block_search(queries, rows, key, weights, {f: stats[f][1] for f in fields}, limit, boosts, phrases or {})


def block_search(queries: DataFrame, rows: DataFrame, key: list[str], weights: DataFrame, averages: dict[str, float], limit: int, boosts: dict, phrases: dict) -> DataFrame:
    """The same as collapsed and ranked `bm25`, over tokenised chunks and `weights` (query_id, field's number, term, w). Blocks of
    chunks meet blocks of queries, and each such pair keeps its `limit` best documents of a query: no row a query and chunk is
    shuffled, and a task holds a pair of blocks. Phrases are counted in the blocks' tokens."""
    document, fields = key[0], list(averages)
    # Blocks of queries: numbered by their ids' hashes, so that a block has about BLOCK_QUERIES of them.
    n_queries = weights.select("query_id").distinct().count()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // BLOCK_QUERIES)))).alias("b")
    asked = weights.groupBy(block).agg(F.collect_list(F.struct("query_id", "field", "term", "w")).alias("asked"))
    said = queries.select("query_id", tokens(F.col("query")).alias("qtoks")).filter((F.size("qtoks") > 0) & F.lit(bool(phrases)))
    said = said.groupBy(block).agg(F.collect_list(F.struct("query_id", "qtoks")).alias("said"))
    asked = asked.join(said, "b", "left").select("asked", "said")
    if weights.limit(BLOCK_WEIGHTS + 1).count() <= BLOCK_WEIGHTS:
        asked = F.broadcast(asked)
    lists = [f"toks_{k}" for k in range(len(fields))]
    kinds = {f.name: f.dataType for f in [*rows.schema.fields, weights.schema["query_id"]]}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), *(T.StructField(c, kinds[c]) for c in key), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for packed, table, phrased in zip(b.column("chunks"), b.column("asked"), b.column("said")):
                block = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks().to_batches()[0]
                block = block.take(pc.sort_indices(block, [(c, "ascending") for c in key], null_placement="at_start"))
                rows = table.values
                ids = rows.field("query_id").dictionary_encode()
                query, of_field, w = ids.indices.to_numpy(), rows.field("field").to_numpy(), rows.field("w").to_numpy()
                best = np.zeros((block.num_rows, len(ids.dictionary)))
                near = np.zeros_like(best)
                if phrases and phrased.is_valid:
                    by = pc.fill_null(pc.index_in(phrased.values.field("query_id"), value_set=ids.dictionary), -1).to_numpy()
                    words = phrased.values.field("qtoks")
                    cuts = np.cumsum(words.value_lengths().to_numpy())[:-1]
                for k, f in enumerate(fields):
                    mine = np.flatnonzero(of_field == k)
                    if not len(mine):
                        continue
                    terms = rows.field("term").take(pa.array(mine)).dictionary_encode()
                    matrix = np.zeros((len(terms.dictionary), best.shape[1]))
                    matrix[terms.indices.to_numpy(), query[mine]] = w[mine]
                    toks = block.column(f"toks_{k}")
                    toks = pc.split_pattern(pc.if_else(pc.equal(toks, ""), None, toks), " ")
                    n = np.nan_to_num(toks.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                    at = pc.fill_null(pc.index_in(toks.flatten(), value_set=terms.dictionary), -1).to_numpy()
                    bits = np.maximum(np.floor(np.log2(np.maximum(n - 24, 0) + 0.5)) - 3, 0)
                    length = np.where(n < 40, n, 24 + np.floor((n - 24) / 2**bits) * 2**bits)
                    starts, norm = np.append(0, np.cumsum(n)), K1 * (1 - B + B * length / averages[f])
                    np.maximum(best, boosts[f] * _block_scores(starts, at, matrix, norm), out=best)
                    if f in phrases and phrased.is_valid:
                        codes = np.split(pc.fill_null(pc.index_in(words.flatten(), value_set=terms.dictionary), -1).to_numpy(), cuts)
                        total = matrix.sum(0)
                        for j, r, tf in _phrase_counts(starts, at, len(terms.dictionary), codes):
                            near[r, by[j]] = np.maximum(near[r, by[j]], phrases[f] * total[by[j]] * tf / (tf + norm[r]))
                hit = np.where(best > 0, np.round(best + near, 6), -np.inf)
                codes = block.column(document).dictionary_encode(null_encoding="encode").indices.to_numpy()
                first = np.flatnonzero(np.append(True, np.diff(codes) != 0))
                top = np.maximum.reduceat(hit, first, axis=0)  # of a document's chunks here
                order = np.argsort(-top, axis=0, kind="stable")[:limit]
                d, q = order.ravel(), np.tile(np.arange(top.shape[1]), len(order))
                some = np.isfinite(top[d, q])
                d, q = d[some], q[some]
                ends = np.append(first[1:], block.num_rows)
                chunk = np.array([first[x] + np.argmax(hit[first[x] : ends[x], y] == top[x, y]) for x, y in zip(d, q)], np.int64)
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(q)), *(block.column(c).take(pa.array(chunk)) for c in key), pa.array(top[d, q])], names=schema.names)

    met = _chunk_blocks(rows.select(*key, *lists), lists).crossJoin(asked)  # a row is a block
    partial = met.mapInArrow(run, schema)
    return top_k(collapse(partial, document, key[1:]), ["query_id"], [F.desc("score"), document], limit)


# --- vectors ------------------------------------------------------------------


def valid_vector(v: Column, dim: int) -> Column:
    """Right length, all numbers finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Rows (id, vector) as blocks: an id array and a matrix of unit rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, rows):
                p = b.slice(at, rows)
                x = np.stack(p.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([p.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["ids", "m"])

    return df.select("id", "v").mapInArrow(run, "ids array<long>, m binary")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, id, score): the k nearest vectors of each query by cosine,
    exact. Both sides are (id, v); invalid vectors must be gone. Blocks of
    queries meet blocks of vectors as matrix products that keep k rows a query,
    and the partial lists are merged by query."""
    _positive(k=k)
    q, v = _packed(queries, block).toDF("qids", "qm"), _packed(vectors, block)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for qids, qm, ids, m in zip(*(b.column(c).to_pylist() for c in ("qids", "qm", "ids", "m"))):
                qids, ids = np.array(qids), np.array(ids)
                s = np.round(np.frombuffer(qm).reshape(len(qids), -1) @ np.frombuffer(m).reshape(len(ids), -1).T, 6) + 0.0
                n = min(k, len(ids))
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, n)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())],
                    names=["query_id", "id", "score"],
                )

    met = v.crossJoin(q).select("qids", "qm", "ids", "m")  # a row is a block
    partial = met.mapInArrow(run, "query_id long, id long, score double")
    return top_k(partial, ["query_id"], [F.desc("score"), "id"], k)


def candidate_pool(limit: int) -> int:
    """How many passages are fetched for `limit` documents."""
    return min(10_000, max(100, 50 * limit))


def dense_search(queries: DataFrame, vectors: DataFrame, limit: int, document: Column) -> DataFrame:
    """Nearest passages, collapsed to documents: query_id, document_id, id, score, rank."""
    hits = vector_search(queries, vectors, candidate_pool(limit)).drop("rank").withColumn("document_id", document)
    return top_k(collapse(hits, "document_id", ["id"]), ["query_id"], [F.desc("score"), "document_id"], limit)


def current_only(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits whose content hash is the document's current one; incomplete hits go."""
    whole = hits.filter("document_id IS NOT NULL AND content_hash IS NOT NULL AND content_hash <> ''")
    return whole.join(documents.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_semi")


# --- fusion -------------------------------------------------------------------


def reciprocal_rank_fusion(rankings: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """`rankings`: query_id, ranking (an ordinal), document_id, rank. Ids that are
    empty or null don't count, repeated ids at their first rank only. Order:
    score, best single rank, id."""
    _positive(limit=limit, k=k)
    ids = rankings.filter("document_id IS NOT NULL AND cast(document_id AS string) <> ''")
    first = ids.groupBy("query_id", "document_id", "ranking").agg(F.min("rank").alias("rank"))
    # Added in the order of the rankings, so that sums agree on every run.
    shares = F.array_sort(F.collect_list(F.struct("ranking", (1.0 / (k + F.col("rank"))).alias("s"))))
    fused = first.groupBy("query_id", "document_id").agg(shares.alias("shares"), F.min("rank").alias("best_rank"))
    score = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x.s)
    fused = fused.select("query_id", "document_id", F.round(score, 12).alias("score"), "best_rank")
    return top_k(fused, ["query_id"], [F.desc("score"), "best_rank", "document_id"], limit)


def fused_search(lexical: DataFrame, dense: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fusion of two rankings (query_id, document_id, rank) with both ranks kept;
    a query without dense hits is degraded to its lexical ranking."""
    _positive(limit=limit, k=k)
    both = lexical.select("query_id", F.lit(0).alias("ranking"), "document_id", "rank").unionByName(
        dense.select("query_id", F.lit(1).alias("ranking"), "document_id", "rank")
    )
    fused = reciprocal_rank_fusion(both, limit, k)
    ranks = both.groupBy("query_id", "document_id").agg(*(F.min(F.when(F.col("ranking") == n, F.col("rank"))).alias(c) for n, c in ((0, "lexical_rank"), (1, "dense_rank"))))
    found = dense.select("query_id").distinct().withColumn("has_dense", F.lit(True))
    out = fused.join(ranks, ["query_id", "document_id"]).join(found, "query_id", "left")
    mode = F.when(F.col("has_dense"), "hybrid").otherwise("bm25")
    return out.select("query_id", "document_id", "rank", "score", "lexical_rank", "dense_rank", mode.alias("mode_used"), F.col("has_dense").isNull().alias("degraded"), F.when(F.col("has_dense").isNull(), F.lit("no current dense candidate")).alias("reason"))


def candidate_limit(limit: int) -> int:
    return min(20, max(10, limit))


def search(queries: DataFrame, chunks: DataFrame, limit: int, mode: str = "hybrid", query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, document: Column | None = None, documents: DataFrame | None = None, fallback: bool = True, **options) -> DataFrame:
    """The whole ladder: lexical search always runs; without vectors, or for
    queries without current dense hits, it is the answer. `documents` with
    content hashes guards against stale vectors (dense hits must bear one).
    With `fallback` it is also the answer, marked so, where `query_vectors`, which a model
    makes, can't be had; without it, and wherever else a step fails, the search fails."""
    _positive(limit=limit)
    if mode not in ("bm25", "hybrid"):
        raise ValueError(f"mode must be bm25 or hybrid, not {mode!r}")
    if mode == "bm25" or vectors is None or query_vectors is None:
        rows = lexical_search(queries, chunks, limit, **options)
        return _lexical_only(rows, mode, "dense retrieval is off")
    pool = candidate_limit(limit)
    lexical = written(lexical_search(queries, chunks, pool, **options), "lexical")
    if fallback:
        try:
            query_vectors = written(query_vectors, "query-vectors")
        except Exception as e:  # whatever a model raises: the lexical ranking still answers
            return _lexical_only(lexical.filter(F.col("rank") <= limit), mode, f"dense retrieval failed: {type(e).__name__}")
    dense = dense_search(query_vectors, vectors, pool, document)
    if documents is not None:
        hashes = vectors.select("id", "content_hash") if "content_hash" in vectors.columns else None
        dense = current_only(dense.join(hashes, "id") if hashes is not None else dense, documents)
        dense = dense.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return fused_search(lexical, written(dense, "dense"), limit)


def _lexical_only(rows: DataFrame, mode: str, reason: str) -> DataFrame:
    degraded = mode != "bm25"
    none = F.lit(None).cast("int")
    return rows.select("query_id", "document_id", "rank", "score", F.col("rank").alias("lexical_rank"), none.alias("dense_rank"), F.lit("bm25").alias("mode_used"), F.lit(degraded).alias("degraded"), F.lit(reason if degraded else None).cast("string").alias("reason"))


# --- rerank -------------------------------------------------------------------


def protected_order(scored: DataFrame, protected: int = PROTECTED, pool: int = POOL) -> DataFrame:
    """Reorders the first `pool` hits by score inside their part, the first
    `protected` or the rest; what lies beyond the pool keeps its place. `scored`:
    query_id, rank, rerank_score and more; adds new_rank."""
    part = F.when(F.col("rank") <= protected, 0).when(F.col("rank") <= pool, 1).otherwise(2)
    by = F.when(F.col("rank") <= pool, -F.col("rerank_score")).asc_nulls_last()  # what has no score comes last in its part
    return scored.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(part, by, "rank")))


def score_order(scored: DataFrame) -> DataFrame:
    """The plain order by score, without protection."""
    return scored.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")))


def first_stage_limit(limit: int, pool: int = POOL) -> int:
    """How many hits the first stage is asked for where a rerank follows."""
    return max(limit, pool)


def rerank_control(first: DataFrame, scores: DataFrame | None, limit: int, protected: int = PROTECTED, pool: int = POOL) -> DataFrame:
    """The first stage (query_id, document_id, rank, score, mode_used, degraded) reranked by `scores`
    (query_id, document_id, rerank_score) and cut to the limit: adds position, rerank_used,
    rerank_degraded and rerank_reason. A query that asked for BM25 alone bypasses the rerank silently;
    one whose first stage is degraded, or any of whose candidates lacks a finite score, keeps
    the order of the first stage and says why. Without `scores` that holds for all."""
    _positive(limit=limit)
    if scores is None:
        scores = first.select("query_id", "document_id", F.lit(None).cast("double").alias("rerank_score"))
    rows = first.join(scores.select("query_id", "document_id", "rerank_score"), ["query_id", "document_id"], "left")
    finite = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    short = F.count_if((F.col("rank") <= pool) & ~finite).over(W.partitionBy("query_id")) > 0
    why = F.when(F.col("degraded"), F.lit("the first stage is degraded")).when(F.col("mode_used") == "bm25", None).when(short, F.lit("the scorer failed"))
    rows = rows.withColumn("rerank_reason", why).withColumn("rerank_used", (F.col("mode_used") != "bm25") & F.col("rerank_reason").isNull())
    rows = protected_order(rows.withColumn("rerank_score", F.when(F.col("rerank_used"), F.col("rerank_score"))), protected, pool)
    place = F.when(F.col("rerank_used"), F.col("new_rank")).otherwise(F.col("rank"))
    rows = rows.withColumn("position", place).withColumn("rerank_degraded", F.col("rerank_reason").isNotNull())
    return rows.filter(F.col("position") <= limit).drop("new_rank")


def rerank_text(title: Column, description: Column) -> Column:
    """What a scorer reads; raises where both parts are blank."""
    held = F.filter(F.array(F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))), lambda x: x != "")
    return F.when(F.size(held) == 0, F.raise_error(F.lit("a candidate has neither title nor description"))).otherwise(F.array_join(held, "\n"))


def overlap_score(query: Column, text: Column) -> Column:
    """A model-free scorer: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


class ModelError(RuntimeError):
    """A model that must not score: its files aren't those it was admitted with."""


_FAILED: dict[tuple, str] = {}


def verified(spark: SparkSession, files: dict[str, str], version: str, admitted: str, load: Callable[[list[str]], Callable[[list[str], list[str]], list[float]]]) -> Callable:
    """A scorer for `scored_by` that reads model files on the executors. `files`: SHA-256 of each by its path or URI, which Spark
    ships to every executor. A worker process compares version and checksums before its first score, once: what fails
    then fails at once in that process from then on, and no score is given by files that aren't the admitted ones."""
    import os
    from urllib.parse import urlparse

    names = {}
    for path, digest in files.items():
        spark.sparkContext.addFile(path)
        names[os.path.basename(urlparse(path).path)] = digest.lower()
    if len(names) < len(files):
        raise ValueError("two model files have the same name")
    key = (version, admitted, *sorted(names.items()))

    def scorer():
        import hashlib

        from pyspark import SparkFiles

        if key in _FAILED:
            raise ModelError(_FAILED[key])
        try:
            if version != admitted:
                raise ModelError(f"model version {version} isn't the admitted {admitted}")
            places = [SparkFiles.get(n) for n in names]
            for place, (name, digest) in zip(places, names.items()):
                with open(place, "rb") as f:
                    found = hashlib.file_digest(f, "sha256").hexdigest()
                if found != digest:
                    raise ModelError(f"{name} has the checksum {found}, admitted is {digest}")
            return load(places)
        except Exception as e:
            _FAILED[key] = str(e)
            raise

    return scorer


def scored_by(pairs: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """Adds rerank_score to rows with query and text from a model: `scorer` makes
    the scoring function once per Python worker. Scores must be finite."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = scorer()
        for q, t in batches:
            s = pd.Series(f(q.tolist(), t.tolist()), dtype="float64")
            if len(s) != len(q) or not np.isfinite(s).all():
                raise ValueError("a scorer must return one finite score a pair")
            yield s

    return pairs.withColumn("rerank_score", run("query", "text"))
