"""The entry points: contexts, indexing, crawling and search over tables of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..sources.markup import extract_any_udf
from . import passages as P
from . import tables as T


def embedded(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """Adds `embedding`: `model` makes the function once per Python worker; blank
    passages and vectors that are not finite or all zero are errors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for texts in parts:
            if (texts.fillna("").str.strip() == "").any():
                raise ValueError("a passage to embed is blank")
            made = [f(texts[k : k + batch].tolist()) for k in range(0, len(texts), batch)]
            x = np.concatenate(made) if made else np.zeros((0, 1))
            if not np.isfinite(x).all() or not x.any(axis=1).all():
                raise ValueError("a model must give finite vectors that are not zero")
            yield pd.Series(list(x.astype(np.float32)))

    return rows.withColumn("embedding", run(F.col(text)))


def hashed_words(dim: int = 64, seed: int = 0):
    """A model-free embedder for tests: words hashed to signed dimensions."""
    import zlib

    def one(t: str) -> np.ndarray:
        x = np.zeros(dim)
        for w in t.lower().split():
            h = zlib.crc32(w.encode(), seed)
            x[h % dim] += 1 if h >> 16 & 1 else -1
        if not x.any():
            x[0] = 1
        return x / np.linalg.norm(x)

    return lambda: lambda texts: np.stack([one(t) for t in texts])


def extractions(pages: DataFrame) -> DataFrame:
    """Pages (url, html) with identity, title, markdown, hash, quality, error and the extractor whose text it is."""
    e = pages.withColumn("e", extract_any_udf("html"))
    out = e.select("url", "html", "e.*")
    return out.select(
        "url",
        U.document_id(F.col("url"), F.coalesce("canonical", "url")).alias("document_id"),
        "title",
        "markdown",
        X.content_hash(F.col("markdown")).alias("content_hash"),
        X.quality(F.col("markdown"), F.col("html")).alias("quality"),
        "error",
        "extractor",
    )


def index_pages(pages: DataFrame, target_tokens: int = P.TARGET_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, passages, outcomes) of pages: one outcome per page, in error
    where there is nothing to index; one document per identity."""
    found = extractions(pages)
    docs = T.latest_by_key(found.filter("error IS NULL"), ["document_id"], [F.col("url")])
    parts = docs.withColumn("p", F.explode(P.passages_udf(target_tokens)("markdown")))
    parts = parts.select("document_id", "content_hash", "url", "title", F.col("p.ordinal").alias("ordinal"), X.section_path(F.col("p.section_path")).alias("section_path"), F.col("p.text").alias("text"), F.col("p.approx_tokens").alias("approx_tokens"))
    parts = parts.withColumn("passage_id", P.passage_id(F.col("document_id"), F.col("content_hash"), F.col("ordinal")))
    n = parts.groupBy("document_id").agg(F.count("*").alias("passages"))
    outcomes = found.join(n, "document_id", "left")
    why = F.coalesce("error", F.when(F.col("passages").isNull(), F.lit("no indexable content")))
    outcomes = outcomes.select("url", "document_id", "content_hash", why.isNull().alias("indexed"), F.coalesce("passages", F.lit(0)).alias("passages"), why.alias("error"))
    return docs.join(n, "document_id", "left_semi").select("document_id", "url", "title", "content_hash", "quality"), parts, outcomes


def build_contexts(pages: DataFrame, budget: int = 3500, most: int = 3, query: str | None = None) -> DataFrame:
    """One row per page: the passages that fit the budget, best first for a query
    (a column of the pages), in document order without one."""
    kept = [c for c in (query,) if c]
    e = pages.select("url", *kept, extract_any_udf("html").alias("e"))
    parts = e.select("url", *kept, F.explode(P.passages_udf()("e.markdown")).alias("p"))
    parts = parts.select("url", *kept, F.col("p.ordinal").alias("ordinal"), X.section_path(F.col("p.section_path")).alias("path"), F.col("p.text").alias("text"))
    order = "ordinal"
    if query:
        parts, order = P.ranked_passages(parts, "url", "ordinal", query, "path"), "rank"
    found = P.contexts(P.within_budget(parts, "url", order, budget, most), "url", "ordinal")
    return pages.select("url").join(found, "url", "left").withColumn("error", F.when(F.col("context").isNull(), F.lit("no content")))
