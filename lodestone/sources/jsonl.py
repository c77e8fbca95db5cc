"""JSON Lines under explicit schemas; judgments are maps, never inferred structs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, url string, title string, chunks array<struct<section_path: array<string>, text: string>>"
QUERIES = "id string, language string, query string, relevance map<string,int>"
RANKINGS = "id string, language string, hybrid_top10 array<string>, candidate1_score_order array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_policy(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def chunk_rows(corpus: DataFrame) -> DataFrame:
    """document_id, url, title, ordinal, section_path, text of a corpus file's passages."""
    c = corpus.select("id", "url", "title", F.posexplode("chunks").alias("ordinal", "c"))
    path = F.array_join(F.filter("c.section_path", lambda x: x != ""), " > ")
    return c.select(F.col("id").alias("document_id"), "url", "title", "ordinal", path.alias("section_path"), F.col("c.text").alias("text"))


def judgment_rows(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("query_id"), F.explode("relevance").alias("item", "grade"))


def query_violations(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many rows break each rule of the fixtures."""
    known = corpus.select(F.col("id").alias("item"))
    judged = judgment_rows(queries)
    unknown = judged.join(known, "item", "left_anti").agg(F.count("*").alias("unknown_documents"))
    own = queries.agg(
        (F.count("*") - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.coalesce(F.trim("query"), F.lit("")) == "").alias("blank_queries"),
        F.count_if(F.coalesce(F.size("relevance"), F.lit(0)) == 0).alias("unjudged"),
    )
    bad = judged.agg(F.count_if(F.col("grade") <= 0).alias("bad_grades"))
    return own.crossJoin(unknown).crossJoin(bad)  # one row each
