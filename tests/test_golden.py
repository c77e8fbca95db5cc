"""Published ranking quality, where its fixtures are at hand: LODESTONE_GOLDEN names
a JSON list of {"corpora": [paths], "queries": [paths], "mrr", "recall", "ndcg"}."""

import json
import os
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from lodestone.sources import jsonl

PATH = os.environ.get("LODESTONE_GOLDEN")


@pytest.mark.skipif(not PATH, reason="no golden fixtures are named")
def test_published_quality(spark):
    with open(PATH) as f:
        sets = json.load(f)
    for s in sets:
        read = lambda paths, schema: reduce(DataFrame.union, [jsonl.read_jsonl(spark, p, schema) for p in paths])
        queries = read(s["queries"], jsonl.QUERIES)
        asked = queries.select(F.col("id").alias("query_id"), "query")
        hits = R.lexical_search(asked, jsonl.chunk_rows(read(s["corpora"], jsonl.CORPUS)), 10, phrases=R.PHRASE_BOOSTS)
        hits = hits.select("query_id", F.col("document_id").alias("item"), "rank")
        m = E.macro_average(E.ranking_metrics(hits, jsonl.judgment_rows(queries), 10, 5)).first()
        assert (m.mrr, m.recall, m.ndcg) == (s["mrr"], s["recall"], s["ndcg"])
