"""A training-corpus pipeline: toxicity, quality, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again, so a lost executor costs at
most work of one stage. All stages but the last return the columns of the
documents; the last returns one row per document of the mix, with its token ids. The mix is
written in the order of training, and the last stage names each row's place in it (ORDER): rows sorted
by these columns are in the order that the curriculum trains on. They are missing where rows come from no files.

Defined results. Rows are documents of their own: those with a null id, or with
an id that others have too, are judged each by its text. Null and blank texts
score by the classifiers' biases, are no copies of anything, and have no words
for the mix to take: it leaves them out. Of a group of near copies, equal rows
among them, the row with the smallest id stays, one with an id before one
without, then the first as stored. Very long texts are read whole by each stage.
An empty table gives an empty one at each stage; without labels of both kinds
the classifiers reject nothing. Extra columns are kept up to the mix, whatever
their names: the stages name their own columns apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, neardup, quality, toxicity
from lodestone.llm.common import ORDER, numbered, placed, scratch, table, unused  # noqa: F401


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text isn't toxic."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    return toxicity.score(docs, fitted, out=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    fitted = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    return quality.score(docs, fitted, out=score).filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near copies. Rows are told apart by a number of
    their own, so that what shares an id or has none is a copy only if its text is."""
    row = unused("row", docs.columns)
    rows = numbered(docs, row, "pipeline-rows")
    groups = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id")
    ids = rows.select(F.col(row).alias("own"), F.col("doc_id").isNull().alias("none"), "doc_id")
    kept = groups.join(ids, "own").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "own")).alias("first")).select(F.col("first.own").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and in the order that the curriculum trains on them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with their count and digests of them and of the decoded text, and
    its place in the order of training: Spark reads files in any order, so that places are those of the mix's own files."""
    rows = placed(docs)
    return bpe.encode(rows, None, bpe.build_lexicon(rows.select("doc_id", "text")), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned scores, MinHash and merges are beyond SQL; tests/llm hold the operators, and the
#: rows that stages 3 and 4 keep, against brute-force versions, and stages 1, 2 and 5 against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
