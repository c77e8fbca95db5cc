"""An inverted index that outlives its session: a folder that any session opens by name.

A commit names the index's segments and deletions. A segment holds, for the chunks of one `add`:

* `texts`: the tokens of each field of each chunk, a row a chunk;
* `postings`: packed rows of at most BLOCK postings of one term in one field, those of most weight first, with the
  largest term frequency and smallest length among them, from which a bound on any score in the block follows. A task packs and
  sorts the chunks it has read, some at a time, so that no posting is shuffled;
* `dictionary`: document frequency and bounds of each term.

Documents that are replaced or removed are named in a deletion, with what that takes from the dictionary and
the statistics, so that scores are at all times those of an index that was built anew.

A search computes the k-th best score that a few weighty terms alone make for sure. Terms that even together can't reach it
are no source of candidates; blocks whose bound can't reach it aren't unpacked. What is left is scored exactly
from its texts. Batches of queries with more terms than are broadcast, or whose terms stand in more places than the texts
have tokens, are scored without those short cuts: blocks of texts meet blocks of queries.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import tokens
from ..session import written
from .commits import Commits
from .joins import small, top_k
from .retrieval import PHRASE_BOOSTS, TERM_BOOSTS, B, K1, _positive, block_search, collapse, field_stats, idf, n_tokens, saturated, split_tokens, tokenised

BLOCK = 256
PACKED = 2_000_000  # tokens whose postings are packed at a time
SEEDS = 8  # terms of a query that its bound is made of
WEIGHTS = 200_000  # rows (query, field, term) that are broadcast: some 10 MB
PLACES = 1.0  # places of a batch's terms for each token of the texts, beyond which it is cheaper to read the texts
IDLE = 0.25  # of the bound, what terms that give no candidates may add up to: less of it, more candidates, but better known ones
SLACK = 2e-6  # scores are rounded to six decimals before they are compared


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), Commits(spark, path)
        self.number, self.state = self.commits.latest()
        if self.number < 0:
            raise FileNotFoundError(f"no index at {path}")
        self.key = T.StructType.fromJson(self.state["key"])
        self.names, self.document = self.key.names, self.key.names[0]

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return Commits(spark, path).latest()[0] >= 0

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: T.StructType, fields: list[str]) -> StoredIndex:
        """An empty index of chunks by `key`, whose first column is the document, or the one that is there."""
        Commits(spark, path).offer(0, {"key": key.jsonValue(), "fields": list(fields), "segments": [], "deletions": [], "stats": {f: [0, 0] for f in fields}})
        return cls(spark, path)

    # --- tables of the parts

    def _schema(self, part: str) -> T.StructType:
        key = [T.StructField(f.name, f.dataType) for f in self.key.fields]
        word, long_ = (lambda n: T.StructField(n, T.StringType())), (lambda n: T.StructField(n, T.LongType()))
        hit = T.StructType([*key, T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
        return T.StructType(
            {
                "texts": [word("segment"), *key, *(word(c) for c in self._lists())],
                "postings": [word("segment"), word("field"), word("term"), long_("n"), long_("max_tf"), long_("min_dl"), T.StructField("hits", T.ArrayType(hit))],
                "dictionary": [word("field"), word("term"), long_("df"), long_("max_tf"), long_("min_dl")],
                "dead": [word("segment"), key[0]],
            }[part]
        )

    def _lists(self) -> list[str]:
        return [f"toks_{k}" for k in range(len(self.state["fields"]))]

    def _read(self, part: str, names: list[str] | None = None) -> DataFrame:
        if names is None:
            names = [n for n in ([] if part == "dead" else self.state["segments"])]
            names += self.state["deletions"] if part in ("dead", "dictionary") else []
        if not names:
            return self.spark.createDataFrame([], self._schema(part))
        reader = self.spark.read.schema(self._schema(part))
        frames = [reader.parquet(f"{self.path}/parts/{n}/{part}") for n in names]  # as many as there are parts: `compact` bounds them
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Without chunks of deleted documents."""
        if not self.state["deletions"]:
            return rows
        return rows.join(small(self._read("dead").distinct()), ["segment", self.document], "left_anti")

    def chunks(self) -> DataFrame:
        """What is live, as `tokenised` has it."""
        return self._alive(self._read("texts"))

    def texts(self) -> DataFrame:
        """(segment, *key, field, dl, toks) of what is live."""
        return self._by_field(self.chunks(), lambda c: [n_tokens(c).alias("dl"), split_tokens(c).alias("toks")])

    def _by_field(self, chunks: DataFrame, values) -> DataFrame:
        """A row for each field that a chunk has."""
        each = [chunks.filter(F.col(c) != "").select("segment", *self.names, F.lit(f).alias("field"), *values(F.col(c))) for f, c in zip(self.state["fields"], self._lists())]
        return reduce(DataFrame.unionByName, each)

    def stats(self) -> dict[str, tuple[int, float]]:
        return {f: (n, total / max(n, 1)) for f, (n, total) in self.state["stats"].items()}

    # --- writing

    def _segment(self, name: str, chunks: DataFrame) -> dict[str, list[int]]:
        """Writes a segment of tokenised chunks; chunks with the field and tokens by field."""
        at, fields = f"{self.path}/parts/{name}", self.state["fields"]
        some = F.greatest(*(F.length(c) for c in self._lists()), F.lit(0)) > 0
        chunks.filter(some).select(F.lit(name).alias("segment"), *self.names, *self._lists()).write.parquet(f"{at}/texts")
        texts = self.spark.read.schema(self._schema("texts")).parquet(f"{at}/texts")
        stats = field_stats(texts, fields)
        schema = self._schema("postings")
        blocks = texts.mapInArrow(_packer(name, self.names, {f: total / max(n, 1) for f, (n, total) in stats.items()}, schema.names), schema)
        blocks.write.parquet(f"{at}/postings")
        blocks = self.spark.read.schema(schema).parquet(f"{at}/postings")
        words = blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
        words.sortWithinPartitions("field", "term").write.parquet(f"{at}/dictionary")
        return stats

    def _delete(self, name: str, documents: DataFrame) -> tuple[bool, dict[str, list[int]]]:
        """Writes a deletion of the live chunks of the documents; whether there are any, and what goes from the statistics."""
        at = f"{self.path}/parts/{name}"
        gone = written(self.chunks().join(small(documents.select(self.document).distinct(), WEIGHTS), self.document, "left_semi"), "index-gone")
        if gone.isEmpty():
            return False, {}
        gone.select("segment", self.document).distinct().write.parquet(f"{at}/dead")
        none = F.lit(None).cast("long")
        words = self._by_field(gone, lambda c: [F.explode(F.array_distinct(split_tokens(c))).alias("term")]).groupBy("field", "term")
        words.agg((-F.count("*")).alias("df"), none.alias("max_tf"), none.alias("min_dl")).write.parquet(f"{at}/dictionary")
        return True, field_stats(gone, self.state["fields"])

    def add(self, chunks: DataFrame) -> StoredIndex:
        """Indexes chunks; documents that they name replace those of before, chunk by chunk or not."""
        return self._change(chunks.select(self.document), chunks)

    def remove(self, documents: DataFrame) -> StoredIndex:
        return self._change(documents, None)

    def _change(self, documents: DataFrame, chunks: DataFrame | None) -> StoredIndex:
        """Parts are written once; a deletion is made anew where another writer has come first, as it depends on what is live."""
        segment, made = uuid.uuid4().hex, None

        def change(state: dict) -> dict:
            nonlocal made
            self.state = state
            if made is None and chunks is not None:
                made = self._segment(segment, tokenised(chunks, self.names, self.state["fields"]))
            deletion = uuid.uuid4().hex
            some, gone = self._delete(deletion, documents) if self.state["segments"] else (False, {})
            stats = {f: [v + (made or {}).get(f, [0, 0])[k] - gone.get(f, [0, 0])[k] for k, v in enumerate(self.state["stats"][f])] for f in self.state["fields"]}
            return self.state | {"segments": self.state["segments"] + ([segment] if made is not None else []), "deletions": self.state["deletions"] + ([deletion] if some else []), "stats": stats}

        self.commits.change(change)
        return StoredIndex(self.spark, self.path)

    def compact(self) -> StoredIndex:
        """One segment of all that is live, without deletions; fails if another writer comes first."""
        name = uuid.uuid4().hex
        stats = self._segment(name, self.chunks())
        new = self.state | {"segments": [name], "deletions": [], "stats": {f: stats.get(f, [0, 0]) for f in self.state["fields"]}}
        if not self.commits.offer(self.number + 1, new):
            self.commits.remove(f"parts/{name}")
            raise RuntimeError("the index changed meanwhile")
        return StoredIndex(self.spark, self.path)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes parts that the last commits don't name."""
        return self.commits.expire(keep, "parts", lambda s: {*s["segments"], *s["deletions"]})

    # --- searching

    def weights(self, queries: DataFrame, boosts: dict, phrases: dict) -> DataFrame:
        """(query_id, field, term, raw, w, df, ub, need, phrase): a term's weight without and with the field's, its places, what it
        adds at most, the query's distinct terms, and what its phrase adds at most in the field."""
        stats = self.stats()
        of = lambda values: F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for f in boosts for x in (f, float(values[f])))), lambda f, _: f == F.col("field"))), F.lit(0))
        terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        words = self._read("dictionary").filter(F.col("field").isin(*boosts)).join(small(terms.select("term").distinct(), WEIGHTS), "term")
        words = words.groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).filter("df > 0")
        need = W.partitionBy("query_id")
        rows = terms.withColumn("need", F.count("*").over(need)).join(words, "term")
        raw = F.col("qtf") * idf(of({f: stats[f][0] for f in boosts}), F.col("df"))
        average = of({f: stats[f][1] for f in boosts})
        rows = rows.withColumn("raw", raw).withColumn("w", F.col("raw") * of(boosts)).withColumn("ub", F.col("w") * saturated(F.col("max_tf"), F.col("min_dl"), average))
        field = W.partitionBy("query_id", "field")
        phrase = F.when(F.count("*").over(field) == F.col("need"), F.sum("raw").over(field) * of({f: phrases.get(f, 0.0) for f in boosts})).otherwise(0.0)
        return rows.select("query_id", "field", "term", "raw", "w", "df", "ub", "need", phrase.alias("phrase"), average.alias("average"))

    def _hits(self, weights: DataFrame, reachable: Column | None = None) -> DataFrame:
        """(query_id, field, *key, part) of all live postings of the weighted terms, but for blocks that can't reach."""
        met = self._read("postings").join(F.broadcast(weights), ["field", "term"])  # at most WEIGHTS rows
        if reachable is not None:
            met = met.filter(reachable)
        hits = self._alive(met.select("query_id", "field", "segment", "w", "average", F.inline("hits")))
        return hits.select("query_id", "field", *self.names, (F.col("w") * saturated(F.col("tf"), F.col("dl"), F.col("average"))).alias("part"))

    def _threshold(self, sums: DataFrame, limit: int) -> DataFrame:
        """(query_id, theta): the limit-th best document's sure score, of queries that have so many."""
        best = sums.groupBy("query_id", self.document).agg(F.max("sure").alias("sure"))
        kept = top_k(best, ["query_id"], [F.desc("sure"), self.document], limit, "__n")
        return kept.groupBy("query_id").agg(F.min("sure").alias("theta"), F.count("*").alias("n")).filter(F.col("n") >= limit).select("query_id", "theta")

    def candidates(self, weights: DataFrame, limit: int) -> DataFrame:
        """(query_id, *key): every chunk that can be the best of one of the query's `limit` best documents, and some others."""
        of_query = ["query_id", *self.names]
        seeds = weights.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("ub"), "field", "term"))).filter(F.col("n") <= SEEDS)
        sure = self._hits(seeds.select("query_id", "field", "term", "w", "average")).groupBy(*of_query, "field").agg(F.sum("part").alias("sure"))
        theta = written(self._threshold(sure, limit), "index-theta")
        field = W.partitionBy("query_id", "field")
        weights = weights.join(F.broadcast(theta), "query_id", "left").fillna(0.0, ["theta"])
        weights = weights.withColumn("up_to", F.sum("ub").over(field.orderBy("ub", "term"))).withColumn("place", F.row_number().over(field.orderBy(F.desc("ub"), F.desc("term"))))
        weights = weights.withColumn("idle", (F.col("up_to") < IDLE * F.col("theta") - SLACK) & (F.col("place") > 1))
        weights = weights.withColumn("rest", F.sum(F.when(F.col("idle"), F.col("ub")).otherwise(0.0)).over(field)).withColumn("others", F.sum("ub").over(field) - F.col("ub"))
        weights = written(weights.withColumn("sources", F.count_if(~F.col("idle")).over(field)), "index-sources")
        reach = F.col("w") * saturated(F.col("max_tf"), F.col("min_dl"), F.col("average")) + F.col("others") + F.col("phrase") >= F.col("theta") - SLACK
        # A chunk's score is the best field's terms and the best field's phrase, so that other fields count with what idle terms make.
        hits = self._hits(weights.filter(~F.col("idle")).select("query_id", "field", "term", "w", "average", "others", "phrase", "theta"), reach)
        sums = hits.groupBy(*of_query, "field").agg(F.sum("part").alias("sure"), F.count("*").alias("met"))
        sums = written(sums, "index-sums")
        bounds = weights.groupBy("query_id", "field").agg(F.max("rest").alias("rest"), F.max("phrase").alias("phrase"), F.max("sources").alias("sources"))
        idle = bounds.groupBy("query_id").agg(F.max("rest").alias("least"))
        best = self._threshold(sums, limit).withColumnRenamed("theta", "better")
        rows = sums.join(F.broadcast(bounds), ["query_id", "field"])
        rows = rows.groupBy(*of_query).agg(F.max(F.col("sure") + F.col("rest")).alias("terms"), F.max(F.when(F.col("met") >= F.col("sources"), F.col("phrase")).otherwise(0.0)).alias("phrase"))
        rows = rows.join(F.broadcast(idle), "query_id").join(F.broadcast(best), "query_id", "left")
        most = F.greatest("terms", "least") + F.col("phrase")
        return rows.filter(F.col("better").isNull() | (most >= F.col("better") - SLACK)).select(*of_query)

    def scored(self, candidates: DataFrame, weights: DataFrame, queries: DataFrame, phrases: dict) -> DataFrame:
        """(query_id, *key, score) of candidates, exactly, from their texts."""
        of_query = ["query_id", *self.names]
        candidates = written(candidates, "index-candidates")
        texts = self.texts().join(small(candidates.select(*self.names).distinct(), WEIGHTS), self.names, "left_semi")
        words = texts.select(*self.names, "field", "dl", F.explode("toks").alias("term")).join(F.broadcast(weights.select("term").distinct()), "term")
        counts = words.groupBy(*self.names, "field", "dl", "term").agg(F.count("*").alias("tf"))
        rows = counts.join(candidates, self.names).join(F.broadcast(weights), ["query_id", "field", "term"])
        part = F.col("w") * saturated(F.col("tf"), F.col("dl"), F.col("average"))
        sums = rows.groupBy(*of_query, "field").agg(F.sum(part).alias("terms"), F.count("*").alias("met"), F.max("need").alias("need"), F.max("phrase").alias("phrase"), F.max("average").alias("average"))
        if not phrases:
            return sums.groupBy(*of_query).agg(F.round(F.max("terms"), 6).alias("score"))
        sums = written(sums, "index-scores")
        near = sums.filter((F.col("met") == F.col("need")) & (F.col("phrase") > 0))
        near = near.join(texts.select(*self.names, "field", "dl", "toks"), [*self.names, "field"]).join(queries.select("query_id", tokens(F.col("query")).alias("qtoks")), "query_id")
        runs = F.expr("size(filter(sequence(1, greatest(1, size(toks) - size(qtoks) + 1)), i -> slice(toks, i, size(qtoks)) = qtoks))")
        near = near.withColumn("tf", runs).filter("tf > 0").select(*of_query, (F.col("phrase") * saturated(F.col("tf"), F.col("dl"), F.col("average"))).alias("p"))
        near = near.groupBy(*of_query).agg(F.max("p").alias("p"))
        best = sums.groupBy(*of_query).agg(F.max("terms").alias("t")).join(near, of_query, "left")
        return best.select(*of_query, F.round(F.col("t") + F.coalesce("p", F.lit(0.0)), 6).alias("score"))

    def search(self, queries: DataFrame, limit: int, boosts: dict | None = None, phrases: dict | None = None) -> DataFrame:
        """Collapsed top documents of each query, as `lexical_search` finds them: query_id, document, ordinal, score, rank."""
        _positive(limit=limit)
        boosts = {f: b for f, b in (TERM_BOOSTS if boosts is None else boosts).items() if f in self.state["fields"]}
        phrases = {f: b for f, b in (PHRASE_BOOSTS if phrases is None else phrases).items() if f in boosts}
        weights = written(self.weights(queries, boosts, phrases), "index-weights")
        n, places = weights.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        if n > WEIGHTS or places > PLACES * sum(self.state["stats"][f][1] for f in boosts):
            number = {f: k for k, f in enumerate(boosts)}
            rows = self.chunks().select(*self.names, *(F.col(c).alias(f"toks_{number[f]}") for f, c in zip(self.state["fields"], self._lists()) if f in number))
            of = F.create_map(*(F.lit(x) for f, k in number.items() for x in (f, k)))
            weights = weights.select("query_id", F.get(F.map_values(F.map_filter(of, lambda f, _: f == F.col("field"))), F.lit(0)).alias("field"), "term", F.col("raw").alias("w"))
            return block_search(queries, rows, self.names, weights, {f: self.stats()[f][1] for f in boosts}, limit, boosts, phrases)
        found = self.scored(self.candidates(weights, limit), weights, queries, phrases)
        found = collapse(found, self.document, self.names[1:])
        return top_k(found, ["query_id"], [F.desc("score"), self.document], limit)


def _packer(segment: str, key: list[str], averages: dict[str, float], names: list[str]):
    """Postings of tokenised chunks as blocks, sorted by field and term; a block's postings are of one batch, term and field."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def packed(part, column, field, n):
            words = pc.split_pattern(pc.if_else(pc.equal(column, ""), None, column), " ").flatten().dictionary_encode()
            place = pc.sort_indices(words.dictionary).to_numpy()
            of_word = np.empty(len(place), np.int64)
            of_word[place] = np.arange(len(place))  # terms are numbered in their order
            pairs, tf = np.unique(of_word[words.indices.to_numpy()] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
            term, row = pairs // len(n), pairs % len(n)
            dl = n[row]
            bits = np.maximum(np.floor(np.log2(np.maximum(dl - 24, 0) + 0.5)) - 3, 0)
            length = np.where(dl < 40, dl, 24 + np.floor((dl - 24) / 2**bits) * 2**bits)
            order = np.lexsort((np.floor(-16 * (tf / (tf + K1 * (1 - B + B * length / averages[field])))), term))
            term, row, dl, tf = term[order], row[order], dl[order], tf[order]
            first = np.flatnonzero(np.append(True, np.diff(term) != 0))
            start = np.flatnonzero((np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))) % BLOCK == 0)
            ends = np.append(start, len(term))
            hits = [*(part.column(c).take(pa.array(row)) for c in key), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())]
            columns = {
                "segment": pa.array([segment] * len(start), pa.string()),
                "field": pa.array([field] * len(start), pa.string()),
                "term": words.dictionary.take(pa.array(place[term[start]])),
                "n": pa.array(np.diff(ends), pa.int64()),
                "max_tf": pa.array(np.maximum.reduceat(tf, start), pa.int64()),
                "min_dl": pa.array(np.minimum.reduceat(dl, start), pa.int64()),
                "hits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(hits, names=[*key, "tf", "dl"])),
            }
            return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

        for b in batches:
            size = lambda c: np.where(pc.fill_null(pc.not_equal(c, ""), False).to_numpy(zero_copy_only=False), pc.fill_null(pc.count_substring(c, " "), 0).to_numpy() + 1, 0).astype(np.int64)
            sizes = [size(b.column(f"toks_{k}")) for k in range(len(averages))]
            group = np.cumsum(sum(sizes)) // PACKED
            cuts = np.flatnonzero(np.append(True, np.diff(group) != 0))
            for at, to in zip(cuts, np.append(cuts[1:], b.num_rows)):
                part = b.take(pa.array(np.arange(at, to)))  # a copy: Arrow splits strings of a slice wrongly
                for k, field in sorted(enumerate(averages), key=lambda x: x[1]):
                    if (n := sizes[k][at:to]).any():
                        out = packed(part, part.column(f"toks_{k}"), field, n)
                        for x in range(0, out.num_rows, 20_000):
                            yield out.slice(x, 20_000)

    return run
