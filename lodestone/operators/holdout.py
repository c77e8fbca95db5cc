"""Freezing of holdouts, identities and checksums, and admission by name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U
from .evaluation import macro_average, ranking_metrics
from .joins import small
from .retrieval import POOL, PROTECTED, protected_order


def canonical_json(*columns: str) -> Column:
    """The columns as a JSON object, keys sorted, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def key_sorted(c: Column, kind: T.DataType) -> Column:
    """The column with the fields of its structs, at any depth, in the order of their names, and maps in that of their keys."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(key_sorted(c.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: key_sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(F.transform_values(c, lambda _, v: key_sorted(v, kind.valueType)))
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, by_key))
    return c


def canonical_rows(rows: DataFrame, *columns: str) -> Column:
    """The hash of the columns of `rows` as JSON, keys sorted at every depth, nulls kept; names with a dot are as they stand."""
    fields = sorted((f for f in rows.schema.fields if f.name in columns), key=lambda f: f.name)
    if len(fields) != len(set(columns)):
        raise ValueError(f"not all of {', '.join(columns)} are columns, or one is there twice")
    whole = F.struct(*(key_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def set_checksum(digest: Column) -> Column:
    """An aggregate of hexadecimal digests that doesn't depend on their order but on how often each is there: the
    sum of their first 60 bits, modulo 2^60."""
    total = F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))
    return F.pmod(total, F.lit(1 << 60).cast("decimal(38,0)")).cast("long")


def file_checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of files; each is read whole by one task."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def holdout_freeze(holdout: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """One row: how many items each side has, how many of the holdout's ids and contents the known
    side has too, the checksums of both sides, and whether the holdout may be frozen."""
    digest = lambda df: df.select(F.col(key).alias("id"), F.sha2(F.col(content), 256).alias("content"), canonical_hash(key, content).alias("row"))
    h, k = digest(holdout), digest(known)
    size = lambda df, name: df.agg(F.count("*").alias(f"n_{name}"), set_checksum(F.col("row")).alias(f"{name}_checksum"))
    shared = lambda c: h.join(k, c, "left_semi").agg(F.count("*").alias(f"shared_{c}s"))
    row = size(h, "holdout")
    for other in (size(k, "known"), shared("id"), shared("content")):
        row = row.crossJoin(other)  # one row each
    return row.withColumn("frozen", F.expr("shared_ids = 0 AND shared_contents = 0 AND n_holdout > 0"))


def identity_report(lexical: DataFrame, vector: DataFrame, key: list[str]) -> DataFrame:
    """One row: whether two stores hold the same identities, and how many are in one alone."""
    sides = lexical.select(*key, F.lit(1).alias("l"), F.lit(0).alias("v")).union(vector.select(*key, F.lit(0).alias("l"), F.lit(1).alias("v")))
    each = sides.groupBy(*key).agg(F.max("l").alias("l"), F.max("v").alias("v"))
    out = each.agg(F.sum("l").alias("n_lexical"), F.sum("v").alias("n_vector"), F.count_if(F.col("l") != F.col("v")).alias("n_apart"))
    return out.select(F.coalesce("n_lexical", F.lit(0)).alias("n_lexical"), F.coalesce("n_vector", F.lit(0)).alias("n_vector"), "n_apart", (F.col("n_apart") == 0).alias("agree"))


def require_identity(lexical: DataFrame, vector: DataFrame, key: list[str]) -> None:
    """Raises where the two stores don't hold the same identities."""
    r = identity_report(lexical, vector, key).first()
    if not r.agree:
        raise ValueError(f"{r.n_apart} identities are in one of two stores alone")


def fixture_items(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Results (query_id, url, rank) by the id that a fixture (url, item) gives their URL, else by the URL itself."""
    known = fixtures.groupBy("url").agg(F.min("item").alias("item"))
    return results.join(small(known), "url", "left").select("query_id", F.coalesce("item", "url").alias("item"), "rank")


def resolved_admission(targets: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Adds `refusal` and `admitted`: the static checks, then the port, then the host's class if it is an IP literal, else what it
    resolves to by `dns` (host, address): nothing, or any address that must not be fetched, refuses."""
    seen = dns.select("address").distinct().withColumn("bad", U.forbidden_ip("address"))
    hosts = dns.join(seen, "address").groupBy("host").agg(F.max(F.coalesce("bad", F.lit(True))).alias("bad"))
    rows = targets.withColumn("host", U.host(F.col(url))).join(hosts, "host", "left")
    literal = U.forbidden_ip(U.host(F.col(url)))  # null where the host is a name
    why = F.coalesce(U.refusal(F.col(url)), F.when(~U.valid_port(F.col(url)), "port").when(literal, "address").when(literal.isNull() & F.col("bad").isNull(), "not resolved").when(F.col("bad"), "address"))
    return rows.withColumn("refusal", why).withColumn("admitted", F.col("refusal").isNull()).drop("bad")


def frozen_manifest(**tables: DataFrame) -> dict[str, list[int]]:
    """Rows and checksum of each table, to be kept with a holdout and verified before it is used."""
    out = {}
    for name, df in tables.items():
        r = df.agg(F.count("*").alias("n"), set_checksum(canonical_hash(*df.columns)).alias("c")).first()
        out[name] = [r.n, r.c or 0]
    return out


def require_frozen(manifest: dict[str, list[int]], **tables: DataFrame) -> None:
    """Raises where a table isn't what the manifest has frozen."""
    found = frozen_manifest(**tables)
    changed = sorted(n for n in manifest.keys() | found.keys() if list(manifest.get(n, ())) != found.get(n))
    if changed:
        raise ValueError(f"not as frozen: {', '.join(changed)}")


def frozen_evaluation(rankings: DataFrame, scores: DataFrame, judgments: DataFrame, categories: DataFrame, depth: int = 10, protected: int = PROTECTED, pool: int = POOL) -> DataFrame:
    """From frozen rankings (query_id, item, rank) and scores (query_id, item, rerank_score) a row for each category of
    queries (query_id, category) and one for all: macro metrics before and after the protected rerank, their
    differences, wins, ties and losses by ndcg, and how many queries kept the items of their protected part."""
    after = protected_order(rankings.join(scores, ["query_id", "item"], "left"), protected, pool)
    moved = after.groupBy("query_id").agg(F.count_if((F.col("rank") <= protected) != (F.col("new_rank") <= protected)).alias("moved"))
    asked = categories.select("query_id").distinct()
    before = ranking_metrics(rankings, judgments, depth, queries=asked)
    later = ranking_metrics(after.select("query_id", "item", F.col("new_rank").alias("rank")), judgments, depth, queries=asked)
    names = ("mrr", "recall", "ndcg")
    rows = before.join(later.select("query_id", *(F.col(c).alias(f"new_{c}") for c in names)), "query_id").join(moved, "query_id", "left").join(categories, "query_id")
    rows = rows.withColumn("d", F.round(F.col("new_ndcg") - F.col("ndcg"), 6)).withColumn("category", F.explode(F.array(F.col("category").cast("string"), F.lit("all"))))
    sums = [F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for n in names for c in (n, f"new_{n}"))]
    sums += [F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.coalesce("moved", F.lit(0)) == 0).alias("membership_kept")]
    return rows.groupBy("category").agg(*sums).withColumns({f"{n}_delta": F.round(F.col(f"new_{n}") - F.col(n), 6) for n in names})


def frozen_rerank(rankings: DataFrame, scores: DataFrame, judgments: DataFrame, depth: int = 10, protected: int = PROTECTED, pool: int = POOL) -> DataFrame:
    """One row from frozen rankings (query_id, item, rank) and scores (query_id, item, rerank_score): macro
    metrics before and after the protected rerank, and whether every query kept the items of its protected part."""
    scored = rankings.join(scores, ["query_id", "item"], "left")
    after = protected_order(scored, protected, pool)
    kept = after.groupBy("query_id").agg(F.count_if((F.col("rank") <= protected) != (F.col("new_rank") <= protected)).alias("moved")).agg(F.max(F.col("moved")).alias("moved"))
    before = macro_average(ranking_metrics(rankings, judgments, depth))
    later = macro_average(ranking_metrics(after.select("query_id", "item", F.col("new_rank").alias("rank")), judgments, depth))
    names = ("mrr", "recall", "ndcg")
    row = before.crossJoin(later.select(*(F.col(c).alias(f"new_{c}") for c in names))).crossJoin(kept)  # one row each
    deltas = [F.round(F.col(f"new_{c}") - F.col(c), 6).alias(f"{c}_delta") for c in names]
    return row.select("n_queries", *names, *deltas, (F.col("moved") == 0).alias("membership_kept"))
