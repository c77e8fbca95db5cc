"""Maintenance of document, passage and vector tables: keyed replacement, stale
clean-up, touches, latest versions, caches, outcomes, schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def latest_by_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order; one batch holds one version of a key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns that only one side has are null."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def without_stale(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages whose document carries their hash, and those of documents not in this batch."""
    current = documents.select("document_id", F.col("content_hash").alias("__current"))
    joined = passages.join(current, "document_id", "left")
    return joined.filter("__current IS NULL OR __current = content_hash").drop("__current")


def stale(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """The passages that replacement makes stale: the document is known, the hash isn't its."""
    known = passages.join(documents.select("document_id"), "document_id", "left_semi")
    return known.join(documents.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def touch(documents: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers 304 renew the fetch time and status and, where given, the
    validators; other answers change nothing. `responses`: document_id,
    http_status, fetched_at, etag, last_modified."""
    r = responses.filter("http_status = 304").select("document_id", *(F.col(c).alias(f"r_{c}") for c in ("http_status", "fetched_at", "etag", "last_modified")))
    both = documents.join(r, "document_id", "left")
    renewed = {c: F.coalesce(F.col(f"r_{c}"), F.col(c)) for c in ("http_status", "fetched_at", "etag", "last_modified")}
    return both.select(*(renewed.get(c, F.col(c)).alias(c) for c in documents.columns))


def with_vectors(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Passages with their vectors by (document_id, ordinal); raises where counts differ."""
    n = passages.groupBy("document_id").agg(F.count("*").alias("p"))
    m = vectors.groupBy("document_id").agg(F.count("*").alias("v"))
    bad = n.join(m, "document_id", "left").filter("coalesce(v, 0) <> p")
    if not bad.isEmpty():
        raise ValueError("a document's vectors don't match its passages in number")
    return passages.join(vectors, ["document_id", "ordinal"])


def evolve(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows under a schema that may have nullable columns more; unknown columns are an error."""
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def create_if_missing(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Creates an empty table under an explicit schema; whether it was missing."""
    if spark.catalog.tableExists(name):
        found = spark.table(name).schema
        if [(f.name, f.dataType) for f in found.fields] != [(f.name, f.dataType) for f in schema.fields]:
            raise ValueError(f"table {name} exists with another schema")
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


def with_recovery(spark: SparkSession, name: str, schema: T.StructType, write):
    """Runs write(); if the table is gone, creates it and tries once more."""
    try:
        return write()
    except Exception:
        if spark.catalog.tableExists(name):
            raise
        create_if_missing(spark, name, schema)
        return write()


def vector_metadata(model: str, dimension: int, engine: str = "exact", method: str = "flat", space: str = "cosine") -> dict:
    return {"model": model, "dimension": dimension, "engine": engine, "method": method, "space": space}


def validate_vectors(vectors: DataFrame, expected: dict, column: str = "embedding") -> None:
    """Fails closed where type, provenance or any row's length isn't the expected."""
    field = vectors.schema[column]
    if not isinstance(field.dataType, T.ArrayType) or not isinstance(field.dataType.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{column} is no array of floats")
    if dict(field.metadata) != expected:
        raise ValueError(f"vectors are {dict(field.metadata)}, expected {expected}")
    if not vectors.filter(F.size(column) != expected["dimension"]).isEmpty():
        raise ValueError("a vector has another dimension")


def vector_storage(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    from .retrieval import valid_vector

    n = F.size(column)
    return vectors.agg(F.count("*").alias("n_vectors"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), F.count_if(~valid_vector(F.col(column), dim)).alias("n_invalid"))


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("|", *parts), 256))


def cache_entries(rows: DataFrame, key: Column, value: Column, written_at: Column, ttl_s: int) -> DataFrame:
    """Entries with their expiry; a lifetime of 0 or less stores nothing."""
    made = rows.select(key.alias("key"), value.alias("value"), (written_at + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))
    return made if ttl_s > 0 else made.limit(0)


def cache_lookup(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Requests (key, ...) with the value of the newest entry that hasn't expired; hit says whether there is one."""
    live = latest_by_key(entries.filter(F.col("expires_at") > now), ["key"], [F.desc("expires_at"), F.desc("value")])
    return requests.join(live, "key", "left").withColumn("hit", F.col("expires_at").isNotNull())


def readiness(components: dict[str, str]) -> dict:
    """Overall state of named components: ready unless one is `not_ready`."""
    allowed = {"ready", "not_ready", "not_required", "disabled"}
    if bad := set(components.values()) - allowed:
        raise ValueError(f"unknown states: {sorted(bad)}")
    return {"ready": "not_ready" not in components.values(), "components": dict(components)}


def check_ready(spark: SparkSession, tables: dict[str, T.StructType], vectors: tuple[str, dict] | None, hybrid: bool, reranker: bool, warmed: bool) -> dict:
    """State of the tables, the vector table and the scorer."""

    def fits(name: str, schema: T.StructType) -> bool:
        return spark.catalog.tableExists(name) and spark.table(name).schema.names == schema.names

    state = {"lexical": "ready" if all(fits(n, s) for n, s in tables.items()) else "not_ready"}
    if not hybrid:
        state["dense"] = "not_required"
    else:
        try:
            if vectors is None or not spark.catalog.tableExists(vectors[0]):
                raise ValueError("no vector table")
            validate_vectors(spark.table(vectors[0]), vectors[1])
            state["dense"] = "ready"
        except ValueError:
            state["dense"] = "not_ready"
    state["reranker"] = "disabled" if not reranker else "ready" if warmed else "not_ready"
    return readiness(state)
