"""Incremental tables: each micro-batch replaces the keys it brings.

Rows lie in buckets by a hash of their key. A batch reads and writes only the buckets its keys are in, and a commit
names for each bucket the part that holds it: of writers that change one bucket at the same time one is first, and
the others merge again with what it left. A batch is applied once, since the commit bears its writer's last number.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.commits import Commits, Conflict
from ..operators.tables import latest_by_key, upsert
from ..session import written

BUCKETS = 64


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.commits = Commits(spark, self.path)
        self._bucket = next(n for n in ("bucket", "_bucket", "__bucket") if n not in {c.lower() for c in schema.names})

    def version(self, writer: str = "") -> int:
        """The number of the writer's last batch, -1 if there is none."""
        return self.commits.latest()[1].get("batches", {}).get(writer, -1)

    def _read(self, parts: dict[str, str]) -> DataFrame:
        """Buckets from the parts that hold them."""
        by_part: dict[str, list[int]] = {}
        for bucket, part in parts.items():
            by_part.setdefault(part, []).append(int(bucket))
        kept = T.StructType([*self.schema.fields, T.StructField(self._bucket, T.IntegerType())])
        read = lambda part: self.spark.read.schema(kept).parquet(f"{self.path}/parts/{part}")
        found = [read(part).filter(F.col(self._bucket).isin(buckets)) for part, buckets in by_part.items()]  # at most a part a bucket
        return reduce(DataFrame.unionByName, found).select(*self.schema.names) if found else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.commits.latest()[1].get("buckets", {}))

    def apply(self, batch: DataFrame, batch_id: int, key: list[str], order: list[Column], writer: str = "", tries: int = 20) -> bool:
        """Replaces the batch's keys; False if this batch of the writer has been applied before."""
        number = F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")
        new, merged, touched = None, None, []
        for _ in range(tries):
            n, state = self.commits.latest()
            held, batches = state.get("buckets", {}), state.get("batches", {})
            if batches.get(writer, -1) >= batch_id:
                return False
            if new is None:
                new = written(latest_by_key(batch, key, order), "batch")
                touched = [str(r[0]) for r in new.select(number).distinct().collect()]  # at most `buckets`
            before = {b: held[b] for b in touched if b in held}
            if merged is None or merged[0] != before:  # else the others have changed other buckets
                part = uuid.uuid4().hex
                rows = upsert(self._read(before), new, key).select(*self.schema.names).withColumn(self._bucket, number)
                rows.write.partitionBy(self._bucket).parquet(f"{self.path}/parts/{part}")
                merged = before, part
            if self.commits.offer(n + 1, {"buckets": held | {b: merged[1] for b in touched}, "batches": batches | {writer: batch_id}}):
                return True
        raise Conflict(f"{self.path}: {tries} commits were each overtaken")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes parts that the last commits don't name; no writer may be at work."""
        return self.commits.expire(keep, "parts", lambda s: set(s.get("buckets", {}).values()))


def keep_current(stream: DataFrame, table: VersionedTable, key: list[str], order: list[Column], checkpoint: str):
    """A streaming query that folds a stream of row versions into the table."""
    write = stream.writeStream.foreachBatch(lambda df, n: table.apply(df, n, key, order) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums per event-time window and type, batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
