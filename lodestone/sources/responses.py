"""Stored HTTP responses as a data source, and fetching from them.

`store_responses` lays responses out by host; the source `lodestone_responses` reads them back, a task a file, with
filters on host, url and status pushed down: those on host or url leave out the files of other hosts. `fetch` answers a table of
requests from them: conditional requests, redirects with admission of every hop, statuses, types, sizes, decoding.

A row has url, host, status, location, content_type, body (bytes), etag and last_modified.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions import url as U
from ..operators.joins import small
from ..session import written
from .markup import MOST_BYTES, acceptable_type

NAME = "lodestone_responses"
FIELDS = "url string, host string, status int, location string, content_type string, body binary, etag string, last_modified string"
COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]
BUCKETS = 32
AT_ONCE = 256  # rows that a task holds
PUSHED = ("host", "url", "status")
REDIRECTS = (301, 302, 303, 307, 308)
MOST_HOPS = 5


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.wanted = folder, buckets, {}

    def pushFilters(self, filters):
        """Takes equalities and lists on PUSHED; Spark applies the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def _hosts(self):
        if "url" in self.wanted:
            hosts = {(urlsplit(u).hostname or "") for u in self.wanted["url"] if u is not None}
            return hosts & self.wanted["host"] if "host" in self.wanted else hosts
        return self.wanted.get("host")

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder)
        hosts = self._hosts()
        kept = None if hosts is None else {zlib.crc32(h.encode()) % self.buckets for h in hosts if h is not None}
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [(m[1], f.path) for f in found if f.is_file and f.base_name.endswith(".parquet") and (m := re.search(r"/bucket=(\d+)/", f.path))]
        return [_File(p) for b, p in sorted(files, key=lambda x: (int(x[0]), x[1])) if kept is None or int(b) in kept]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(AT_ONCE, columns=COLUMNS):
                for name, values in self.wanted.items():
                    b = b.filter(pc.is_in(b.column(name), pa.array([v for v in values if v is not None], b.schema.field(name).type)))
                if b.num_rows:
                    yield b.select(COLUMNS)


class ResponseSource(DataSource):
    """Options: path, a folder that `store_responses` has written, and buckets, how many it was written with."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("buckets", BUCKETS)))


def store_responses(responses: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes responses (FIELDS but for the host) so that a host's are in one folder; a hot host's are many files."""
    rows = responses.withColumn("host", U.host(F.col("url"))).select(*COLUMNS)
    rows = rows.withColumn("bucket", (F.crc32(F.col("host").cast("binary")) % buckets).cast("int"))
    rows.write.partitionBy("bucket").option("maxRecordsPerFile", 50_000).parquet(path)


def read_responses(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored responses. `path` is a URI of a store that pyarrow reads, as the tasks do."""
    spark.dataSource.register(ResponseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off in Spark by default
    return spark.read.format(NAME).option("path", path if "://" in path or path.startswith("file:") else f"file://{path}").option("buckets", buckets).load()


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text by the charset of the content type, else UTF-8; what can't be decoded is replaced."""

    def one(raw, kind) -> str | None:
        if raw is None:
            return None
        m = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", kind or "", re.I)
        try:
            return bytes(raw).decode(m[1] if m else "utf-8", "replace")
        except LookupError:
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(b, k) for b, k in zip(body, content_type)], dtype=object)


def failure(cap: int = MOST_BYTES) -> Column:
    """Why a response that is no redirect is no page, or null."""
    s = F.col("status")
    return (
        F.when(s.isNull(), "no answer")
        .when(s >= 400, F.concat(F.lit("HTTP "), s))
        .when(~acceptable_type(F.col("content_type")), "unsupported content type")
        .when(F.octet_length("body") > cap, "response exceeds the size limit")
    )


def html_pages(responses: DataFrame, cap: int = MOST_BYTES) -> DataFrame:
    """(url, html) of responses that are pages."""
    rows = responses.filter(~F.col("status").isin(*REDIRECTS, 304)).filter(failure(cap).isNull())
    return rows.select("url", decoded("body", "content_type").alias("html"))


def fetch(requests: DataFrame, responses: DataFrame, admission=None, most: int = MOST_HOPS, cap: int = MOST_BYTES) -> DataFrame:
    """Answers distinct requests (url, if_none_match, if_modified_since): url, final_url, hops, status, html, body_bytes,
    etag, last_modified, not_modified, error. `admission` adds a column `refusal` to rows with a column `url`; it is asked
    about every address on the way. A loop over hops, at most `most` + 1, that ends when nothing is under way; each is a join of what
    is, written, so that no plan grows with the hops."""
    at = requests.select("url", "if_none_match", "if_modified_since", F.col("url").alias("final_url"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("hops"), F.lit(False).alias("done"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("content_type", "string"), ("body", "binary"), ("etag", "string"), ("last_modified", "string"))]
    at = at.select("*", *nothing, F.lit(False).alias("not_modified"))
    ended = []
    for hop in range(most + 1):
        if hop:
            at = written(at, f"fetch-{hop}")
            ended.append(at.filter("done"))
            at = at.filter("NOT done")
            if at.isEmpty():
                break
        if admission is not None:
            asked = admission(at.filter("NOT done").select(F.col("final_url").alias("url")).distinct()).select(F.col("url").alias("a_url"), F.col("refusal").alias("a_refusal"))
            at = at.join(asked, at.final_url == asked.a_url, "left")
        else:
            at = at.withColumns({"a_url": F.lit(None).cast("string"), "a_refusal": F.lit(None).cast("string")})
        refused = ~F.col("done") & F.col("a_refusal").isNotNull()
        # Answers that nobody asks for are dropped where they are read, before anything is shuffled.
        asked_for = small(at.filter("NOT done").select(F.col("final_url").alias("url")).distinct())
        one = responses.select(*COLUMNS).join(asked_for, "url", "left_semi").dropDuplicates(["url"]).select(*(F.col(c).alias(f"r_{c}") for c in COLUMNS))
        met = at.withColumn("key", F.when(~F.col("done") & ~refused, F.col("final_url"))).join(one, F.col("key") == F.col("r_url"), "left")
        open_ = F.col("key").isNotNull()
        moved = open_ & F.coalesce(F.col("r_status").isin(*REDIRECTS), F.lit(False))
        same = open_ & (F.lit(hop) == 0) & F.coalesce((F.col("if_none_match") == F.col("r_etag")) | (F.col("if_none_match").isNull() & (F.col("if_modified_since") == F.col("r_last_modified"))), F.lit(False)) & ~moved & F.coalesce(F.col("r_status") < 400, F.lit(False))
        answered = open_ & ~moved & ~same
        lost = moved & F.col("r_location").isNull()
        far = moved & ~lost & (F.lit(hop) >= most)
        why = F.when(refused, F.col("a_refusal")).when(lost, "redirect without a location").when(far, "too many redirects")
        value = lambda c, when: F.when(when, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
        at = met.select(
            "url", "if_none_match", "if_modified_since",
            F.when(moved & ~lost & ~far, U.resolve(F.col("final_url"), F.col("r_location"))).otherwise(F.col("final_url")).alias("final_url"),
            F.coalesce(why, "error").alias("error"),
            (F.col("hops") + (moved & ~lost & ~far).cast("int")).alias("hops"),
            (F.col("done") | refused | lost | far | same | answered).alias("done"),
            F.when(same, 304).when(answered, F.col("r_status")).otherwise(F.col("status")).alias("status"),
            value("content_type", answered), value("body", answered),
            F.when(same, F.coalesce("r_etag", "if_none_match")).when(answered, F.col("r_etag")).otherwise(F.col("etag")).alias("etag"),
            F.when(same, F.coalesce("r_last_modified", "if_modified_since")).when(answered, F.col("r_last_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
            (F.col("not_modified") | same).alias("not_modified"),
        )
    at = reduce(DataFrame.unionByName, ended, at)
    bad = F.coalesce("error", F.when(~F.col("not_modified"), failure(cap)))
    found = at.withColumn("error", bad)
    whole = F.col("error").isNull() & ~F.col("not_modified")
    return found.select(
        "url", "final_url", "hops", "status", F.when(whole, decoded("body", "content_type")).alias("html"),
        F.when(whole, F.octet_length("body").cast("long")).otherwise(F.lit(0).cast("long")).alias("body_bytes"), "etag", "last_modified", "not_modified", "error",
    )
