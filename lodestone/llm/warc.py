"""WARC: a deterministic sharded writer and its reader.

Writing: records are range-sorted by page id and a hash of the payload. Bounds
of the shards come from exact running sums of bytes in that order, over a narrow
table, so that reruns cut alike whatever the ids are; rows of one id and payload
that are more than a shard are dealt out to several. Each shard is one task
that streams gzip members into files, rolled by compressed size. A file is
written under a temporary name and renamed when it is whole; the
manifest (one row per file: name, size, digest, records), stored after all
files, is the commit. What no manifest names isn't part of an archive, so lost
executors and repeated or duplicate tasks do no harm: the same shard always has the
same names and bytes, and temporary files of lost tasks go when the manifest is there.

Payloads of at least 1000 bytes are written once: the record of the largest
page id is the response, the others are revisits that refer to it and keep the
HTTP headers of the full payload. Record ids, dates, lengths and digests are
regenerated from the content.

Defined results: a null html is an empty payload; a null url leaves out the
target URI; a null page id is written and read back as null, sorts first, and is
smaller than any other (equal payloads that all have none are all responses);
repeated rows are records of their own (of those with the largest id one is the
response, the others revisit it). Ids may be any longs. A very long text is one record, held
once in its task. An empty table gives an archive without files and no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import filesystem, rows_of, scratch, stored

LEAST_SHARED = 1000
SHARD_BYTES = 24 << 20  # bytes of a shard, about; more where there would be more than MOST_SHARDS
MOST_SHARDS = 50_000
RECORD_BYTES = 600  # of a record besides its payload, about
ROLL_BYTES = 16 << 20  # compressed bytes of a file, about
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the archive holds no clock: reruns are equal

MANIFEST = "file string, shard long, seq long, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _record_id(page_id: int | None, digest: str, k: int | str = 0) -> str:
    return f"<urn:lodestone-page:{'null' if page_id is None else page_id}:{digest}:{k}>"


def _page_of(record_id: str) -> int | None:
    part = record_id.strip("<>").split(":")[2]
    return None if part == "null" else int(part)


def make_record(page_id: int | None, k: int | str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with regenerated headers and digests; a revisit needs no payload, only its size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    uri = url and "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, k)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_records(stream):
    """(headers, block) of each record of an uncompressed WARC stream."""
    f = io.BufferedReader(stream, 1 << 20)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a WARC record ends early")
        yield headers, block


class _Roller:
    """Files of one shard: temporary name, roll by compressed size, rename."""

    def __init__(self, folder: str, shard: int, roll: int, level: int):
        self.fs, self.path = filesystem(folder)
        self.shard, self.roll, self.level, self.seq, self.out = shard, roll, level, 0, None

    def write(self, page_id: int | None, record: bytes):
        """Appends a gzip member; the row of a file that this has filled, or None."""
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.path}/.tmp-{uuid.uuid4().hex}"
            self.out, self.sha = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256()
            self.size = self.records = 0
            self.first = self.last = None
        c = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = c.compress(record) + c.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if page_id is not None:
            self.first, self.last = page_id if self.first is None else self.first, page_id
        return self.close() if self.size >= self.roll else None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.temp, f"{self.path}/{self.name}")
        row = (self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest(), self.first, self.last)
        self.seq += 1
        return row


def shard_bounds(keys: DataFrame, shard_bytes: int | None = None) -> tuple[list[tuple[int, int]], dict[tuple[int, int], tuple[int, int]]]:
    """From (page, hash, bytes): the first key of each shard, in order, and of each key that is more than a
    shard the number of the first further shard it goes to and how many these are. At most
    about MOST_SHARDS rows come to the driver; running sums are by range of keys, and over the ranges' totals."""
    keys = keys.groupBy("page", "hash").agg(F.sum("bytes").alias("bytes")).repartitionByRange("page", "hash")
    keys = stored(keys.withColumn("part", F.spark_partition_id()), "warc-keys")
    parts = keys.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    size = shard_bytes or max(SHARD_BYTES, total // MOST_SHARDS)
    before = W.rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("bytes").over(before.orderBy("part")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("bytes").over(before.partitionBy("part").orderBy("page", "hash")), F.lit(0))
    placed = keys.withColumn("inside", inside).join(offsets, "part").withColumn("shard", F.expr(f"(offset + inside) div {size}"))
    found = placed.groupBy("shard").agg(F.min(F.struct("page", "hash")).alias("key"), F.max_by(F.struct("page", "hash", "bytes"), "bytes").alias("most")).collect()
    bounds = sorted((r.key.page, r.key.hash) for r in found)
    heavy, further = {}, len(bounds)
    # A key that is more than a shard is the last of its shard, and the largest.
    for r in sorted(found, key=lambda r: r.shard):
        if r.most.bytes > size:
            n = -(-r.most.bytes // size) - 1
            heavy[r.most.page, r.most.hash] = further, n
            further += n
    return bounds, heavy


def shards_of(bounds: list[tuple[int, int]], heavy: dict[tuple[int, int], tuple[int, int]]):
    """A function of columns (page, hash): the shards of a row, its own first; several for a key that is more than a shard."""
    first = np.array(bounds or [(0, 0)], np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def shards(page, hash):
        import pandas as pd

        p, h = page.to_numpy(np.int64), hash.to_numpy(np.int64)
        lo, hi = np.searchsorted(first[:, 0], p, "left"), np.searchsorted(first[:, 0], p, "right")
        at = np.maximum(lo - 1, 0)
        for k in np.flatnonzero(hi > lo):  # bounds with this very page
            at[k] = max(0, lo[k] + np.searchsorted(first[lo[k] : hi[k], 1], h[k], "right") - 1)
        out = [[x] for x in at.tolist()]
        if heavy:
            for k, key in enumerate(zip(p.tolist(), h.tolist())):
                if key in heavy:
                    further, n = heavy[key]
                    out[k] += range(further, further + n)
        return pd.Series(out)

    return shards


def _dealt(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of keys that are more than a shard, dealt out by content. Equal rows are counted, then numbered; where the key's
    payload is shared, one row of the target (the first by url) is its response and stays in the key's own shard, and all
    others travel as revisits, without their html."""
    key = ["page_id", "page", "hash", "digest"]
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).groupBy(*key, "url", "shards").agg(F.count("*").alias("n"), F.max("html").alias("html"))
    first = rows.groupBy(*key).agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("first"))
    one = targets.withColumnsRenamed({c: f"of_{c}" for c in targets.columns})
    rows = rows.join(first.withColumnsRenamed({c: f"of_{c}" for c in key}), F.expr(" AND ".join(f"{c} <=> of_{c}" for c in key))).drop(*(f"of_{c}" for c in key))
    rows = rows.join(one, (F.col("digest") == F.col("of_digest")) & F.col("page_id").eqNullSafe(F.col("of_page_id")), "left")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    response = F.col("of_target").eqNullSafe(F.col("page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 0)
    plain = F.col("of_target").isNull()
    salt = F.when(response, F.lit(0)).otherwise(F.pmod(F.xxhash64("url", "copy"), F.size("shards"))).cast("int")
    return rows.select(
        "page_id", "hash", F.when(plain | response, F.lit(1)).otherwise(F.lit(2)).alias("kind"), "digest", F.col("of_target").alias("target"), "url",
        F.when(plain | response, F.col("html")).alias("html"), size.alias("payload_bytes"), F.get("shards", salt).alias("shard"),
    )


def write_warc(pages: DataFrame, folder: str, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, least_shared: int = LEAST_SHARED, level: int = LEVEL) -> DataFrame:
    """Writes (page_id, url, html) as archives below `folder`; the manifest."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long")
    key = [F.coalesce(page_id, F.lit(-(1 << 63))).alias("page"), F.xxhash64(raw).alias("hash")]
    narrow = stored(pages.select(page_id.alias("page_id"), *key, F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("payload_bytes")), "warc-digests")
    groups = narrow.filter(F.col("payload_bytes") >= least_shared).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1")
    shared = narrow.join(groups, "digest").select("page_id", "page", "hash", "digest", "target").distinct()
    bounds, heavy = shard_bounds(narrow.select("page", "hash", (F.col("payload_bytes") + RECORD_BYTES).alias("bytes")), shard_bytes)
    own = len(bounds)
    shards = shards_of(bounds, heavy)
    whole = pages.select(page_id.alias("page_id"), *key, "url", "html").withColumn("shards", shards("page", "hash"))
    plain = whole.filter(F.size("shards") == 1) if heavy else whole
    rows = plain.withColumn("kind", F.lit(1)).withColumn("shard", F.col("shards")[0])
    if heavy:
        rows = rows.unionByName(_dealt(whole.filter(F.size("shards") > 1), shared.select("page_id", "digest", "target")), allowMissingColumns=True)
    marks = shared.withColumn("kind", F.lit(0)).withColumn("shard", shards("page", "hash")[0])
    rows = rows.drop("shards", "page").unionByName(marks.drop("page"), allowMissingColumns=True)
    rows = rows.withColumns({c: F.col(c) if c in rows.columns else F.lit(None).cast("long") for c in ("payload_bytes",)})
    rows = rows.repartitionById(max(1, own + sum(n for _, n in heavy.values())), F.col("shard"))
    # Repeated rows of an id differ at most in url and html: these settle their order.
    rows = rows.sortWithinPartitions("page_id", "kind", "hash", "url", "html")

    def run(batches):
        import pyarrow as pa

        roller, page, targets, written = None, None, {}, Counter()
        done = []
        for b in batches:
            for pid, kind, digest, target, url, html, size, k in rows_of(b.select(["page_id", "kind", "digest", "target", "url", "html", "payload_bytes", "shard"]), 64):
                roller = roller or _Roller(folder, k, roll_bytes, level)
                if pid != page:
                    page, targets, written = pid, {}, Counter()
                if kind == 0:
                    targets[digest] = target
                    continue
                payload, to = None, target
                if kind == 1:
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    # The first of the largest id is the response; of a key that is dealt out, it is the only one here.
                    to = targets.get(digest)
                    if to is not None and to == pid and not written[digest]:
                        to = None
                number = written[digest] if k < own else f"{k}.{written[digest]}"
                done.append(roller.write(pid, make_record(pid, number, url, payload, size, digest, to)))
                written[digest] += 1
        if roller:
            done.append(roller.close())
        rows = [r for r in done if r]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j in (0, 5) else pa.int64()) for j, c in enumerate(zip(*rows))], names=[f.split()[0] for f in MANIFEST.split(", ")])

    manifest = stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")
    _clear(folder)
    return manifest


def _clear(folder: str) -> None:
    """Temporary files that lost tasks left."""
    from pyarrow import fs

    store, path = filesystem(folder)
    for info in store.get_file_info(fs.FileSelector(path)):
        if info.base_name.startswith(".tmp-"):
            store.delete_file(info.path)


def read_warc(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the manifest's files, block and payload digests verified."""
    schema = T.StructType([f for f in RECORDS.fields if payload or f.name != "payload"])

    def parse(headers: dict, block: bytes) -> tuple:
        if hashlib.sha1(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {headers['warc-record-id']} differs")
        http, _, body = block.partition(b"\r\n\r\n")
        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
            raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
        to = _page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
        row = (_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, to)
        return (*row, body if kind == "response" else None) if payload else row

    def run(batches):
        import pyarrow as pa

        types = [{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}.get(f.dataType.simpleString(), pa.binary()) for f in schema.fields]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        fs, path = filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_file(f"{path}/{name}") as f:
                    for headers, block in read_records(gzip.GzipFile(fileobj=f)):
                        held.append(parse(headers, block))
                        size += len(block) if payload else 64
                        if size > 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    files = manifest.select("file")
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(run, schema)


def checked(records: DataFrame) -> DataFrame:
    """The records, stored, if each revisit's target is a response of its payload; else an error."""
    records = stored(records, "warc-records")
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    lost = wanted.join(records.filter("record_type = 'response'").select("page_id", "payload_digest"), ["page_id", "payload_digest"], "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"revisits refer to pages that hold no response of their payload: {[r.page_id for r in lost]}")
    return records


def op1(pages: DataFrame) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    manifest = write_warc(pages.select("page_id", "url", "html"), folder)
    return checked(read_warc(manifest, folder, payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS top,
         row_number() OVER (PARTITION BY sha1(coalesce(html, '')) ORDER BY page_id DESC NULLS LAST) AS place FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND place > 1 AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN top END AS refers_to
FROM p
"""
