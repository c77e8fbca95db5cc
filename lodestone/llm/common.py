"""What the training-data operators share: tables, the shared folder, folds, words."""

from __future__ import annotations

import gc
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than the six ASCII blanks.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Only where a local session names none (a test) a temporary one is set; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found if urlparse(found).scheme else f"file://{found}"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here and
    a lost executor loses nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str, what: str) -> DataFrame:
    """The documents with a number of their own as column `row`: their ids, where each has one that no other has;
    else rows are numbered and stored, since a number that is made anew need not be the same."""
    if dict(docs.dtypes)["doc_id"] == "bigint" and docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(row, F.col("doc_id"))
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), what)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that `stored` has made and nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a folder of any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Where a row stands in files that were written in order: the number of the part, of the file in it, of the row in that.
ORDER = ("train_part", "train_file", "train_row")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the places (ORDER) of rows of tables that Spark has written."""
    if not any(f.rpartition("/")[2].startswith("part-") for f in docs.inputFiles()):
        return docs.select("doc_id", "text")
    name, number = F.col("_metadata.file_name"), lambda of, pattern: F.regexp_extract(of, pattern, 1).try_cast("long")
    places = (number(name, r"part-(\d+)"), number(name, r"c(\d+)\."), F.col("_metadata.row_index"))
    try:
        return docs.select("doc_id", "text", *(p.alias(n) for p, n in zip(places, ORDER)))
    except AnalysisException:  # the rows are no table's, though some were chosen by tables
        return docs.select("doc_id", "text")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def words(text: str | None) -> list[bytes]:
    """Whole text in UTF-8, A-Z lower-cased, split at the six ASCII blanks
    (`bytes.split` knows exactly those)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def unused(name: str, *taken) -> str:
    """A column name that none of the lists of names has, whatever the case."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name = f"_{name}"
    return name


def rows_of(batch, at_once: int = 256):
    """The rows of an Arrow batch as tuples, few of them as Python objects at a time."""
    for at in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, at_once).columns))


#: Integers made of vector components stay within this, so that blocks of BLOCK rows add up in 64 bits.
EDGE, BLOCK = 1 << 52, 1000


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, for a power of two; what lies beyond EDGE becomes EDGE."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(x * scale, -float(EDGE), float(EDGE))).astype(np.int64)


def matrices(column, at_once: int = BLOCK):
    """The vectors of an Arrow list column that hold no null or non-finite component and at least one: for each
    dimension and run of rows the rows' numbers and the vectors as doubles."""
    first = column.offsets.to_numpy()
    length, known = np.diff(first), column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for d in np.unique(length[known & (length > 0)]):
        rows = np.flatnonzero(known & (length == d))
        for at in range(0, len(rows), at_once):
            r = rows[at : at + at_once]
            x = flat[first[r][:, None] + np.arange(d)]
            fine = np.isfinite(x).all(1)
            if fine.any():
                yield r[fine], x[fine]


_HELD: dict = {}


def release() -> None:
    """Gives memory that earlier tasks of this worker process freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key, make):
    """What `make` returns, kept by the worker process from task to task until
    another key is asked for: a process holds one model at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    release()
    return _HELD[key]
