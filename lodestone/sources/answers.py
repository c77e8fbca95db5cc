"""Search answers as a caller gets them, and a sink that lines of text are written to all or none.

`answers` makes one JSON answer a query. The sink `lodestone_lines` takes a table with one string column: each task writes a file of its
own below `data`, and a commit names the files of the tasks that count in a manifest below `manifests`. What is read is what manifests
name, so neither a failed write nor a second attempt of a task leaves a row behind. Commits only add manifests (an overwrite names those
that it replaces), so writers needn't know of each other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.joins import small

NAME = "lodestone_lines"
MANIFEST = "replaces array<string>, files array<struct<file:string, rows:bigint>>"
ANSWER = "success boolean, error string, data struct<web:array<struct<title:string, url:string, description:string, position:int>>>"


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.replaces = folder, []
        if overwrite:
            store, path = self._store()
            from pyarrow import fs

            found = store.get_file_info(fs.FileSelector(f"{path}/manifests", allow_not_found=True))
            self.replaces = sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator):
        store, path = self._store()
        store.create_dir(f"{path}/data")
        name, rows = f"{uuid.uuid4().hex}.txt", 0
        try:
            with store.open_output_stream(f"{path}/data/{name}") as out:
                for batch in iterator:
                    for line in batch.column(0).to_pylist():
                        if line is None or "\n" in line or "\r" in line:
                            raise ValueError("a line is null or has a line break")
                        out.write(line.encode("utf-8") + b"\n")
                        rows += 1
        except BaseException:
            self._remove([name])
            raise
        return _Written(name, rows)

    def _remove(self, names) -> None:
        store, path = self._store()
        for n in names:
            try:
                store.delete_file(f"{path}/data/{n}")
            except OSError:  # no manifest names it, so it is as good as gone
                pass

    def commit(self, messages):
        store, path = self._store()
        store.create_dir(f"{path}/manifests")
        made = {"replaces": self.replaces, "files": [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]}
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{path}/manifests/{name}.tmp") as out:
            out.write(json.dumps(made).encode() + b"\n")
        store.move(f"{path}/manifests/{name}.tmp", f"{path}/manifests/{name}.json")

    def abort(self, messages):
        self._remove([m.file for m in messages if m is not None])


class LineSink(DataSource):
    """Option: path, a URI of a store that driver and tasks share and pyarrow writes to."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite):
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("the sink takes one string column")
        return _Writer(self.options["path"], overwrite)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Commits the one string column of `lines`; mode is append or overwrite. Lines must be neither null nor broken."""
    lines.sparkSession.dataSource.register(LineSink)
    lines.write.format(NAME).option("path", _uri(path)).mode(mode).save()


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of each committed file that no later overwrite replaced."""
    found = spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{_uri(path)}/manifests").select("*", F.col("_metadata.file_name").alias("manifest"))
    gone = found.select(F.explode("replaces").alias("manifest")).distinct()
    return found.join(gone, "manifest", "left_anti").select(F.explode("files").alias("f")).select("f.file", "f.rows")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Committed lines (value, file). A committed file that is missing or not whole is an error, found while reading."""
    files = committed_files(spark, path)
    lines = spark.read.schema("value string").option("pathGlobFilter", "*.txt").text(f"{_uri(path)}/data").select("value", F.col("_metadata.file_name").alias("file"))
    lines = lines.join(small(files.select("file")), "file", "left_semi")
    # One row a file: what it should hold, less what it does.
    short = files.join(lines.groupBy("file").agg(F.count("*").alias("n")), "file", "left").filter(F.coalesce("n", F.lit(0)) != F.col("rows"))
    wrong = short.agg(F.first("file").alias("wrong")).filter("wrong IS NOT NULL")
    checked = wrong.select(F.raise_error(F.concat(F.lit("a committed file is missing or not whole: "), "wrong")).cast("string").alias("value"), F.col("wrong").alias("file"))
    return lines.select("value", "file").unionByName(checked)


def answers(queries: DataFrame, hits: DataFrame, error: Column | None = None) -> DataFrame:
    """(query_id, answer): one JSON answer a row of `queries` (query_id). `hits` are a search's (query_id, rank, title, url, description,
    position), at most as many a query as the search gave. Hits without a url are left out, a missing title or description is
    empty, a missing position is the hit's rank. `error`, of the columns of `queries`, makes a failed answer where it isn't null."""
    empty = F.lit("")
    item = F.struct(F.coalesce("title", empty).alias("title"), "url", F.coalesce("description", empty).alias("description"), F.coalesce("position", "rank").cast("int").alias("position"))
    kept = hits.filter("url <> ''").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item")))).alias("w"))
    asked = queries.select("query_id", (error if error is not None else F.lit(None).cast("string")).alias("error"))
    found = asked.join(kept, "query_id", "left").withColumn("web", F.coalesce(F.transform("w", lambda x: x["item"]), F.from_json(F.lit("[]"), "array<struct<title:string,url:string,description:string,position:int>>")))
    good = F.struct(F.lit(True).alias("success"), F.struct("web").alias("data"))
    bad = F.struct(F.lit(False).alias("success"), "error")
    return found.select("query_id", F.when(F.col("error").isNull(), F.to_json(good)).otherwise(F.to_json(bad)).alias("answer"))
