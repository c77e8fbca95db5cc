"""Labelled rows to fit a classifier on: all of them, or a bounded sample."""

from __future__ import annotations

import importlib
import math
import os
import pickle
import subprocess
import sys
import traceback
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import fold, held, rows_of

FOLDS = 5  # rows of fold 0 are held out
IDS = 200_000  # ids with a label that are broadcast: some 10 MB


def labelled(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, text, y): whole text and label of every row with the label 0 or 1, or of at most
    `most[v]` rows with each label v, those of least crc32 of the id, without the held-out fold.

    Ids are chosen from the labels alone; a bounded list of them is broadcast
    to fetch the texts, a longer one is joined by a shuffle. Labels that contradict
    each other for one id and null labels are left out, as are null texts.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = (
        labels.filter(F.col(label).isin(*(most or (0, 1))) & (fold(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("z"))
        .filter("y = z")
    )
    if most is None:
        chosen = small(known.select("doc_id", F.col("y").cast("int").alias("y")), IDS)
        rows = documents.filter(F.col("text").isNotNull()).join(chosen, "doc_id")
        return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value, n in most.items():
        part = known.filter(F.col("y") == value).select("doc_id", F.col("y").cast("int").alias("y")).orderBy(key, "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    rows = documents.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def child(module: str, name: str) -> None:
    """A training process: reads rows from its input up to the end, writes the model that
    the named function makes of them, or what went wrong."""
    out = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)  # what training prints is no part of the model
    try:
        rows = []
        while True:
            try:
                rows.append(pickle.load(sys.stdin.buffer))
            except EOFError:
                break
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        made = b"+" + pickle.dumps(getattr(importlib.import_module(module), name)(rows))
    except BaseException:
        made = b"-" + traceback.format_exc().encode()
    with out:
        out.write(made)


def in_child(train: Callable, rows) -> bytes:
    """The pickled model that `train`, a function of a module, makes of the rows in an
    interpreter of its own: rows are handed on one by one, and all memory goes back with its end."""
    code = f"from {__name__} import child; child({train.__module__!r}, {train.__name__!r})"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    with subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env) as p:
        try:
            for r in rows:
                pickle.dump(r, p.stdin)
            p.stdin.close()
        except BrokenPipeError:  # it says why below
            pass
        out = p.stdout.read()
    if out[:1] != b"+":
        raise RuntimeError(out[1:].decode() or "training ended without a model")
    return out[1:]


def trained(sample: DataFrame, train: Callable[[list[tuple[int, str, int]]], object]):
    """What `train` makes of the bounded sample, as (doc_id, text, label) rows by
    crc32 of the id. It runs in one task, where there is memory for it; the
    driver gets the model alone."""

    def run(batches):
        import pyarrow as pa

        held("training", dict)
        rows = (r for b in batches for r in rows_of(b.select(["doc_id", "text", "y"]), 16))
        yield pa.RecordBatch.from_arrays([pa.array([in_child(train, rows)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
