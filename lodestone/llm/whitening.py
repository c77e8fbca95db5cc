"""Whitening of embeddings by a tall-skinny QR.

A first scan adds up the integer vectors exactly. A second one centres each row by the exact sums and turns a
partition's rows, block by block, into one triangular factor; factors merge by QR in a tree of fan-in FAN. The
singular values and right vectors of the last factor are those of all centred rows, so that no covariance is ever
formed. A third scan measures how far the whitened vectors' covariance is from the identity, a fourth returns them.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped; ids may be
null or repeated, each row is whitened on its own; vectors of different dimension have models of their own, n and
sums among them, while identity_error is the largest of all; components are cut to +-2^46 (2^52 as integers).
A component without variance (fewer rows than dimensions, constant entries) has explained 0 and whitened 0 and is
left out of identity_error. An eigenvector's largest entry (the first of equal ones) is positive. A `deviation` beyond a
64-bit integer is null, `deviation_exact` has up to 38 digits. An empty table gives an empty one. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import matrices, floored, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 16  # factors that one task merges
ROWS = 4096  # of a block, beside the factor
DIGITS = T.DecimalType(38, 0)


def _integers(x: np.ndarray) -> np.ndarray:
    return floored(x, SCALE) + SHIFT


def exact_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dimension -> (number of vectors, sums of their integer components): a row for each task and component meets in
    the shuffle, and one for each component comes to the driver."""

    def run(batches):
        import pyarrow as pa

        count, sums = {}, {}
        for b in batches:
            for rows, x in matrices(b.column(0)):
                d = x.shape[1]
                count[d] = count.get(d, 0) + len(rows)
                sums[d] = sums.get(d, 0) + _integers(x).sum(0).astype(object)
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([count[d]] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))],
                names=["dim", "at", "n", "total"],
            )

    found = vectors.mapInArrow(run, "dim int, at int, n long, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found.collect(), key=lambda r: (r.dim, r["at"])):
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.total))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where that holds it, else as Python's integers."""
    y = _integers(x)
    if n * int(np.abs(y).max()) + max(map(abs, sums)) < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def squared(v: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if v.dtype == object or np.abs(v).max() >= 1 << 50 or v.shape[1] > 1 << 12:
        return [sum(int(c) ** 2 for c in row) for row in v]
    if np.abs(v).max() < 1 << 25:
        return (v * v).sum(1).tolist()
    high, low = v >> 25, v & ((1 << 25) - 1)
    parts = ((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
    return [(a << 50) + (b << 26) + c for a, b, c in zip(*parts)]


def merged(df: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray], what: str) -> dict[int, np.ndarray]:
    """dimension -> the matrix that `combine` makes of all tasks' matrices, rows (dim, part, matrix), in a tree whose
    tasks read at most FAN of them. Only the last matrix of a dimension comes to the driver."""
    schema = "dim int, part int, matrix binary"

    def merge(table):
        import pyarrow as pa

        table = table.sort_by("part")
        d = table["dim"][0].as_py()
        made = combine([np.frombuffer(m, np.float64).reshape(-1, d) for m in table["matrix"].to_pylist()])
        return pa.table({"dim": pa.array([d], pa.int32()), "part": pa.array([table["part"][0].as_py() // FAN], pa.int32()), "matrix": pa.array([made.tobytes()], pa.binary())})

    df = stored(df, what)
    parts = (df.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        df = df.groupBy("dim", F.expr(f"part div {FAN}").alias("level")).applyInArrow(merge, schema)
        parts = -(-parts // FAN)
    return {r.dim: np.frombuffer(r.matrix, np.float64).reshape(-1, r.dim) for r in df.collect()}


def _of_tasks(vectors: DataFrame, start: Callable, add: Callable, end: Callable) -> DataFrame:
    """A matrix for each task and dimension: `end` of what `add(state, x)` makes of its vectors."""

    def run(batches):
        import pyarrow as pa

        state = {}
        for b in batches:
            for _, x in matrices(b.column(0)):
                d = x.shape[1]
                state[d] = add(state[d] if d in state else start(d), x)
        for d, s in state.items():
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([end(s).tobytes()], pa.binary())], names=["dim", "part", "matrix"])

    return vectors.mapInArrow(run, "dim int, part int, matrix binary")


def triangular(blocks: list[np.ndarray]) -> np.ndarray:
    """The R factor of the stacked blocks."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


def factors(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """dimension -> the triangular factor of all its centred rows."""

    def add(state, x):
        n, s = sums[x.shape[1]]
        state.append(centred(x, n, s).astype(np.float64) / n)
        if sum(map(len, state)) >= max(ROWS, 4 * x.shape[1]):
            state[:] = [triangular(state)]
        return state

    return merged(_of_tasks(vectors, lambda d: [], add, triangular), triangular, "whitening-factors")


class Whitener:
    """The components of one dimension, from the triangular factor of its centred rows."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray, components: int = COMPONENTS):
        _, s, right = np.linalg.svd(factor, full_matrices=True)
        s = np.concatenate([s, np.zeros(len(right) - len(s))])
        rows = np.arange(len(right))
        right = right * np.sign(right[rows, np.abs(right).argmax(1)])[:, None]
        self.n, self.sums = n, sums
        self.values = np.where(s > s[0] * len(s) * np.finfo(float).eps * 4, s**2 / n, 0)
        trace = self.values.sum()
        self.explained = (self.values / trace if trace else self.values)[:components]
        e = self.values[:components]
        # Vectors of the covariance, each over the root of its value.
        self.matrix = (right[: len(e)] * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0)[:, None]).T

    def whitened(self, v: np.ndarray) -> np.ndarray:
        return v.astype(np.float64) / self.n @ self.matrix


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    sums = exact_sums(vectors)
    return {d: Whitener(*sums[d], r, components) for d, r in factors(vectors, sums).items()}


def identity_error(vectors: DataFrame, models: dict[int, Whitener]) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, of components that have
    variance: each task adds up products of its whitened rows and their sums, a tree adds the tasks."""

    # Matrices travel with as many columns as the vectors have: products and sums stand in their first columns.
    def add(state, x):
        model = models[x.shape[1]]
        w = model.whitened(centred(x, model.n, model.sums))
        k = w.shape[1]
        state[:k, :k] += w.T @ w
        state[-1, :k] += w.sum(0)
        return state

    total = merged(_of_tasks(vectors, lambda d: np.zeros((min(d, models[d].matrix.shape[1]) + 1, d)), add, lambda s: s), lambda blocks: np.sum(blocks, 0), "whitening-products")
    worst = 0.0
    for d, t in total.items():
        model, k = models[d], len(t) - 1
        mean = t[-1, :k] / model.n
        off = t[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)
        alive = model.values[:k] > 0
        worst = max(worst, float(np.abs(off[np.ix_(alive, alive)]).max(initial=0)))
    return worst


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, deviation_exact, whitened array, explained array, identity_error), a row for each vector that
    isn't dropped."""
    vectors = embeddings.select(F.col("embedding").cast("array<double>").alias("embedding"))
    models = fit(vectors, components)
    error = identity_error(vectors, models)
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("n", T.LongType()), T.StructField("deviation_exact", DIGITS), T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, x in matrices(b.column(1)):
                model = models[x.shape[1]]
                v = centred(x, model.n, model.sums)
                w, n = model.whitened(v), len(at)
                k = w.shape[1]
                ends = pa.array(np.arange(n + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)),
                        pa.array([model.n] * n, pa.int64()),
                        pa.array([Decimal(s) for s in squared(v)], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(ends, pa.array(w.ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(np.tile(model.explained[:k], n))),
                    ],
                    names=schema.names,
                )

    made = rows.mapInArrow(run, schema)
    return made.withColumns({"deviation": F.expr("try_cast(deviation_exact AS long)"), "identity_error": F.lit(error)})


def op11(embeddings: DataFrame) -> DataFrame:
    parts = whiten(embeddings).withColumn("part", F.arrays_zip("whitened", "explained")).select("vec_id", "n", "deviation", "deviation_exact", "identity_error", F.posexplode("part").alias("at", "part"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error", "deviation_exact")
