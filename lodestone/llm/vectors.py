"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells. Each
vector lives in the cell of its nearest codewords and visits, in multi-sequence
order (ascending sum of the halves' distances), its nearest cells; how many is
set so that a pair at the threshold meets with the target probability from one
side (measured on a sample with planted pairs; as either side may find the
other, most pairs have two chances). What meets is verified in double precision.

Vectors that are equal number by number are one class with a multiplicity. A
cell's residents and visitors are cut into blocks of bounded size; a task
multiplies one block of residents with one of visitors and returns sums of links
and a spanning forest of them, never the pairs. A pair that both sides find is
counted by one of them: a resident knows which cells it visits itself.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; components are floats or doubles, which travel as they are and are compared in double precision; vectors of different dimension don't link, each
dimension has an index of its own; rows with the same id are one vertex but
have the links of their own vector. An empty table gives an empty one. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components

COSINE = 0.9
RECALL = 0.97  # of pairs at the threshold, from one side
SAMPLE, MOST_SAMPLE = 4096, 65_536  # vectors that codebooks are fitted on: at most the first, or so many a codeword up to the second
EACH = 16
PLANTED = 2000  # of them, so many to measure recall with
CELL = 200  # residents of a cell, about
LARGEST_BOOK = 4096  # reached by 3 * 10^9 vectors; beyond that cells grow
STEPS = 12  # of k-means
SEED = 11
RESIDENTS, VISITORS = 1024, 4096  # rows of a block, about


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1), 0)


def fit_book(x: np.ndarray, k: int, rng) -> np.ndarray:
    book = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        at = _squared(x, book).argmin(1)
        n = np.bincount(at, minlength=len(book))
        sums = np.stack([np.bincount(at, x[:, d], len(book)) for d in range(x.shape[1])], 1)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def multi_sequence(one: np.ndarray, two: np.ndarray, count: int) -> list[int]:
    """The `count` cells of least one[i] + two[j], in ascending order: from two
    sorted lists by a heap that holds the frontier of the grid."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    da, db = one[a], two[b]
    heap, seen, out = [(da[0] + db[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(two) + int(b[j]))
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (da[p[0]] + db[p[1]], *p))
    return out


def book_size(n: int) -> int:
    """Codewords of a half for n vectors: the grid has about n / CELL cells."""
    return min(1 << max(1, round(np.log2(max(n, 1) / CELL) / 2)), LARGEST_BOOK) if n > CELL else 1


class Index:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL):
        rng = np.random.default_rng(SEED)
        x = unit(sample)
        self.half = max(1, x.shape[1] // 2)
        k = min(book_size(n), len(x))
        self.books = [fit_book(h, k, rng) for h in self._halves(x)]
        self.visits = self._visits(x[:PLANTED], cosine, recall, rng)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        two = x[:, self.half :]
        return [x[:, : self.half], two if two.shape[1] else np.zeros((len(x), 1))]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_squared(h, b) for h, b in zip(self._halves(x), self.books)]

    def _visits(self, x: np.ndarray, cosine: float, recall: float, rng) -> int:
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        near = cosine * x + np.sqrt(1 - cosine**2) * noise
        one, two = self.distances(x)
        p, q = self.distances(near)
        i, j = p.argmin(1), q.argmin(1)
        rows = np.arange(len(x))
        cost = one[rows, i] + two[rows, j]
        rank = [int((one[r][:, None] + two[r][None, :] < cost[r]).sum()) for r in rows]
        return 1 + int(np.quantile(rank, recall, method="higher"))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each vector and the cells it visits, its own among them."""
        one, two = self.distances(x)
        home = one.argmin(1) * two.shape[1] + two.argmin(1)
        visits = [multi_sequence(a, b, self.visits) for a, b in zip(one, two)]
        return home, [v if h in v else [int(h), *v] for h, v in zip(home.tolist(), visits)]


def _matrix(column, size: int, kind: str) -> np.ndarray:
    """Unit rows in double precision of vectors that travel as they are stored."""
    return unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64))


def _block(cosine: float, dim: int, kind: str):
    """Residents times visitors: sums of links per vector, forest edges."""

    def run(residents, visitors):
        import pyarrow as pa

        x, y = _matrix(residents.column("vector"), dim, kind), _matrix(visitors.column("vector"), dim, kind)
        r, v = residents.column("rep").to_numpy(), visitors.column("rep").to_numpy()
        rn, vn = residents.column("copies").to_numpy(), visitors.column("copies").to_numpy()
        home, visited = visitors.column("home").to_numpy(), residents.column("visits").to_pylist()
        cell = int(residents.column("cell")[0].as_py())
        link = (x @ y.T >= cosine) & (r[:, None] != v[None, :])
        sums_r, sums_v = np.zeros(len(r), np.int64), np.zeros(len(v), np.int64)
        i, j = np.nonzero(link)
        if len(i):
            # A visitor's own cell is visited by this resident too, if it is its own or on its list: then the smaller id counts.
            mutual = home[j] == cell
            other = np.flatnonzero(~mutual)
            sets = {k: set(visited[k]) for k in np.unique(i[other]).tolist()}
            mutual[other] = [h in sets[k] for k, h in zip(i[other].tolist(), home[j[other]].tolist())]
            once = ~mutual | (v[j] < r[i])
            sums_r = np.bincount(i[once], vn[j[once]], len(r)).astype(np.int64)
            sums_v = np.bincount(j[once], rn[i[once]], len(v)).astype(np.int64)
        label_r, label_v = r.copy(), v.copy()
        far = np.iinfo(np.int64).max
        while len(i):
            new_v = np.minimum(label_v, _least(j, label_r[i], len(v), far))
            new_r = np.minimum(label_r, _least(i, new_v[j], len(r), far))
            if (new_v == label_v).all() and (new_r == label_r).all():
                break
            label_r, label_v = new_r, new_v
        ids = np.concatenate([r, v])
        sums, labels = np.concatenate([sums_r, sums_v]), np.concatenate([label_r, label_v])
        keep = (sums > 0) | (labels != ids)
        return pa.table({"id": pa.array(ids[keep], pa.int64()), "links": pa.array(sums[keep], pa.int64()), "to": pa.array(labels[keep], pa.int64())})

    return run


def _least(at: np.ndarray, values: np.ndarray, n: int, far: int) -> np.ndarray:
    out = np.full(n, far)
    np.minimum.at(out, at, values)
    return out


def _links(reps: DataFrame, dim: int, n: int, cosine: float, recall: float) -> DataFrame:
    """(id, links, to) of the representatives of one dimension."""
    rows = reps.orderBy(F.xxhash64("rep"), "rep").limit(min(MOST_SAMPLE, max(SAMPLE, EACH * book_size(n)))).select("embedding").collect()
    index = Index(np.array([r.embedding for r in rows], np.float64), n, cosine, recall)
    kind = "<f4" if reps.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            home, visits = index.cells(unit(x.astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("copies"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                names=["rep", "copies", "vector", "home", "visits"],
            )

    placed = stored(reps.select("rep", "copies", "embedding").mapInArrow(place, "rep long, copies long, vector binary, home long, visits array<long>"), "vectors-placed")
    lives = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n"))
    comes = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
    blocks = stored(lives.join(comes, "cell").select("cell", F.ceil(F.col("n") / RESIDENTS).alias("rows"), F.ceil(F.col("m") / VISITORS).alias("cols")), "vectors-blocks")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    residents = placed.withColumn("cell", F.col("home")).join(blocks, "cell").select("cell", part("rows").alias("row"), every("cols").alias("col"), "rep", "copies", "vector", "visits")
    visitors = placed.withColumn("cell", F.explode("visits")).join(blocks, "cell").select("cell", part("cols").alias("col"), every("rows").alias("row"), "rep", "copies", "vector", "home")
    visitors = visitors.toDF(*visitors.columns)  # names of its own, though both sides come from one table
    keys = ("cell", "row", "col")
    return residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(_guarded(_block(cosine, dim, kind)), "id long, links long, to long")


def _guarded(f):
    """Blocks that lack either side have no links."""

    def run(residents, visitors):
        import pyarrow as pa

        if not residents.num_rows or not visitors.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "links", "to")})
        return f(residents, visitors)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of (vec_id, embedding)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same number and must hash alike.
    number = T.FloatType() if vectors.schema["embedding"].dataType.elementType == T.FloatType() else T.DoubleType()
    same = F.when(valid, F.transform(e, lambda x: x.cast(number) + F.lit(0.0).cast(number)))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), same.alias("embedding"))
    v = v.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    classes = stored(v.filter("embedding IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors-classes")
    reps = v.filter("embedding IS NOT NULL").join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "k1", "k2"]).dropDuplicates(["vec_id", "k1", "k2"])
    reps = stored(reps.select(F.col("vec_id").alias("rep"), "copies", F.size("embedding").alias("dim"), "embedding"), "vectors-reps")
    sizes = sorted((r.dim, r.n) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect())
    out = v.select("vec_id", "k1", "k2", "embedding").withColumn("lone", F.col("embedding").isNull()).drop("embedding")
    if not sizes:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(reduce(DataFrame.union, [_links(reps.filter(F.col("dim") == d), d, n, cosine, recall) for d, n in sizes]), "vectors-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "i2")
    known = classes.join(sums, F.col("rep") == F.col("id"), "left").join(part, F.col("rep") == F.col("i2"), "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(False).alias("lone"))
    out = out.join(known, ["k1", "k2", "lone"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors.select("vec_id", "embedding"))
