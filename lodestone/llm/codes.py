"""Product quantisation of embeddings with an exact search by annuli of norms.

Vectors become integers and are cut into PARTS equal consecutive parts; each part position has a codebook. The entries of
a codebook are sorted by norm. By the triangle inequality an entry nearer than the best one known has a norm within the
best distance of the part's norm: that interval is found by binary search, and only entries in it, both ends included, are
compared exactly. The search starts at the entries nearest by norm and widens, so that the interval shrinks meanwhile.

A round is one scan: a task adds up the parts of each entry, the shuffle gets a row for each task, entry and 16
components, and the driver gets the codebooks alone (256 entries of a vector's length).

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped. Ids may be null or
repeated: each row is coded on its own, the first entries are by id, then by vector, null ids last. With fewer than 256
rows the codebooks are as short. Vectors of different dimension have codebooks of their own; a dimension that isn't a multiple of
PARTS is filled up with zeros. Components are cut to +-2^42 (2^52 as integers); an error that no 64-bit integer holds ends the
query with a message. An empty table gives an empty one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import floored, matrices, stored, unused

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
NEAREST = 4  # entries on each side that the search begins with
PAIRS = 1 << 16  # that are compared at once
TOGETHER = 16  # components of a row of sums
LABELS = 100_000  # sums by label are broadcast up to so many, beyond that joined by shuffling
SALTS = 16


def cut(x: np.ndarray) -> np.ndarray:
    """Vectors as integers, (part, row, position)."""
    y = floored(x, SCALE)
    width = -(-y.shape[1] // PARTS)
    y = np.pad(y, ((0, 0), (0, width * PARTS - y.shape[1])))
    return y.reshape(len(y), PARTS, width).transpose(1, 0, 2)


class Annuli:
    """A codebook with its entries by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norms = norm[self.order]
        self.largest = int(np.abs(entries).max())
        self.compared = 0

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry, the lowest of equally near ones, and its squared distance, exactly."""
        exact = np.int64 if (self.largest + int(np.abs(q).max())) ** 2 * q.shape[1] < 1 << 62 else object
        q, entries = q.astype(exact), self.entries.astype(exact)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        best, code = np.full(len(q), (1 << 62) if exact is np.int64 else 1 << 200, exact), np.full(len(q), len(entries))
        left = np.searchsorted(self.norms, norm)
        right = left.copy()
        open_, width = np.arange(len(q)), NEAREST
        reach = np.full(len(q), np.inf)
        while len(open_):
            # Rounding must not shut an entry out: the interval is a little wider than it need be.
            slack = (np.where(np.isfinite(reach[open_]), reach[open_], 0) + norm[open_]) * 1e-12 + 1e-9
            low = np.searchsorted(self.norms, norm[open_] - reach[open_] - slack, "left")
            high = np.searchsorted(self.norms, norm[open_] + reach[open_] + slack, "right")
            some = (low < left[open_]) | (high > right[open_])
            open_, low, high = open_[some], low[some], high[some]
            for first, last, side in ((np.maximum(low, left[open_] - width), left[open_], left), (right[open_], np.minimum(high, right[open_] + width), right)):
                self._compare(q, entries, open_, first, np.maximum(last, first), best, code)
                side[open_] = np.minimum(first, last) if side is left else np.maximum(first, last)
            reach[open_] = np.sqrt(best[open_].astype(np.float64))
            width *= 2
        return code, best

    def _compare(self, q, entries, rows, first, last, best, code) -> None:
        """Entries first to last, by norm, with each of the rows."""
        some = last > first
        rows, first, count = rows[some], first[some], (last - first)[some]
        step = max(1, PAIRS // max(1, int(count.max(initial=0))))
        for at in range(0, len(rows), step):
            r, f, c = rows[at : at + step], first[at : at + step], count[at : at + step]
            start = np.concatenate([[0], np.cumsum(c)[:-1]])
            of = np.repeat(np.arange(len(r)), c)
            entry = self.order[np.arange(len(of)) - start[of] + f[of]]
            gap = q[r[of]] - entries[entry]
            far = (gap * gap).sum(1)
            self.compared += len(far)
            least = np.minimum.reduceat(far, start)
            lowest = np.minimum.reduceat(np.where(far == least[of], entry, len(entries)), start)
            better = (least < best[r]) | ((least == best[r]) & (lowest < code[r]))
            best[r[better]], code[r[better]] = least[better], lowest[better]


Books = dict[int, np.ndarray]  # dimension -> (part, entry, position)


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def first_books(rows: DataFrame) -> Books:
    """The parts of the vectors with the smallest ids, of each dimension."""
    kept = rows.filter(F.expr("size(embedding) > 0") & F.forall("embedding", _finite)).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    place = F.row_number().over(W.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "embedding"))
    found = kept.withColumn("place", place).filter(F.col("place") <= ENTRIES).collect()
    by_dim: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r.place):
        by_dim.setdefault(r.dim, []).append(r.embedding)
    return {d: cut(np.array(v, np.float64)) for d, v in by_dim.items()}


def _sums(y: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each entry has and their sums."""
    order = np.argsort(code, kind="stable")
    used, start = np.unique(code[order], return_index=True)
    total = np.zeros((entries, y.shape[1]), object)
    total[used] = np.add.reduceat(y[order], start, axis=0)
    return np.bincount(code, minlength=entries), total


def next_books(rows: DataFrame, books: Books) -> Books:
    """The books after a round: each entry the floor of the mean of its parts, or as it was without any."""

    def run(batches):
        import pyarrow as pa

        search = {d: [Annuli(b) for b in book] for d, book in books.items()}
        count = {d: np.zeros(book.shape[:2], np.int64) for d, book in books.items()}
        total = {d: np.zeros(book.shape, object) for d, book in books.items()}
        for b in batches:
            for _, x in matrices(b.column(b.schema.get_field_index("embedding"))):
                d = x.shape[1]
                for part, y in enumerate(cut(x)):
                    n, s = _sums(y, search[d][part].nearest(y)[0], books[d].shape[1])
                    count[d][part] += n
                    total[d][part] += s
        for d in books:
            for part, entry in zip(*(a.tolist() for a in np.nonzero(count[d]))):
                s = [Decimal(int(v)) for v in total[d][part, entry]]
                pieces = [s[at : at + TOGETHER] for at in range(0, len(s), TOGETHER)]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * k, pa.int32()) for v in (d, part, entry)), pa.array(range(k), pa.int32()), pa.array([int(count[d][part, entry])] * k, pa.int64()), pa.array(pieces, pa.list_(pa.decimal128(38, 0)))],
                    names=["dim", "part", "entry", "piece", "n", "total"],
                )

    sums = rows.select("embedding").mapInArrow(run, "dim int, part int, entry int, piece int, n long, total array<decimal(38,0)>")
    each = [F.sum(F.get("total", F.lit(k))).alias(f"s{k}") for k in range(TOGETHER)]
    out = {d: book.copy() for d, book in books.items()}
    for r in sums.groupBy("dim", "part", "entry", "piece").agg(F.sum("n").alias("n"), *each).collect():
        at = r.piece * TOGETHER
        mean = [int(r[f"s{k}"]) // r.n for k in range(min(TOGETHER, out[r.dim].shape[2] - at))]
        out[r.dim][r.part, r.entry, at : at + TOGETHER] = mean
    return out


def fit_books(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        books = next_books(rows, books)
    return books


def digest(books: Books) -> str:
    """SHA-256 of all entries' components as decimal numbers, by dimension, part, entry and position."""
    return hashlib.sha256(",".join(str(v) for d in sorted(books) for v in books[d].ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of each row that isn't dropped."""
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        import pyarrow as pa

        search = {d: [Annuli(b) for b in book] for d, book in books.items()}
        for b in batches:
            for at, x in matrices(b.column(2)):
                found = [search[x.shape[1]][part].nearest(y) for part, y in enumerate(cut(x))]
                error = sum(far.astype(object) for _, far in found)
                if max(error) >= 1 << 63:
                    raise ValueError(f"a squared error of {max(error)} is more than 64 bits hold")
                text = [code.astype(np.uint8).tobytes().hex() for code in np.stack([code for code, _ in found], 1)]
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(text), pa.array(error.tolist(), pa.int64())], names=schema.names)

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def with_sums(df: DataFrame, key: str, value: str, out: str, most: int = LABELS) -> DataFrame:
    """Adds the sum of a column over rows of an equal key, nulls together: sums are small where keys are few, and are then
    broadcast; else rows are dealt by key and salt, so that a hot key is SALTS tasks. `df` must be stored."""
    same, salt = unused("same", df.columns), unused("salt", df.columns)
    sums = df.groupBy(F.col(key).alias(same)).agg(F.sum(value).alias(out))
    if sums.limit(most + 1).count() <= most:
        return df.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col(same))).drop(same)
    sums = sums.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn(f"{salt}_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return df.join(sums, F.col(key).eqNullSafe(F.col(same)) & (F.col(f"{salt}_") == F.col(salt))).drop(same, salt, f"{salt}_")


def op12(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    books = fit_books(rows)
    made = with_sums(stored(coded(rows, books), "codes"), "label", "error", "label_error")
    return made.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql12() -> str:
    """The rounds one after the other: a_k assigns parts to the books b_k, b_k+1 are their means."""
    out = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, part::BIGINT AS part, y[part * (len(y) // {PARTS}) + 1 : (part + 1) * (len(y) // {PARTS})] AS q
  FROM v, range({PARTS}) AS r(part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"""
    for k in range(ROUNDS + 1):
        out += f""",
a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, q, min({{'far': list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': entry}}) AS near
  FROM p JOIN b{k} USING (part) GROUP BY vec_id, label, part, q)"""
        if k < ROUNDS:
            out += f""",
s{k} AS (
  SELECT part, near.entry AS entry, pos, sum(q[pos]) AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(q) + 1)) AS pos FROM a{k}) GROUP BY part, near.entry, pos),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
    return (
        out
        + f""",
e AS (
  SELECT vec_id, label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, sum(near.far)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM e
"""
    )


SQL12 = _sql12()
