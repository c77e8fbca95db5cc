"""Mixing sources to target weights along a time-varying curriculum. Native DataFrame code.

Each source has a share of all words by weight, held at a multiple of its own
size; what is cut off goes to the others by weight (water filling). Within a
source, documents stand in the order of a digest of their id and form a stream
of words that the mix reads from its start, again and again, until the
source's target is met. A source's weight over training time t in [0, 1] is
`1 + a(2t - 1)`; its integral is `G(t) = (1 - a)t + at^2`, and the word at share
u of the source's demand is trained at `G^-1(u)`.

Defined results: a null or blank text has size 0 and nothing is taken of it; a
null source is a source of its own, the last; repeated rows are documents of
their own, and rows with equal id and size are interchangeable. An empty table
gives an empty table. Extra columns are ignored.

Skew: each source's stream is cut into 256 buckets by digest; running sums
are over (source, bucket), and over the bucket totals of a source. Only the
table of sources (one row each) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_RE, numbered, shared_dir, unused

WEIGHTS = (5, 2, 1)
ROW = "row"  # number of the row, where documents have one: none but `mixed_documents` gives it
RAMPS = (-0.5, 0.0, 0.5)  # a of each weight's schedule
MOST = 3


def sized(documents: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, and the digest that orders the documents; as `ROW` the column `row`, if named."""
    return documents.select(
        *([F.col(row).alias(ROW)] if row else []),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("order_key"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST) -> DataFrame:
    """From (source, source_size): weight, ramp and target of each source."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("n") % len(values) + 1).cast("int"))
    s = sizes.withColumn("n", n).withColumn("weight", pick(weights)).withColumn("ramp", pick(ramps))
    cap = F.col("source_size") * most
    # Sources reach their cap in the order of cap / weight. Of the first that
    # does not, the level is what the capped ones leave, a unit of weight.
    by_cap = W.orderBy(F.col("source_size") / F.col("weight"), "n")
    before, rest = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("fits", F.col("left") * F.col("weight") <= cap * F.col("open_weight"))
    )
    s = s.withColumn("first", F.min(F.when(F.col("fits"), F.col("place"))).over(everything))
    at_first = lambda c: F.max(F.when(F.col("place") == F.col("first"), F.col(c))).over(everything)
    s = s.withColumn("level_left", at_first("left")).withColumn("level_weight", at_first("open_weight"))
    target = F.when(F.col("place") < F.col("first"), cap.cast("double")).otherwise(F.col("weight") * F.col("level_left") / F.col("level_weight"))
    return s.select("source", "source_size", "weight", "ramp", F.least(target, cap.cast("double")).alias("target"))


def training_time(share, ramp):
    """G^-1: when a source with this ramp has met this share of its demand."""
    b = F.lit(1.0) - ramp
    return F.when(ramp == 0.0, share).otherwise((F.sqrt(b * b + F.lit(4.0) * ramp * share) - b) / (F.lit(2.0) * ramp))


def _placed(documents: DataFrame, weights, ramps, most: int, row: str | None = None) -> DataFrame:
    """Each document with its place in its source's stream and what is taken of it."""
    shared_dir(documents.sparkSession)
    docs = sized(documents, row).withColumn("bucket", F.substring("order_key", 1, 2)).checkpoint()
    buckets = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(sizes, weights, ramps, most).withColumnRenamed("source", "s")
    past = W.rowsBetween(W.unboundedPreceding, -1).partitionBy("source")
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(past.orderBy("bucket")), F.lit(0)))
    offsets = offsets.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "ramp", "target"
    )
    inside = W.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", *([ROW] if row else [])).rowsBetween(W.unboundedPreceding, -1)
    d = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    demand = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * most)
    d = d.withColumn("start", F.col("offset") + F.col("inside")).withColumn("demand", demand)
    part = F.when(F.col("source_size") > 0, F.expr("demand % source_size")).otherwise(F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0))
    taken = F.col("size") * whole + F.least(F.greatest(part - F.col("start"), F.lit(0)), F.col("size"))
    return d.withColumn("taken", taken.cast("long"))


def _position(start) -> Column:
    """Training time of the word at this place of the source's repeated stream."""
    return F.round(training_time(F.least(start / F.col("demand"), F.lit(1.0)), F.col("ramp")), 9)


def mix(documents: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position (training time
    of the first copy, null where nothing is taken), range-sorted by position."""
    d = _placed(documents, weights, ramps, most)
    at = F.when(F.col("taken") > 0, _position(F.col("start")))
    d = d.select("doc_id", "source", "size", "source_size", "target", "taken", at.alias("position"))
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(documents: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST) -> DataFrame:
    """The documents as the mix trains on them, in the order of training: each as
    often as its taken words make whole copies (to the nearest, so at most one
    document of a source differs from `taken`), its columns unchanged. Each row
    is a document of its own, also where ids are null or repeated."""
    columns = documents.columns
    row, position, own, by_id = (unused(n, columns) for n in ("row", "position", "own", "by_id"))
    documents = numbered(documents, row, "mixing-rows")
    d = _placed(documents, weights, ramps, most, row).withColumn("copies", F.expr("(2 * taken + size) div (2 * nullif(size, 0))"))
    d = d.filter("copies > 0").select("doc_id", ROW, "start", "source_size", "demand", "ramp", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    d = d.select(F.col(ROW).alias(own), F.col("doc_id").alias(by_id), _position(F.col("start") + F.col("copy") * F.col("source_size")).alias(position))
    return documents.join(d, F.col(row) == F.col(own)).orderBy(position, by_id, own).select(*columns)


def op3(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS n FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][n + 1] AS weight, [-0.5::DOUBLE, 0::DOUBLE, 0.5::DOUBLE][n + 1] AS a, source_size * 3 AS cap FROM s),
o AS (
  SELECT *, row_number() OVER q AS place,
         (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW q AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
f AS (SELECT place AS first_place, room AS level_room, open_weight AS level_weight FROM o
      WHERE room * weight <= cap * open_weight ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, a,
         least(CASE WHEN place < first_place THEN cap::DOUBLE
                    ELSE (weight * level_room)::DOUBLE / level_weight::DOUBLE END, cap::DOUBLE) AS target FROM o, f),
p AS (
  SELECT d.*, t.source_size, t.target, t.a,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         least(floor(t.target + 0.5)::BIGINT, t.source_size * 3) AS demand
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, (CASE WHEN source_size > 0 THEN size * (demand // source_size)
             + least(greatest(demand % source_size - start, 0), size) ELSE 0 END)::BIGINT AS taken,
         least(start / demand, 1.0::DOUBLE) AS u FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN a = 0 THEN u
            ELSE (sqrt((1.0::DOUBLE - a) * (1.0::DOUBLE - a) + 4.0::DOUBLE * a * u) - (1.0::DOUBLE - a)) / (2.0::DOUBLE * a) END, 9) END AS position
FROM x
"""
