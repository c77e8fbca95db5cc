"""MinHash near-dedup by min-max hashing.

Each permutation of a document's shingles gives two signature values, its
minimum and its maximum, so that half the hash evaluations fill a signature;
42 bands of six values each bring similar documents together (a pair at
similarity 0.85 meets in 16 bands on average, in none with probability 2e-9).
What meets is confirmed on full shingle sets.

1. Documents of one shingle set are a class, for which its smallest id stands.
2. Bands of class representatives give buckets; those who share less than three
   buckets with others drop out (at similarity 0.85: probability 1e-6).
3. Of the rest, a document whose set has more than 15 % shingles that no other
   one's has can't link with anything: an exact bound that leaves few.
4. Each of them is compared with one leader, the document with the smallest share
   of unique shingles among those it shares a bucket with; confirmed links
   give components.
5. Pairs in a bucket that are still in different components, within the exact
   bound that sizes and unique shingles set, are each compared once (in the
   first band they share), and components are found again.

So links inside a component that one leader already spans are never listed, and
no link between different components is lost. What step 5 lists is quadratic
only in documents that share buckets, are no links of the leader, and have
few unique shingles.

Defined results: null, empty and blank texts have no shingles, link with nothing
and stand for themselves; rows with the same id are one vertex. An empty table
gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, rows_of, stored, words
from .components import components

WIDTH = 5
SIMILAR = 85  # of a hundred
PERMUTATIONS, BAND = 126, 6
BANDS = 2 * PERMUTATIONS // BAND
LEAST_SHARED = 3
SEED = 20
AT_ONCE = 1024  # shingles that are hashed at a time

SIGNED = "doc_id long, n long, set_hi long, set_lo long, bands array<long>"


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of all words if fewer."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, w)), np.uint64)
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(total)


class Signer:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
        self.a, self.b = draw(PERMUTATIONS) | np.uint64(1), draw(PERMUTATIONS)
        self.c, self.band = draw(BAND) | np.uint64(1), draw(BANDS)

    def bands(self, s: np.ndarray) -> np.ndarray:
        """The band keys of a non-empty set, the number of the band mixed in."""
        low = high = None
        for at in range(0, len(s), AT_ONCE):
            p = s[at : at + AT_ONCE, None] * self.a + self.b
            lo, hi = p.min(0), p.max(0)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        values = np.concatenate([low, high]).reshape(BANDS, BAND)
        return _mixed((_mixed(values) * self.c).sum(1, dtype=np.uint64) + self.band)


def signed(documents: DataFrame) -> DataFrame:
    """Size, digest of the set and band keys of every document; null keys for empty sets."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashes, signer = held("neardup", _Hashes), Signer()
        for b in batches:
            n, hi, lo, bands = [], [], [], []
            for (text,) in rows_of(b.select(["text"])):
                s = shingles(text, hashes)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                hi.append(d and int.from_bytes(d[:8], "little", signed=True))
                lo.append(d and int.from_bytes(d[8:], "little", signed=True))
                bands.append(signer.bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "set_hi", "set_lo", "bands"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def shingle_sets(documents: DataFrame) -> DataFrame:
    """(id, n, shingles) of documents with `id` and `text`."""

    def run(batches):
        import pyarrow as pa

        hashes = held("neardup", _Hashes)
        for b in batches:
            sets = [shingles(t, hashes).view(np.int64) for (t,) in rows_of(b.select(["text"]))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "shingles"])

    return documents.select("id", "text").mapInArrow(run, "id long, n long, shingles array<long>")


def _can_link(n1: str, e1: str, n2: str, e2: str, similar: int = SIMILAR):
    """Whether sizes and numbers of unique shingles let two sets be similar: the
    common part lacks both sides' unique ones."""
    common = f"least({n1} - {e1}, {n2} - {e2})"
    return F.expr(f"100 * {common} >= {similar} * ({n1} + {n2} - {common})")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = both.select("a", "b", F.col("na").alias("na"), F.col("nb").alias("nb"), common.alias("common"))
    return both.filter(100 * F.col("common") >= similar * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def near_duplicates(documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of the documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signed(docs), "neardup-signatures")
    classes = stored(sig.filter("n > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "neardup-classes")

    reps = sig.filter("n > 0").join(classes.select(F.col("rep").alias("doc_id"), F.col("set_hi").alias("h"), F.col("set_lo").alias("l")), "doc_id")
    reps = reps.filter("set_hi = h AND set_lo = l").select(F.col("doc_id").alias("id"), "bands")
    exploded = reps.select("id", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = stored(exploded.join(shared, "key"), "neardup-members")
    met = stored(members.groupBy("id").agg(F.count("*").alias("buckets")).filter(F.col("buckets") >= LEAST_SHARED).select("id"), "neardup-met")

    sets = stored(shingle_sets(docs.withColumnRenamed("doc_id", "id").join(met, "id", "left_semi")), "neardup-sets")
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    unique = alone.groupBy("id").agg(F.count("*").alias("u"))
    able = sets.select("id", "n").join(unique, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    able = stored(able.filter(F.expr(f"100 * (n - u) >= {similar} * n")).dropDuplicates(["id"]), "neardup-able")
    sets = sets.join(able.select("id"), "id", "left_semi")
    members = members.join(able, "id")

    rank = F.struct((F.col("u") / F.col("n")).alias("share"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("u").alias("u"))
    leaders = members.groupBy("key").agg(F.min(rank).alias("leader"))
    best = members.join(leaders, "key").filter("id <> leader.id").groupBy("id", "n", "u").agg(F.min("leader").alias("leader"))
    first = best.select(F.col("leader.id").alias("a"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("leader.n").alias("na"), F.col("leader.u").alias("ua"))
    links = stored(confirmed(first.filter(_can_link("na", "ua", "nb", "ub", similar)).select("a", "b"), sets, similar), "neardup-links")

    part = components(links)
    placed = members.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    # The rest: buckets that hold several components. Bands tell where a pair first meets.
    bands = reps.join(able.select("id"), "id", "left_semi")
    rest = stored(placed.join(mixed, "key").join(bands, "id").select("key", "id", "n", "u", "component", "bands"), "neardup-rest")
    one = rest.select("key", *(F.col(c).alias(f"{c}1") for c in ("id", "n", "u", "component", "bands")))
    two = rest.select("key", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "u", "component", "bands")))
    meet = F.expr("element_at(bands1, int(array_position(zip_with(bands1, bands2, (x, y) -> x = y), true))) = one.key")
    pairs = one.alias("one").join(two.alias("two"), (F.col("one.key") == F.col("two.key")) & F.expr("id1 < id2 AND component1 <> component2") & _can_link("n1", "u1", "n2", "u2", similar) & meet)
    more = stored(confirmed(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")), sets, similar), "neardup-links")
    if not more.isEmpty():
        part = components(links.union(more))

    found = classes.join(part, F.col("rep") == F.col("id"), "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "set_hi", "set_lo").join(found, ["set_hi", "set_lo"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)
