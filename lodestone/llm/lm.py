"""LM scoring: a deleted-interpolation bigram model over the whole corpus.

P(w | h) = a_b c(hw)/c(h) + b_b c(w)/N + g_b /(V+1), the weights by the bucket b
of the context's frequency c(h). The weights are learned by expectation
maximisation on held-out training documents (a tenth of all) with the counts
of the others; scores then use the counts of all training documents.

How it runs: texts are packed into blocks of a few MB (one row each, stored in
the shared folder). A block asks once for each distinct n-gram it holds: its
sorted 64-bit keys and own counts go to shards by key range. A shard's task adds
the counts up and answers each block with an array of totals, aligned to what
the block asked for; blocks and answers meet by block and the block is scored.
So no n-gram is ever a row, frequent n-grams cost a block one key as rare ones
do, a task holds one shard or one block, and all moves grow as the input.

Keys are 56-bit hashes of words and word pairs: with n distinct n-grams the
expected number that share a key is n^2 / 2^56. They travel sorted, as the byte
planes of their differences, which leaves about five bytes a key.

Defined results: a null or blank text is the end token alone; repeated rows are
scored (and learned from) each; an empty table gives an empty one; without
training tokens the base score is that of the formula with zeros. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, release, rows_of, stored, words

FOLDS, HELD_OUT, TUNING = 10, 0, 1
#: Bytes of text of a block, and of the text whose n-grams a shard gets: least,
#: most, and the number of them that the corpus is cut into in between.
BLOCK_BYTES, SHARD_BYTES = (1 << 20, 32 << 20, 4096), (6 << 20, 256 << 20, 2048)
KEY_BITS = 56
BUCKETS = 14  # of context frequencies: 0, then by powers of two
BINS = 48  # of log probabilities, for the held-out counts
EM_STEPS = 60

BLOCKS = "block long, tuning boolean, docs binary"
ASKED = "shard int, block long, keys binary, learned binary, tuned binary"
ANSWERS = "shard int, block long, rest binary, total binary, types long, rest_tokens long, tokens long, rest_docs long, docs long"

END, START = np.uint64(0x9E3779B97F4A7C), np.uint64(0xC2B2AE3D27D4EA)
ONE = np.uint64(1)


class _Hashes(dict):
    """Word -> even 56-bit hash; forgets all when it has become large."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w) >> 64 - KEY_BITS & ~1
        return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Odd hash of a pair of words."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE7037ED1A0B428DB)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - KEY_BITS) | ONE


def share(size: int, bounds: tuple[int, int, int]) -> int:
    least, most, n = bounds
    return min(most, max(least, size // n))


def pack_keys(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well where high bytes agree."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_totals(a: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, four or eight, which the first byte says."""
    kind = np.uint32 if a.max(initial=0) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(a.astype(kind))


def unpack_totals(raw: bytes) -> np.ndarray:
    return unpack(raw[1:], np.uint32 if raw[0] == 4 else np.uint64).astype(np.int64)


class Block:
    """The n-grams of a block's documents. Keys: words, pairs, and the start once."""

    def __init__(self, raw: bytes, hashes: _Hashes):
        import pyarrow as pa

        t = pa.ipc.open_stream(raw).read_all()
        self.doc_id, self.fold = t.column("doc_id").to_pylist(), t.column("fold").to_numpy()
        parts = []
        for text in t.column("text").to_pylist():
            w = words(text)
            h = np.empty(len(w) + 1, np.uint64)
            h[:-1] = list(map(hashes.__getitem__, w))
            h[-1] = END
            parts.append(h)
        self.n = np.array([len(p) for p in parts])
        token = np.concatenate(parts)
        self.first = np.cumsum(self.n) - self.n
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = START
        m = len(token)
        self.keys, at = np.unique(np.concatenate([token, _pair(before, token), [START]]), return_inverse=True)
        self.word, self.both = at[:m], at[m : 2 * m]
        self.context = np.empty(m, at.dtype)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = at[-1]
        self.start = at[-1]

    def counts(self, keep: np.ndarray) -> np.ndarray:
        """Of each key in the documents to keep; of the start, the documents."""
        w = np.repeat(keep, self.n).astype(np.float64)
        size = len(self.keys)
        c = np.bincount(self.word, w, size) + np.bincount(self.both, w, size)
        c[self.start] += keep.sum()
        return c.astype(np.uint32)


def blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), FOLDS).cast("int").alias("fold"), "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at, seq = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}

        def emit(tuning: bool):
            nonlocal seq
            ids, folds, texts = zip(*held[tuning])
            t = pa.table({"doc_id": pa.array(ids, pa.int64()), "fold": pa.array(folds, pa.int8()), "text": pa.array(texts, pa.string())})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            held[tuning].clear()
            size[tuning] = 0
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([at + seq]), pa.array([tuning]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "tuning", "docs"])

        for b in batches:
            for row in rows_of(b):
                tuning = row[1] == TUNING
                held[tuning].append(row)
                size[tuning] += len(row[2] or "") + 64
                if size[tuning] >= block_bytes:
                    yield emit(tuning)
        for tuning in held:
            if held[tuning]:
                yield emit(tuning)

    return stored(docs.mapInArrow(run, BLOCKS), "lm-blocks")


def _ask(shards: int):
    step = (1 << KEY_BITS) // shards + 1
    bounds = np.array([k * step for k in range(1, shards)], np.uint64)

    def run(batches):
        import pyarrow as pa

        hashes = _Hashes()
        for b in batches:
            for block, docs in zip(b.column("block").to_pylist(), b.column("docs")):
                release()
                x = Block(docs.as_py(), hashes)
                rest = x.counts((x.fold != HELD_OUT) & (x.fold != TUNING))
                tuned = x.counts(x.fold == TUNING)
                cuts = [0, *np.searchsorted(x.keys, bounds).tolist(), len(x.keys)]
                spans = [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                columns = [[f(a[s]) for _, s in spans] for f, a in ((pack_keys, x.keys), (pack, rest), (pack, tuned))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
                    names=["shard", "block", "keys", "learned", "tuned"],
                )

    return run


def _answer(t):
    """A shard: adds up what its blocks bring and answers each with the totals."""
    import pyarrow as pa

    release()  # what the worker's last shard held
    keys = [unpack_keys(x.as_py()) for x in t.column("keys")]
    merged, at = np.unique(np.concatenate(keys), return_inverse=True)
    at = at.astype(np.uint32)  # a shard has fewer keys than that
    release()

    def add(name: str) -> np.ndarray:
        out = np.zeros(len(merged), np.int64)
        lo = 0
        for k, x in zip(keys, t.column(name)):
            out[at[lo : lo + len(k)]] += unpack(x.as_py(), np.uint32)  # a block has each key once
            lo += len(k)
        return out

    rest = add("learned")
    total = rest + add("tuned")
    cuts = np.cumsum([0, *map(len, keys)])
    n, shard = len(keys), t.column("shard")[0].as_py()
    ends = list(zip(cuts[:-1], cuts[1:]))
    word, start = (merged & ONE == 0) & (merged != START), merged == START
    stats = [int(x) for x in (((total > 0) & word).sum(), rest[word].sum(), total[word].sum(), rest[start].sum(), total[start].sum())]
    return pa.table(
        {
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()),
            "rest": pa.array([*(pack_totals(rest[at[a:b]]) for a, b in ends), None], pa.binary()),
            "total": pa.array([*(pack_totals(total[at[a:b]]) for a, b in ends), None], pa.binary()),
            **{k: pa.array([None] * n + [v], pa.int64()) for k, v in zip(("types", "rest_tokens", "tokens", "rest_docs", "docs"), stats)},
        }
    )


def bucket(c: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for 0, k for 2^(k-1) <= c < 2^k, the last open."""
    return np.minimum(np.ceil(np.log2(c.astype(np.float64) + 1)), BUCKETS - 1).astype(np.int64)


def estimates(c: np.ndarray, x: Block, tokens: int):
    """Maximum-likelihood estimates of the block's tokens by pair and by word."""
    h = c[x.context].astype(np.float64)
    return np.divide(c[x.both], h, out=np.zeros(len(h)), where=h > 0), c[x.word] / max(tokens, 1), bucket(c[x.context])


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.round(-4 * np.log10(np.maximum(p, 1e-300))), 0, BINS - 2) + 1, 0).astype(np.int64)


def learn_weights(held: np.ndarray, types: int, steps: int = EM_STEPS) -> np.ndarray:
    """EM over held-out counts [bucket, bin of the pair's estimate, of the word's]:
    the weights of pair, word and uniform by bucket. Buckets without counts get
    the weights of all; where a context is unseen the pair has none."""
    values = np.concatenate([[0.0], 10 ** (-np.arange(BINS - 1) / 4)])
    p = np.stack(np.broadcast_arrays(values[:, None], values[None, :], 1.0 / (types + 1)))

    def em(counts: np.ndarray, seen: bool) -> np.ndarray:
        w = np.array([0.4, 0.4, 0.2]) if seen else np.array([0.0, 0.7, 0.3])
        for _ in range(steps if counts.sum() else 0):
            mix = w[:, None, None] * p
            got = (counts * mix / mix.sum(0)).sum((1, 2))
            w = np.maximum(got / got.sum(), [1e-9 * seen, 1e-6, 1e-6])
            w /= w.sum()
        return w

    common = em(held[1:].sum(0), True)
    return np.stack([em(h, k > 0) if h.sum() or k == 0 else common for k, h in enumerate(held)])


def score(documents: DataFrame, block_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """One row per document: counts, base score and score (log10)."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = blocks(documents, block_bytes or share(size, BLOCK_BYTES))
    shards = max(1, -(-size // (shard_bytes or share(size, SHARD_BYTES))))
    asked = packed.select("block", "docs").mapInArrow(_ask(shards), ASKED)
    answers = stored(asked.groupBy("shard").applyInArrow(_answer, ANSWERS), "lm-answers")
    names = ("types", "rest_tokens", "tokens", "rest_docs", "docs")
    types, rest_tokens, tokens, _, _ = (x or 0 for x in answers.filter("block IS NULL").agg(*(F.sum(n) for n in names)).first())
    answers = answers.filter("block IS NOT NULL").select("block", "shard", "rest", "total")

    def gather(raw: list, got, column: str, hashes: _Hashes):
        release()
        order = np.argsort(got.column("shard").to_numpy())
        parts = got.column(column)
        return Block(raw[0].as_py(), hashes), np.concatenate([unpack_totals(parts[int(k)].as_py()) for k in order])

    def tune(left, right):
        import pyarrow as pa

        x, c = gather(left.column("docs"), right, "rest", _Hashes())
        pair, word, b = estimates(c, x, rest_tokens)
        cell, n = np.unique((b * BINS + _bin(pair)) * BINS + _bin(word), return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    tuning = packed.filter("tuning").groupBy("block").cogroup(answers.join(packed.filter("tuning").select("block"), "block", "left_semi").select("block", "shard", "rest").groupBy("block"))
    cells = tuning.applyInArrow(tune, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # BUCKETS * BINS^2 at most
    held = np.zeros(BUCKETS * BINS * BINS)
    for r in cells:
        held[r.cell] = r.n
    weights = learn_weights(held.reshape(BUCKETS, BINS, BINS), types)

    def final(left, right):
        import pyarrow as pa

        x, c = gather(left.column("docs"), right, "total", _Hashes())
        pair, word, b = estimates(c, x, tokens)
        w = weights[b]
        p = w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (types + 1)
        own = c[x.word]
        base = np.log10((own + 0.1) / (tokens + 0.1 * (types + 1)))
        add = lambda v: np.add.reduceat(v, x.first)
        n = len(x.n)
        return pa.table(
            {
                "doc_id": pa.array(x.doc_id, pa.int64()),
                "held_out": pa.array(x.fold == HELD_OUT),
                "n_tokens": pa.array(x.n, pa.int64()),
                "n_known": pa.array(add((own > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(add(base), pa.float64()),
                "score": pa.array(add(np.log10(p)), pa.float64()),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.select("block", "docs").groupBy("block").cogroup(answers.select("block", "shard", "total").groupBy("block")).applyInArrow(final, out)


def op8(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text"))
