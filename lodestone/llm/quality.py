"""Quality classifier: supervised subword embeddings.

A word's features are its hash and the hashes of its character n-grams, all
rows of one learned embedding table; a word is the mean of its features, a
document the mean of its words (with two marks for word repetition: the same
word again, the same word pair again); a softmax layer gives the class. Trained
by stochastic gradient descent in numpy, in one task, on a bounded sample of
labelled rows. As the network is linear up to the softmax, scoring folds table
and layer into one number a feature, so that a document costs a look-up a word.

Defined results: a null or blank text scores as the empty mean, by the bias
alone; without labelled rows of both kinds every score is 1 (nothing is
rejected). Repeated rows are scored each. Whole texts are read, in linear time.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, held, rows_of
from .sample import FOLDS, labelled, sigmoid, trained

SAMPLE = {0: 1000, 1: 1500}  # labelled rows that are learned from, at most
SLOTS = 1 << 17
SAME, AGAIN = SLOTS, SLOTS + 1  # marks of repetition
GRAMS = (2, 3, 4)
DIM, EPOCHS, BATCH, RATE, DECAY = 8, 12, 16, 0.15, 1e-4
SEED = 7
REMEMBERED = 200_000
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Slots of a word and of its character n-grams, ends marked."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [zlib.crc32(w) % SLOTS]
    s = f"<{word}>"
    for n in GRAMS:
        out += [zlib.crc32(s[k : k + n].encode("utf-8", "surrogatepass"), n) % SLOTS for k in range(len(s) - n + 1)]
    return out


def repeats(words: list[str]) -> tuple[int, int]:
    """How often a word follows itself, and how often a pair of words comes again."""
    after = words[1:]
    return sum(map(str.__eq__, words, after)), len(after) - len(set(zip(words, after)))


def vector(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of a document; the words' weights sum to 1."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, weights = [], []
    for w, n in Counter(words).items():
        if w not in known:
            known[w] = features(w)
        f = known[w]
        slots += f
        weights += [n / len(f)] * len(f)
    same, again = repeats(words)
    slots += [SAME, AGAIN]
    weights += [same, again]
    at, back = np.unique(np.array(slots), return_inverse=True)
    return at.astype(np.int32), (np.bincount(back, np.array(weights, float)) / len(words)).astype(np.float32)


def train(rows: list[tuple[int, str, int]]) -> dict | None:
    """Scores per slot, the bias; None without rows of both classes."""
    if len({y for _, _, y in rows}) < 2:
        return None
    known: dict[str, list[int]] = {}
    docs = [vector(text, known) for _, text, _ in rows]
    known.clear()
    y = np.array([label for _, _, label in rows])
    share = 0.5 / np.array([(y == 0).mean(), (y == 1).mean()])
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.3, (SLOTS + 2, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    # Adaptive steps: a slot's gradients are as small as its share of a document.
    sum_table, sum_layer, sum_bias = np.full(SLOTS + 2, 1e-12), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            slots = np.concatenate([docs[k][0] for k in batch])
            if not len(slots):
                continue
            weight = np.concatenate([docs[k][1] for k in batch])
            doc = np.repeat(np.arange(len(batch)), [len(docs[k][0]) for k in batch])
            mean = np.stack([np.bincount(doc, weight * table[slots, d], len(batch)) for d in range(DIM)], 1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= share[y[batch]][:, None] / len(batch)
            back = p @ layer.T
            g_layer, g_bias = mean.T @ p + DECAY * layer, p.sum(0)
            used, place = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(place, weight * back[doc, d], len(used)) for d in range(DIM)], 1)
            sum_table[used] += (g * g).mean(1)
            sum_layer += g_layer**2
            sum_bias += g_bias**2
            table[used] -= (rate * g / np.sqrt(sum_table[used])[:, None]).astype(np.float32)
            layer -= rate * g_layer / np.sqrt(sum_layer)
            bias -= rate * g_bias / np.sqrt(sum_bias)
    # What no document showed keeps its random start: it must say nothing.
    table[sum_table <= 1e-12] = 0
    return {"slots": (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


class _Grams(dict):
    """Character n-gram -> the number of its slot; forgets all when large."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    def __missing__(self, gram: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[gram] = v = float(self.slots[zlib.crc32(gram.encode("utf-8", "surrogatepass"), len(gram)) % SLOTS])
        return v


class _Words(dict):
    """Word -> its logit, the mean of its features' numbers; forgets all when large."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.grams = slots, _Grams(slots)

    def __missing__(self, w: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        s = f"<{w}>"
        grams = [s[k : k + n] for n in GRAMS for k in range(len(s) - n + 1)]
        whole = float(self.slots[zlib.crc32(s.encode("utf-8", "surrogatepass")) % SLOTS])
        self[w] = v = sum(map(self.grams.__getitem__, grams), whole) / (len(grams) + 1)
        return v


def known_words(fitted: dict) -> _Words:
    key = ("quality", zlib.crc32(fitted["slots"].tobytes()), fitted["bias"])
    return held(key, lambda: _Words(fitted["slots"]))


def logit(text: str | None, known: _Words, bias: float) -> float:
    words = text.split() if text else []
    if not words:
        return bias
    same, again = repeats(words)
    total = sum(map(known.__getitem__, words)) + same * float(known.slots[SAME]) + again * float(known.slots[AGAIN])
    return total / len(words) + bias


def score(df: DataFrame, fitted: dict | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score to rows with a text; all columns are kept. The model, half
    a MB of fixed size, travels with the task."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        known = known_words(fitted) if fitted else None
        for b in batches:
            made = [sigmoid(logit(t, known, fitted["bias"])) if fitted else 1.0 for (t,) in rows_of(b.select([text]))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(made, pa.float64())], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame) -> dict | None:
    return trained(labelled(documents, labels, "quality", SAMPLE), train)


def op2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
