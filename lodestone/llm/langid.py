"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces; each language has a probability of every piece. A text is its words, each with the
vocabulary's blank mark before it, and its probability is the sum over all segmentations into pieces, by the forward
algorithm. As no piece goes beyond a word, that sum is a product over words, so that a text needs each of its
distinct words once, and a worker remembers words it has met.

Probabilities are learned by expectation-maximisation over the words of a bounded sample, SAMPLE documents a
language: expected counts of pieces over all segmentations by forward and backward sums, a round a job, in which words
counted by language are dealt out and pieces meet in the shuffle. Prior shares are of all labelled documents.

Defined results: blanks are Unicode's white space, and runs of them one mark. A character that no piece begins with its
own is the bytes of its UTF-8 form, which the vocabulary has as pieces. A text that is null or has no letter is `und` with
score 0, as is every text where nothing could be learned; else the score is the probability of the predicted language
among those learned. Equally likely languages: the first by code point. Rows of the sample are by crc32 of the id, then id;
ids may be null or repeated. Texts of any length are read whole, in slices; the empty string is a language like any other.
An empty table gives an empty one. Extra columns are ignored by `op13`, kept by `identify` unless they have a result's name.
"""

from __future__ import annotations

import functools
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fold, held, rows_of, stored

FOLDS = 5
SAMPLE = 2000  # documents of a language that piece probabilities are learned from, at most
MARGIN = 1.5
ROUNDS = 4
LANGUAGES = 500  # at most: a model has a number for each piece and language, some 128 MB then
PRIOR = 0.01  # count that each piece starts with in each language
MARK = "▁"
UNKNOWN = -1
BETWEEN = 8  # positions between two scalings of a word's sums
CELLS = 1 << 20  # numbers that a batch of words holds
SLICE = 1 << 20  # characters of a text that are words at once
REMEMBERED, LONGEST = 300_000, 48  # words a worker remembers, and characters of them


@functools.cache
def pieces_of(path: str) -> tuple[list[str], list[int]]:
    """The pieces of a vocabulary file that can stand in a word, and the places of its 256 byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [model.id_to_piece(k) for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    plain = sorted({p for p in plain if MARK not in p[1:]})
    return plain, list(range(len(plain), len(plain) + 256))


def default_vocabulary() -> str:
    sys.path.append("/opt/tokenizers")
    try:
        import public_tokenizers
    finally:
        sys.path.remove("/opt/tokenizers")
    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """All segmentations of words into pieces: a tree of the pieces' characters, whose steps are found in one hash table for many
    positions at once."""

    def __init__(self, pieces: list[str]):
        nodes = {"": 0}
        for p in pieces:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[p] for p in pieces]] = range(len(pieces))
        self.widest = max(map(len, pieces), default=1)
        self.bytes_at = len(pieces)
        steps = np.array([(nodes[p[:-1]] << 21 | ord(p[-1]), k) for p, k in nodes.items() if p], np.int64).reshape(-1, 2)
        self.mask = (4 << len(steps).bit_length()) - 1
        self.keys, self.nodes = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left, at = steps, self._slot(steps[:, 0])
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.nodes[at[free]] = left[free].T
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, -1 for none."""
        key = node.astype(np.int64) << 21 | char
        at, out = self._slot(key), np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.nodes[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], (at[more] + 1) & self.mask
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(word, start, end, piece) of every piece in every word, by start; the words' lengths; and the characters that stand for
        themselves as bytes, whose pieces are numbered from -1 down."""
        length = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        start = np.arange(len(chars)) - np.repeat(np.cumsum(length) - length, length)
        left = length[word] - start
        node, at = np.zeros(len(chars), np.int32), np.arange(len(chars))
        parts, odd = [], np.zeros(0, np.int64)
        for n in range(1, self.widest + 1):
            node = self._step(node, chars[at + n - 1])
            piece = np.where(node >= 0, self.piece[node], -1)
            if n == 1:
                lone = np.flatnonzero(piece < 0)
                odd, which = np.unique(chars[lone], return_inverse=True)
                parts.append((word[lone], start[lone], start[lone] + 1, -1 - which))
            some = np.flatnonzero(piece >= 0)
            parts.append((word[at[some]], start[at[some]], start[at[some]] + n, piece[some]))
            on = np.flatnonzero((node >= 0) & (left[at] > n))
            node, at = node[on], at[on]
            if not len(at):
                break
        made = np.stack([np.concatenate(c) for c in zip(*parts)], 1).astype(np.int64)
        order = made[:, 1].astype(np.uint16) if len(length) and length.max() < 1 << 16 else made[:, 1]  # short keys sort faster
        return made[np.argsort(order, kind="stable")], length, [chr(c).encode("utf-8", "surrogatepass") for c in odd.tolist()]

    def probabilities(self, table: np.ndarray, odd: list[bytes], piece: np.ndarray) -> np.ndarray:
        """Of each edge, by language: a piece's own or the product of its bytes'."""
        if not odd:
            return table[piece]
        own = np.stack([table[[self.bytes_at + b for b in c]].prod(0) for c in odd])
        return np.concatenate([table, own[::-1]])[piece]


def _scaled(sums: np.ndarray, logs: np.ndarray, at: int, step: int, widest: int) -> None:
    """Brings what stands at and beyond a position (before it, for step -1) to about one, and notes by how much."""
    window = slice(at, at + widest + 1) if step > 0 else slice(max(0, at - widest), at + 1)
    most = sums[:, window].max(1)
    most[most == 0] = 1
    sums[:, window] /= most[:, None]
    logs[:, slice(at, None) if step > 0 else slice(0, at + 1)] += np.log(most)[:, None]


def passes(lattice: Lattice, words: list[str], table: np.ndarray, backward: bool):
    """(log probability of each word by language; edges, their expected counts by language if `backward`)."""
    edges, length, odd = lattice.edges(words)
    p = lattice.probabilities(table, odd, edges[:, 3])
    w, i, j, _ = edges.T
    most, langs = int(length.max()), table.shape[1]
    begin = np.searchsorted(i, np.arange(most + 1))
    rows = np.arange(len(words))

    def swept(starts: np.ndarray, source: np.ndarray, target: np.ndarray, order: range, step: int):
        sums, logs = np.zeros((len(words), most + 1, langs)), np.zeros((len(words), most + 1, langs))
        sums[rows, starts] = 1
        flat, source, target = sums.reshape(-1, langs), w * (most + 1) + source, w * (most + 1) + target
        for k, at in enumerate(order):
            if k and k % BETWEEN == 0:
                _scaled(sums, logs, at, step, lattice.widest)
            e = slice(begin[at], begin[at + 1]) if step > 0 else by_end[begin_back[at] : begin_back[at + 1]]
            flat[target[e]] += flat[source[e]] * p[e]  # from one position each target is reached once
        return sums, logs

    forward, up = swept(np.zeros(len(words), np.int64), i, j, range(most), 1)
    total = np.log(forward[rows, length]) + up[rows, length]
    if not backward:
        return total, edges, None
    by_end = np.argsort(j.astype(np.uint16) if most < 1 << 16 else j, kind="stable")
    begin_back = np.searchsorted(j[by_end], np.arange(most + 2))
    back, down = swept(length, j, i, range(most, 0, -1), -1)
    expected = forward[w, i] * p * back[w, j] * np.exp(up[w, i] + down[w, j] - total[w])
    return total, (edges, odd), expected


def batches_of(words: list[str], langs: int) -> Iterator[list[str]]:
    """Words of like length together, so many that a batch's sums stay within CELLS."""
    held_, widest = [], 0
    for word in sorted(words, key=len):
        if held_ and (len(held_) + 1) * (len(word) + 1) * langs > CELLS:
            yield held_
            held_ = []
        held_.append(word)
    if held_:
        yield held_


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, by slices that end between words."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            gap = BLANK.search(text, end)
            end = gap.end() if gap else len(text)
        yield text[at:end].split()
        at = end


BLANK = re.compile(r"\s")


class Model:
    """Languages in order, log prior shares, and probabilities (piece, language)."""

    def __init__(self, languages: list[str], shares: list[float], table: np.ndarray, vocabulary: str):
        self.languages, self.prior, self.table, self.vocabulary = languages, np.log(shares), table, vocabulary


class _Known:
    """What a worker keeps: the lattice, and words' log probabilities as rows of one matrix. When that is full, words that were
    met but once are forgotten, or all if these are few."""

    def __init__(self, model: Model, pieces: list[str]):
        self.model, self.lattice = model, Lattice(pieces)
        self.at: dict[str, int] = {}
        self.logs = np.zeros((REMEMBERED, len(model.languages)))
        self.again = np.zeros(REMEMBERED, bool)

    def _forget(self) -> None:
        kept = [(w, k) for w, k in self.at.items() if self.again[k]]
        kept = kept if len(kept) < REMEMBERED // 2 else []
        self.logs[: len(kept)] = self.logs[[k for _, k in kept]]
        self.at = {w: n for n, (w, _) in enumerate(kept)}
        self.again[:] = False

    def totals(self, counts: list[dict[str, int]]) -> list[np.ndarray]:
        """Of each count of words the sum of count times log probability, by language."""
        every = set().union(*counts)
        if len(self.at) + len(every) > REMEMBERED:
            self._forget()
        fresh, known = [w for w in every if w not in self.at], len(self.at)
        extra: list[str] = []  # words that aren't kept beyond this call
        more = []
        for batch in batches_of(fresh, self.logs.shape[1]):
            logs = passes(self.lattice, [MARK + w for w in batch], self.model.table, False)[0]
            keep = np.array([len(w) <= LONGEST for w in batch]) & (np.arange(len(batch)) + len(self.at) < REMEMBERED)
            first = len(self.at)
            self.logs[first : first + keep.sum()] = logs[keep]
            for w, kept in zip(batch, keep.tolist()):
                if kept:
                    self.at[w] = len(self.at)
                else:
                    extra.append(w)
            more.append(logs[~keep])
        more = np.concatenate(more) if more else self.logs[:0]
        self.at.update((w, REMEMBERED + n) for n, w in enumerate(extra))
        out = []
        for c in counts:
            at = np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            own = at < REMEMBERED
            self.again[at[own & (at < known)]] = True
            out.append(n[own] @ self.logs[at[own]] + n[~own] @ more[at[~own] - REMEMBERED])
        for w in extra:
            del self.at[w]
        return out


def predict(known: _Known | None, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
    """(language, probability) of each text, in order. Words of several short texts are scored together; of a long
    one slice by slice."""

    def ended(z: np.ndarray | None) -> tuple[str, float]:
        if z is None:
            return "und", 0.0
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return known.model.languages[best], float(p[best] / p.sum())

    waiting: list[np.ndarray | None] = []
    counts: list[tuple[int, Counter]] = []
    size = 0

    def flush() -> Iterator[tuple[str, float]]:
        nonlocal size
        for (k, _), total in zip(counts, known.totals([c for _, c in counts]) if counts else ()):
            waiting[k] = waiting[k] + total
        yield from map(ended, waiting)
        waiting.clear()
        counts.clear()
        size = 0

    for text in texts:
        if known is None or not text or not any(map(str.isalpha, text)):
            waiting.append(None)
        else:
            waiting.append(known.model.prior)
            for words in words_of(text):
                length = min(SLICE, len(text))
                if size + length > SLICE and counts:  # what is counted so far joins its texts
                    for (k, _), total in zip(counts, known.totals([c for _, c in counts])):
                        waiting[k] = waiting[k] + total
                    counts.clear()
                    size = 0
                counts.append((len(waiting) - 1, Counter(words)))
                size += length
        if size >= SLICE // 2 or len(waiting) >= 4096:
            yield from flush()
    yield from flush()


def _learnable(documents: DataFrame, folds: int) -> DataFrame:
    return documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("doc_id"), folds), F.lit(1)) != 0))


def sampled(documents: DataFrame, sample: int, counts: dict[str, int]) -> DataFrame:
    """(lang, text): of each language, which has so many rows, the first documents by crc32 of the id. Ids alone are ranked, of a
    language that has more than `sample` only those whose crc32 is so small that about MARGIN times the sample is left; rows of
    an equal id and language come together, so that a few more than `sample` may be taken."""
    rows = _learnable(documents, FOLDS).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    spark = documents.sparkSession
    below = spark.createDataFrame([(lang, int((1 << 32) * min(1.0, MARGIN * sample / n))) for lang, n in counts.items()], "its string, below long")
    ids = rows.join(F.broadcast(below), F.col("lang") == F.col("its")).filter(key <= F.col("below"))  # at most LANGUAGES rows
    ids = ids.groupBy("lang", "doc_id").agg(F.min(key).alias("key"))
    ids = ids.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).filter(F.col("place") <= sample)
    ids = ids.select(F.col("lang").alias("its"), F.col("doc_id").alias("id"))
    # At most LANGUAGES times `sample` ids, eight bytes and a language each.
    return rows.join(F.broadcast(ids), (F.col("lang") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("lang", "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of a table (lang, text), words without their mark; a task counts before it hands on."""

    def run(batches):
        import pyarrow as pa

        def out(counts):
            rows = [(lang, w, n) for (lang, w), n in counts.items()]
            for at in range(0, len(rows), 10_000):
                part = list(zip(*rows[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64())], names=["lang", "word", "n"])

        counts: Counter = Counter()
        size = 0
        for b in batches:
            for lang, text in rows_of(b.select(["lang", "text"]), 16):
                for words in words_of(text or ""):
                    new = Counter((lang, w) for w in words)
                    size += sum(len(w) for _, w in new)
                    counts.update(new)
                    if len(counts) > 200_000 or size > 32 << 20:
                        yield from out(counts)
                        counts.clear()
                        size = 0
        yield from out(counts)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, languages: list[str], table: np.ndarray, pieces: list[str]) -> np.ndarray:
    """(piece, language): a round's expectations. A task adds up its words; the driver gets a row for each piece."""
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches):
        import pyarrow as pa

        lattice = Lattice(pieces)
        out = np.zeros(table.shape)
        for b in batches:
            by_lang: dict[str, dict[str, int]] = {}
            for lang, word, n in rows_of(b.select(["lang", "word", "n"]), 4096):
                by_lang.setdefault(lang, {})[word] = n
            for lang, counts in by_lang.items():
                k = number[lang]
                for batch in batches_of(list(counts), 1):
                    _, (edges, odd), e = passes(lattice, [MARK + w for w in batch], table[:, k : k + 1], True)
                    e = e[:, 0] * np.array([counts[w] for w in batch], float)[edges[:, 0]]
                    piece = edges[:, 3]
                    out[:, k] += np.bincount(piece[piece >= 0], e[piece >= 0], len(table))
                    for c, n in zip(odd, np.bincount(-1 - piece[piece < 0], e[piece < 0], len(odd))):
                        for byte in c:
                            out[lattice.bytes_at + byte, k] += n
        at, k = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(out[at, k])], names=["piece", "k", "n"])

    found = words.mapInArrow(run, "piece int, k int, n double").groupBy("piece").agg(F.collect_list(F.struct("k", "n")).alias("by"))
    made = np.zeros(table.shape)
    for r in found.toLocalIterator():
        for x in sorted(r.by):
            made[r.piece, x.k] += x.n
    return made


def fit(documents: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """The model of the labelled documents whose crc32 modulo FOLDS is not 0; None without any."""
    vocabulary = vocabulary or default_vocabulary()
    pieces, byte_places = pieces_of(vocabulary)
    shares = _learnable(documents, FOLDS).groupBy(F.col("lang").cast("string").alias("lang")).count().limit(LANGUAGES + 1).collect()
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not shares:
        return None
    shares = sorted((r.lang, r["count"]) for r in shares)
    languages = [lang for lang, _ in shares]
    words = stored(word_counts(sampled(documents, sample, dict(shares))), "langid-words")
    table = np.full((len(pieces) + len(byte_places), len(languages)), 1.0 / (len(pieces) + len(byte_places)))
    for _ in range(rounds):
        table = expected_counts(words, languages, table, pieces) + PRIOR
        table /= table.sum(0)
    n = sum(c for _, c in shares)
    return Model(languages, [c / n for _, c in shares], table, vocabulary)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score; the model, of a size that the vocabulary and LANGUAGES bound, is broadcast."""
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([f for f in documents.schema.fields if f.name in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast((model, pieces_of(model.vocabulary)[0])) if model else None
    name = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        known = held(("langid", name), lambda: _Known(*shared.value)) if shared else None
        for b in batches:
            made = list(predict(known, (t for (t,) in rows_of(b.select(["text"]), 64))))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*kept, "lang_pred", "score"])

    return documents.select(*kept).mapInArrow(run, schema)


def op13(documents: DataFrame) -> DataFrame:
    model = fit(documents)
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")
