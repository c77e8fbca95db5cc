"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent pre-tokens are encoded once and compiled into a
minimal acyclic automaton whose edges carry additive outputs: the sum along an
accepted path is the word's rank among the sorted words, which addresses its
ids. The automaton's arrays lie in the shared folder and are memory-mapped by
the Python workers; words that it doesn't hold are merged exactly.

Defined results: a null text is an empty one, which has no ids. The strings of
added tokens become their ids, as in the library. Repeated rows are encoded
each. Extra columns are ignored by `op7`, kept by `encode`.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import re
import struct
import sys
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, held, placed, rows_of, scratch, stored

LEXICON_WORDS = 262_144
LONGEST = 32  # bytes of a lexicon word
SLICE = 1 << 21  # characters of text that are held as words at once
REMEMBERED = 240_000  # words whose encoding a worker remembers, beside those of a slice
HOT = 160_000  # of them, so many of the lexicon's stay


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _category_class(first: str, last: int) -> str:
    """The characters up to `last` of a general category as ranges of a character class."""
    out, start = [], None
    for cp in range(last + 2):
        inside = cp <= last and unicodedata.category(chr(cp))[0] == first
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


#: White space of the tokenizer's pattern. Fixed values.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def _piece_pattern(last: int) -> re.Pattern:
    """The pattern for texts without characters beyond `last`; small classes match faster."""
    letter, number = _category_class("L", last), _category_class("N", last)
    return re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{BLANKS}{letter}{number}]+")


def _last(text: str) -> int:
    """The smallest of four bounds of the text's code points."""
    if text.isascii():
        return 0x7F
    try:
        text.encode("latin-1")
        return 0xFF
    except UnicodeEncodeError:
        return 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Splitter:
    """Cuts texts into pre-tokens."""

    def __init__(self, spec: dict):
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @classmethod
    def load(cls, path: str | None):
        """From a tokenizer file; without a path from the default one of the machine that loads it."""
        with open(path or default_tokenizer(), encoding="utf-8") as f:
            return cls(json.load(f))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a whole text; added tokens stand as themselves."""
        if not any(s in text for s in self.added):
            return self._plain(text)
        out = []
        for part in self.specials.split(text):
            out += [part] if part in self.added else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return _piece_pattern(_last(text)).findall(text)


class Vocabulary(Splitter):
    """A tokenizer file: ids, merge ranks, added tokens; merges words exactly."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.symbols = byte_symbols()

    def merge(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        s = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.end
        return [self.ids[x] for x in (self._few(s) if len(s) <= 48 else self._many(s))]

    def _few(self, s: list[str]) -> list[str]:
        get, none = self.merges.get, len(self.merges)
        ranks = [get(p, none) for p in zip(s, s[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            s[i] += s.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), none)
        return s

    def _many(self, s: list[str]) -> list[str]:
        """The same by a heap of pairs over a linked list: n log n for long words."""
        nxt, prv = [*range(1, len(s)), -1], [-1, *range(len(s) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (r := self.merges.get((s[i], s[j]))) is not None:
                heapq.heappush(heap, (r, i, s[i], s[j]))

        for i in range(len(s)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [x for x in s if x]


def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary.load(path)


def compile_automaton(keys: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct keys, as arrays.

    Edges are sorted by `state * 256 + byte`; each has a target and a skip, the
    number of keys that come before those behind it. The root is the last state.
    """
    register: dict[tuple, int] = {}
    path: list[tuple[list, list]] = [([False], [])]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            state = register.setdefault((final[0], tuple(edges)), len(register))
            path[-1][1].append((last[len(path) - 1], state))

    for key in keys:
        same = 0
        while same < min(len(key), len(last)) and key[same] == last[same]:
            same += 1
        close(same)
        path.extend(([False], []) for _ in key[same:])
        path[-1][0][0] = True
        last = key
    close(0)
    root = (path[0][0][0], tuple(path[0][1]))
    states = [*register, root]
    below = np.zeros(len(states), np.int64)
    edge, target, skip = [], [], []
    for k, (final, edges) in enumerate(states):
        n = int(final)
        for label, to in edges:
            edge.append(k * 256 + label)
            target.append(to)
            skip.append(n)
            n += int(below[to])
        below[k] = n
    return {
        "edge": np.array(edge, np.int64),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in states], bool),
    }


class Lexicon:
    """The automaton with the ids of each word, its arrays mapped from files."""

    NAMES = ("edge", "target", "skip", "final", "out_at", "out_ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Lexicon:
        keys = sorted(words)
        outs = [words[k] for k in keys]
        flat = np.array([i for o in outs for i in o], np.uint32)
        return cls(compile_automaton(keys) | {"out_at": np.cumsum([0, *map(len, outs)]).astype(np.int64), "out_ids": flat})

    def save(self, folder: str) -> None:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        for n in self.NAMES:
            held = io.BytesIO()
            np.save(held, getattr(self, n))
            with fs.open_output_stream(f"{path}/{n}.npy") as f:
                f.write(held.getvalue())

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        fs, path = filesystem(folder)
        if fs.type_name == "local":
            return cls({n: np.load(f"{path}/{n}.npy", mmap_mode="r") for n in cls.NAMES})
        read = lambda n: np.load(io.BytesIO(fs.open_input_stream(f"{path}/{n}.npy").read()))
        return cls({n: read(n) for n in cls.NAMES})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Ranks of the words among the lexicon's, -1 for others; all walk at once."""
        n = np.array([len(w) for w in words], np.int64)
        at = np.cumsum(n) - n
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), len(self.final) - 1, np.int64)
        rank = np.zeros(len(words), np.int64)
        alive = np.flatnonzero((n > 0) & (n <= LONGEST)) if len(self.edge) else np.array([], np.int64)
        rank[np.setdiff1d(np.arange(len(words)), alive, assume_unique=True)] = -1
        step = 0
        while len(alive):
            going = alive[n[alive] > step]
            done = alive[n[alive] <= step]
            rank[done[~self.final[state[done]]]] = -1
            if not len(going):
                break
            key = state[going] * 256 + text[at[going] + step]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[e] == key
            rank[going[~ok]] = -1
            going, e = going[ok], e[ok]
            rank[going] += self.skip[e]
            state[going] = self.target[e]
            alive, step = going, step + 1
        return rank

    def ids(self, rank: int) -> list[int]:
        return self.out_ids[self.out_at[rank] : self.out_at[rank + 1]].tolist()


class Encoder:
    """Encodes slices of text. `known` holds (bytes, decoded text of the ids) of recent words;
    when it is full all go but the first `HOT` that the lexicon had. Other words of the
    lexicon are walked through the automaton again whenever a slice has them."""

    def __init__(self, path: str | None, folder: str | None):
        self.v = Vocabulary.load(path)
        self.lexicon = Lexicon.load(folder) if folder else None
        self.hot: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.v.tokens.__getitem__, ids))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = dict(self.hot)
        new = list(words - self.known.keys())
        ranks = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in new]).tolist() if self.lexicon and new else [-1] * len(new)
        for w, r in zip(new, ranks):
            if r < 0 or w in self.v.added:
                self.known[w] = self._entry(self.v.merge(w))
                continue
            self.known[w] = self._entry(self.lexicon.ids(r))
            if len(self.hot) < HOT:
                self.hot[w] = self.known[w]

    def slices(self, texts):
        """Yields lists of (bytes of ids, decoded text) for runs of texts; an id has four bytes."""
        held, size = [], 0
        for t in texts:
            held.append(self.v.pieces(t or ""))
            size += len(t or "")
            if size >= SLICE:
                yield self._encoded(held)
                held, size = [], 0
        if held:
            yield self._encoded(held)

    def _encoded(self, texts: list[list[str]]) -> list[tuple[bytes, str]]:
        self._learn(set(chain.from_iterable(texts)))
        entry, out = self.known.__getitem__, []
        for words in texts:
            ids, decoded = zip(*map(entry, words)) if words else ((), ())
            out.append((b"".join(ids), " ".join(decoded)))
        return out


def frequent_words(documents: DataFrame, path: str | None = None, n: int = LEXICON_WORDS) -> list[str]:
    """The pre-tokens that all texts hold most often: those of the largest counts,
    at most n; equal counts go in or stay out together."""

    def count(batches):
        import pyarrow as pa

        v, seen = held(("bpe-words", path), lambda: Splitter.load(path)), Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for (t,) in rows_of(b):
                if t:
                    seen.update(v.pieces(t))
                if len(seen) > 400_000:
                    yield emit()
                    seen.clear()
        if seen:
            yield emit()

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    total = counted.filter(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    total = stored(total, "bpe-words")
    # How many words have which count, coarsely for large counts: a few thousand rows.
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n") / 4096) * 16)).cast("long")
    steps = sorted((r.step, r.words) for r in total.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())
    room, least = n, None
    for at, words in reversed(steps):
        if words > room:
            break
        room, least = room - words, at
    return sorted(total.filter(step >= least).select("word").toArrow().column("word").to_pylist()) if least is not None else []


def build_lexicon(documents: DataFrame, path: str | None = None, n: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words into an automaton in the shared folder; its path."""
    v = vocabulary(path)
    words = {w.encode("utf-8"): v.merge(w) for w in frequent_words(documents, path, n) if w not in v.added}
    folder = scratch(documents.sparkSession, "bpe-lexicon")
    Lexicon.compile(words).save(folder)
    return folder


def encode(df: DataFrame, path: str | None, folder: str | None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Rows with a `text`, which is dropped, get `n_tokens` and, as asked for, their `ids`,
    the `decoded` text, and the SHA-256 of ids and decoded text."""
    made = [T.StructField("n_tokens", T.LongType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    made += [T.StructField(f"{n}_sha256", T.StringType()) for n in ("ids", "decoded") if digests]
    new = {f.name for f in made}
    kept = [c for c in df.columns if c.lower() not in new and c.lower() != "text"]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + made)
    df = df.select(*(F.col(c) for c in kept), "text")

    def run(batches):
        import pyarrow as pa

        e = held(("bpe", path, folder), lambda: Encoder(path, folder))
        for b in batches:
            at = 0
            for rows in e.slices(t for (t,) in rows_of(b.select(["text"]))):
                n = [len(i) // 4 for i, _ in rows]
                found = {"n_tokens": pa.array(n, pa.int64())}
                if ids:
                    flat = np.frombuffer(b"".join(i for i, _ in rows), "<i4")
                    found["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32()))
                if decoded:
                    found["decoded"] = pa.array([d for _, d in rows], pa.string())
                if digests:
                    found["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows])
                    found["decoded_sha256"] = pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in rows])
                part = b.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [found[f.name] for f in made], names=schema.names)
                at += len(rows)

    return df.mapInArrow(run, schema)


def op7(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids, their number and digests; of tables that Spark has written, each row's place too."""
    docs = placed(documents)
    return encode(docs, path, build_lexicon(docs.select("doc_id", "text"), path), digests=True)
