"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike characters (leetspeak), by spacing letters out
and by repeating them. A token that may be so hidden is a lattice: each
character may stand for itself, for a letter it looks like, or for nothing (a
separator, a repetition). Viterbi decoding finds the likeliest restored word
under a character trigram model of plain words, the words themselves and the
channel's costs. Runs of short pieces between blanks are decoded as a whole: a
blank is nothing or the end of a word, so that a run is joined and segmented at
once. Other tokens restore to themselves.

Restored words are scored by learned evidence: the lower confidence bound of
the log odds with which the word or its beginning marks toxic documents; a
logistic function of a document's two strongest pieces of evidence is its score.

All labelled documents outside the held-out fold are learned from: words, marks and
weights are counted by Spark, and the driver gets the character model and the evidence.

Defined results: a null or blank text has no evidence and gets the score of
none; without labelled documents of both kinds all scores are 0. Repeated rows
are scored each. Whole texts are read; time is linear but for one lattice per
distinct hidden token or run, which takes time linear in its length. Labels,
source, language and id are no inputs of a score; a null id counts as held out
by no fold (`held_out` is null) and is never learned from. An empty table gives
an empty one. A column named like the output is replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import small
from .common import discard, fold, held, rows_of, stored
from .sample import FOLDS, IDS, labelled, sigmoid

SHARE = 1e-6  # of all words, that a word known as a whole has at least: a million of them at most
STARTS = (4, 5, 6)  # lengths of the beginnings of words that carry evidence
SURE = 2.5  # standard errors that the evidence is lowered by
REMEMBERED = 150_000
REMEMBERED_LENGTH = 200
#: Letters that a character may stand for. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h",
}
SEPARATORS = frozenset(".-_*~'`·•,/\\^\"")
COST_LOOK, COST_DROP, COST_LEFT_OUT, COST_REPEAT = -0.7, -0.4, -3.0, -0.5

TRAILING = ".,;:?!\"')]}>»…*#%&"
LEADING = "\"'([{<«¿¡*#%&-"
DECORATION = re.compile(r"([^\w\s])\1{2,}")
LOOK, LETTER = re.compile(r"[0-9@$!|+€(#]"), re.compile(r"[^\W\d_]")
THRICE = re.compile(r"([^\W\d_])\1\1")
PARTED = re.compile(r"[^\W\d_][.\-_*~'`·•,/\\^\"]+[^\W\d_]")
#: Single characters with separators between them, which are pieces of a run each.
SINGLES = re.compile(r"(?:[^\s.\-_*][.\-_*]+)+[^\s.\-_*]")
BETWEEN = re.compile(r"[.\-_*]+")
#: Marks around a piece that look like no letter.
OUTER = "".join(sorted({*TRAILING, *LEADING, *SEPARATORS} - {*LOOKS}))
PIECES = 3  # a run has so many pieces at least
LONGEST = 24  # pieces of one word, at most
KNOWN = math.log(0.5)  # share of the words as a whole in the model of words
TRIGRAMS = 200_000  # that a character model remembers, beside those it has counted


def hidden(token: str) -> bool:
    """Whether a token has look-alikes beside letters, a letter three times in a row, or letters that are parted."""
    return bool(LOOK.search(token) and LETTER.search(token) or THRICE.search(token) or PARTED.search(token))


class _Trigrams(dict):
    """Log probability of each trigram; of those not counted by its last two characters or its last."""

    def __init__(self, three: dict, two: dict, uni: dict, low: float):
        super().__init__(three)
        self.two, self.uni, self.low, self.most = two, uni, low, len(three) + TRIGRAMS

    def __reduce__(self):
        return _Trigrams, (dict(self), self.two, self.uni, self.low)

    def __missing__(self, g: str) -> float:
        p = self.two.get(g[1:])
        if p is None:
            p = self.uni.get(g[2:], self.low)
        if len(self) < self.most:
            self[g] = p
        return p


class CharModel:
    """Interpolated character trigrams of plain words, with their ends."""

    def __init__(self, counted: Counter):
        c3: Counter = Counter()
        for w, n in counted.items():
            s = f"^^{w}$"
            for k in range(2, len(s)):
                c3[s[k - 2 : k + 1]] += n
        # A word seen once is no likelier than its characters.
        self._fit(c3, {w: n for w, n in counted.items() if n > 1}, sum(counted.values()))

    @classmethod
    def of(cls, c3: dict[str, int], known: dict[str, int], words: int) -> CharModel:
        """The model of counted trigrams, of the words known as a whole, and of the number of all words."""
        model = cls.__new__(cls)
        model._fit(c3, known, words)
        return model

    def _fit(self, c3: dict[str, int], known: dict[str, int], words: int) -> None:
        c2: Counter = Counter()
        c1: Counter = Counter()
        for g, n in c3.items():
            c2[g[1:]] += n
            c1[g[2]] += n
        h2: Counter = Counter()
        h1: Counter = Counter()
        for g, n in c3.items():
            h2[g[:2]] += n
        for g, n in c2.items():
            h1[g[0]] += n
        self.words = {w: KNOWN + math.log(n / words) for w, n in known.items()}
        total = sum(c1.values()) + 1
        self.longest = max(map(len, self.words), default=0)
        uni = {c: (n + 0.5) / (total + 0.5 * len(c1)) for c, n in c1.items()}
        two = {g: 0.2 * n / h1[g[0]] + 0.03 * uni[g[1]] for g, n in c2.items()}
        three = {g: math.log(0.77 * n / h2[g[:2]] + two[g[1:]]) for g, n in c3.items()}
        uni_logs, two_logs = ({g: math.log(p) for g, p in d.items()} for d in ({c: 0.03 * p for c, p in uni.items()}, two))
        self.trigrams = _Trigrams(three, two_logs, uni_logs, math.log(0.03 * 0.5 / total))

    def __call__(self, a: str, b: str, c: str) -> float:
        return self.trigrams[a + b + c]


#: By the last two letters written: likelihood, the letters, cost of the channel, how many letters.
#: Letters are strings of up to CHUNK linked backwards, so that a step costs the same in long tokens.
Paths = dict[tuple[str, str], tuple[float, tuple[str, tuple | None], float, int]]
START: Paths = {("^", "^"): (0.0, ("", None), 0.0, 0)}
CHUNK = 64


def written(letters: tuple) -> str:
    last, before = letters
    if before is None:
        return last
    out = [last]
    while before:
        last, before = before
        out.append(last)
    return "".join(reversed(out))


@lru_cache(1 << 14)
def channel(c: str) -> tuple[tuple[tuple[str, float], ...], float | None]:
    """The letters that a character may stand for, with costs, and the cost of its standing for nothing."""
    ways = (((c, 0.0),) if c.isalpha() else ()) + tuple((x, COST_LOOK) for x in LOOKS.get(c, ""))
    drop = COST_DROP if c in SEPARATORS else COST_LEFT_OUT if not c.isalnum() or not ways else None
    return ways, drop


def further(paths: Paths, c: str, before: str, model: CharModel, kept: bool = False) -> Paths:
    """The paths behind one more character; one that is `kept` stands for a letter if it may.
    All states stay: look-alikes that may be left out stand for few letters, so there are few."""
    ways, drop = channel(c)
    if kept and ways:
        drop = None
    again = before == c
    trigram = model.trigrams
    new: Paths = {}
    for (a, b), (p, out, cost, n) in paths.items():
        for x, look in ways:
            q = p + look + trigram[a + b + x]
            state = (b, x)
            if state not in new or q > new[state][0]:
                new[state] = (q, (x, out) if n % CHUNK == CHUNK - 1 else (out[0] + x, out[1]), cost + look, n + 1)
        if again and b != "^" and (b == c or b in LOOKS.get(c, "")):
            q = p + COST_REPEAT
            if (a, b) not in new or q > new[a, b][0]:
                new[a, b] = (q, out, cost + COST_REPEAT, n)
        if drop is not None:
            q = p + drop
            if (a, b) not in new or q > new[a, b][0]:
                new[a, b] = (q, out, cost + drop, n)
    return new or paths


def finished(paths: Paths, model: CharModel) -> tuple[float, str]:
    """Likelihood and letters of the likeliest word, as a known word or by its characters; the greater of equals."""
    best, word = -math.inf, ""
    for (a, b), (p, letters, cost, n) in paths.items():
        q, out = p + model.trigrams[a + b + "$"], None
        if n <= model.longest:
            out = written(letters)
            q = max(q, cost + model.words.get(out, -math.inf))
        if q >= best:
            out = written(letters) if out is None else out
            if q > best or out > word:
                best, word = q, out
    return best, word


def straight(text: str) -> int:
    """How many characters a text begins with, less than CHUNK, that only stand for themselves: letters, none twice in a row."""
    before = ""
    for k, c in enumerate(text[: CHUNK - 1]):
        if c == before or not c.isalpha():
            return k
        before = c
    return min(len(text), CHUNK - 1)


def read(token: str, model: CharModel, kept: bool = False) -> tuple[float, str]:
    """Likelihood and letters of the word behind a token, the first and last look-alikes of which may be `kept`."""
    n = straight(token)
    trigrams, padded, p = model.trigrams, "^^" + token[:n], 0.0
    for k in range(n):
        p += trigrams[padded[k : k + 3]]
    paths = {(padded[-2], padded[-1]): (p, (token[:n], None), 0.0, n)}
    before = padded[-1] if n else ""
    for k in range(n, len(token)):
        c = token[k]
        paths = further(paths, c, before, model, kept and k in (0, len(token) - 1))
        before = c
    return finished(paths, model)


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a token."""
    return read(token, model)[1]


def segmented(pieces: list[str], model: CharModel) -> list[str]:
    """The likeliest words behind a run of pieces: each blank between them is nothing or the end of a word."""
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-math.inf, 0, "")] * len(pieces)
    trigrams, known, joined = model.trigrams, model.words, "".join(pieces)
    off = [0, *accumulate(map(len, pieces))]
    for i, piece in enumerate(pieces):
        sofar = best[i][0]
        # What has no letter may be no part of a word.
        if not piece.isalpha() and not any(c.isalpha() for c in piece) and sofar + COST_LEFT_OUT > best[i + 1][0]:
            best[i + 1] = (sofar + COST_LEFT_OUT, i, "")
        # While characters only stand for themselves there is one path.
        last = min(len(pieces), i + LONGEST)
        lone = straight(joined[off[i] : min(off[last], off[i] + CHUNK)])
        padded, at, p_at = "^^" + joined[off[i] : off[i] + lone], 0, 0.0
        paths = None
        for j in range(i, last):
            n = off[j + 1] - off[i]
            if n <= lone:
                for k in range(at, n):
                    p_at += trigrams[padded[k : k + 3]]
                at = n
                word = padded[2 : n + 2]
                p = p_at + trigrams[padded[n : n + 2] + "$"]
                if word in known and known[word] > p:
                    p = known[word]
            else:
                if paths is None:
                    paths = {(padded[at], padded[at + 1]): (p_at, (padded[2 : at + 2], None), 0.0, at)}
                    before = padded[at + 1] if at else ""
                for k, c in enumerate(pieces[j]):
                    paths = further(paths, c, before, model, j == i and k == 0)
                    before = c
                p, word = finished(paths, model)
            if sofar + p > best[j + 1][0]:
                best[j + 1] = (sofar + p, i, word)
    out, at = [], len(pieces)
    while at:
        _, at, word = best[at]
        if word:
            out.append(word)
    return out[::-1]


def core(token: str) -> str:
    """A lower-cased token without the marks around it."""
    t = token.strip(TRAILING).lstrip(LEADING)
    if not t.isalpha():
        t = DECORATION.sub(r"\1", token).rstrip(TRAILING).lstrip(LEADING)
        if t[-1:] == "$" and token.endswith("$$$"):
            t = t[:-1]
        t = t.rstrip(TRAILING)
    return t


def plain(token: str) -> str:
    """The word that a token is but for marks around it; empty for others."""
    t = token if token.isalpha() else token.strip(OUTER)
    return t if t.isalpha() and not THRICE.search(t) else ""


def restored(token: str, model: CharModel | None) -> str:
    if word := plain(token):
        return word
    t = core(token)
    if model is None or not t:
        return t
    # Marks around the token may be letters too, as in (lown.
    full = DECORATION.sub(r"\1", token).strip(OUTER)
    more = full != t and hidden(full)
    if hidden(t):
        best = read(t, model)
    elif more:
        trigrams, padded = model.trigrams, f"^^{t}$"
        best = (math.fsum([trigrams[padded[k : k + 3]] for k in range(len(t) + 1)]), t)
    else:
        return t
    if more:
        lead, tail = len(full) - len(full.lstrip(LEADING)), len(full) - len(full.rstrip(TRAILING))
        for x in {full, full[lead:] if lead else full, full[: len(full) - tail] if tail else full} - {t}:
            best = max(best, read(x, model, kept=True))
    return best[1]


@lru_cache(1 << 16)
def short(token: str) -> tuple[str, ...] | None:
    """The pieces of a run that a token is, none for marks alone; null for any other token."""
    t = DECORATION.sub(r"\1", token).strip(OUTER)
    if len(t) <= 2:
        return (t,) if t else ()
    return tuple(BETWEEN.split(t)) if SINGLES.fullmatch(t) else None


def runs(words: list[str], distinct: set[str] | None = None) -> list[list[str]]:
    """Runs of short pieces, several pieces each, that hold a letter. `distinct`: the words, each once."""
    out: list[list[str]] = []
    run: list[str] = []
    last = -1

    def close() -> None:
        if len(run) >= PIECES and any(c.isalpha() for p in run for c in p):
            out.append(run[:])
        run.clear()

    brief = {w for w in distinct or set(words) if len(w) < 4 or not w[1:4].isalnum()}
    for k in [k for k, w in enumerate(words) if w in brief]:
        found = short(words[k])
        if found is None:
            continue
        if k != last + 1:
            close()
        run += found
        last = k
    close()
    return out


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased tokens, and runs of short pieces with blanks between."""
    if not text:
        return set()
    words = text.lower().split()
    distinct = set(words)
    return {*distinct, *map(" ".join, runs(words, distinct))}


def plain_words(text: str) -> list[str]:
    """Lower-cased words of letters, without those that are spelt out: three single characters in a row."""
    words = text.lower().split()
    out = []
    for k, w in enumerate(words):
        c = w if w.isalpha() else core(w)
        if c.isalpha() and not (len(c) == 1 and any(k >= d and k - d + 3 <= len(words) and max(map(len, words[k - d : k - d + 3])) <= 1 for d in range(3))):
            out.append(c)
    return out


def behind(token: str, model: CharModel | None) -> list[str]:
    """Marks of the words that a token or a run restores to."""
    if " " not in token:
        return marks(restored(token, model))
    return [] if model is None else [m for w in segmented(token.split(" "), model) for m in marks(w)]


def marks(word: str) -> list[str]:
    if (n := len(word)) > STARTS[-1]:
        return [word, *[word[:k] + "~" for k in STARTS]]
    return [word, *[word[:k] + "~" for k in STARTS if n > k]] if word else []


def evidence_of(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lower bound of the log odds of each mark that stands for toxic documents. `counts`: mark, and in a and b the
    toxic and clean documents that have it."""
    if not n_toxic or not n_clean:
        return {}
    begins, a, b = F.col("mark").endswith("~"), F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    bound = odds - SURE * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) - 1 / (n_toxic + 1) - 1 / (n_clean + 1))
    strong = counts.withColumn("bound", bound).filter("a > 0 AND bound > 0.05")
    # A beginning says more than a word only if several words share it.
    starts = F.array(*(F.when(F.length("mark") > n, F.concat(F.substring("mark", 1, n), F.lit("~"))) for n in STARTS))
    words = counts.filter(~begins & (a > 0)).select(F.explode(starts).alias("mark"), "a").filter("mark IS NOT NULL")
    leading = words.groupBy("mark").agg(F.max("a").alias("leading"))
    found = strong.join(leading, "mark", "left").filter(~begins | (a >= 1.5 * F.coalesce("leading", F.lit(0))))
    return {r.mark: r.bound for r in found.select("mark", "bound").collect()}


def near_keys(text: str) -> tuple[bytes, bytes]:
    """Two triples of minimum hashes of the text's runs of three words; near copies share one."""
    w = text.lower().encode("utf-8", "surrogatepass").split()
    joined = memoryview(b" ".join(w))
    ends = [k + n for n, k in enumerate(accumulate(map(len, w)))]
    starts = [0, *(k + 1 for k in ends)]
    hashes = np.array([zlib.crc32(joined[a:b]) for a, b in zip(starts, ends[2:])] or [zlib.crc32(joined)], np.uint64)
    lows = [int((hashes * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for m in (1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
    return tuple(bytes([k]) + b"".join(v.to_bytes(4, "little") for v in lows[3 * k : 3 * k + 3]) for k in (0, 1))


def without_copies(rows: DataFrame) -> DataFrame:
    """A table of the rows (doc_id, y, half, text) but those that share a key with a row before them by crc32 of
    the id: near copies of a document would count its words again."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = [near_keys(t) for (t,) in rows_of(b.select(["text"]), 16)]
            rows = pa.array(np.repeat(np.arange(b.num_rows), 2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), pa.array([k for pair in keys for k in pair], pa.binary())], names=["doc_id", "key"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.BinaryType())])
    keys = rows.select("doc_id", "text").mapInArrow(run, schema)
    order = F.struct(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    first = keys.groupBy("key").agg(F.min(order).alias("first")).groupBy("first.doc_id").agg(F.count("*").alias("n"))
    kept = stored(first.filter("n = 2").select("doc_id"), "toxicity-kept")
    found = stored(rows.join(small(kept, IDS), "doc_id", "left_semi"), "toxicity-distinct")
    discard(kept)
    return found


TALLIED = 400_000  # counts that a task holds before it hands them on


def _tallies(rows: DataFrame, name: str, by: list[str], each) -> DataFrame:
    """Counts of strings, and of the columns `by` of their row: (name, *by, n). `each` gives a function of a text once
    per task, which gives the strings to count."""
    schema = T.StructType([T.StructField(name, T.StringType()), *(T.StructField(c, T.IntegerType()) for c in by), T.StructField("n", T.LongType())])

    def run(batches):
        import pyarrow as pa

        count, tallies = each(), {}

        def counted():
            for key, tally in tallies.items():
                repeated = [pa.array(np.full(len(tally), k, np.int32)) for k in key]
                yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), *repeated, pa.array(tally.values(), pa.int64())], names=schema.names)
            tallies.clear()

        for b in batches:
            for text, *key in rows_of(b.select(["text", *by]), 16):
                tallies.setdefault(tuple(key), Counter()).update(count(text))
                if sum(map(len, tallies.values())) > TALLIED:
                    yield from counted()
        yield from counted()

    return rows.select("text", *by).mapInArrow(run, schema).groupBy(name, *by).agg(F.sum("n").alias("n"))


def char_model(rows: DataFrame) -> CharModel:
    """The character model of the plain words of all rows."""
    counted = stored(_tallies(rows, "word", [], lambda: plain_words), "toxicity-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    padded = F.concat(F.lit("^^"), "word", F.lit("$"))
    grams = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda k: F.substring(padded, k, F.lit(3)))).alias("g"), "n")
    c3 = {r.g: r.n for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    # A word seen once, or hardly ever, is no likelier than its characters.
    known = {r.word: r.n for r in counted.filter((F.col("n") > 1) & (F.col("n") >= SHARE * total)).collect()}
    discard(counted)
    return CharModel.of(c3, known, total)


def two_best(values) -> tuple[float, float]:
    a = b = 0.0
    for v in values:
        if v > a:
            a, b = v, a
        elif v > b:
            b = v
    return a, b


def fit_logistic(points: DataFrame, ridge: float = 0.002, steps: int = 50) -> list[float]:
    """Newton steps for a ridge logistic model with an intercept. `points`: one, two, y, n; a step is a sum over them."""
    w, x = np.zeros(3), [F.lit(1.0), F.col("one"), F.col("two")]
    total = points.agg(F.sum("n")).first()[0] or 0
    keep = np.diag([1e-6] + [ridge * total] * 2)
    for _ in range(steps):
        z = sum((float(a) * c for a, c in zip(w, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        slopes = [F.sum(F.col("n") * (F.col("y") - p) * c) for c in x]
        curves = [F.sum(F.col("n") * p * (1 - p) * x[i] * x[j]) for i in range(3) for j in range(3)]
        r = np.array([v or 0.0 for v in points.agg(*(c.alias(f"s{k}") for k, c in enumerate(slopes + curves))).first()])
        step = np.linalg.solve(r[3:].reshape(3, 3) + keep, r[:3] - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _points(rows: DataFrame, fitted: list[dict]) -> DataFrame:
    """(one, two, y, n): how many rows with a label have such evidence by the half they aren't in."""
    schema = "one double, two double, y int"

    def run(batches):
        import pyarrow as pa

        e = [_Evidence(f) for f in fitted]
        for b in batches:
            made = [(*e[1 - half].strongest(t), y) for t, y, half in rows_of(b.select(["text", "y", "half"]), 16)]
            columns = [*zip(*made)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int32()))], names=["one", "two", "y"])

    return rows.select("text", "y", "half").mapInArrow(run, schema).groupBy("one", "two", "y").agg(F.count("*").alias("n"))


def train(rows: DataFrame) -> dict | None:
    """The character model, the evidence and the logistic weights, all counted from all rows (doc_id, text, y).
    Weights are fitted on evidence that the other half of the rows gave."""
    half = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % 2
    given = stored(rows.select("doc_id", "y", half.cast("int").alias("half"), "text"), "toxicity-rows")
    if given.select("y").distinct().count() < 2:
        discard(given)
        return None
    rows = without_copies(given)
    discard(given)
    n = {(r.y, r.half): r.n for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    model = char_model(rows)

    def each():
        known: dict[str, tuple[str, ...]] = {}

        def of(text: str) -> set[str]:
            found: set[str] = set()
            for w in tokens(text):
                if (made := known.get(w)) is None:
                    made = tuple(marks(p) if (p := plain(w)) else behind(w, model))
                    if len(w) <= REMEMBERED_LENGTH:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[w] = made
                found.update(made)
            return found

        return of

    met = lambda y, h: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n"))), F.lit(0)).alias(f"n{y}{h}")
    tallies = _tallies(rows, "mark", ["y", "half"], each).groupBy("mark").agg(*(met(y, h) for y in (0, 1) for h in (0, 1)))
    tallies = stored(tallies.filter("n10 + n11 > 0"), "toxicity-marks")  # others stand for no toxic document
    n = {k: n.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    of_half = [evidence_of(tallies.select("mark", F.col(f"n1{h}").alias("a"), F.col(f"n0{h}").alias("b")), n[1, h], n[0, h]) for h in (0, 1)]
    evidence = evidence_of(tallies.select("mark", (F.col("n10") + F.col("n11")).alias("a"), (F.col("n00") + F.col("n01")).alias("b")), n[1, 0] + n[1, 1], n[0, 0] + n[0, 1])
    points = stored(_points(rows, [{"model": model, "evidence": e} for e in of_half]), "toxicity-points")
    weights = fit_logistic(points)
    discard(rows, tallies, points)
    return {"model": model, "evidence": evidence, "weights": weights}


class _Evidence(dict):
    """Token or run -> evidence of the words it restores to; forgets all when large. Those without evidence are a set."""

    def __init__(self, fitted: dict):
        self.of_mark, self.model = fitted["evidence"], fitted["model"]
        self.nothing: set[str] = set()
        #: How words with evidence begin: other plain words have none.
        self.leads = frozenset(m.rstrip("~")[: STARTS[0]] for m in fitted["evidence"])

    def __missing__(self, token: str) -> float:
        e, v = self.of_mark, 0.0
        if word := plain(token):
            found = marks(word) if word[: STARTS[0]] in self.leads else ()
        else:
            found = behind(token, self.model)
        for m in found:
            if m in e and e[m] > v:
                v = e[m]
        if len(token) <= REMEMBERED_LENGTH:
            if v:
                self[token] = v
            else:
                self.nothing.add(token)
        return v

    def strongest(self, text: str | None) -> tuple[float, float]:
        """The two strongest pieces of evidence in a text."""
        words = (text or "").lower().split()
        distinct = set(words)
        found = runs(words, distinct)
        if len(self) + len(self.nothing) > 2 * REMEMBERED:
            self.clear()
            self.nothing.clear()
        distinct.update(map(" ".join, found))
        return two_best(map(self.__getitem__, distinct - self.nothing))


def known_evidence(fitted: dict) -> _Evidence:
    key = ("toxicity", zlib.crc32(repr((fitted["weights"], sorted(fitted["evidence"].items()))).encode("utf-8", "surrogatepass")))
    return held(key, lambda: _Evidence(fitted))


def score(df: DataFrame, fitted: dict | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score to rows with a text; all columns are kept."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        e = known_evidence(fitted) if fitted else None
        for b in batches:
            made = []
            for (t,) in rows_of(b.select([text])):
                if e is None:
                    made.append(0.0)
                    continue
                one, two = e.strongest(t)
                w = fitted["weights"]
                made.append(sigmoid(w[0] + w[1] * one + w[2] * two))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(made, pa.float64())], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


THRESHOLD = 0.5


def fit(documents: DataFrame, labels: DataFrame) -> dict | None:
    return train(labelled(documents, labels, "toxic"))


def op9(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
