"""Whitening, product codes and language ID against brute force."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import codes, langid, whitening
from lodestone.llm.common import floored

VEC = "vec_id long, embedding array<float>, label int, n string, code string, part string"


def vectors(rng, n, d=16, spread=1.0):
    return (rng.normal(size=(n, d)) * np.linspace(spread, spread / 4, d)).astype(np.float32)


def rows_of(x, labels=None):
    return [(k, [float(v) for v in row], None if labels is None else labels[k], "clash", "clash", "clash") for k, row in enumerate(x)]


ODD = [
    (900, None, 1, "", "", ""),
    (901, [], 1, "", "", ""),
    (902, [1.0] * 15 + [None], 1, "", "", ""),
    (903, [1.0] * 15 + [float("nan")], 1, "", "", ""),
    (904, [float("inf")] + [1.0] * 15, None, "", "", ""),
]


# --- whitening --------------------------------------------------------------------


def whitened(df):
    got = sorted(df.collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component))
    return got, np.array([r.whitened for r in got])


def test_whitening_against_the_covariance(frame):
    x = vectors(np.random.default_rng(1), 300)
    got, w = whitened(whitening.op11(frame(VEC, rows_of(x) + ODD, parts=7)))
    y = np.floor(x.astype(float) * 64).astype(int) + 1_000_000
    n, s = len(y), y.sum(0)
    centred = (n * y - s) / n
    e, right = np.linalg.eigh(centred.T @ centred / n)
    e, right = e[::-1], right[:, ::-1]
    want = centred @ right / np.sqrt(e)
    w = w.reshape(n, 16)
    signs = np.sign((w * want).sum(0))
    assert np.abs(w - want * signs).max() < 1e-10
    assert [r.vec_id for r in got[::16]] == list(range(300)) and [r.component for r in got[:16]] == list(range(1, 17))
    assert all(r.n == n and r.deviation == r.deviation_exact == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[r.vec_id], s)) for r in got)
    assert np.allclose([r.explained for r in got[:16]], e / e.sum(), rtol=1e-12)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_whitening_at_most_32_components_and_dimensions_apart(frame):
    rng = np.random.default_rng(2)
    wide, narrow = vectors(rng, 80, 40), vectors(rng, 30, 3)
    rows = rows_of(wide) + [(1000 + k, *r[1:]) for k, r in enumerate(rows_of(narrow))]
    got, _ = whitened(whitening.op11(frame(VEC, rows, parts=5)))
    assert len(got) == 80 * 32 + 30 * 3
    assert {r.n for r in got if r.vec_id < 1000} == {80} and {r.n for r in got if r.vec_id >= 1000} == {30}
    assert got[0].identity_error < 1e-10


def test_whitening_without_variance(frame):
    for rows in ([], ODD, [(1, [1.0, 2.0], 0, "", "", "")], [(None, [1.0, 2.0], 0, "", "", ""), (None, [1.0, 2.0], 0, "", "", "")]):
        got, w = whitened(whitening.op11(frame(VEC, rows)))
        assert len(got) == 2 * sum(r[1] is not None and len(r[1]) == 2 for r in rows)
        assert not w.any() and all(r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    # One constant entry: its component has no variance, the others are white.
    x = vectors(np.random.default_rng(3), 50, 4)
    x[:, 2] = 0.5
    got, w = whitened(whitening.op11(frame(VEC, rows_of(x))))
    assert not w.reshape(50, 4)[:, 3].any() and got[0].identity_error < 1e-12 and got[3].explained == 0


def test_large_components_stay_exact():
    x = np.array([[1e30, -1e30], [2.0**40, 1.0], [0.5, -3.0]])
    y = floored(x, 64) + 1_000_000
    s = [int(v) for v in y.astype(object).sum(0)]
    v = whitening.centred(x, 3, s)
    assert whitening.squared(v) == [sum((3 * int(a) - b) ** 2 for a, b in zip(row, s)) for row in y.tolist()]
    rng = np.random.default_rng(4)
    for bits in (20, 30, 45, 49, 55):
        v = rng.integers(-(1 << bits), 1 << bits, (50, 64))
        assert whitening.squared(v) == [sum(c * c for c in row) for row in v.tolist()]


def test_factors_merge_in_a_tree(spark):
    """More tasks than the fan-in: the merged factor has the singular values of all rows."""
    x = vectors(np.random.default_rng(5), 400, 6)
    df = spark.createDataFrame([(r,) for r in x.astype(float).tolist()], "embedding array<double>").repartition(40)
    model = whitening.fit(df)[6]
    y = np.floor(x.astype(float) * 64)
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1], rtol=1e-11)


# --- product codes ----------------------------------------------------------------


def brute_codes(rows):
    """(codes, errors, books) with Python's integers."""
    kept = sorted((r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])), key=lambda r: r[0])
    cut = [[math.floor(1024 * Fraction(v)) for v in r[1]] for r in kept]
    w = len(cut[0]) // 4
    parts = [[y[p * w : p * w + w] for p in range(4)] for y in cut]
    books = [[y[p] for y in parts[:256]] for p in range(4)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = {}
            for y in parts:
                of.setdefault(near(y[p], books[p])[1], []).append(y[p])
            for k, mine in of.items():
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(y[p], books[p]) for p in range(4)] for y in parts]
    return {r[0]: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, found)}, books


def test_codes_against_brute_force(frame):
    rng = np.random.default_rng(6)
    x = np.concatenate([vectors(rng, 320, 16, 0.2), np.round(vectors(rng, 80, 16, 0.01), 2)])  # with many ties
    labels = [None if k % 7 == 0 else k % 3 for k in range(400)]
    rows = rows_of(x, labels) + ODD
    want, books = brute_codes(rows)
    got = {r.vec_id: r for r in codes.op12(frame(VEC, rows, parts=5)).collect()}
    assert {k: (r.code, r.error) for k, r in got.items()} == want
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    for label in (None, 0, 1, 2):
        same = [k for k in want if labels[k] is label or labels[k] == label]
        assert {got[k].label_error for k in same} == {sum(want[k][1] for k in same)}


def test_few_equal_and_odd_rows(frame):
    assert codes.op12(frame(VEC, [])).count() == codes.op12(frame(VEC, ODD)).count() == 0
    rows = [(3, [0.1] * 8, 1, "", "", ""), (3, [0.1] * 8, 1, "", "", ""), (None, [0.1] * 8, None, "", "", ""), (4, [9.0] * 6, 2, "", "", "")]
    got = codes.op12(frame(VEC, rows)).collect()
    assert len(got) == 4 and {r.error for r in got} == {0} and {r.code for r in got} == {"00000000"}


@pytest.mark.parametrize("scale", [3, 1000, 1 << 33])
def test_annuli_find_what_a_full_search_finds(scale):
    """Exactly, with ties at the ends of the interval, and with fewer comparisons where norms differ."""
    rng = np.random.default_rng(7)
    entries = rng.integers(-scale, scale + 1, (200, 3)) * rng.integers(1, 40, (200, 1))
    q = rng.integers(-scale, scale + 1, (500, 3)) * rng.integers(1, 40, (500, 1))
    search = codes.Annuli(entries)
    code, far = search.nearest(q)
    gap = ((q[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert (far == gap.min(1)).all() and code.tolist() == [int(np.argmin(g)) for g in gap]
    assert search.compared < 0.7 * gap.size


def test_sums_by_label_with_and_without_broadcast(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("label"), F.col("id").alias("error"))
    few = sorted(map(tuple, codes.with_sums(df, "label", "error", "total").collect()), key=str)
    many = codes.with_sums(df, "label", "error", "total", most=2)
    assert sorted(map(tuple, many.collect()), key=str) == few and few[0][3] == sum(k for k in range(500) if k % 5 == 0)
    assert many.columns == ["id", "label", "error", "total"]


# --- language ID ------------------------------------------------------------------

PIECES = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab"]


def segmentations(word):
    """Every way to cut a word into pieces; a character of none is its bytes."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            for rest in segmentations(word[n:]):
                yield [[PIECES.index(word[:n])], *rest]
    if word and word[0] not in PIECES:
        for rest in segmentations(word[1:]):
            yield [[len(PIECES) + b for b in word[0].encode()], *rest]


def tables(seed, langs):
    p = np.random.default_rng(seed).random((len(PIECES) + 256, langs)) + 0.01
    return p / p.sum(0)


def test_forward_sums_all_segmentations_and_counts_are_expectations():
    table = tables(1, 3)
    words = ["▁ab", "▁aba", "▁abababab", "▁aéb", "▁", "▁€abaab", "▁b" + "ab" * 5]
    total, (edges, odd), counts = langid.passes(langid.Lattice(PIECES), words, table, True)
    lattice = langid.Lattice(PIECES)
    for k, word in enumerate(words):
        every = [(cut, math.prod(table[j] for piece in cut for j in piece)) for cut in segmentations(word)]
        mass = sum(p for _, p in every)
        assert np.allclose(total[k], np.log(mass), rtol=1e-12)
        want = sum(len(cut) * p for cut, p in every) / mass
        assert np.allclose(counts[edges[:, 0] == k].sum(0), want, rtol=1e-10)
    assert np.allclose(langid.passes(lattice, words, table, False)[0], total, rtol=1e-13)


def test_long_words_do_not_vanish():
    table = tables(2, 2)
    lattice = langid.Lattice(PIECES)
    for word in ("▁" + "ab" * 5000, "▁" + "😀" * 3000):
        total, _, counts = langid.passes(lattice, [word], table, True)
        assert np.isfinite(total).all() and (total < -1000).all() and np.isfinite(counts).all() and (counts >= 0).all()
    once, twice = (langid.passes(lattice, ["😀" * n], table, False)[0] for n in (1, 2))
    assert np.allclose(2 * once, twice)


def test_slices_hold_every_word(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    for text in ("", "  ", "a", "one two  three four " * 5, "x" * 40 + " y"):
        assert [w for s in langid.words_of(text) for w in s] == text.split()


def test_a_small_memory_changes_nothing(monkeypatch):
    model = langid.Model(["x", "y"], [0.5, 0.5], tables(3, 2), "")
    texts = [" ".join(random.Random(k).choices(["ab", "ba", "aab", "bbb", "a€", "abba" * 20], k=30)) for k in range(20)] + [None, "", "12"]
    whole = list(langid.predict(langid._Known(model, PIECES), texts))
    assert whole[-3:] == [("und", 0.0)] * 3
    for remembered, size in ((3, 1 << 20), (3, 50), (150, 7)):
        monkeypatch.setattr(langid, "REMEMBERED", remembered)
        monkeypatch.setattr(langid, "SLICE", size)
        got = list(langid.predict(langid._Known(model, PIECES), texts))
        assert [(lang, round(p, 9)) for lang, p in got] == [(lang, round(p, 9)) for lang, p in whole]


DOC = "doc_id long, text string, lang string, source string, score string, lang_pred string"
EN = "the water of this old town was there with some people who would think about many things".split()
DE = "das wasser der alten stadt war dort mit den leuten die über viele dinge nachdenken würden und".split()


def documents():
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(EN if k % 3 else DE, k=12)), "en" if k % 3 else "de", "s", "clash", "clash") for k in range(150)]
    return rows + [(200, None, "en", "s", "", ""), (201, "", "en", "s", "", ""), (202, "12 34 !?", None, "s", "", ""), (None, "das wasser der stadt", None, None, None, None), (203, "über " * 40_000, None, None, None, None), (203, "the people", None, None, None, None)]


def test_languages(frame):
    got = [tuple(r) for r in langid.op13(frame(DOC, documents())).select("doc_id", "held_out", "lang_pred", "score").collect()]
    assert len(got) == 156 and all(0 <= p <= 1 and held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, held, _, p in got)
    by_id = {i: (lang, p) for i, _, lang, p in got}
    assert all(by_id[k][0] == ("en" if k % 3 else "de") for k in range(150))
    assert by_id[200] == by_id[201] == by_id[202] == ("und", 0.0) and by_id[None][0] == "de"
    assert sorted(lang for i, _, lang, _ in got if i == 203) == ["de", "en"]


def test_nothing_to_learn_and_empty(frame):
    none = [(k, t, None, s, "", "") for k, t, _, s, _, _ in documents()[:5]]
    assert {(r.lang_pred, r.score) for r in langid.op13(frame(DOC, none)).collect()} == {("und", 0.0)}
    assert langid.op13(frame(DOC, [])).count() == 0
    kept = langid.identify(frame(DOC, documents()[:9]), None)
    assert kept.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]


def test_held_out_documents_and_labels_are_not_read(frame):
    """Other languages of held-out documents change nothing."""
    rows = documents()
    other = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang, *rest) for i, t, lang, *rest in rows]
    a, b = (sorted(map(str, langid.op13(frame(DOC, r)).collect())) for r in (rows, other))
    assert a == b


def test_sample_is_bounded_and_steady(frame):
    first = sorted((k for k in range(150) if k % 3 and zlib.crc32(str(k).encode()) % 5), key=lambda k: (zlib.crc32(str(k).encode()), k))
    texts = {r[0]: r[1] for r in documents()}
    for n in (len(first), 10 * len(first)):  # where it seems that there are many more, few ids are below the bound
        found = langid.sampled(frame(DOC, documents()), 10, {"en": n, "de": 10}).collect()
        taken = sorted(r.text for r in found if r.lang == "en")
        want = [k for k in first[:10] if zlib.crc32(str(k).encode()) <= (1 << 32) * 15 / n]
        assert taken == sorted(texts[k] for k in want) and len(want) == (10 if n == len(first) else len(want))
        assert sum(r.lang == "de" for r in found) == 10
