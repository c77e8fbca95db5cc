import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R

CHUNKS = [
    (1, 0, "Alpha guide", "start > intro", "alpha beta gamma beta"),
    (1, 1, "Alpha guide", "", "beta beta beta delta"),
    (2, 0, "Other", "", "gamma beta alpha and more words here"),
    (3, 0, "Empty", "", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "document_id long, ordinal int, title string, section_path string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def model(query, boosts, phrases):
    """BM25 written out for the fixture."""
    field = {"title": 2, "section_path": 3, "text": 4}
    toks = {f: [c[i].lower().replace(">", " ").split() for c in CHUNKS] for f, i in field.items()}
    q, out = query.split(), {}
    for k, c in enumerate(CHUNKS):
        t, p = [], []
        for f in field:
            docs = [x for x in toks[f] if x]
            avg, n, own = sum(map(len, docs)) / len(docs), len(docs), toks[f][k]
            idf = lambda w: math.log(1 + (n - sum(w in d for d in docs) + 0.5) / (sum(w in d for d in docs) + 0.5))  # noqa: B023, E731
            sat = lambda tf: tf / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))  # noqa: B023, E731
            if hits := [w for w in q if w in own]:
                t.append(boosts[f] * sum(idf(w) * sat(own.count(w)) for w in hits))
            runs = sum(own[i : i + len(q)] == q for i in range(len(own)))
            if runs and f in phrases:
                p.append(phrases[f] * sum(map(idf, q)) * sat(runs))
        if t or p:
            out[c[0], c[1]] = round(max(t, default=0) + max(p, default=0), 6)
    return out


@pytest.mark.parametrize("query", ["beta", "alpha beta", "beta beta", "gamma beta", "alpha guide", "nothing"])
def test_bm25_with_phrases(spark, chunks, query):
    got = R.bm25(queries(spark, query), chunks, ["document_id", "ordinal"], phrases=R.PHRASE_BOOSTS).collect()
    assert {(r.document_id, r.ordinal): r.score for r in got} == pytest.approx(model(query, R.TERM_BOOSTS, R.PHRASE_BOOSTS), abs=2e-6)


def test_length_quantisation(spark):
    got = [r.x for r in spark.range(36, 140).select("id", R.quantised(F.col("id")).alias("x")).orderBy("id").collect()]

    def want(n):
        if n < 40:
            return n
        rest, shift = n - 24, max((n - 24).bit_length() - 4, 0)
        return 24 + (rest >> shift << shift)

    assert got == [want(n) for n in range(36, 140)]


def test_collapse_and_limits(spark, chunks):
    top = R.lexical_search(queries(spark, "beta"), chunks, 5).collect()
    assert sorted(r.document_id for r in top) == [1, 2]
    with pytest.raises(ValueError):
        R.lexical_search(queries(spark, "beta"), chunks, 0)


def fuse(spark, *lists, limit=10):
    rows = [(0, k, d, r + 1) for k, ids in enumerate(lists) for r, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "query_id int, ranking int, document_id string, rank int")
    return [r.document_id for r in sorted(R.reciprocal_rank_fusion(df, limit).collect(), key=lambda r: r.rank)]


def test_fusion(spark):
    assert fuse(spark, ["lexical", "shared", "only"], ["dense", "shared", "other"])[0] == "shared"
    assert fuse(spark, ["b"], ["a"]) == ["a", "b"]
    assert fuse(spark, ["a", "a", "b"], ["b"]) == ["b", "a"]
    assert fuse(spark, ["", "a"], []) == ["a"]
    for bad in ({"limit": 0}, {"limit": 1, "k": 0}):
        with pytest.raises(ValueError):
            R.reciprocal_rank_fusion(spark.createDataFrame([], "query_id int, ranking int, document_id string, rank int"), **bad)


def test_provenance(spark):
    s = "query_id int, document_id string, rank int"
    lexical = spark.createDataFrame([(0, "exact", 1), (0, "semantic", 2), (1, "x", 1)], s)
    dense = spark.createDataFrame([(0, "semantic", 1), (0, "dense", 2)], s)
    got = {(r.query_id, r.rank): r for r in R.fused_search(lexical, dense, 5).collect()}
    first = got[0, 1]
    assert (first.document_id, first.lexical_rank, first.dense_rank, first.mode_used) == ("semantic", 2, 1, "hybrid")
    assert first.score == pytest.approx(1 / 62 + 1 / 61)
    assert [got[0, k].document_id for k in (2, 3)] == ["exact", "dense"]
    assert got[1, 1].mode_used == "bm25" and got[1, 1].degraded


def test_ladder(spark, chunks):
    q = queries(spark, "beta")
    plain = R.search(q, chunks, 5, "bm25").collect()
    fallen = R.search(q, chunks, 5, "hybrid").collect()
    assert [(r.document_id, r.degraded) for r in plain] == [(r.document_id, not r.degraded) for r in fallen]
    with pytest.raises(ValueError):
        R.search(q, chunks, 5, "other")


def test_guard(spark):
    hits = spark.createDataFrame([(0, 1, "old"), (0, 2, "same"), (0, 3, None), (0, None, "x")], "query_id int, document_id int, content_hash string")
    docs = spark.createDataFrame([(1, "new"), (2, "same"), (3, "z")], "document_id int, content_hash string")
    assert [r.document_id for r in R.current_only(hits, docs).collect()] == [2]


def test_vector_search(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    got = {}
    for r in R.vector_search(v.filter("id < 20"), v, 7, block=64).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    for q in range(20):
        assert [got[q][k] for k in range(1, 8)] == sorted(range(300), key=lambda k: (-s[q, k], k))[:7]


def test_valid_vectors(spark):
    rows = [[1.0, 2.0], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<float>")
    assert [r.x for r in df.orderBy("k").select(R.valid_vector(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False, False]


def test_protected_order(spark):
    scores = [0.1, 0.9, 0.3, 0.7, 0.5, 0.2, 0.8, 0.4, 0.6, 0.0]

    def order(values):
        df = spark.createDataFrame([(0, k + 1, s) for k, s in enumerate(values)], "query_id int, rank int, rerank_score double")
        return [r.rank - 1 for r in R.protected_order(df).orderBy("new_rank").collect()]

    assert order(scores) == [1, 3, 4, 2, 0, 6, 8, 7, 5, 9]
    assert order([0.5] * 10) == list(range(10))
    assert order(scores + [9.0, 8.0])[10:] == [10, 11]


def test_model_scorer(spark):
    df = spark.createDataFrame([("a", "a b"), ("c", "d")], "query string, text string")
    good = R.scored_by(df, lambda: lambda q, t: [float(x in y) for x, y in zip(q, t)])
    assert sorted(r.rerank_score for r in good.collect()) == [0.0, 1.0]
    with pytest.raises(Exception, match="finite"):
        R.scored_by(df, lambda: lambda q, t: [float("nan")] * len(q)).collect()


def test_block_search_equals_scored_pairs_and_makes_none(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k // 3, k % 3, text(3), None if k % 50 == 0 else text(int(rng.integers(0, 90)))) for k in range(1500)]
    rows += [(900 + k, 0, "same title", "w1 w2 w3 same") for k in range(40)]
    chunks = spark.createDataFrame(rows, "document_id long, ordinal int, title string, text string").repartition(5)
    asked = queries(spark, *(text(int(rng.integers(1, 9))) for _ in range(200)), "same", "", "absent")
    boosts = {"title": 4.0, "text": 1.0}
    found = R.lexical_search(asked, chunks, 7, boosts=boosts)
    hits = R.collapse(R.bm25(asked, chunks, ["document_id", "ordinal"], boosts=boosts), "document_id", ["ordinal"])
    want = R.top_k(hits, ["query_id"], [F.desc("score"), "document_id"], 7)
    assert sorted(found.select("query_id", "document_id", "ordinal", "score", "rank").collect()) == sorted(want.select("query_id", "document_id", "ordinal", "score", "rank").collect())
    assert "CartesianProduct" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "BroadcastNestedLoopJoin" in plan


def test_phrases_are_counted_in_blocks_and_make_no_pairs(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(6)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k // 3, k % 3, text(int(rng.integers(0, 4))), None if k % 50 == 0 else text(int(rng.integers(0, 90)))) for k in range(900)]
    rows += [(900, 0, "a a a", "a a b a a a"), (901, 0, "a", "a"), (902, 0, "b", "a a"), (903, 0, "a b", None)]
    chunks = spark.createDataFrame(rows, "document_id long, ordinal int, title string, text string").repartition(3)
    asked = queries(spark, *(text(int(rng.integers(1, 5))) for _ in range(150)), "a", "a a", "a a a", "b a", "a absent", "", "absent")
    options = {"boosts": {"title": 4.0, "text": 1.0}, "phrases": {"title": 7.0, "text": 2.0}}
    found = R.lexical_search(asked, chunks, 7, **options)
    hits = R.collapse(R.bm25(asked, chunks, ["document_id", "ordinal"], **options), "document_id", ["ordinal"])
    want = R.top_k(hits, ["query_id"], [F.desc("score"), "document_id"], 7)
    assert sorted(found.select("query_id", "document_id", "ordinal", "score", "rank").collect()) == sorted(want.select("query_id", "document_id", "ordinal", "score", "rank").collect())
    assert "CartesianProduct" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "BroadcastNestedLoopJoin" in plan
