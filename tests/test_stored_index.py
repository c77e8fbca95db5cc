"""The stored index against the plain search, changes, other sessions' view, and commits."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import stored_index as S
from lodestone.operators.commits import Commits, Conflict
from lodestone.operators.retrieval import lexical_search
from lodestone.operators.stored_index import StoredIndex

WORDS = [f"w{k}" for k in range(60)] + ["the"] * 40
OPTIONS = {"boosts": {"title": 4.0, "text": 1.0}, "phrases": {"title": 7.0, "text": 2.0}}


def corpus(rng, n=120, first=0):
    said = lambda k: " ".join(rng.choices(WORDS, k=k))
    rows = [(first + d, c, said(rng.randint(0, 5)), said(rng.choice([0, 8, 40, 300]))) for d in range(n) for c in range(rng.randint(1, 3))]
    return rows


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(random.Random(1)), "document_id long, ordinal int, title string, text string").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark, chunks):
    rng = random.Random(2)
    texts = [r.text for r in chunks.select("text").collect()]
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 6, 25])))) for k in range(25)]
    rows += [(100 + k, " ".join(rng.choice([t for t in texts if t]).split()[:n])) for k, n in enumerate((2, 3, 8, 30))]
    rows += [(200, ""), (201, "nowhere seen"), (202, "the"), (203, "the the w1"), (204, "w1 nowhere")]
    return spark.createDataFrame(rows, "query_id long, query string").cache()


def found(df):
    return sorted((r.query_id, r["rank"], r.document_id, r.ordinal, r.score) for r in df.collect())


def index(spark, path, chunks):
    return StoredIndex.create(spark, str(path), chunks.select("document_id", "ordinal").schema, ["title", "text"]).add(chunks)


def plain(queries, chunks, limit=5, options=OPTIONS):
    return found(lexical_search(queries, chunks, limit, **options))


@pytest.mark.parametrize("limit,options", [(1, OPTIONS), (5, OPTIONS), (200, OPTIONS), (4, {"boosts": {"text": 1.0}, "phrases": {}})])
def test_search_is_that_of_the_chunks(spark, tmp_path, chunks, queries, limit, options):
    made = index(spark, tmp_path / "i", chunks)
    assert found(StoredIndex(spark, str(tmp_path / "i")).search(queries, limit, **options)) == plain(queries, chunks, limit, options)
    assert made.number == 1


def test_small_blocks_are_passed_over_and_change_nothing(spark, tmp_path, chunks, queries, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "SEEDS", 2)
    made = index(spark, tmp_path / "i", chunks)
    assert made._read("postings").filter("n > 4").isEmpty() and not made._read("postings").filter("field = 'text' AND term = 'the' AND n = 4").isEmpty()
    assert found(made.search(queries, 3, **OPTIONS)) == plain(queries, chunks, 3)
    some = queries.filter("query_id < 100")
    weights = made.weights(some, {"text": 1.0}, {}).cache()
    every = made._hits(weights.select("query_id", "field", "term", "w", "average")).select("query_id", *made.names).distinct().count()
    assert 0 < made.candidates(weights, 3).count() < every


def test_without_short_cuts(spark, tmp_path, chunks, queries, monkeypatch):
    made = index(spark, tmp_path / "i", chunks)
    monkeypatch.setattr(S, "WEIGHTS", 10)
    assert found(made.search(queries, 5, **OPTIONS)) == plain(queries, chunks)


def test_changes_are_as_of_a_new_index(spark, tmp_path, chunks, queries):
    """Replaced, removed, added again, and compacted: scores and statistics are those of what is live."""
    rng = random.Random(3)
    made = index(spark, tmp_path / "i", chunks)
    new = spark.createDataFrame(corpus(rng, 20, 10) + corpus(rng, 5, 500), chunks.schema)
    made = made.add(new)
    made = made.remove(spark.createDataFrame([(3,), (12,), (9999,)], "document_id long"))
    live = chunks.filter("document_id NOT BETWEEN 10 AND 29").unionByName(new).filter("document_id NOT IN (3, 12)")
    want = plain(queries, live)
    assert found(made.search(queries, 5, **OPTIONS)) == want
    assert made.stats() == index(spark, tmp_path / "new", live).stats()
    small = made.compact()
    assert len(small.state["segments"]) == 1 and not small.state["deletions"]
    assert found(small.search(queries, 5, **OPTIONS)) == want
    assert len(small.vacuum()) >= 3 and found(StoredIndex(spark, str(tmp_path / "i")).search(queries, 5, **OPTIONS)) == want
    back = small.add(spark.createDataFrame([(3, 0, "w1", "w1 w2")], chunks.schema))
    assert any(r[2] == 3 for r in found(back.search(queries.filter("query_id = 204"), 200, **OPTIONS)))


def test_empty_and_odd(spark, tmp_path, chunks, queries):
    none = StoredIndex.create(spark, str(tmp_path / "i"), chunks.select("document_id", "ordinal").schema, ["title", "text"])
    assert found(none.search(queries, 5, **OPTIONS)) == []
    assert none.remove(chunks).state["segments"] == []
    odd = none.add(spark.createDataFrame([(1, 0, None, ""), (2, 0, "w1", None)], chunks.schema))
    assert [r[2] for r in found(odd.search(queries.filter("query_id = 204"), 5, **OPTIONS))] == [2]
    with pytest.raises(FileNotFoundError):
        StoredIndex(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        odd.search(queries, 0)


def test_another_session_opens_it_by_name(spark, tmp_path, chunks, queries):
    index(spark, tmp_path / "i", chunks)
    other = spark.newSession()
    assert found(StoredIndex(other, str(tmp_path / "i")).search(other.createDataFrame(queries.collect(), queries.schema), 5, **OPTIONS)) == plain(queries, chunks)


def test_one_writer_wins_each_number(spark, tmp_path):
    """Eight writers add up: none of their changes is lost, and each number is made once."""
    commits = Commits(spark, str(tmp_path / "c"))
    assert commits.latest() == (-1, {}) and commits.offer(0, {"n": 0}) and not commits.offer(0, {"n": 9})

    def add():
        for _ in range(5):
            Commits(spark, str(tmp_path / "c")).change(lambda s: {"n": s["n"] + 1}, tries=1000)

    threads = [threading.Thread(target=add) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert commits.latest() == (40, {"n": 40})

    def meddle(state):
        commits.offer(commits.latest()[0] + 1, state)
        return state

    with pytest.raises(Conflict):
        commits.change(meddle, tries=3)
    assert commits.change(lambda s: None) == commits.latest()[0]


def test_two_writers_of_an_index(spark, tmp_path, chunks, queries):
    """What two writers add at the same time is all there."""
    parts = [chunks.filter(f"document_id % 2 = {k}") for k in (0, 1)]
    path = str(tmp_path / "i")
    StoredIndex.create(spark, path, chunks.select("document_id", "ordinal").schema, ["title", "text"])
    threads = [threading.Thread(target=lambda p=p: StoredIndex(spark, path).add(p)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found(StoredIndex(spark, path).search(queries, 5, **OPTIONS)) == plain(queries, chunks)


def test_large_batches_read_texts_in_blocks_and_small_ones_postings(spark, tmp_path, chunks, queries, monkeypatch):
    """Rows of queries and chunks are made only where the batch's terms stand in few places; postings are packed some chunks at a time."""
    monkeypatch.setattr(S, "PACKED", 500)
    made = index(spark, tmp_path / "i", chunks)
    made = made.remove(spark.createDataFrame([(7,), (8,)], "document_id long"))
    want = plain(queries, chunks.filter("document_id NOT IN (7, 8)"))
    for places in (0.0, 1e9):
        monkeypatch.setattr(S, "PLACES", places)
        got = made.search(queries, 5, **OPTIONS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert found(got) == want and ("BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan) == (places == 0.0)
    hits = made._read("postings").filter("field = 'text'").selectExpr("term", "inline(hits)").groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    words = chunks.select(F.explode(F.split("text", " ")).alias("term"), "document_id", "ordinal").filter("term <> ''").groupBy("term")
    assert sorted(hits.collect()) == sorted(words.agg(F.count_distinct("document_id", "ordinal").alias("n"), F.count("*").alias("tf")).collect())
