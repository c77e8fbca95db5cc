import hashlib
import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lodestone.functions import url as U
from lodestone.operators import holdout as H
from lodestone.operators import retrieval as R
from lodestone.sources import markup as M

BASE = "https://h.example/a/b/c?q=1#f"
LINKS = ["../d", "./e", "../../../f", "g/./h/../i", "/j/../k", ".", "..", "x?y=../z", "//o.example/p", "?r=2", "#s", "", "http://t.example/../u", "v/..", "w/."]


def test_relative_links(spark):
    rows = spark.createDataFrame([(BASE, x) for x in LINKS], "base string, link string")
    got = {r.link: r.full for r in rows.select("link", U.resolve(F.col("base"), F.col("link")).alias("full")).collect()}
    want = {x: urljoin(BASE, x) if x else BASE.split("#")[0] for x in LINKS}
    want["http://t.example/../u"] = "http://t.example/../u"  # absolute ones stay as they are
    assert got == want


class _Hrefs(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.found.append(dict(attrs)["href"])


def test_links_of_any_quotes(spark, sf_dir):
    """Against a parser of its own: quotes of both kinds, none, references, other attributes."""
    odd = """<a href='/one'>1</a><A class=x HREF=/two>2</A><a title="a > b" href = "/three?x=1&amp;y=2">3</a><a data-href="/no">4</a><a href="/one">5</a><abbr href="/no">6</abbr><a
      href="/four">7</a><a name=x>8</a>"""
    pages = spark.createDataFrame([("https://h.example/p/", odd)], "url string, html string").union(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"))
    got = {}
    for r in M.page_links(pages).collect():
        got.setdefault(r.url, set()).add(r.link)
    for r in pages.collect():
        parser = _Hrefs()
        parser.feed(r.html)
        full = spark.createDataFrame([(urljoin(r.url, h),) for h in parser.found], "u string")
        if r.url == "https://h.example/p/":
            assert got[r.url] == {x.n for x in full.select(U.normalize(F.col("u")).alias("n")).collect()}
            assert len(got[r.url]) == 4
        assert len(got.get(r.url, ())) <= len(parser.found) and (not parser.found or got[r.url])


def test_canonical_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n", None)], "b int, a string, c string")
    made = df.select(H.canonical_json("b", "a", "c").alias("j"), H.canonical_hash("c", "b", "a").alias("h")).first()
    assert made.j == json.dumps({"a": "é\n", "b": 1, "c": None}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert made.h == hashlib.sha256(made.j.encode()).hexdigest()
    (tmp_path / "x").write_bytes(b"abc")
    assert H.file_checksums(spark, str(tmp_path / "x")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_freeze_and_identity(spark):
    rows = lambda x: spark.createDataFrame(x, "id long, text string")
    one = H.holdout_freeze(rows([(1, "a"), (2, "b")]), rows([(2, "c"), (3, "a")]), "id", "text").first()
    assert (one.n_holdout, one.n_known, one.shared_ids, one.shared_contents, one.frozen) == (2, 2, 1, 1, False)
    two = H.holdout_freeze(rows([(2, "b"), (1, "a")]), rows([]), "id", "text").first()
    assert two.frozen and two.holdout_checksum == one.holdout_checksum
    H.require_identity(rows([(1, "a")]), rows([(1, "z")]), ["id"])
    with pytest.raises(ValueError, match="2 identities"):
        H.require_identity(rows([(1, "a"), (5, "")]), rows([(1, "a"), (2, "b")]), ["id"])


def test_name_resolution(spark):
    urls = ["https://a.example/", "https://b.example/", "https://c.example/", "https://a.example:0/", "https://a.example:99999/", "https://a.example:x/", "https://a.example:443/", "ftp://a.example/"]
    dns = spark.createDataFrame([("a.example", "93.184.216.34"), ("b.example", "93.184.216.34"), ("b.example", "127.0.0.1")], "host string, address string")
    got = {r.url: r.refusal for r in H.resolved_admission(spark.createDataFrame([(u,) for u in urls], "url string"), dns).collect()}
    assert [got[u] for u in urls] == [None, "address", "not resolved", "port", "port", "port", None, "scheme"]


def test_rerank_control(spark):
    first = [(q, f"d{k}", k, 1.0 / k, "bm25" if q in (2, 3) else "hybrid", q == 3) for q in (1, 2, 3, 4) for k in range(1, 13)]
    first = spark.createDataFrame(first, "query_id int, document_id string, rank int, score double, mode_used string, degraded boolean")
    scores = spark.createDataFrame([(q, f"d{k}", float("nan") if q == 4 and k == 3 else float(k)) for q in (1, 2, 3, 4) for k in range(1, 11)], "query_id int, document_id string, rerank_score double")
    got = {}
    for r in R.rerank_control(first, scores, 11).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, ([], set()))[0].append(int(r.document_id[1:]))
        got[r.query_id][1].add((r.rerank_used, r.rerank_degraded, r.rerank_reason))
    assert got[1] == ([5, 4, 3, 2, 1, 10, 9, 8, 7, 6, 11], {(True, False, None)})
    same = list(range(1, 12))
    assert got[2] == (same, {(False, False, None)})
    assert got[3] == (same, {(False, True, "the first stage is degraded")})
    assert got[4] == (same, {(False, True, "the scorer failed")})
    assert {r.rerank_reason for r in R.rerank_control(first, None, 3).filter("query_id = 1").collect()} == {"the scorer failed"}


def test_frozen_rerank(spark):
    rankings = spark.createDataFrame([(1, f"i{k}", k) for k in range(1, 8)], "query_id int, item string, rank int")
    scores = spark.createDataFrame([(1, f"i{k}", float(k)) for k in range(1, 8)], "query_id int, item string, rerank_score double")
    judgments = spark.createDataFrame([(1, "i5", 1)], "query_id int, item string, grade int")
    r = H.frozen_rerank(rankings, scores, judgments).first()
    assert (r.mrr, r.mrr_delta, r.membership_kept) == (0.2, 0.8, True)


def test_frozen_evaluation(spark):
    rankings = spark.createDataFrame([(q, f"i{k}", k) for q in (1, 2, 3) for k in range(1, 8)], "query_id int, item string, rank int")
    scores = spark.createDataFrame([(q, f"i{k}", float(k if q == 1 else -k)) for q in (1, 2) for k in range(1, 6)], "query_id int, item string, rerank_score double")
    judgments = spark.createDataFrame([(1, "i5", 1), (2, "i1", 2), (3, "i6", 1)], "query_id int, item string, grade int")
    categories = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "query_id int, category string")
    manifest = H.frozen_manifest(rankings=rankings, scores=scores)
    H.require_frozen(manifest, scores=scores, rankings=rankings)
    for bad in (rankings.union(rankings.limit(2)), rankings.filter("rank > 1")):
        with pytest.raises(ValueError, match="rankings"):
            H.require_frozen(manifest, rankings=bad, scores=scores)
    got = {r.category: r for r in H.frozen_evaluation(rankings, scores, judgments, categories).collect()}
    assert (got["a"].mrr, got["a"].new_mrr, got["a"].wins, got["a"].n_queries) == (0.2, 1.0, 1, 1)
    assert (got["b"].n_queries, got["b"].wins, got["b"].ties, got["b"].losses, got["b"].membership_kept) == (3, 0, 3, 0, 3)  # a query without hits ties
    assert (got["all"].n_queries, got["all"].wins, got["all"].mrr_delta) == (4, 1, 0.2)


def test_checksums_count_equal_rows(spark):
    sums = [spark.createDataFrame([(x,) for x in rows], "x string").agg(H.set_checksum(F.sha2("x", 256))).first()[0] for rows in ("aab", "b", "baa", "ab")]
    assert sums[0] == sums[2] and len(set(sums)) == 3


def test_ip_literals_need_no_name_resolution(spark):
    none = spark.createDataFrame([], "host string, address string")
    urls = ["http://93.184.216.34/", "http://10.0.0.1/", "http://[2606:2800:220:1::1]/", "http://[::1]/", "http://name.example/"]
    got = {r.url: r.refusal for r in H.resolved_admission(spark.createDataFrame([(u,) for u in urls], "url string"), none).collect()}
    assert [got[u] for u in urls] == [None, "address", None, "address", "not resolved"]


def test_search_survives_dense_failure(spark):
    chunks = spark.createDataFrame([("d1", 0, "one two"), ("d2", 0, "two three")], "document_id string, ordinal int, text string")
    queries = spark.createDataFrame([(1, "two")], "query_id int, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    broken = vectors.withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("no model")).cast("array<double>")))
    rows = R.search(queries, chunks, 5, "hybrid", broken, vectors, F.lit("d1"), boosts={"text": 1.0}).collect()
    assert len(rows) == 2 and all(r.degraded and r.mode_used == "bm25" and r.reason.startswith("dense retrieval failed") for r in rows)


def test_other_failures_are_no_results(spark, sf_dir, monkeypatch):
    """Only a model that makes query vectors may fail, and not in the registered queries."""
    from lodestone.plans import retrieval as P

    chunks = spark.createDataFrame([("d1", 0, "one two")], "document_id string, ordinal int, text string")
    queries = spark.createDataFrame([(1, "two")], "query_id int, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    broken = vectors.withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("no store")).cast("array<double>")))
    with pytest.raises(Exception, match="no store"):
        R.search(queries, chunks, 5, "hybrid", vectors, broken, F.lit("d1"), boosts={"text": 1.0}).collect()
    with pytest.raises(Exception, match="no store"):
        R.search(queries, chunks, 5, "hybrid", broken, vectors, F.lit("d1"), fallback=False, boosts={"text": 1.0}).collect()
    found = P._vectors
    monkeypatch.setattr(P, "_vectors", lambda spark, d: found(spark, d).withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("no store")).cast("array<float>"))))
    for query in (P.hybrid_search, P.rerank_control):
        with pytest.raises(Exception, match="no store"):
            query(spark, sf_dir).collect()


def test_canonical_rows(spark):
    one = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('y', 1, 'x', map('q', 1, 'c', 2)))) AS v, CAST(NULL AS struct<a:int>) AS `n.m`")
    two = spark.sql("SELECT CAST(NULL AS struct<a:int>) AS `n.m`, named_struct('a', array(named_struct('x', map('c', 2, 'q', 1), 'y', 1)), 'b', 1) AS v, 3 AS other")
    want = '{"n.m":null,"v":{"a":[{"x":{"c":2,"q":1},"y":1}],"b":1}}'
    for df in (one, two):
        assert df.select(H.canonical_rows(df, "v", "n.m").alias("h")).first().h == hashlib.sha256(want.encode()).hexdigest()
    with pytest.raises(ValueError, match="columns"):
        H.canonical_rows(one, "v", "missing")
