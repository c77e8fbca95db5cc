import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import jsonl, robots
from lodestone.sources import markup as M


def test_extraction():
    html = "<html><head><title> A  B </title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b> <a href='/x'>three</a></p><ul><li>a</li><li>b</li></ul><pre>code</pre><script>x</script></article><footer>f</footer></body></html>"
    got = M.extract(html)
    assert got["title"] == "A B" and got["error"] is None
    assert got["markdown"] == "# Head\n\nOne **two** [three](/x)\n\n- a\n- b\n\n```\ncode\n```"
    assert M.extract("")["error"] and M.extract(None)["error"]
    assert M.extract("<p>unclosed <b>bold")["markdown"] == "unclosed **bold**"


def test_selectors():
    html = "<div class='a b'><p id=x>one</p><p data-k='v'>two</p></div><p>three</p>"
    left = lambda *s: M.extract(f"<main>{html}</main>", list(s))["markdown"].split()
    assert left() == ["one", "two", "three"]
    assert left("div.a #x") == ["two", "three"] and left("[data-k=v]") == ["one", "three"] and left(".b p") == ["three"]
    assert left("p", "bad >> one") == ["one", "two", "three"]
    assert left("p" * 600) == ["one", "two", "three"]


def test_deep_nesting():
    assert "x" in M.extract("<div>" * 3000 + "x" + "</div>" * 3000)["text"]


def test_links(spark):
    html = '<a href="/a?utm_source=1">x</a><a class="k" href="b">y</a><a href="/a">z</a><a href="mailto:q@r.s">m</a>'
    df = spark.createDataFrame([("https://h.example/d/p", html)], "url string, html string")
    got = [r.link for r in M.page_links(df).orderBy("position").collect()]
    assert got == ["https://h.example/a", "https://h.example/d/b"]


def test_types_and_sizes(spark):
    df = spark.createDataFrame([("Text/HTML; charset=x", "abc"), ("image/png", "abcdef")], "t string, h string")
    rows = df.select(M.acceptable_type(F.col("t")).alias("t"), M.within_size(F.col("h"), cap=3).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False)]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private"
    assert robots.may_fetch("https://h.example/a", "bot", 200, body) and not robots.may_fetch("https://h.example/private/a", "bot", 200, body)
    assert robots.may_fetch("https://h.example/a", "bot", 404, None) and not robots.may_fetch("https://h.example/a", "bot", 503, None)
    assert not robots.may_fetch("https://h.example/a", "bot", 200, "x" * 600_000) and not robots.may_fetch("https://h.example/a", "bot", None, None)
    urls = spark.createDataFrame([("https://h.example/a",), ("https://old.example/a",)], "url string")
    rules = spark.sql("SELECT 'https|h.example|443' AS origin, 200 AS status, '' AS body, timestamp'2030-01-01' AS expires_at UNION ALL SELECT 'https|old.example|443', 200, '', timestamp'2000-01-01'")
    got = {r.url: r.robots_ok for r in robots.robots_decisions(urls, rules, "bot", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got == {"https://h.example/a": True, "https://old.example/a": False}


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "d", "url": "u", "title": "t", "chunks": [{"section_path": ["a", "", "b"], "text": "x"}]}) + "\n\n")
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q", "language": "en", "query": "w", "relevance": {"d": 2, "z": 0}}) + "\n")
    corpus = jsonl.read_jsonl(spark, str(tmp_path / "c.jsonl"), jsonl.CORPUS)
    queries = jsonl.read_jsonl(spark, str(tmp_path / "q.jsonl"), jsonl.QUERIES)
    assert jsonl.chunk_rows(corpus).first().section_path == "a > b"
    v = jsonl.query_violations(queries, corpus).first()
    assert (v.repeated_ids, v.blank_queries, v.unjudged, v.unknown_documents, v.bad_grades) == (0, 0, 0, 1, 1)
    (tmp_path / "bad.jsonl").write_text("[1, 2\n")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), jsonl.CORPUS).collect()
    (tmp_path / "p.json").write_text("[]")
    with pytest.raises(ValueError):
        jsonl.read_policy(str(tmp_path / "p.json"))


def test_long_pages_are_extracted():
    page = "<p>text</p>"
    fits = page + " " * (6_000_000 - len(page))
    assert M.extract(fits)["text"] == "text" and M.extract(fits)["error"] is None
    assert M.extract(fits + " ")["error"] and M.within_size.__defaults__[-1] == 5_000_000
