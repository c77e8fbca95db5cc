"""The response source, fetching and the crawl loop."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crawler as C
from lodestone.sources import responses as R



def now():
    return F.lit("2026-01-02 00:00:00").cast("timestamp")

RESPONSE = "url string, status int, location string, content_type string, body binary, etag string, last_modified string"
HTML = "text/html"


def response(url, body="", status=200, location=None, kind=HTML, etag=None, modified=None):
    return (url, status, location, kind, body if isinstance(body, bytes) else body.encode(), etag, modified)


def page(text, *links):
    return f"<html><body><main><p>{text}</p>" + "".join(f"<a href='{x}'>x</a>" for x in links) + "</main></body></html>"


def web(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE).withColumn("host", F.lit("unused")).select(*R.COLUMNS)


# --- source -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("responses") / "r")
    rows = [response(f"https://h{k % 5}.example/p/{k}", f"page {k}", 200 if k % 3 else 404) for k in range(60)]
    R.store_responses(spark.createDataFrame(rows, RESPONSE), path, 8)
    return path


def test_source_reads_what_was_stored(spark, stored):
    df = R.read_responses(spark, stored, 8)
    assert df.columns == R.COLUMNS and df.count() == 60
    assert sorted(r.url for r in df.filter("status = 404").collect()) == sorted(f"https://h{k % 5}.example/p/{k}" for k in range(0, 60, 3))
    assert {bytes(r.body) for r in df.filter("host = 'h2.example' AND status = 200").collect()} == {f"page {k}".encode() for k in range(60) if k % 5 == 2 and k % 3}
    assert df.filter("host IN ('h1.example', 'h3.example') AND length(url) > 5").count() == 24


def test_filters_leave_out_files_of_other_hosts(stored):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    every = len(R._Reader(f"file://{stored}", 8).partitions())
    one = R._Reader(f"file://{stored}", 8)
    left = list(one.pushFilters([EqualTo(("url",), "https://h1.example/p/1"), GreaterThan(("status",), 3)]))
    assert len(left) == 1 and 0 < len(one.partitions()) < every
    rows = [r for p in one.partitions() for b in one.read(p) for r in b.to_pylist()]
    assert [r["url"] for r in rows] == ["https://h1.example/p/1"]
    none = R._Reader(f"file://{stored}", 8)
    assert list(none.pushFilters([In(("host",), ("h1.example",)), EqualTo(("host",), "h2.example")])) == [] and not [b for p in none.partitions() for b in none.read(p)]


def test_decoding(spark):
    rows = [(b"caf\xe9", "text/html; charset=ISO-8859-1", "café"), ("é".encode(), None, "é"), (b"\xff!", "text/html", "�!"), ("é".encode(), "x; charset=unheard-of", "é"), (None, "x", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "b binary, k string")
    assert [r[0] for r in df.select(R.decoded("b", "k")).collect()] == [r[2] for r in rows]


def test_fetch(spark):
    h = "https://h.example"
    rows = [
        response(f"{h}/", page("home")), response(f"{h}/old", status=301, location="/"), response(f"{h}/older", status=302, location="old"),
        response(f"{h}/loop", status=302, location="/loop"), response(f"{h}/nowhere", status=302), response(f"{h}/gone", status=410), response(f"{h}/pdf", kind="application/pdf"),
        response(f"{h}/big", "x" * 2000), response(f"{h}/tag", "t", etag="e1", modified="m1"), response(f"{h}/out", status=308, location="http://10.0.0.1/"),
    ]
    asked = [(f"{h}{p}", None, None) for p in ("/", "/old", "/older", "/loop", "/nowhere", "/gone", "/pdf", "/big", "/out", "/missing")]
    asked += [(f"{h}/tag", "e1", None)]
    requests = spark.createDataFrame(asked, "url string, if_none_match string, if_modified_since string")
    ask = C.admission(None, None, "bot", now())
    got = {r.url.removeprefix(h): r for r in R.fetch(requests, web(spark, *rows), ask, most=3, cap=1000).collect()}
    assert len(got) == 11
    assert (got["/older"].final_url, got["/older"].hops, got["/older"].html) == (f"{h}/", 2, page("home"))
    errors = {p: got[p].error for p in ("/loop", "/nowhere", "/gone", "/pdf", "/big", "/out", "/missing")}
    assert errors == {"/loop": "too many redirects", "/nowhere": "redirect without a location", "/gone": "HTTP 410", "/pdf": "unsupported content type", "/big": "response exceeds the size limit", "/out": "address", "/missing": "no answer"}
    assert got["/tag"].not_modified and got["/tag"].status == 304 and got["/tag"].html is None and got["/tag"].etag == "e1" and got["/tag"].error is None
    other = spark.createDataFrame([(f"{h}/tag", "e2", "m1")], requests.schema)
    assert not R.fetch(other, web(spark, *rows)).first().not_modified  # a tag that differs counts, not the date
    dated = spark.createDataFrame([(f"{h}/tag", None, "m1")], requests.schema)
    assert R.fetch(dated, web(spark, *rows)).first().not_modified


# --- crawl ------------------------------------------------------------------------

DOCUMENT = "document_id string, url string, content_hash string, fetched_at string, etag string, last_modified string"
H = "https://h.example"


def seeds(spark, *urls):
    return spark.createDataFrame([(1, u, k) for k, u in enumerate(urls)], "crawl_id int, url string, position int")


def run(spark, folder, start, rows, stored=(), **options):
    extra = {k: options.pop(k) for k in ("robots", "dns", "touch_ok") if k in options}
    made = C.crawl(spark, str(folder), seeds(spark, *start), web(spark, *rows), spark.createDataFrame(list(stored), DOCUMENT), now(), C.CrawlPolicy(**options), **extra)
    return made, {r.url: r for r in made.outcomes.collect()}


#: Counters of a page of 262,144 bytes that are published for five ways to refresh it. Fixed values:
#: conditional and unconditional requests, body bytes, extractions, index writes, touches.
SCENARIOS = {
    "fresh page": (False, 100, True, (0, 1, 262144, 0, 0, 0)),
    "fresh leaf": (True, 100, True, (0, 0, 0, 0, 0, 0)),
    "stale page": (False, 9000, True, (0, 1, 262144, 1, 1, 0)),
    "stale leaf, unchanged": (True, 9000, True, (1, 0, 0, 0, 0, 1)),
    "touch fails": (True, 9000, False, (1, 1, 262144, 1, 1, 1)),
}


@pytest.mark.parametrize("leaves", [False, True])
def test_published_refresh_counters(spark, tmp_path, leaves):
    body = page("x" * 100)
    body += " " * (262144 - len(body))
    names = [n for n in SCENARIOS if SCENARIOS[n][0] == leaves]
    url = lambda n: f"{H}/{n.replace(' ', '-').replace(',', '')}"
    stored = [(n, url(n), "h", "2026-01-01T23:58:20Z" if SCENARIOS[n][1] == 100 else "2026-01-01T21:30:00Z", "e", None) for n in names]
    _, got = run(spark, tmp_path, map(url, names), [response(url(n), body, etag="e") for n in names], stored, max_depth=0, refresh_after_s=3600, revalidate_leaves=leaves, touch_ok=F.col("document_id") != "touch fails")
    for name in names:
        _, age, _, want = SCENARIOS[name]
        r = got[url(name)]
        assert (r.conditional_gets, r.unconditional_gets, r.body_bytes, r.extractions, r.index_writes, r.touches) == want
        assert (r.freshness_skipped, r.network_skipped, r.revalidated, r.indexed) == (age == 100, name == "fresh leaf", name == "stale leaf, unchanged", want[4] == 1)
        assert r.error is None and (r.document_id == name) == (want[4] == 0)


def test_fresh_leaves_are_admitted_before_they_are_skipped(spark, tmp_path):
    rows = [("d1", f"{H}/private", "h", "2026-01-01T23:59:00Z", "e", None), ("d2", "http://10.0.0.1/", "h", "2026-01-01T23:59:00Z", "e", None), ("d3", f"{H}/open", "h", "2026-01-01T23:59:00Z", "e", None)]
    robots = spark.sql("SELECT 'https|h.example|443' AS origin, 200 AS status, 'User-agent: *\nDisallow: /private' AS body, timestamp'2030-01-01' AS expires_at UNION ALL SELECT 'http|10.0.0.1|80', 404, '', timestamp'2030-01-01'")
    _, got = run(spark, tmp_path, [r[1] for r in rows], [], rows, max_depth=0, refresh_after_s=3600, revalidate_leaves=True, robots=robots)
    assert got[f"{H}/private"].error == "blocked by robots.txt" and got["http://10.0.0.1/"].error == "address"
    assert not got[f"{H}/private"].network_skipped and got[f"{H}/open"].network_skipped and got[f"{H}/open"].document_id == "d3"


def test_freshness_counts_by_the_address_reached(spark, tmp_path):
    rows = [response(f"{H}/a", status=301, location="/b"), response(f"{H}/b", page("text"))]
    _, got = run(spark, tmp_path, [f"{H}/a"], rows, [("d", f"{H}/b", "h", "2026-01-01T23:59:00Z", None, None)], max_depth=0, refresh_after_s=3600)
    r = got[f"{H}/a"]
    assert (r.final_url, r.freshness_skipped, r.network_skipped, r.document_id, r.age_s, r.extractions) == (f"{H}/b", True, False, "d", 60.0, 0)


def test_order_budget_origins_and_index(spark, tmp_path):
    rows = [
        response(f"{H}/", page("home", "/b", "/a", "https://other.example/", "/b#again", "/")), response(f"{H}/a", page("first", "/c")), response(f"{H}/b", page("second", "/d", "/a")),
        response(f"{H}/c", page("deep")), response(f"{H}/d", "<main></main>"), response("https://other.example/", page("other")),
    ]
    made, got = run(spark, tmp_path / "one", [f"{H}/"], rows, max_depth=2)
    assert [u.removeprefix(H) for u in sorted(got, key=lambda u: got[u].visit)] == ["/", "/b", "/a", "/d", "/c"]
    assert {u.removeprefix(H): r.depth for u, r in got.items()} == {"/": 0, "/b": 1, "/a": 1, "/d": 2, "/c": 2}
    assert not got[f"{H}/d"].indexed and got[f"{H}/d"].error == "no indexable content" and got[f"{H}/c"].passages == 1
    assert made.documents.count() == 4 and sorted(r.text for r in made.passages.collect())[0].startswith("deep")
    totals = C.crawl_totals(made.outcomes).first()
    assert (totals.pages_visited, totals.pages_indexed, totals.pages_skipped_fresh) == (5, 4, 0)
    _, far = run(spark, tmp_path / "two", [f"{H}/"], rows, max_depth=1, same_origin=False)
    assert "https://other.example/" in far
    _, few = run(spark, tmp_path / "three", [f"{H}/"], rows, max_depth=2, max_pages=3)
    assert [u.removeprefix(H) for u in sorted(few, key=lambda u: few[u].visit)] == ["/", "/b", "/a"]
    with pytest.raises(ValueError):
        run(spark, tmp_path / "four", [f"{H}/"], rows, max_pages=0)


def test_a_crawl_is_resumed_at_its_next_level(spark, tmp_path, monkeypatch):
    rows = [response(f"{H}/", page("home", "/a")), response(f"{H}/a", page("a", "/b")), response(f"{H}/b", page("b"))]
    real, calls = C._level, []

    def level(*args):
        calls.append(args[3])
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(C, "_level", level)
    with pytest.raises(RuntimeError, match="lost"):
        run(spark, tmp_path, [f"{H}/"], rows, max_depth=2)
    _, got = run(spark, tmp_path, [f"{H}/"], rows, max_depth=2)
    assert calls == [0, 1, 1, 2] and len(got) == 3
