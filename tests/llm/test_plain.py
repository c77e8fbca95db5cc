"""WARC, mixing, HTML text and media: SQL, brute force, round trips, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from same import same_rows

from lodestone.llm import htmltext, media, mixing, queries, warc
from lodestone.llm.common import filesystem, scratch

DOC = "doc_id long, text string, source string, extra string"
PAGE = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name]) > 0


# --- WARC -------------------------------------------------------------------------


def test_warc_edge_cases(frame):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a.example/ü\r\nX: y", big, "x"), (2, None, big, None), (5, "u", big, "z"), (3, "u", None, None), (4, "u", "", None), (6, "u", "small", None), (7, "u", "small", None), (None, "u", "w" * 2000, None), (5, "u", big, "z")]
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1(frame(PAGE, rows)).collect())
    n = len(big.encode())
    want = [(-1, 2000, "response", None), (1, n, "revisit", 5), (2, n, "revisit", 5), (3, 0, "response", None), (4, 0, "response", None), (5, n, "response", None), (5, n, "revisit", 5), (6, 5, "response", None), (7, 5, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.op1(frame(PAGE, [])).count() == 0


def test_warc_files(spark, frame):
    """Payloads come back whole, files roll, and a second run gives equal files."""
    rng = random.Random(1)
    rows = [(k, f"http://h.example/{k}", "".join(rng.choices("abcdef <>", k=4000)), None) for k in range(120)]
    digests = []
    for _ in range(2):
        folder = scratch(spark, "test-warc")
        fs, path = filesystem(folder)
        fs.create_dir(path)
        manifest = warc.write_warc(frame(PAGE, rows), folder, shard_bytes=100_000, roll_bytes=20_000)
        files = sorted((r.file, r.sha256, r.records, r.first_page, r.last_page) for r in manifest.collect())
        digests.append(files)
        back = {r.page_id: r.payload.decode() for r in warc.read_warc(manifest, folder).collect()}
        assert back == {k: h for k, _, h, _ in rows}
    assert digests[0] == digests[1] and len(digests[0]) > 8 and sum(f[2] for f in digests[0]) == 120
    spans = sorted((f[3], f[4]) for f in digests[0])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_warc_bounds(spark, frame):
    """Shards are of one size whatever the ids: at both ends of long, with an outlier, without ids, one id, equal rows."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdef <>", k=n))
    ends = [-(2**63), -(2**62) - 5, 2**62 + 5, 2**63 - 1]
    tables = {
        "wide": [(i, "u", text(5000), None) for i in ends * 10],
        "outlier": [(k, "u", text(5000), None) for k in range(100)] + [(10**12, "u", text(5000), None)],
        "null": [(None, "u", text(5000), None) for _ in range(60)],
        "one": [(7, "u", text(5000), None) for _ in range(60)],
        "equal": [(7, "u", "x" * 5000, None)] * 60 + [(9, "u", "y" * 900, None)] * 60 + [(1, "u", "x" * 5000, None)],
    }
    for name, rows in tables.items():
        df = frame(PAGE, rows)
        folder = scratch(spark, "test-warc")
        fs, path = filesystem(folder)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/.tmp-lost") as f:
            f.write(b"x")
        manifest = warc.write_warc(df, folder, shard_bytes=50_000)
        files = manifest.collect()
        assert len(files) >= len(rows) * 5000 // 100_000 and sum(r.records for r in files) == len(rows), name
        assert max(r.records for r in files) <= (60 if name == "equal" else 20), name
        assert not any(i.base_name.startswith(".tmp") for i in fs.get_file_info(__import__("pyarrow").fs.FileSelector(path))), name
        back = warc.read_warc(manifest, folder).collect()
        largest = {}
        for i, _, h, _ in rows:
            largest.setdefault(h, []).append(-(2**64) if i is None else i)
        assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes) for r in back) == sorted((i if i is not None else -1, len(h)) for i, _, h, _ in rows), name
        for h, ids in largest.items():
            mine = [r for r in back if r.payload == h.encode()]
            assert len(mine) == (1 if len(h) >= 1000 else len(ids)) and (mine[0].page_id or 0) == max(0 if i == -(2**64) else i for i in ids), name
        assert all(r.refers_to == 7 for r in back if r.record_type == "revisit"), name


def test_warc_many_shards(spark):
    """Ten thousand shards: bounds are in order, and every key goes to the one that holds it."""
    from pyspark.sql import functions as F

    keys = spark.range(40_000).select(((F.col("id") - 20_000) * 400_000_000_000_000).alias("page"), F.xxhash64("id").alias("hash"), F.lit(25).cast("long").alias("bytes"))
    bounds, heavy = warc.shard_bounds(keys, shard_bytes=100)
    assert len(bounds) == 10_000 and bounds == sorted(bounds) and not heavy
    got = keys.select("page", warc.shards_of(bounds, heavy)("page", "hash").alias("s")).collect()
    assert all(r.s == [(r.page // 400_000_000_000_000 + 20_000) // 4] for r in got)


@pytest.mark.parametrize("rows", [[(5, 1), (10, 1)], [(5, 3), (10, 1)], [(5, 1), (10, 7), (None, 2)], [(None, 4)]], ids=str)
@pytest.mark.parametrize("size", [5000, 900])
def test_payloads_above_a_shard_are_kept_once(spark, frame, rows, size):
    """Equal payloads that are each more than a shard, with and without urls: one response, of the largest id."""
    html = "é" + "x" * (size - 2)
    pages = [(i, None if n % 3 == 2 else f"u{n % 2}", html, None) for i, times in rows for n in range(times)]
    for _ in range(2):
        folder = scratch(spark, "test-warc")
        filesystem(folder)[0].create_dir(filesystem(folder)[1])
        manifest = warc.write_warc(frame(PAGE, pages), folder, shard_bytes=2000 if size == 5000 else 700)
        back = warc.checked(warc.read_warc(manifest, folder)).collect()
        ids = [i for i, _, _, _ in pages]
        top = max((i for i in ids if i is not None), default=None)
        key = lambda r: (r[0] or 0, r[1] or "")
        assert sorted(((r.page_id, r.url) for r in back), key=key) == sorted(((i, u) for i, u, _, _ in pages), key=key)
        kinds = [r.page_id for r in back if r.record_type == "response"]
        assert sorted(kinds, key=str) == ([top] if size >= 1000 and top is not None else sorted(ids, key=str))
        assert all(r.payload.decode() == html for r in back if r.record_type == "response") and {r.payload_bytes for r in back} == {size}


def test_revisit_without_response_fails(spark):
    rows = [(1, 9, "d", "revisit", 2), (2, 9, "e", "response", None)]
    records = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    with pytest.raises(ValueError, match="no response"):
        warc.checked(records)


def test_damaged_warc_fails(spark, frame):
    folder = scratch(spark, "test-warc")
    fs, path = filesystem(folder)
    fs.create_dir(path)
    manifest = warc.write_warc(frame(PAGE, [(1, "u", "text", None)]), folder)
    name = manifest.first().file
    import gzip

    raw = gzip.decompress(fs.open_input_stream(f"{path}/{name}", compression=None).read()).replace(b"text\r\n", b"tent\r\n")
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(gzip.compress(raw))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(manifest, folder).collect()


# --- mixing -----------------------------------------------------------------------


def filled(sizes, weights):
    """Shares handed out again and again until none is above its cap."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        w = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / w > 3 * sizes[k] - target[k]]
        if not over:
            for k in open_:
                target[k] += left * weights[k] / w
            break
        for k in over:
            left -= 3 * sizes[k] - target[k]
            target[k] = 3.0 * sizes[k]
            open_.remove(k)
    return target


def test_mixing(frame):
    rng = random.Random(4)
    sizes = {None: 3, "b": 500, "a": 40, "é": 2000, "z": 0, "c": 10, "d": 7000}
    rows, k = [], 0
    for source, n in sizes.items():
        left = n
        while left > 0 or n == 0:
            m = min(left, rng.randint(1, 90))
            rows.append((k, " ".join(["w"] * m) if m else rng.choice([None, " \t", ""]), source, "x"))
            k, left = k + 1, left - m
            if n == 0:
                break
    got = mixing.mix(frame(DOC, rows)).collect()
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, filled([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    assert sorted(map(str, mixing.mix(frame(DOC, rows, 1)).collect())) == sorted(map(str, got))
    assert mixing.mix(frame(DOC, [])).count() == 0


def test_mixed_documents(frame):
    rows = [(k, "w " * 10, "a" if k < 30 else "b", "x") for k in range(130)]
    df = frame(DOC, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(abs(10 * n.get(k, 0) - taken[k]) <= 5 for k in range(130)) and max(n.values()) == 3


def test_training_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for a in (-0.5, 0.0, 0.5):
        rows = spark.range(11).select((F.col("id") / 10).alias("t")).select("t", mixing.training_time((1 - a) * F.col("t") + a * F.col("t") ** 2, F.lit(a)).alias("back"))
        assert all(r.back == pytest.approx(r.t) for r in rows.collect())


# --- HTML -------------------------------------------------------------------------

WEIGHTS = {"word": 1.0, "tags": {"p": -0.1, "left-out": -2.0, "li": -2.0, "a": -2.0, "ul": -2.0, "/p": -0.1, "/li": -2.0, "/a": -2.0, "/ul": -2.0}, "other": -0.7}
BODY = "one two three four five six seven eight nine ten " * 3
CASES = {
    f"<nav>menu a b c</nav><article><h1>T</h1><p>{BODY}</p></article><footer>f</footer>": f"T\n\n{BODY.strip()}",
    f"<main><p>{BODY}<br>a&nbsp; &amp;&#x41;\n b<p>{BODY}</main>": f"{BODY.strip()} a &A b\n\n{BODY.strip()}",
    f"<article><p>short</p><div class='ad-box'>buy this now please</div><p>{BODY}</p><section id=comments><p>reader says hi</p></section></article>": f"short\n\n{BODY.strip()}",
    f"<body><header>site</header><ul><li><a>x</a><li><a>y</a></ul><p>{BODY}</p><form><label>q</label></form><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></body>": BODY.strip(),
    "": "",
    "<p>": "",
    "plain words only": "plain words only",
    "<p>a < b and c > d</p>": "a < b and c > d",
    "<script>never closed": "",
    "<p>x</p><!-- never closed": "x",
    "<p title='a > b'>ok</p>": "ok",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert htmltext.main_text(page, WEIGHTS) == CASES[page]


LONG = BODY.strip()
WHOLE = [
    *(f"<body><nav>menu</nav><div class='{c}'><article><p>{BODY}</p></article></div></body>" for c in ("has-sidebar", "no-sidebar", "with-sidebar", "hide-menu", "ad-free", "sidebar-layout", "ad")),
    *(f"<body><div class='{c}'><p>{BODY}</p></div></body>" for c in ("no-sidebar", "page-banner", "sidebar")),
    f"<form id=page><div class=menu>a b</div><main><p>{BODY}</p></main><aside><article>card</article></aside></form>",
    f"<article><div class='post-widget'><p>{BODY}</p></div></article>",
    f"<article><p>{BODY}</p></article><div id=comments><article class=comment>{BODY}</article></div>",
    f"<p class='notice'>we use cookies<p>{BODY}</p><p class=ad>buy</p>",
    f"<div><p class='notice'>we use cookies</div><p>{BODY}</p>",
    f"<p class=notice>we use cookies<div>{BODY}</div>",
    f"<ul><li class='ad'>buy<li>{BODY}</ul>",
    f"<dl><dt class=ad>buy<dd>{BODY}</dl>",
    f"<table><tr class=ad><td>buy<tr><td>{BODY}</table>",
    f"<table><tr><td class=ad>buy<td>{BODY}</table>",
    f"<html><head><meta charset=x><title>t</title><body><p>{BODY}",
    f"<head><meta charset=x>{BODY}",
    f"<svg width='1' /><p>{BODY}</p><math/>",
    f"<svg/><p>{BODY}</p><svg><text>no</text></svg>",
]


@pytest.mark.parametrize("page", WHOLE)
def test_main_text_is_whole(page):
    assert htmltext.main_text(page, WEIGHTS) == LONG


def test_deep_containers_are_linear():
    assert htmltext.main_text("<div class=ad>" * 50_000 + BODY, WEIGHTS) == LONG
    assert htmltext.main_text("<ul><li class=ad>" * 20_000 + "</div><li></p>" * 20_000 + BODY, WEIGHTS) is not None


def test_best_region():
    rng = random.Random(2)
    for _ in range(200):
        s = [float(rng.randint(-3, 3)) for _ in range(rng.randint(1, 12))]
        lo, hi = htmltext.best_region(s)
        assert sum(s[lo:hi]) == max(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))


def test_html_table(spark, frame, sf_dir):
    rows = [(1, "u", f"<nav>x</nav><article><p>{BODY}</p></article>", "e"), (2, None, None, None), (2, None, None, None)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.op4(frame(PAGE, rows)).collect())
    assert got == [(1, BODY.strip(), len(BODY.strip())), (2, "", 0), (2, "", 0)]
    assert htmltext.op4(frame(PAGE, [])).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.op4(pages).collect():
        inner = html[r.page_id]
        inner = inner[inner.index("<article>") : inner.rindex("</article>")]
        import html as entities
        import re

        assert r.text.split() == entities.unescape(re.sub(r"<(/?p|h1|/h1|br)>", " ", inner).replace("<b>", "").replace("<article>", "")).split()


def test_long_broken_markup():
    assert htmltext.main_text("<p " * 20_000 + "x", WEIGHTS) is not None
    assert htmltext.main_text("<div>" * 50_000 + BODY, WEIGHTS) == BODY.strip()


TEXT = "one two three four five six seven eight nine ten eleven twelve. " * 2
LEARNED = f"<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class=ad>buy this one now please today</div><article><h1>A title</h1><p>{TEXT}</p><p>{TEXT}</p></article><footer>Example Inc.</footer>"
UNMARKED = {
    # class names in running text of the article say what it is about, not what it is
    "<article>" + "".join(f"<p class='{c}'>{c} {TEXT}</p>" for c in ("related-work", "share-price", "form-factor", "banner-story", "popup", "article-alert")) + "</article>":
        [f"{c} {TEXT}" for c in ("related-work", "share-price", "form-factor", "banner-story", "popup", "article-alert")],
    f"<article><p>{TEXT}</p></article><div>" + "<a>link to a page</a> " * 20 + f"</div><article><p>two {TEXT}</p></article>": [TEXT, f"two {TEXT}"],
    f"<div><a>Home</a> <a>News</a> <a>About us</a></div><h1>Title</h1><div>{TEXT}</div><div>{TEXT}</div><div>Copyright 2024 Example Inc.</div>": ["Title", TEXT, TEXT],
    f"<div class=top><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div>{TEXT}</div><div>{TEXT}</div><div>© 2024 Example</div>": [TEXT, TEXT],
    f"<div>{TEXT}<a>link</a></div><ul><li>point one of it</li><li>point two of it</li></ul>": [f"{TEXT}link", "point one of it", "point two of it"],
    f"<p>{TEXT}</p><p>See <a>this</a>.</p>": [TEXT, "See this."],
    f"<div class='site-footer'>x</div><div class='cookie-notice'>y</div><div class='comments-area'><p>z</p></div><p>{TEXT}</p>": [TEXT],
    # a short part behind a long list of links counts by its own words, however long the best part is
    f"<p>{TEXT * 12}</p><ul>" + "<li><a>link to page</a></li>" * 30 + f"</ul><p>{TEXT}{TEXT}</p>": [TEXT * 12, TEXT * 2],
}


@pytest.mark.parametrize("page", UNMARKED)
def test_main_text_of_unmarked_pages(page):
    weights = htmltext.learn([LEARNED] * 50)
    assert htmltext.main_text(page, weights) == "\n\n".join(" ".join(x.split()) for x in UNMARKED[page])


def test_regions():
    rng = random.Random(5)
    for _ in range(300):
        s = [float(rng.randint(-3, 3)) for _ in range(rng.randint(1, 14))]
        want, spans = [], [(0, len(s))]
        while spans:  # the best run of least length, then those on both its sides
            a, b = spans.pop()
            best = max(((sum(s[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                want.append((best[0], i, j))
                spans += [(a, i), (j, b)]
        assert sorted(x for x, _, _ in htmltext.regions(s)) == sorted(x for x, _, _ in want)


BROKEN = ["<script " + '"' * 10**6, "<script " * 10**5, "<a " * 10**5, "<a '>' " * 10**5, "<!--" * 10**5, "<script>" * 10**5, "<a href='x>" * 10**5, "<svg/ " * 10**5, "</script" * 10**5]


@pytest.mark.parametrize("page", BROKEN, ids=lambda p: p[:9])
def test_broken_markup_is_linear(page):
    import time

    began = time.process_time()
    htmltext.main_text(page, WEIGHTS)
    assert time.process_time() - began < 1


# --- media ------------------------------------------------------------------------


def test_media(frame):
    texts = {1: "hello", 2: None, 3: "", 4: "é" * 32, 5: "x" * 64, 6: "y" * 65, 7: "long " * 20_000, 8: "hello", 9: "\x00"}
    got = {r.doc_id: r for r in media.op10(frame(DOC, [(k, t, "s", "e") for k, t in texts.items()])).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(pay)).hexdigest() and r.media_bytes == len(pay) + 44
        assert media.from_wav(media.to_wav(pay)) == pay
    assert got[1].feature == got[8].feature != got[5].feature
    assert media.op10(frame(DOC, [])).count() == 0


def test_landmarks_find_tones():
    n = np.arange(64 * 200)
    tone = lambda f: (127 + 100 * np.sin(2 * np.pi * f * n / 128)).astype(np.uint8)
    x = np.concatenate([tone(10), tone(30)])
    at, code, peaks = media.landmark_pairs(x)
    assert peaks > 0 and (np.diff(at) >= 0).all() and len(at) == len(code)
    f = set((code >> 16).tolist()) | set((code >> 8 & 255).tolist())
    assert f & {9, 10, 11} and f & {29, 30, 31}


def test_landmarks_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (64, 128, 192, 64 * 40):
        x = rng.integers(0, 256, n).astype(np.uint8)
        wave = [float(v) - 128 for v in x] + [float(x[-1]) - 128] * max(0, media.FRAME - n)
        loudest = []
        for at in range(0, len(wave) - media.FRAME + 1, media.HOP):
            part = np.array(wave[at : at + media.FRAME])
            part = (part - part.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1)))
            size = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME))) for k in range(media.FRAME // 2 + 1)]
            loudest.append([max((size[k], -k) for k in range(lo, hi)) for lo, hi in media.BANDS])
        peaks = []
        for t, bands in enumerate(loudest):
            for b, (size, k) in enumerate(bands):
                before = [loudest[u][b][0] for u in range(max(0, t - media.NEAR), t)]
                after = [loudest[u][b][0] for u in range(t + 1, min(len(loudest), t + media.NEAR + 1))]
                if size > 1e-3 and all(size >= v for v in before) and all(size > v for v in after):
                    peaks.append((t, -k))
        pairs = [(t, f << 16 | g << 8 | u - t) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 1 + media.FAN] if u - t <= media.REACH]
        at, code, count = media.landmark_pairs(x)
        assert count == len(peaks) and sorted(zip(at.tolist(), code.tolist())) == sorted(pairs)


def test_media_names_rows_and_slices(frame, monkeypatch):
    schema = "doc_id long, text string, given_text string, __text string, given_media string, n_bytes string, Feature string"
    rows = [(None, "a" * 100, "p", "q", "r", "s", "t"), (1, "b", None, None, None, None, None), (1, "b", None, None, None, None, None), (2, "long " * 10_000, "p", "q", "r", "s", "t")]
    want = None
    for most in (media.AT_ONCE, 1):
        monkeypatch.setattr(media, "AT_ONCE", most)
        kept = media.landmarks(media.store_wav(frame(schema, rows)), arrays=False)
        assert kept.columns[:4] == ["doc_id", "given_text", "__text", "given_media"]
        got = sorted(map(str, kept.collect()))
        assert len(got) == 4 and (want is None or got == want)
        want = got
    r = {x.doc_id: x for x in kept.collect()}
    assert (r[None].given_text, r[None].given_media, r[None].n_bytes, r[2].n_bytes) == ("p", "r", 100, 50_000)


def test_media_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * n if n is not None else None for n in (3, 9, None, 2, 2, 0, 30, 1)]})
    media_at, media.AT_ONCE = media.AT_ONCE, 5
    try:
        parts = [p.column(0).to_pylist() for p in media._slices(batch, "t")]
    finally:
        media.AT_ONCE = media_at
    assert sum(parts, []) == batch.column(0).to_pylist() and [len(p) for p in parts] == [1, 1, 4, 1, 1]


def test_fingerprint_arrays(frame):
    df = media.store_wav(frame("doc_id long, text string, media string", [(1, "some text " * 100, "clash")]))
    r = media.landmarks(df).first()
    assert len(r.pair_time) == len(r.pair_code) and r.payload_bytes % 64 == 0
