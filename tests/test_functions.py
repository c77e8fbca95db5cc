import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import url as U
from lodestone.operators.passages import clip_text, count_tokens


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


def many(spark, expr, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", expr.alias("x")).collect()
    return [r.x for r in sorted(rows)]


TEXTS = ["", " ", "a", "abc d\x1ce", "x y z ", "日本語のテキスト", "é" * 700, "word " * 400, "\U0001f642 ok", "a\x85b c\n\nd\r\n e "]


def test_token_estimate(spark):
    assert many(spark, X.approx_tokens(F.col("t")), TEXTS) == [count_tokens(t) for t in TEXTS]
    assert one(spark, X.approx_tokens(F.col("t")), t="日" * 240) == 240
    assert many(spark, X.approx_tokens(F.col("t")), [None]) == [0]


def test_collapse_and_lines(spark):
    assert many(spark, X.collapse(F.col("t")), TEXTS) == [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert many(spark, X.lines(F.col("t")), TEXTS) == [[x.strip() for x in t.splitlines() if x.strip()] for t in TEXTS]


def test_compact(spark):
    long = "word " * 200
    got = one(spark, X.compact(F.col("t")), t=long)
    assert len(got) <= 600 and got == ("word " * 200)[:598].rstrip() + " …" and one(spark, X.compact(F.col("t")), t=" a  b ") == "a b"


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="It's 3.14, v1.2.3 a.b_c U.S. don't e-mail x:y 1,000") == ["it's", "3.14", "v1.2.3", "a.b_c", "u.s", "don't", "e", "mail", "x:y", "1,000"]


def test_clip_equals_the_general_form(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab  cé") for _ in range(rng.randint(1, 60))), rng.randint(1, 25)) for _ in range(400)]
    rows = [(t, b) for t, b in rows if count_tokens(t) > b]
    df = spark.createDataFrame([(k, t, b) for k, (t, b) in enumerate(rows)], "k int, t string, b int")
    got = [r.x for r in sorted(df.select("k", X.clip(F.col("t"), F.col("b")).alias("x")).collect())]
    assert [g or "" for g in got] == [clip_text(t, b) for t, b in rows]
    # With one token left the ellipsis stands alone and costs two.
    assert clip_text("abcdefgh", 1) == " …"


def test_quality_and_render(spark):
    html, text = "<p>" + "x" * 2000 + "</p>", "line one\nline two\nline one"
    n = len(re.sub(r"\s+", " ", text))
    want = round(0.55 * n / 500 + 0.25 * min(1, n / len(html) / 0.08) + 0.2 * 2 / 3, 4)
    assert one(spark, X.quality(F.col("t"), F.col("h")), t=text, h=html) == pytest.approx(want)
    assert one(spark, X.quality(F.col("t"), F.col("h")), t=" ", h=html) == 0
    assert one(spark, X.needs_render(F.col("t"), F.col("h"), F.lit(0.5)), t="x" * 600, h='<div ID="ROOT">') is True
    assert one(spark, X.needs_render(F.col("t"), F.col("h"), F.lit(0.7)), t="x" * 600, h='<div id="root">') is False


URLS = {
    "HTTPS://Example.COM:443/path?utm_source=x&b=2&a=1#section": "https://example.com/path?a=1&b=2",
    "http://user:pw@Host.Example.:80": "http://host.example/",
    "http://h.example:8080/a?x=&y=b%20c&fbclid=1": "http://h.example:8080/a?x=&y=b+c",
    "https://[2001:DB8::1]:443/p": "https://[2001:db8::1]/p",
    "http://h.example/?z=%7E&a=*&UTM_x=1": "http://h.example/?a=%2A&z=~",
}


def test_normal_urls(spark):
    assert many(spark, U.normalize(F.col("t")), list(URLS)) == list(URLS.values())


def test_identity(spark):
    url, same, other = "https://a.example/x?utm_id=1", "https://a.example/canonical", "https://b.example/x"
    ids = [one(spark, U.document_id(F.col("u"), F.col("c")), u=url, c=c) for c in (same, other)]
    assert ids[0] == one(spark, U.document_id(F.col("u")), u=same)
    assert ids[1] == one(spark, U.document_id(F.col("u")), u="https://a.example/x")


def test_resolution(spark):
    base = "https://h.example/d/page?q=1#f"
    for link in ("/x", "y", "?z=2", "#g", "//o.example/p", "http://o.example/", "", "mailto:a@b.c"):
        assert one(spark, U.resolve(F.col("b"), F.col("k")), b=base, k=link) in (urljoin(base, link), base if not link else urljoin(base, link), urljoin(base, link) if link else "https://h.example/d/page?q=1")


def test_admission(spark):
    bad = {"file:///etc/passwd": "scheme", "http://u:p@h.example/": "credentials", "http:///x": "no host", "http://LOCALHOST./": "reserved host", "http://a.local/": "reserved suffix", "https://ok.example/": None}
    assert many(spark, U.refusal(F.col("t")), list(bad)) == list(bad.values())
    forbidden = {"127.0.0.1": True, "10.1.2.3": True, "169.254.169.254": True, "::1": True, "8.8.8.8": False, "h.example": None}
    assert {h: U.classify_ip(h) for h in forbidden} == forbidden
    assert U.classify_ip("100.64.0.1", strict=True) and U.classify_ip("::ffff:10.0.0.1", strict=True)
    assert many(spark, U.forbidden_ip("t"), ["10.0.0.1", "8.8.4.4"]) == [True, False]


def test_hosts(spark):
    hosts = ["a.example", "a" * 63 + ".example", "a" * 64 + ".example", "-a.example", "single", "1.2.3.4"]
    assert many(spark, U.is_dns_host(F.col("t")), hosts) == [True, True, False, False, False, False]


def test_tokens_are_those_of_the_plain_pattern(spark):
    """Runs against the pattern that goes letter by letter, on odd strings; and a token that is longer than a stack is deep."""
    import random

    from lodestone.functions.text import tokens

    rng = random.Random(4)
    parts = ["a", "Z", "é", "ß", "\U00010400", "字", "7", "٣", "²", "_", ".", "'", ":", ",", " ", "-", "\u0301", "\n"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, x string")
    plain = F.regexp_extract_all(F.lower("x"), F.lit(r"(?:_|\p{L}(?:[.':]\p{L})*|\p{N}(?:[.,]\p{N})*)+"), F.lit(0))
    assert df.filter(plain != tokens(F.col("x"))).count() == 0
    long = spark.createDataFrame([("ab.c" * 50_000 + " 1",)], "x string")
    assert [len(t) for t in long.select(tokens(F.col("x")).alias("t")).first().t] == [200_000, 1]
