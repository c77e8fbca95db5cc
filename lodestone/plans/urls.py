"""Page, URL and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import rules as L
from ..sources import markup as M
from .base import sql_collapse, table

SMALL_PAGE = 4096


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


def scan_pages(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", "url", F.octet_length("html").alias("n_bytes"), F.length("html").alias("n_chars"), U.scheme(F.col("url")).alias("scheme"), U.host(F.col("url")).alias("host"))


def normalize_url(spark, d):
    return _pages(spark, d).select("page_id", U.normalize(F.col("url")).alias("normal_url"))


def document_id(spark, d):
    """A canonical link of the same host for even pages, of another host for odd ones."""
    canonical = F.concat(U.scheme(F.col("url")), F.lit("://"), F.when(F.col("page_id") % 2 == 0, U.host(F.col("url"))).otherwise(F.lit("other.example")), F.lit("/c/"), F.col("page_id"))
    return _pages(spark, d).select("page_id", U.document_id(F.col("url"), canonical).alias("document_id"))


def page_title(spark, d):
    return _pages(spark, d).select("page_id", M.page_title(F.col("html")).alias("title"))


def page_links(spark, d):
    return M.page_links(_pages(spark, d))


def same_origin_links(spark, d):
    """Links whose origin is that of a page over https."""
    seeds = _pages(spark, d).filter(U.scheme(F.col("url")) == "https").select("url")
    return M.same_origin(M.page_links(_pages(spark, d)), seeds)


def _hostile():
    """Variants of a page's URL that admission must tell apart, by page id."""
    n, u = F.col("page_id") % 7, F.col("url")
    return (
        F.when(n == 1, F.concat(F.lit("ftp://"), U.host(u), F.lit("/a")))
        .when(n == 2, F.concat(F.lit("http://user:word@"), U.host(u), F.lit("/a")))
        .when(n == 3, F.lit("http://localhost:8080/a"))
        .when(n == 4, F.lit("https://printer.local/a"))
        .when(n == 5, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 200, F.lit("/a")))
        .when(n == 6, F.lit("http:///a"))
        .otherwise(u)
    )


def url_admission(spark, d):
    rows = _pages(spark, d).select("page_id", _hostile().alias("target"))
    rows = rows.withColumn("refusal", U.refusal(F.col("target"))).withColumn("host", U.host(F.col("target")))
    # Only what looks like an address goes to Python.
    literal = rows.filter("refusal IS NULL").filter(U.looks_like_ip(F.col("host"))).withColumn("refusal", F.when(U.forbidden_ip("host"), "address"))
    plain = rows.filter("refusal IS NOT NULL").union(rows.filter("refusal IS NULL").filter(~U.looks_like_ip(F.col("host"))))
    return literal.union(plain).select("page_id", "target", "refusal", F.col("refusal").isNull().alias("admitted"))


def valid_hosts(spark, d):
    h = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("-"), U.host(F.col("url")))).when(F.col("page_id") % 5 == 1, F.lit("127.0.0.1")).otherwise(U.host(F.col("url")))
    return _pages(spark, d).select("page_id", h.alias("host")).withColumn("valid", U.is_dns_host(F.col("host")))


def page_size_filter(spark, d):
    p = _pages(spark, d)
    return p.filter(M.within_size(F.col("html"))).select("page_id", F.octet_length("html").alias("n_bytes"), M.within_size(F.col("html"), cap=SMALL_PAGE).alias("small"))


def extract_text(spark, d):
    e = _pages(spark, d).select("page_id", M.extract_udf("html").alias("e"))
    return e.select("page_id", "e.title", "e.markdown", "e.text", "e.error", X.content_hash(F.col("e.markdown")).alias("content_hash"))


def extract_fallback(spark, d):
    """Even pages get an empty article before their own, so that the first extractor finds nothing there."""
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<article> </article>"), "html")).otherwise(F.col("html"))
    e = _pages(spark, d).select("page_id", M.extract_any_udf(html).alias("e"))
    return e.select("page_id", "e.extractor", "e.title", "e.markdown", "e.error", X.content_hash(F.col("e.markdown")).alias("content_hash"))


def _plain():
    return F.regexp_replace(F.col("html"), r"<[^>]*>", "\n")


def quality_score(spark, d):
    return _pages(spark, d).select("page_id", X.quality(_plain(), F.col("html")).alias("quality"))


def needs_render(spark, d):
    p = _pages(spark, d).withColumn("quality", X.quality(_plain(), F.col("html")))
    return p.select("page_id", X.needs_render(_plain(), F.col("html"), F.col("quality")).alias("needs_render"))


def _rules(spark, d):
    """A rule for each host with an odd number of characters."""
    hosts = _pages(spark, d).select(U.host(F.col("url")).alias("host")).distinct().filter(F.length("host") % 2 == 1)
    return hosts.select("host", F.array(F.lit(".ad")).alias("remove_selectors"), (F.length("host") % 3 == 0).alias("force_browser"))


def domain_rules(spark, d):
    found = L.with_rule(_pages(spark, d), _rules(spark, d))
    return found.select("page_id", "host", "matched", F.coalesce("force_browser", F.lit(False)).alias("force_browser"))


def marker_contract(spark, d):
    required, forbidden = F.array(F.lit("<article>"), F.lit("</footer>")), F.array(F.lit('"ad'), F.lit("token"))
    p = _pages(spark, d)
    return p.select("page_id", L.meets_contract(F.col("html"), required, forbidden).alias("passes"), F.size(L.missing_markers(F.col("html"), forbidden)).alias("absent"))


_P = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"


def _part(u: str, n: int) -> str:
    return f"regexp_extract(trim({u}), {_P}, {n})"


def _host(u: str) -> str:
    return f"rtrim(lower(regexp_replace(regexp_replace({_part(u, 2)}, '^.*@', ''), ':[0-9]*$', '')), '.')"


def _port(u: str) -> str:
    return f"nullif(regexp_extract(regexp_replace({_part(u, 2)}, '^.*@', ''), ':([0-9]+)$', 1), '')"


def _normal(u: str) -> str:
    s, h, p = f"lower({_part(u, 1)})", _host(u), _port(u)
    place = f"(CASE WHEN {p} IS NULL OR ({s} = 'http' AND {p} = '80') OR ({s} = 'https' AND {p} = '443') THEN {h} ELSE {h} || ':' || {p} END)"
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    encode = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(list_filter(string_split({_part(u, 4)}, '&'), lambda x: x <> ''), lambda x: {{'k': {decode("regexp_extract(x, '^([^=]*)', 1)")}, 'v': {decode("regexp_extract(x, '^[^=]*=(.*)$', 1)")}}})"
    kept = f"list_sort(list_filter({pairs}, lambda x: NOT starts_with(lower(x.k), 'utm_') AND lower(x.k) NOT IN ('fbclid', 'gclid', 'dclid', 'mc_cid', 'mc_eid', 'msclkid', 'igshid')))"
    query = f"coalesce(array_to_string(list_transform({kept}, lambda x: {encode('x.k')} || '=' || {encode('x.v')}), '&'), '')"
    return f"({s} || '://' || {place} || CASE WHEN {_part(u, 3)} = '' THEN '/' ELSE {_part(u, 3)} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


_CANON = f"(CASE WHEN page_id % 2 = 0 THEN lower({_part('url', 1)}) || '://' || {_host('url')} || '/c/' || page_id ELSE url END)"
_ROOT = f"{_part('url', 1)} || '://' || {_part('url', 2)}"
_PATH = f"(CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END)"
_RESOLVED = rf"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN {_part('url', 1)} || ':' || href
  WHEN starts_with(href, '/') THEN {_ROOT} || href WHEN starts_with(href, '?') THEN {_ROOT} || {_PATH} || href
  WHEN href = '' OR starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href ELSE {_ROOT} || regexp_extract({_PATH}, '^(.*/)', 1) || href END"""
_LINKS = rf"""
  h AS (SELECT url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS hs FROM pages),
  f AS (SELECT url, trim(hs[i]) AS href, i - 1 AS k FROM (SELECT url, hs, unnest(range(1, len(hs) + 1)) AS i FROM h)),
  g AS (SELECT url, {_RESOLVED} AS full_url, k FROM f),
  links AS (SELECT url, {_normal("full_url")} AS link, min(k)::INT AS position FROM g WHERE lower({_part("full_url", 1)}) IN ('http', 'https') AND {_host("full_url")} <> '' GROUP BY ALL)"""
_TEXT = "regexp_replace(html, '<[^>]*>', chr(10), 'g')"
_LINES = rf"list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"
_LEN = f"length({sql_collapse(_TEXT)})::DOUBLE"
_QUALITY = f"(CASE WHEN {_LEN} = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * least(1.0::DOUBLE, {_LEN} / 500) + 0.25::DOUBLE * least(1.0::DOUBLE, {_LEN} / greatest(length(html), 1) / 0.08::DOUBLE) + 0.20::DOUBLE * (len(list_distinct({_LINES}))::DOUBLE / greatest(len({_LINES}), 1)))), 4) END)"
_HOSTILE = f"""CASE page_id % 7 WHEN 1 THEN 'ftp://' || {_host("url")} || '/a' WHEN 2 THEN 'http://user:word@' || {_host("url")} || '/a' WHEN 3 THEN 'http://localhost:8080/a'
  WHEN 4 THEN 'https://printer.local/a' WHEN 5 THEN 'http://10.0.0.' || (page_id % 200) || '/a' WHEN 6 THEN 'http:///a' ELSE url END"""
_REFUSAL = "CASE page_id % 7 WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'reserved host' WHEN 4 THEN 'reserved suffix' WHEN 5 THEN 'address' WHEN 6 THEN 'no host' END"

QUERIES = {
    "scan_pages": (scan_pages, f"SELECT page_id, url, octet_length(encode(html))::INT AS n_bytes, length(html)::INT AS n_chars, lower({_part('url', 1)}) AS scheme, {_host('url')} AS host FROM pages"),
    "normalize_url": (normalize_url, f"SELECT page_id, {_normal('url')} AS normal_url FROM pages"),
    "document_id": (document_id, f"SELECT page_id, sha256({_normal(_CANON)}) AS document_id FROM pages"),
    "page_title": (page_title, f"SELECT page_id, {sql_collapse("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages"),
    "page_links": (page_links, f"WITH {_LINKS} SELECT url, link, position FROM links"),
    "same_origin_links": (
        same_origin_links,
        f"WITH {_LINKS}, o AS (SELECT DISTINCT {_host('url')} AS host, coalesce({_port('url')}, '443') AS port FROM pages WHERE lower({_part('url', 1)}) = 'https') SELECT url, link, position FROM links WHERE lower({_part('link', 1)}) = 'https' AND ({_host('link')}, coalesce({_port('link')}, '443')) IN (SELECT (host, port) FROM o)",
    ),
    "url_admission": (url_admission, f"SELECT page_id, {_HOSTILE} AS target, {_REFUSAL} AS refusal, {_REFUSAL} IS NULL AS admitted FROM pages"),
    "valid_hosts": (
        valid_hosts,
        f"SELECT page_id, host, page_id % 5 > 1 AND length(host) <= 253 AND regexp_matches(host, '^[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)+$') AS valid FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '-' || {_host('url')} WHEN 1 THEN '127.0.0.1' ELSE {_host('url')} END AS host FROM pages)",
    ),
    "page_size_filter": (page_size_filter, f"SELECT page_id, octet_length(encode(html))::INT AS n_bytes, octet_length(encode(html)) <= {SMALL_PAGE} AS small FROM pages WHERE octet_length(encode(html)) <= 5000000"),
    "extract_text": (extract_text, None),
    "extract_fallback": (extract_fallback, None),
    "quality_score": (quality_score, f"SELECT page_id, {_QUALITY} AS quality FROM pages"),
    "needs_render": (
        needs_render,
        rf"SELECT page_id, length(regexp_replace(regexp_replace({_TEXT}, '^\s+', ''), '\s+$', '')) < 500 OR {_QUALITY} < 0.35 OR ({_QUALITY} < 0.6 AND (contains(lower(html), 'id=""__next""') OR contains(lower(html), 'id=""root""') OR contains(lower(html), 'ng-version=') OR contains(lower(html), 'data-reactroot'))) AS needs_render FROM pages".replace('""', '"'),
    ),
    "domain_rules": (
        domain_rules,
        f"SELECT page_id, host, length(host) % 2 = 1 AS matched, length(host) % 2 = 1 AND length(host) % 3 = 0 AS force_browser FROM (SELECT page_id, {_host('url')} AS host FROM pages)",
    ),
    "marker_contract": (
        marker_contract,
        """SELECT page_id, contains(t, '<article>') AND contains(t, '</footer>') AND NOT (contains(t, '"ad') OR contains(t, 'token')) AS passes, (NOT contains(t, '"ad'))::INT + (NOT contains(t, 'token'))::INT AS absent
FROM (SELECT page_id, replace(html, '\\_', '_') AS t FROM pages)""",
    ),
}
