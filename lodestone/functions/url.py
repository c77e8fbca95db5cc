"""URL functions: normalisation, identity, origin and admission.

URLs are taken apart by the regular expression of RFC 3986, appendix B, in
native expressions; only the classification of IP literals needs Python
(`classify_ip`), in pandas UDFs.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Query keys that only track. Fixed values.
TRACKING = ("fbclid", "gclid", "dclid", "mc_cid", "mc_eid", "msclkid", "igshid")
#: Host names that are never fetched. Fixed values.
RESERVED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal")
RESERVED_SUFFIXES = (".localhost", ".local")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host without port, brackets and trailing dots."""
    h = F.regexp_replace(_host_port(url), r":[0-9]*$", "")
    return F.rtrim(F.lower(F.regexp_replace(h, r"^\[(.*)\]$", "$1")), F.lit("."))


def port(url: Column) -> Column:
    """The explicit port, or null."""
    return F.nullif(F.regexp_extract(_host_port(url), r":([0-9]+)$", 1), F.lit("")).cast("int")


def effective_port(url: Column) -> Column:
    default = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    return F.coalesce(port(url), default)


def has_credentials(url: Column) -> Column:
    return F.contains(_part(url, 2), F.lit("@")) & (F.regexp_extract(_part(url, 2), r"^(.*)@", 1) != "") & (F.regexp_extract(_part(url, 2), r"^(.*)@", 1) != ":")


def _decoded(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(plus), plus)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, credentials, fragment or
    tracking parameters, sorted parameters, path at least `/`."""
    h, p, s = host(url), port(url), scheme(url)
    h = F.when(F.contains(h, F.lit(":")), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h)
    default = ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))
    place = F.when(p.isNull() | default, h).otherwise(F.concat(h, F.lit(":"), p.cast("string")))
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda x: x != "")
    pairs = F.transform(
        pairs,
        lambda x: F.struct(_decoded(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v")),
    )
    pairs = F.filter(pairs, lambda x: ~F.startswith(F.lower(x.k), F.lit("utm_")) & ~F.lower(x.k).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(_encoded(x.k), F.lit("="), _encoded(x.v))), "&")
    path = F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))
    mark = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.concat(s, F.lit("://"), place, path, mark)


def document_id(url: Column, canonical: Column | None = None) -> Column:
    """SHA-256 of the normalised identity: the canonical URL where that has the same host, else the URL."""
    identity = url if canonical is None else F.when(host(canonical) == host(url), canonical).otherwise(url)
    return F.sha2(normalize(identity), 256)


def origin(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), host(url).alias("host"), effective_port(url).alias("port"))


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments, each `..` with the segment before it."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.filter(parts, lambda x, i: (i > 0) & (x != ".")),
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))),
    )
    open_end = F.regexp_like(path, F.lit(r"/\.\.?$"))
    found = F.concat(F.lit("/"), F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(?:/|$)")), found).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """A link against its page: absolute, `//host`, `/path`, `?query`, `#fragment`
    and relative paths, dot segments removed."""
    path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    link_path, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, without_dots(link_path), tail))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when((link == "") | F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(F.concat(root, without_dots(F.concat(F.regexp_extract(path, r"^(.*/)", 1), link_path)), tail))
    )


def valid_port(url: Column) -> Column:
    """Whether the port, if one is written, is a number from 1 to 65535."""
    place = F.regexp_replace(_part(url, 2), r"^.*@", "")
    written = F.regexp_extract(F.regexp_replace(place, r"^\[[^\]]*\]", ""), r":(.*)$", 1)
    return (written == "") | (F.regexp_like(written, F.lit(r"^[0-9]{1,5}$")) & F.coalesce(written.try_cast("int").between(1, 65535), F.lit(False)))


def looks_like_ip(h: Column) -> Column:
    return F.regexp_like(h, F.lit(r"^(?:[0-9]+(?:\.[0-9]+){3}|[0-9a-f:.]*:[0-9a-f:.]*)$"))


#: Ranges that the stricter policy refuses besides. Fixed values.
STRICT = ("100.64.0.0/10", "fc00::/7")


def classify_ip(value: str | None, strict: bool = False) -> bool | None:
    """Whether an IP literal must not be fetched; None if it is none."""
    try:
        ip = ipaddress.ip_address(value or "")
    except ValueError:
        return None
    if strict:
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if any(ip in ipaddress.ip_network(n) for n in STRICT):
            return True
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(T.BooleanType())
def forbidden_ip(h: pd.Series) -> pd.Series:
    return h.map(classify_ip)


@F.pandas_udf(T.BooleanType())
def forbidden_ip_strict(h: pd.Series) -> pd.Series:
    return h.map(lambda x: classify_ip(x, strict=True))


def refusal(url: Column) -> Column:
    """Why the static checks refuse a URL, or null; IP literals aside."""
    h = host(url)
    suffix = F.lit(False)
    for s in RESERVED_SUFFIXES:
        suffix = suffix | F.endswith(h, F.lit(s))
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(has_credentials(url), "credentials")
        .when(h == "", "no host")
        .when(h.isin(*RESERVED_HOSTS), "reserved host")
        .when(suffix, "reserved suffix")
    )


def is_dns_host(h: Column) -> Column:
    """A host name of labels of at most 63 characters, 253 in all, and no IP literal."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.regexp_like(h, F.lit(rf"^{label}(?:\.{label})+$")) & (F.length(h) <= 253) & ~looks_like_ip(h)
