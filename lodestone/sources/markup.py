"""HTML to title, markdown and text; selectors; links. The parser is the
standard library's; the functions run in pandas UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U

MOST_CHARACTERS = 6_000_000  # of a page that is extracted
MOST_BYTES = 5_000_000  # of a page that is fetched
DROPPED = frozenset("script style noscript template svg canvas form iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p div section article main blockquote figure figcaption header footer nav aside table tr ul ol dl dt dd address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MOST_SELECTORS, LONGEST_SELECTOR = 32, 512

EXTRACTED = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "markdown", "text", "canonical", "error")])
EXTRACTED_BY = T.StructType([*EXTRACTED.fields, T.StructField("extractor", T.StringType())])


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This element and those below it, in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":  # a paragraph ends the one before
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_STEP = re.compile(r"(?P<tag>\*|[a-zA-Z][\w-]*)?(?P<rest>(?:\.[\w-]+|#[\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*)$")
_PIECE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([\w-]+)))?\]")


class BadSelector(ValueError):
    pass


def compile_selector(selector: str):
    """A test of nodes for tags, classes, ids, attributes and descendants."""
    steps = []
    for part in selector.split():
        m = _STEP.match(part)
        if not m or not part:
            raise BadSelector(selector)
        wants = [(c, i, a, next((v for v in vs if v), None)) for c, i, a, *vs in _PIECE.findall(m["rest"])]
        steps.append((m["tag"] if m["tag"] != "*" else None, wants))
    if not steps:
        raise BadSelector(selector)

    def one(node: Node, tag, wants) -> bool:
        if node.tag.startswith("#") or tag and node.tag != tag.lower():
            return False
        for c, i, a, v in wants:
            if c and c not in node.attrs.get("class", "").split() or i and node.attrs.get("id") != i:
                return False
            if a and (a not in node.attrs or v is not None and node.attrs[a] != v):
                return False
        return True

    def test(node: Node) -> bool:
        if not one(node, *steps[-1]):
            return False
        above, left = node.parent, len(steps) - 2
        while left >= 0 and above is not None:
            left -= one(above, *steps[left])
            above = above.parent
        return left < 0

    return test


def usable_selectors(selectors) -> list[str]:
    """The trimmed selectors, or none at all if one of them can't be."""
    if not isinstance(selectors, list) or len(selectors) > MOST_SELECTORS:
        return []
    out = [s.strip() for s in selectors if isinstance(s, str)]
    return out if len(out) == len(selectors) and all(0 < len(s) <= LONGEST_SELECTOR for s in out) else []


def detach(nodes) -> None:
    """Takes elements out of the tree, with one pass over each parent's children."""
    doomed = set(nodes)
    for parent in {n.parent for n in doomed if n.parent}:
        parent.children = [c for c in parent.children if not (isinstance(c, Node) and c in doomed)]


def remove(root: Node, selectors) -> None:
    """Takes out what matches any selector; a bad selector leaves all as it is."""
    try:
        tests = [compile_selector(s) for s in usable_selectors(selectors)]
    except BadSelector:
        return
    detach(n for n in root.walk() if any(t(n) for t in tests))


DEEPEST = 100  # levels of markup that are told apart; below, text is text


def _inline(node: Node | str, depth: int = 0) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if depth > DEEPEST:
        return re.sub(r"\s+", " ", node.text())
    inner = "".join(_inline(c, depth + 1) for c in node.children)
    if node.tag == "br":
        return "\n"
    if node.tag in ("b", "strong") and inner.strip():
        return f"**{inner.strip()}**"
    if node.tag in ("em", "i") and inner.strip():
        return f"_{inner.strip()}_"
    if node.tag == "code":
        return f"`{inner}`"
    if node.tag == "a" and node.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({node.attrs['href']})"
    return inner


def _blocks(node: Node, out: list[str], depth: int = 0) -> None:
    row = ""

    def end():
        nonlocal row
        if text := "\n".join(x.strip() for x in row.split("\n")).strip():
            out.append(text)
        row = ""

    for c in node.children:
        tag = "" if isinstance(c, str) else c.tag
        if re.fullmatch(r"h[1-6]", tag):
            end()
            if text := " ".join(_inline(c).split()):
                out.append(f"{'#' * int(tag[1])} {text}")
        elif tag == "pre":
            end()
            out.append(f"```\n{c.text().strip(chr(10))}\n```")
        elif tag in ("ul", "ol"):
            end()
            items = []
            for li in (x for x in c.children if isinstance(x, Node)):
                inner: list[str] = []
                _blocks(li, inner, depth + 1)
                items.append("- " + "\n".join(inner).replace("\n", "\n  "))
            if items:
                out.append("\n".join(items))
        elif not isinstance(c, str) and depth < DEEPEST and (tag in PARAGRAPHS or any(isinstance(x, Node) and (x.tag in PARAGRAPHS or x.tag == "ul" or re.fullmatch(r"h[1-6]", x.tag)) for x in c.walk() if x is not c)):
            end()
            _blocks(c, out, depth + 1)
        else:
            row += _inline(c)
    end()


def clean(markdown: str) -> str:
    """As `functions.text.clean_markdown`."""
    t = re.sub(r"[ \t]+\n", "\n", markdown.replace("\xa0", " "))
    return re.sub(r"\n{4,}", "\n\n\n", t).strip()


EMPTY = {"title": "", "markdown": "", "text": "", "canonical": None, "error": None}


def _read(html: str | None, selectors) -> tuple[Node | None, dict]:
    """The page's tree without what selectors name or no reader sees, and its title and canonical link, or why there are none."""
    if not html or len(html) > MOST_CHARACTERS:
        return None, EMPTY | {"error": "HTML is empty or too large"}
    try:
        root = parse(html)
    except Exception as e:  # one page's failure is its own row's
        return None, EMPTY | {"error": str(e)}
    titles = [n for n in root.walk() if n.tag == "title"]
    title = " ".join(titles[0].text().split()) if titles else ""
    canonical = next((n.attrs["href"] for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), None)
    remove(root, selectors or [])
    detach(n for n in root.walk() if n.tag in DROPPED or n.tag == "head")
    return root, EMPTY | {"title": title, "canonical": canonical}


def _content(node: Node) -> dict:
    out: list[str] = []
    _blocks(node, out)
    return {"markdown": clean("\n\n".join(out)), "text": node.text().strip()}


def extract(html: str | None, selectors=None) -> dict:
    """Title, markdown, text and canonical link of a page; `error` says why there are none."""
    root, page = _read(html, selectors)
    if root is None:
        return page
    found = next((n for tag in ("article", "main") for n in root.walk() if n.tag == tag), None)
    if found is None:
        remove(root, ["nav", "footer", "aside", "header"])
    return page | _content(found or root)


class Density(NamedTuple):
    characters: int  # that are no white space
    linked: int  # those of them in links
    tags: int

    @property
    def value(self) -> float:
        return (self.characters - self.linked) / max(self.tags, 1)


def densities(root: Node) -> dict[Node, Density]:
    """Of every element, all that is below it counted."""
    found: dict[Node, Density] = {}
    for n in reversed(list(root.walk())):  # children before parents
        below = [found[c] for c in n.children if isinstance(c, Node)]
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        characters = own + sum(d.characters for d in below)
        linked = characters if n.tag == "a" else sum(d.linked for d in below)
        found[n] = Density(characters, linked, sum(d.tags + 1 for d in below))
    return found


def densest(root: Node, found: dict[Node, Density]) -> Node:
    """The element whose child blocks' densities have the largest sum, the first of several; the root where there are no blocks.
    Text density over the element tree, as published for content extraction."""
    total = {n: sum(found[c].value for c in n.children if isinstance(c, Node) and c.tag in PARAGRAPHS | HEADINGS) for n in found}
    best = max(total.values(), default=0.0)
    if best <= 0:  # no blocks: the text stands in the root
        return root
    return next(n for n in root.walk() if total[n] == best)


def extract_dense(html: str | None, selectors=None) -> dict:
    """As `extract`, by another rule, which reads no element's name as a mark of content: the densest element, less those blocks
    of it that are links by more than half. It prefers precision: of several bodies it takes one."""
    root, page = _read(html, selectors)
    if root is None:
        return page
    found = densities(root)
    part = densest(root, found)
    detach(n for n in part.walk() if n is not part and n.tag in PARAGRAPHS and 2 * found[n].linked > found[n].characters)
    return page | _content(part)


def extract_any(html: str | None, selectors=None) -> dict:
    """`extract`, or where that finds no text, `extract_dense`; `extractor` names the one whose text it is, null if neither has any."""
    for name, f in (("article", extract), ("density", extract_dense)):
        page = f(html, selectors)
        if page["markdown"] or page["error"]:
            break
    return page | {"extractor": name if page["markdown"] else None}


@F.pandas_udf(EXTRACTED)
def extract_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h) for h in html], columns=EXTRACTED.names)


@F.pandas_udf(EXTRACTED_BY)
def extract_any_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_any(h) for h in html], columns=EXTRACTED_BY.names)


@F.pandas_udf(EXTRACTED)
def extract_with_rules(html: pd.Series, selectors: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h, None if s is None else list(s)) for h, s in zip(html, selectors)], columns=EXTRACTED.names)


def with_fallback(first: Column, second: Column) -> Column:
    """Markdown of the first extractor that has some."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), second)


# --- native scans ---------------------------------------------------------------

#: A link's whole tag: runs that are never given back, and that end at the next tag's beginning, so that neither long attributes
#: nor tags and quotes without an end cost more than one pass.
ANCHOR = r"""(?is)<a(?=[\s/])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
#: Its attributes one after the other, the value quoted either way or bare.
ATTRIBUTE = r"""(?is)([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def page_title(html: Column) -> Column:
    """The first title's text, white space collapsed (references as they stand)."""
    from ..functions.text import collapse

    return collapse(F.regexp_extract(html, TITLE, 1))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link, position): links of each page, absolute, http(s) only,
    normalised, each once at its first position."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))).alias("at", "tag"))
    part = lambda group: F.regexp_extract_all(F.expr("substring(tag, 3)"), F.lit(ATTRIBUTE), F.lit(group))
    place = F.array_position(F.transform(part(1), F.lower), F.lit("href"))  # the first one counts
    found = found.withColumn("raw", F.get(part(2), (place - 1).cast("int"))).filter("raw <> ''")
    href = F.regexp_replace("raw", r"""^["']|["']$""", "")
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(name), F.lit(char))
    found = found.select("url", "at", href.alias("href"))
    full = found.withColumn("full", U.resolve(F.col("url"), F.trim(F.col("href"))))
    kept = full.filter(U.scheme(F.col("full")).isin("http", "https") & (U.host(F.col("full")) != ""))
    links = kept.select("url", U.normalize(F.col("full")).alias("link"), "at")
    return links.groupBy("url", "link").agg(F.min("at").alias("position"))


def same_origin(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links whose scheme, host and effective port are those of a seed."""
    from ..operators.joins import small

    o = U.origin(F.col("url"))
    allowed = seeds.select(*(o[c].alias(c) for c in ("scheme", "host", "port"))).distinct()
    p = U.origin(F.col("link"))
    placed = links.select("*", *(p[c].alias(c) for c in ("scheme", "host", "port")))
    return placed.join(small(allowed), ["scheme", "host", "port"], "left_semi").select(*links.columns)


def acceptable_type(content_type: Column) -> Column:
    """Whether a Content-Type is one that is parsed, parameters aside."""
    return F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0])).isin("text/html", "application/xhtml+xml")


def within_size(html: Column, declared: Column | None = None, cap: int = MOST_BYTES) -> Column:
    ok = F.octet_length(html) <= cap
    return ok if declared is None else ok & (F.coalesce(declared, F.lit(0)) <= cap)
