"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of blocks of words and tags. Words score positive, by the
class of their block (paragraph, heading, item, links, a few words, more), and
tags negative; the weights are log odds of standing inside rather than outside
the main content, counted on labelled pages: those with one `article` or `main`
element, whose own tags neither count nor score. A linear scan finds the
contiguous regions of maximal sum; the best and those worth a paragraph of LEAST
words are the text, cut at block ends. Where most of their words stand in `article` elements, or in
`main`, they are rounded to these elements as a whole. What HTML itself sets
apart (menus, forms, scripts, hidden parts and so on), and containers whose class,
id or role names a menu, an advert, a notice or comments, score with a tag's weight
alone and are left out of the text, unless the main content stands in them (`containers`).

Defined results: a null or empty html gives an empty text, as does a page
without words; time is linear for any input, broken markup and very long pages
included; ties go to the longest, then the first region. Repeated rows are
extracted each; null and repeated ids are kept. An empty table gives an empty
one. Without labelled pages fixed weights hold. Extra columns are kept by
`extract`, those named like its outputs replaced.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of

LABELLED_PAGES = 1200  # at most so many pages are looked at for labels

#: No word or tag weighs more than so many times log 2: an advert between two paragraphs
#: must not cut a short first one off, nor paragraphs all that is none.
LARGEST = 3 * math.log(2.0)

FEW = 12  # words of a block that is no paragraph: fewer are a line of the layout, if anything
LEAST = 2 * FEW  # words of a paragraph: a region that is worth as many is text too, however good the best one is

#: Elements whose content is no text of the page. Fixed values of HTML.
RAW = "script|style|noscript|template|svg|canvas|iframe|object|textarea|select|title|math|audio|video"
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW.split("|")}
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What ends a tag, or begins a value in which that doesn't.
STOP = re.compile(r">|=\s*+[\"']")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody"
    " tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that are never main text, by element and by words of class, id or role.
LEFT_OUT = frozenset("nav footer aside form head menu dialog button".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar"
    " footer masthead comment comments disqus replies notice notices cookie cookies consent gdpr banner breadcrumb breadcrumbs"
    " share sharing social related recommended newsletter subscribe subscription signup popup modal pagination pager widget"
    " toolbar complementary contentinfo form alert".split()
)
#: What the other parts of such a name may be, as in ad-slot or site-footer.
LAYOUT_NAMES = frozenset(
    "site page global main primary secondary top bottom left right center middle user reader container wrapper wrap box slot section"
    " area block bar panel list item items inner outer unit row col column group holder links buttons button posts articles stories"
    " title text message count thread body feed strip zone mobile desktop sticky fixed header".split()
)
#: Elements of running text: inside the main content only these names are taken for what they say there.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr span em strong b i a figure figcaption table ul ol dl".split())
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored".split())
#: First and last parts of names that tell a layout's state, as in has-sidebar or ad-free.
STATE_FIRST = frozenset("has no not non with without hide show is".split())
STATE_LAST = frozenset("free enabled disabled".split())
CONTENT = frozenset(("article", "main"))
#: End tags that HTML lets be left out: what an opening tag ends, and the elements that this doesn't reach out of.
SCOPE = ("table", "td", "th", "caption")
TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
LISTS = (*SCOPE, *"ul ol menu dir dl blockquote section article main aside nav form fieldset details figure header footer button".split())
GROUPS = ("tbody", "thead", "tfoot", "tr", "caption")
ENDS = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), LISTS), "dd": (("dt", "dd"), LISTS), "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "caption"), ("table",)), "tbody": (GROUPS, ("table",)),
    "thead": (GROUPS, ("table",)), "tfoot": (GROUPS, ("table",)),
}
ENDS_P = BLOCKS - TABLE_PARTS - frozenset("body frameset head html legend option".split())
IN_HEAD = frozenset("base head html link meta".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSED_AS_BLOCKS = BLOCKS | TABLE_PARTS | {"button"}
RIVAL = 10  # marked content elsewhere counts if it has at least this part of a container's words
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
PART = re.compile(r"[a-z]+")


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # empty for comments, declarations and raw elements
    close: bool
    attr: str


def markup(page: str) -> list[Tag]:
    """The markup of a page in order, in one pass: whatever has no end (a quote, a
    tag, an element) is looked for once and then known to have none."""
    out: list[Tag] = []
    at, unquoted, no_end = 0, set(), set()
    odd = False  # after a tag without an end, quotes hold no more
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            ends = [k + n for end, n in (("-->", 3), ("--!>", 4)) if end not in no_end and (k := page.find(end, at + 2 + (n == 4) * 2)) >= 0 or no_end.add(end)]
            end = max(at + 4, min(ends, default=len(page)))
            out.append(Tag(at, end, "", False, ""))
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            if not end:
                break
            out.append(Tag(at, end, "", False, ""))
        elif m := TAG.match(page, at):
            k = m.end()
            while not odd and (stop := STOP.search(page, k)) and stop[0] != ">":
                quote, k = page[stop.end() - 1], stop.end()
                if quote not in unquoted:
                    end = page.find(quote, k)
                    if end < 0:
                        unquoted.add(quote)
                    else:
                        k = end + 1
            if odd:
                end = page.find(">", k) + 1
                if not end:
                    break
            elif stop:
                end = stop.end()
            else:
                odd = True
                continue
            name, close = m[1].lower(), page[at + 1] == "/"
            attr = page[m.end() : end - 1]
            if close or name not in RAW_END or name in ("svg", "math") and attr.endswith("/"):
                out.append(Tag(at, end, name if name not in RAW_END else "", close, attr))
            else:
                after = None if name in no_end else RAW_END[name].search(page, end)
                if after is None:
                    no_end.add(name)
                    end = len(page)
                else:
                    end = page.find(">", after.end()) + 1 or len(page)
                out.append(Tag(at, end, "", False, ""))
        else:
            at += 1
            continue
        at = end
    return out


def _named_out(token: str, names: frozenset) -> bool:
    """Whether a class, id or role names what is left out: it is such a name, or begins or
    ends with one and has but words of the layout beside it."""
    if token in names:
        return True
    parts = PART.findall(token)
    if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
        return False
    return (parts[0] in names or parts[-1] in names) and all(p in names or p in LAYOUT_NAMES for p in parts)


def left_out(name: str, attr: str, in_content: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_content:
        return True
    if not attr or name in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attr):
        return True
    names = ADVERTS if in_content and name in RUNNING else LEFT_OUT_NAMES
    return any(_named_out(token, names) for m in NAMES.finditer(attr) for token in (m[1] or m[2] or m[3] or "").lower().split())


def containers(page: str, found: list[Tag]) -> dict[int, int]:
    """Start of the tag -> end of the content of containers that are left out.

    Elements end as in HTML: with their end tag, with their parent or, where the
    end tag is optional, with what can't stand in them. A container is no reason
    to leave the main content out: one with a `main` is kept, and so is one with
    an `article` or with most of the page's words, unless an `article` or `main`
    beside it has words too (those of comments or cards stay left out then).
    """
    stack: list[tuple[str, int, int]] = []  # name, container or 0, mark or 0
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    blocks: list[int] = []
    # Containers and marks (article, main); the first of each is the page. `beside`
    # counts words whose mark stands in the same container as they do.
    held: list[list[int]] = [[0] * 8]  # start, end, words, mains, articles, container around, mark around, words in marks
    marks: list[list[int]] = [[0, 0, 0]]  # container around, mark around, words
    cover, mark = [0], [0]
    words = mains = articles = 0

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def end(place: int, at: int, own: int | None = None) -> None:
        while len(stack) > place:
            name, c, m = stack.pop()
            opened[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if c:
                cover.pop()
                x = held[c]
                x[1] = at if own is None or len(stack) > place else own
                x[2], x[3], x[4] = words - x[2], mains - x[3], articles - x[4]
            if m:
                mark.pop()

    def text(lo: int, hi: int) -> None:
        nonlocal words
        n = len(page[lo:hi].split())
        if n:
            if stack and stack[-1][0] == "head":
                end(len(stack) - 1, lo)
            words += n
            if mark[-1] and marks[mark[-1]][0] == cover[-1]:
                held[cover[-1]][7] += n
                marks[mark[-1]][2] += n

    at = 0
    for t in found:
        text(at, t.start)
        at = t.end
        name = t.name
        if not name:
            continue
        if t.close:
            if name in ("body", "html"):
                end(max(0, last((name,))), t.start, t.end)
                continue
            names = HEADINGS if name in HEADINGS else (name,)
            if name not in CLOSED_AS_BLOCKS:
                limit = blocks[-1] if blocks else -1
            elif name == "table":
                limit = -1
            else:
                limit = last(("table",) if name in TABLE_PARTS else LISTS if name == "li" else SCOPE)
            if (place := last(names)) > limit:
                end(place, t.start, t.end)
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            end(len(stack) - 1, t.start)
        if name in ENDS_P and (place := last(("p",))) > last(SCOPE):
            end(place, t.start)
        if name in ENDS:
            ended, around = ENDS[name]
            limit = last(around)
            if inside := [opened[n][-1] for n in ended if opened.get(n) and opened[n][-1] > limit]:
                end(min(inside), t.start)
        if name in VOID:
            if left_out(name, t.attr, bool(mark[-1])):
                held.append([t.start, t.end, 0, 0, 0, cover[-1], mark[-1], 0])
            continue
        c = m = 0
        if left_out(name, t.attr, bool(mark[-1])):
            c = len(held)
            held.append([t.start, 0, words, mains, articles, cover[-1], mark[-1], 0])
            cover.append(c)
        if name in CONTENT:
            m = len(marks)
            marks.append([cover[-1], mark[-1], 0])
            mark.append(m)
            mains += name == "main"
            articles += name == "article"
        opened[name].append(len(stack))
        if name in CLOSED_AS_BLOCKS:
            blocks.append(len(stack))
        stack.append((name, c, m))
    text(at, len(page))
    end(0, len(page))
    for x in held[1:]:  # sums over all containers and all marks around
        x[7] += held[x[5]][7]
    for x in marks[1:]:
        x[2] += marks[x[1]][2]
    out = {}
    for lo, hi, n, has_main, has_article, around, within, _ in held[1:]:
        beside = held[around][7] - marks[within][2]
        wrapper = has_main or (has_article or 2 * n > words) and (not beside or RIVAL * beside < n)
        if not wrapper:
            out[lo] = hi
    return out


HEADING, PARAGRAPH = frozenset(HEADINGS), frozenset("p blockquote pre dd".split())
ITEM = frozenset("li dt option".split())


class Atom(NamedTuple):
    """A block of words or a tag, with the content elements it stands in (0: none)."""

    kind: str  # class of the block, or the name of the tag
    text: str | None
    n: int  # words
    article: int
    main: int

    @property
    def inside(self) -> bool:
        return bool(self.article or self.main)


def block_class(name: str, n: int, linked: int) -> str:
    if name in PARAGRAPH:
        return "paragraph"
    if name in HEADING:
        return "heading"
    if 2 * linked > n:
        return "links"
    return "item" if name in ITEM else "few" if n < FEW else "more"


def atoms(page: str, outside: list | None = None) -> list[Atom]:
    """The page as blocks and tags in order. `outside` gets those of containers that are left out."""
    out: list[Atom] = []
    found = markup(page)
    left = containers(page, found)
    at = skip = links = 0
    element, item = "", -1  # of the block; the place of its item's tag
    opened = {"article": 0, "main": 0}
    number = {"article": 0, "main": 0}
    held: list[tuple[str, bool]] = []

    def now(name: str) -> int:
        return number[name] if opened[name] else 0

    def into() -> list[Atom] | None:
        return out if at >= skip else outside

    def add(kind: str, text: str | None = None, n: int = 0) -> None:
        if (to := into()) is not None:
            to.append(Atom(kind, text, n, *((now("article"), now("main")) if to is out else (0, 0))))

    def block() -> None:
        nonlocal item
        if held:
            if joined := " ".join(entities.unescape("".join(t for t, _ in held)).split()):
                n = joined.count(" ") + 1
                kind = block_class(element, n, sum(len(t.split()) for t, linked in held if linked))
                if kind == "item" and item >= 0 and (to := into()) is not None and item < len(to):
                    to[item] = to[item]._replace(kind=f"{element} text")
                add(kind, joined, n)
            held.clear()

    for t in found:
        if t.start > at:
            held.append((page[at : t.start], links > 0))
        if at < skip <= t.start:  # the container that is left out ends
            block()
            at, element, links, item = t.start, "", 0, -1
        name, close = t.name, t.close
        own = t.start < skip and t.end == skip  # a container's own tags are no signs
        if t.start >= skip and t.start in left and not close:
            own = True
            block()
            add("left-out")
            at, skip = t.start, left[t.start]
            element, links = "", 0
        if not name:
            at = t.end
            continue
        if name in BLOCKS:
            block()
            at = t.start
            links = 0
            if name in CONTENT:
                if t.start >= skip:
                    if not close:
                        number[name] += not opened[name]
                    opened[name] = max(0, opened[name] + (-1 if close else 1))
            elif not own:
                text = close and into() and into()[-1].kind == "item" or False
                add(f"/{name}{' text' if text else ''}" if close else name)
                if name in ITEM and not close:
                    item = len(into()) - 1 if into() is not None else -1
            element = "" if close else name
        else:
            if name in SPACED:
                held.append((" ", False))
            if name == "a":
                links = max(0, links + (-1 if close else 1))
            # A link within running text is no sign of a menu.
            if not own:
                add(("/" if close else "") + (f"{name} in text" if element in PARAGRAPH or element in HEADING else name))
        at = t.end
    if len(page) > at:
        held.append((page[at:], links > 0))
    if at < skip:
        at = min(skip - 1, len(page))
    block()
    return out


def label(counts: Counter, page: str) -> None:
    """Adds the words and tags of a labelled page to the counts by (inside, is word, kind). Of what is left
    out only lines of the layout count as words: an advert's running text reads like any other."""
    rest: list[Atom] = []
    for x in atoms(page, rest):
        counts[x.inside, x.text is not None, x.kind] += x.n if x.text is not None else 1
    for x in rest:
        if x.text is None or x.kind in ("links", "few"):
            counts[False, x.text is not None, x.kind] += x.n if x.text is not None else 1


def weights_from(counts: Counter) -> dict:
    """Weights from what stands inside and outside of labelled content:
    {"word": of a word of any block, "words": by class, "tags": by name, "other": of other tags}."""
    if not counts:
        return {"word": math.log(2.0), "words": {"links": 0.01, "few": 0.1}, "tags": {"p": -0.01, "/p": -0.01}, "other": -math.log(2.0)}
    names = {(is_word, kind) for _, is_word, kind in counts}
    total = {k: sum(n for (inside, _, _), n in counts.items() if inside == k) + len(names) + 1 for k in (True, False)}
    share = lambda inside, n: math.log((n + 1) / total[inside])
    odds = lambda key: share(True, counts[True, *key]) - share(False, counts[False, *key])
    words = {k: sum(n for (inside, is_word, _), n in counts.items() if is_word and inside == k) for k in (True, False)}
    positive = lambda o: math.log1p(math.exp(o))
    return {
        "word": positive(share(True, words[True]) - share(False, words[False])),
        "words": {kind: min(positive(odds((True, kind))), LARGEST) for is_word, kind in names if is_word},
        "tags": {kind: -min(positive(-odds((False, kind))), LARGEST) for is_word, kind in names if not is_word},
        "other": -math.log(2.0),
    }


def learn(pages) -> dict:
    counts: Counter = Counter()
    for page in pages:
        label(counts, page)
    return weights_from(counts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum (longest, then first of equals)."""
    best, at, total, start = -math.inf, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and k + 1 - start > at[1] - at[0]:
            best, at = total, (start, k + 1)
    return at


def regions(scores: list[float]) -> list[tuple[float, int, int]]:
    """Every maximal run (sum, first, end): no run that it is part of, or that is part
    of it, has a larger sum. In one pass, with for each run the last before it that begins lower."""
    runs: list[tuple[float, float, int, int, int]] = []  # sums before and behind, bounds, place of the run that begins lower
    total = 0.0
    for k, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        first, high = k, total
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][0] >= low:
                j = runs[j][4]
            if j < 0 or runs[j][1] >= high:
                runs.append((low, high, first, k + 1, j))
                break
            low, first = runs[j][0], runs[j][2]
            del runs[j:]
    return [(high - low, first, end) for low, high, first, end, _ in runs]


def _titled(found: list[Atom], first: int) -> int:
    """Where a region begins with the headings right before it."""
    k = first
    while k and (not found[k - 1].n or found[k - 1].kind == "heading"):
        k -= 1
        if found[k].n:
            first = k
    return first


def main_text(page: str | None, weights: dict) -> str:
    if not page:
        return ""
    found = atoms(page)
    if not any(x.n for x in found):
        return ""
    word, words, tags, other = weights["word"], weights.get("words", {}), weights["tags"], weights["other"]
    scores = [x.n * words.get(x.kind, word) if x.text is not None else tags.get(x.kind, other) for x in found]
    lo, hi = best_region(scores)
    # Equal sums aside, the best region is one of the maximal ones.
    least = LEAST * words.get("paragraph", word)
    chosen = {(lo, hi)} | {(a, b) for s, a, b in regions(scores) if s >= least and (b <= lo or hi <= a)}
    held = [found[k] for a, b in sorted(chosen) for k in range(_titled(found, a), b) if found[k].n]
    total = sum(x.n for x in held if x.kind != "links")
    for mark in ("article", "main"):
        marked = [x for x in held if getattr(x, mark)]
        if 2 * sum(x.n for x in marked) >= total:
            kept = {getattr(x, mark) for x in marked}
            held = [x for x in found if x.n and getattr(x, mark) in kept]
            break
    return "\n\n".join(x.text for x in held)


def weights_of(pages: DataFrame, n: int = LABELLED_PAGES) -> dict:
    """Learns, in a task, from those of n pages (of least crc32 of the id, chosen by ids alone) that
    have one content element; of pages with one id from the least."""
    order = (F.crc32(F.col("page_id").cast("string").cast("binary")), "page_id")
    chosen = pages.filter("page_id IS NOT NULL").select("page_id").distinct().orderBy(*order).limit(n)
    rows = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi")
    rows = rows.filter(F.regexp_count(F.lower("html"), F.lit(r"<(?:article|main)[\s>]")) == 1)
    rows = rows.groupBy("page_id").agg(F.min("html").alias("html")).select("html")

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for b in batches:
            for (page,) in rows_of(b, 16):
                label(counts, page)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(counts)], pa.binary())], names=["counts"])

    total: Counter = Counter()
    for r in rows.coalesce(1).mapInArrow(run, "counts binary").collect():
        total.update(pickle.loads(r.counts))
    return weights_from(total)


def extract(pages: DataFrame, weights: dict) -> DataFrame:
    """Adds `text` and `n_chars` to rows with an `html`, which is dropped."""
    kept = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    schema = T.StructType([f for f in pages.schema.fields if f.name in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h, weights) for (h,) in rows_of(b.select(["html"]))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, "html").mapInArrow(run, schema)


def op4(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    return extract(pages, weights_of(pages))
