"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond Java's own: U+001C to U+001F count too.
SPACE = r"(?U)[\s\x1C-\x1F]+"
#: Line ends, the Unicode ones included.
NEWLINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Letters, digits and underscores; a full stop, colon or apostrophe between
#: letters and a full stop or comma between digits don't end a token. Runs are possessive: matched in
#: loops, not by recursion over a token's letters.
TOKEN = r"(?:\p{L}+(?:[.':]\p{L}+)*+|\p{N}+(?:[.,]\p{N}+)*+|_+)++"
QUERY_TERM = r"[\p{L}\p{N}_.-]+"
ELLIPSIS = " …"
SEPARATOR_TOKENS = 3  # what the separator between passages costs
LATIN_LAST = r"[^\x{0000}-\x{024F}]"


def collapse(c: Column) -> Column:
    """White space runs to one space, both ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def approx_tokens(c: Column) -> Column:
    """Three Latin characters a token, others one each; empty or null is 0."""
    n = F.length(c)
    latin = F.length(F.regexp_replace(c, LATIN_LAST, ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((latin + 2) / 3) + n - latin)).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(collapse(c), 256)


def compact(c: Column, limit: int = 600) -> Column:
    """Collapsed text of at most `limit` characters, an ellipsis for what is cut."""
    t = collapse(F.coalesce(c, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(t, 1, limit - len(ELLIPSIS))), F.lit(ELLIPSIS))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(c, NEWLINE), collapse_ends), lambda x: x != "")


def collapse_ends(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+", ""), r"(?U)[\s\x1C-\x1F]+$", "")


def tokens(c: Column) -> Column:
    """Analysed tokens in order, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column) -> Column:
    """Distinct lower-cased terms of more than one character."""
    found = F.regexp_extract_all(F.lower(c), F.lit(QUERY_TERM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term occurs as a substring, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def clean_markdown(c: Column) -> Column:
    """No-break spaces to spaces, blanks before line ends dropped, at most two blank lines, trimmed."""
    t = F.regexp_replace(c, " ", " ")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return collapse_ends(t)


def quality(markdown: Column, html: Column, min_useful: int = 500) -> Column:
    """Length, text-to-markup ratio and share of distinct lines, weighted; 0 for no text."""
    n = F.length(collapse(markdown)).cast("double")
    found = lines(markdown)
    distinct = F.size(F.array_distinct(found)) / F.greatest(F.size(found), F.lit(1))
    ratio = n / F.greatest(F.length(html), F.lit(1)) / 0.08
    total = 0.55 * F.least(F.lit(1.0), n / min_useful) + 0.25 * F.least(F.lit(1.0), ratio) + 0.20 * distinct
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))


#: Marks of single-page applications. Fixed values.
SHELL_MARKS = ('id="__next"', 'id="root"', "ng-version=", "data-reactroot")


def needs_render(markdown: Column, html: Column, quality_score: Column, min_useful: int = 500) -> Column:
    low = F.lower(html)
    shell = F.lit(False)
    for m in SHELL_MARKS:
        shell = shell | F.contains(low, F.lit(m))
    return (F.length(collapse_ends(markdown)) < min_useful) | (quality_score < 0.35) | (shell & (quality_score < 0.6))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.+?)\s*$", 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, r"^(#{1,6})\s+(.+?)\s*$", 2)


def is_structured(line: Column) -> Column:
    """List items and table rows, which are kept together."""
    return F.regexp_like(line, F.lit(r"^\s*(?:- |\* |\|)"))


def section_path(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), " > ")


def passage_text(prefix: str, *parts: Column) -> Column:
    """Non-empty parts on lines of their own behind a prefix, as embedders want it."""
    held = F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != "")
    return F.concat(F.lit(prefix), F.array_join(held, "\n"))


def clip(text: Column, budget: Column) -> Column:
    """The longest start of a Latin text that fits a token budget with an
    ellipsis behind it; null where nothing fits. The ellipsis alone may cost one
    token more than a budget of 1."""
    room = 3 * budget
    whole = F.rtrim(F.substr(text, F.lit(1), room.cast("int")))
    short = F.rtrim(F.substr(text, F.lit(1), F.greatest(F.lit(0), room - 4).cast("int")))
    kept = F.when(F.length(whole) > room - 4, short).otherwise(whole)
    return F.when((budget > 0) & (F.length(whole) > 0), F.concat(kept, F.lit(ELLIPSIS)))
