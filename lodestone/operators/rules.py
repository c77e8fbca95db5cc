"""Per-host extraction rules: lookup, marker contracts, admission, minimal covers."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U
from ..sources.markup import BadSelector, compile_selector, extract_with_rules, usable_selectors
from .joins import small

MOST_RULES = 100
_LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with the rule of exactly their host: remove_selectors, force_browser, matched."""
    r = rules.select(F.col("host").alias("__h"), "remove_selectors", "force_browser", F.lit(True).alias("__m"))
    joined = pages.withColumn("host", U.host(F.col("url"))).join(small(r, MOST_RULES), F.col("host") == F.col("__h"), "left")
    return joined.withColumn("matched", F.coalesce("__m", F.lit(False))).drop("__h", "__m")


def meets_contract(text: Column, required: Column, forbidden: Column) -> Column:
    """All required markers are there and no forbidden one, escaped underscores aside."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\_"), F.lit("_"))
    return F.forall(required, lambda x: F.contains(t, x)) & ~F.exists(forbidden, lambda x: F.contains(t, x))


def missing_markers(text: Column, required: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\_"), F.lit("_"))
    return F.filter(required, lambda x: ~F.contains(t, x))


def valid_host(host: str) -> bool:
    """A DNS name with several labels, no IP literal."""
    labels = host.split(".")
    return len(host) <= 253 and len(labels) > 1 and all(map(_LABEL.fullmatch, labels)) and not labels[-1].isdigit()


def check_rules(rules: list[dict]) -> None:
    """Raises for too many, repeated, effectless or malformed rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    hosts = [r["host"].strip().rstrip(".").lower() for r in rules]
    if len(set(hosts)) < len(hosts):
        raise ValueError("two rules have the same host")
    for host, r in zip(hosts, rules):
        if not valid_host(host):
            raise ValueError(f"{host} is no exact DNS host")
        if not r.get("remove_selectors") and not r.get("force_browser"):
            raise ValueError(f"the rule of {host} does nothing")
        if r.get("remove_selectors") and not usable_selectors(r["remove_selectors"]):
            raise ValueError(f"the rule of {host} has selectors that can't be used")


PARTS = ("remove_selectors", "force_browser")
BUNDLE = "bundle_id string, host string, url string, static_html string, rendered_html string, required_markers array<string>, forbidden_markers array<string>, candidate_rule struct<remove_selectors: array<string>, force_browser: boolean>"


@F.pandas_udf(T.BooleanType())
def _usable(selectors: pd.Series) -> pd.Series:
    """Whether a list holds selectors and all of them compile."""

    def one(x) -> bool:
        try:
            return x is not None and bool([compile_selector(s) for s in usable_selectors(list(x))])
        except BadSelector:
            return False

    return selectors.map(one)


def trials(bundles: DataFrame) -> DataFrame:
    """What extraction gives for each bundle under each subset of its rule's parts, the empty one among them: bundle_id, selectors and
    browser (which parts are on), output, good (its contract is met). At most four rows a bundle."""
    rule = F.col("candidate_rule")
    has = {"selectors": F.coalesce(F.size(rule.remove_selectors) > 0, F.lit(False)), "browser": F.coalesce(rule.force_browser, F.lit(False))}
    on = F.array(F.lit(False), F.lit(True))
    rows = bundles.withColumn("selectors", F.explode(F.filter(on, lambda x: ~x | has["selectors"])))
    rows = rows.withColumn("browser", F.explode(F.filter(on, lambda x: ~x | has["browser"])))
    html = F.when(F.col("browser") & F.col("rendered_html").isNotNull(), F.col("rendered_html")).otherwise(F.col("static_html"))
    found = rows.withColumn("e", extract_with_rules(html, F.when(F.col("selectors"), rule.remove_selectors)))
    output = F.struct("e.title", "e.markdown", "e.text")
    return found.select("bundle_id", "selectors", "browser", output.alias("output"), meets_contract(F.col("e.markdown"), F.col("required_markers"), F.col("forbidden_markers")).alias("good"))


def control_effects(bundles: DataFrame, controls: DataFrame) -> DataFrame:
    """(bundle_id, matched, changed) for each control page (url, html), which no rule should touch: whether the rule of the
    bundle's host applies to it, and whether its text would change by that. A few pages meet all bundles."""
    host = F.lower(F.regexp_replace(F.trim("host"), r"\.+$", ""))
    met = bundles.select("bundle_id", host.alias("host"), F.col("candidate_rule.remove_selectors").alias("remove_selectors")).join(
        small(controls.select(U.host(F.col("url")).alias("host"), "html"), MOST_RULES), "host"
    )
    outputs = met.withColumn("plain", extract_with_rules("html", F.lit(None).cast("array<string>"))).withColumn("ruled", extract_with_rules("html", "remove_selectors"))
    changed = outputs.groupBy("bundle_id").agg(F.lit(True).alias("matched"), F.max(F.col("plain.markdown") != F.col("ruled.markdown")).alias("changed"))
    return bundles.select("bundle_id").join(changed, "bundle_id", "left").fillna(False, ["matched", "changed"])


def admissions(bundles: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """(bundle_id, decision, selected, reasons): a rule is admitted if its page needs it, some smallest set of its parts meets the page's
    contract, each part of that set does something, and no control page is touched. `bundles` has the columns of BUNDLE.

    All follows from one table of trials, four outputs a bundle at most: `need` is the empty set's failure, `sufficient` the full set's
    success, the selection the smallest good set (selectors before the browser), `effective` a difference to the set without selectors."""
    outputs = trials(bundles)
    size = F.col("selectors").cast("int") + F.col("browser").cast("int")
    key = F.struct(size.alias("size"), F.col("browser").alias("browser"), F.col("selectors").alias("selectors"))
    output = lambda s, b: F.max(F.when((F.col("selectors") == s) & (F.col("browser") == b), F.struct("output", "good")))
    found = outputs.groupBy("bundle_id").agg(
        F.max(key).alias("whole"), F.max_by("good", key).alias("sufficient"), F.min(F.when(F.col("good") & (size > 0), key)).alias("best"),
        output(False, False).alias("plain"), output(True, False).alias("cut"), output(False, True).alias("rendered"), output(True, True).alias("both"),
    )
    rows = bundles.join(found, "bundle_id")
    touched = F.lit(False)
    if controls is not None:
        rows = rows.join(control_effects(bundles, controls), "bundle_id")
        touched = F.col("matched") | F.col("changed")
    host, best, rule = F.lower(F.regexp_replace(F.trim("host"), r"\.+$", "")), F.col("best"), F.col("candidate_rule")
    named = F.filter(F.array(F.when(F.size(rule.remove_selectors) > 0, F.lit(PARTS[0])), F.when(rule.force_browser, F.lit(PARTS[1]))), lambda x: x.isNotNull())
    with_cut = F.when(best.browser, F.col("both.output")).otherwise(F.col("cut.output"))
    without = F.when(best.browser, F.col("rendered.output")).otherwise(F.col("plain.output"))
    problems = {
        "host": F.when(~U.is_dns_host(host), "host is no DNS name").when(host != U.host(F.col("url")), "page is of another host"),
        "rule": F.when(F.size(named) == 0, "rule has no parts").when((F.size(rule.remove_selectors) > 0) & ~_usable(rule.remove_selectors), "selectors can't be used"),
        "need": F.when(F.col("plain.good"), "page needs no rule"),
        "success": F.when(~F.col("sufficient"), "rule doesn't help"),
        "effect": F.when(best.selectors & (with_cut == without), "selectors change nothing").when(best.browser & F.col("rendered_html").isNull(), "no rendered page"),
        "harm": F.when(touched, "rule touches a control page"),
    }
    reasons = F.filter(F.array(*problems.values()), lambda x: x.isNotNull())
    selected = F.filter(F.array(F.when(best.selectors, F.lit(PARTS[0])), F.when(best.browser, F.lit(PARTS[1]))), lambda x: x.isNotNull())
    return rows.select("bundle_id", F.when(F.size(reasons) == 0, "ADMIT").otherwise("REJECT").alias("decision"), selected.alias("selected"), reasons.alias("reasons"))


def minimal_cover(coverage: dict[str, set[str]], needed: set[str]) -> list[str] | None:
    """The fewest primitives that cover all needed classes, the first of equals by name; None if none do."""
    names = sorted(n for n, c in coverage.items() if c)
    for size in range(len(names) + 1):
        for chosen in combinations(names, size):
            if needed <= set().union(*(coverage[n] for n in chosen)):
                return list(chosen)
    return None
