import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import crawl as C
from lodestone.operators import evaluation as E
from lodestone.operators import passages as P
from lodestone.operators import rules as L
from lodestone.operators import tables as T
from lodestone.operators.indexing import build_contexts, embedded, hashed_words, index_pages
from lodestone.operators.operations import request_metrics

# --- passages -------------------------------------------------------------------


def test_splitting():
    text = "# A\nintro\n## B\n" + "\n".join(["line " + "x" * 90] * 12) + "\n# C\nend\n### D\ndeep"
    got = P.split_markdown(text, 128)
    assert [g[0] for g in got] == list(range(len(got)))
    assert got[0][1:3] == (["A"], "# A\nintro")
    assert {tuple(g[1]) for g in got} == {("A",), ("A", "B"), ("C",), ("C", "", "D")}
    assert all(len(g[2]) <= 800 for g in got) and all(g[3] == P.count_tokens(g[2]) for g in got)


def test_lists_stay_together():
    items = ["- " + "y" * 100] * 12
    assert len(P.split_markdown("\n".join(items), 128)) == 1
    assert len(P.split_markdown("\n".join(items * 2), 128)) == 2


def test_long_lines():
    words = "word " * 400 + "z" * 2000 + " tail"
    pieces = P.fit_line(words, 800)
    assert all(len(p) <= 800 for p in pieces) and "".join("".join(pieces).split()) == "".join(words.split())
    assert P.fit_line("q" * 1700, 800) == ["q" * 800, "q" * 800, "q" * 100]
    assert P.split_markdown(None) == [] and P.split_markdown(" \n ") == []


def selected(parts, budget, most):
    """Selection step by step, as it is described."""
    out, used = [], 0
    for k, t in enumerate(parts[:most]):
        left = budget - used - (3 if k else 0)
        if P.count_tokens(t) <= left:
            out.append(t)
            used += P.count_tokens(t) + (3 if k else 0)
            continue
        if left > 0 and (piece := P.clip_text(t, left)):
            out.append(piece)
        break
    return out


def test_budget(spark):
    rng = random.Random(2)
    cases = [[" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))] for _ in range(120)]
    df = spark.createDataFrame([(c, k, t) for c, parts in enumerate(cases) for k, t in enumerate(parts)], "c int, k int, text string")
    got = {r.c: r.context for r in P.contexts(P.within_budget(df, "c", "k", 100, 3), "c", "k").collect()}
    for c, parts in enumerate(cases):
        assert got.get(c, "") == P.SEPARATOR.join(selected(parts, 100, 3))
    with pytest.raises(ValueError):
        P.within_budget(df, "c", "k", 0, 3)


def test_budget_of_any_script(spark):
    rng = random.Random(3)
    cases = [["".join(rng.choices("ab é日本ЖΩ—”😀", [9, 9, 5, 3, *[rng.randint(0, 9)] * 7], k=rng.randint(1, 300))).strip() or "x" for _ in range(rng.randint(1, 5))] for _ in range(120)]
    cases += [["日本" * 400], ["текст " * 200], ["“quoted” " + "word " * 100]]
    df = spark.createDataFrame([(c, k, t) for c, parts in enumerate(cases) for k, t in enumerate(parts)], "c int, k int, text string")
    rows = P.within_budget(df, "c", "k", 100, 3).collect()
    for c, parts in enumerate(cases):
        assert [r.piece for r in sorted(r for r in rows if r.c == c)] == selected(parts, 100, 3)
    assert all(P.count_tokens(r.piece) <= 100 for r in rows)


def test_density_is_by_words(spark):
    texts = ["Fox-trot a.b fox, Größe_1 naïve!", "fox", "internationalization of foxes", "", "狐 fox 狐狸 日本", "... fox -- é"]
    df = spark.createDataFrame([(0, k, t, "fox", "") for k, t in enumerate(texts)], "c int, k int, text string, q string, path string")
    for r in P.ranked_passages(df, "c", "k", "q", "path").collect():
        n = r.text.lower().count("fox")
        assert r.score == pytest.approx(n + 100 * n / max(1, len(re.findall(r"[\w.-]+", r.text.lower()))), abs=1e-6)


# --- evaluation -------------------------------------------------------------------


def test_metrics(spark):
    rank = spark.createDataFrame([(1, x, k + 1) for k, x in enumerate("abcd")], "query_id int, item string, rank int")
    judged = spark.createDataFrame([(1, "b", 2), (1, "d", 1), (1, "z", 3), (2, "q", 1)], "query_id int, item string, grade int")
    got = {r.query_id: r for r in E.ranking_metrics(rank, judged, 10, 3).collect()}
    import math

    dcg, ideal = 3 / math.log2(3) + 1 / math.log2(5), 7 / 1 + 3 / math.log2(3) + 1 / math.log2(4)
    assert (got[1].mrr, got[1].recall) == (0.5, pytest.approx(1 / 3, abs=1e-6)) and got[1].ndcg == pytest.approx(dcg / ideal, abs=1e-6)
    assert (got[2].mrr, got[2].recall, got[2].ndcg) == (0, 0, 0)
    m = E.macro_average(E.ranking_metrics(rank, judged, 10, 3)).first()
    assert m.n_queries == 2 and m.mrr == 0.25
    with pytest.raises(Exception, match="no queries"):
        E.macro_average(E.ranking_metrics(rank.limit(0), judged.limit(0))).collect()


def test_judgments_by_class_equal_those_in_pairs(spark):
    things = [(k, "abc"[k % 7 % 3] if k != 33 else "alone", k % 2 == 0) for k in range(60)]
    items = spark.createDataFrame(things, "item long, cls string, kind boolean")
    asked = items.filter("item % 4 = 0 OR item IN (7, 33)").withColumnRenamed("item", "query_id")
    grades = spark.createDataFrame([(a, b, 1 + (a == b)) for a in (True, False) for b in (True, False)], "query_kind boolean, item_kind boolean, grade int")
    classes = E.ClassJudgments(asked, items, grades)
    pairs = asked.join(items.withColumnRenamed("kind", "other"), "cls").filter("query_id <> item")
    pairs = pairs.select("query_id", "item", F.when(F.col("kind") == F.col("other"), 2).otherwise(1).alias("grade"))
    rankings = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).withColumn("item", (F.col("query_id") * 5 + F.col("rank") * 7) % 60)
    assert classes.of(rankings).count() <= rankings.count() < pairs.count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for depth, at in ((10, 5), (3, 2), (40, 40)):
        assert rows(E.ranking_metrics(rankings, classes, depth, at, asked)) == rows(E.ranking_metrics(rankings, pairs, depth, at, asked))
    assert rows(E.target_item(classes)) == rows(E.target_item(pairs)) and len(rows(E.target_item(classes))) == asked.count() - 1
    assert rows(E.top1_rate(rankings, classes)) == rows(E.top1_rate(rankings, pairs))


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (7, 1, 3, 5, 2, 6, 4)], "v double")
    r = df.agg(*E.nearest_rank("v", 0.5, 0.95)).first()
    assert (r.p50, r.p95) == (4.0, 7.0)


def test_selection(spark):
    s = "ranker string, ndcg double, p95 double, eligible boolean"
    pick = lambda *rows: E.select_candidate(spark.createDataFrame(list(rows), s), "bm25").first().selected
    assert pick(("dense", 0.900, 10.0, True), ("hybrid", 0.904, 20.0, True)) == "dense"
    assert pick(("dense", 0.900, 10.0, True), ("hybrid", 0.910, 20.0, True)) == "hybrid"
    assert pick(("dense", 0.9, 10.0, False), ("hybrid", 0.9, 20.0, False)) == "bm25"


def test_candidate_gate(spark):
    rows = [("bm25", 0.9, 0.9, 0.9, 10.0, 1.0), ("good", 0.95, 0.9, 0.93, 400.0, 1.0), ("slow", 0.95, 0.9, 0.93, 600.0, 1.0), ("loses", 0.89, 0.9, 0.95, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "ranker string, mrr double, recall double, ndcg double, p95 double, top1_rate double")
    assert {r.ranker: r.eligible for r in E.candidate_checks(df, "bm25").collect()} == {"good": True, "slow": False, "loses": False}


def test_reproduction_and_grades(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.7)], "q int, m double")
    b = spark.createDataFrame([(1, 0.5000001), (3, 0.7)], "q int, m double")
    assert E.reproduced(a, b, ["q"], ["m"]).first().differences == 2
    j = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 1)], "query_id int, item string, grade int")
    assert [r.query_id for r in E.multi_graded(j).collect()] == [1]


# --- tables -----------------------------------------------------------------------


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "k int, v string, extra int")
    once = T.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", None), (2, "B", 9), (3, "C", 9)]
    assert sorted(map(str, T.upsert(once, new, ["k"]).collect())) == sorted(map(str, once.collect()))


def test_schema_rules(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    assert T.evolve(rows, spark.createDataFrame([], "a int, etag string").schema).first().etag is None
    with pytest.raises(ValueError):
        T.evolve(rows, spark.createDataFrame([], "b int").schema)
    schema = spark.createDataFrame([], "a int").schema
    assert T.create_if_missing(spark, "things", schema) and not T.create_if_missing(spark, "things", schema)
    with pytest.raises(ValueError):
        T.create_if_missing(spark, "things", spark.createDataFrame([], "b int").schema)


def test_recovery(spark):
    schema, calls = spark.createDataFrame([], "a int").schema, []

    def write():
        calls.append(1)
        return spark.table("lost").count()

    assert T.with_recovery(spark, "lost", schema, write) == 0 and len(calls) == 2


def test_vector_provenance(spark):
    meta = T.vector_metadata("m", 2)
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    good = df.withMetadata("embedding", meta)
    T.validate_vectors(good, meta)
    for bad, want in ((df, meta), (good, T.vector_metadata("m", 3)), (spark.createDataFrame([("x",)], "embedding string"), meta)):
        with pytest.raises(ValueError):
            T.validate_vectors(bad, want)
    good.write.saveAsTable("vectors_ok")
    state = T.check_ready(spark, {"vectors_ok": good.schema}, ("vectors_ok", meta), True, True, False)
    assert state == {"ready": False, "components": {"lexical": "ready", "dense": "ready", "reranker": "not_ready"}}
    assert T.check_ready(spark, {}, None, False, False, False)["ready"]


def test_vector_counts(spark):
    p = spark.createDataFrame([(1, 0), (1, 1)], "document_id int, ordinal int")
    v = spark.createDataFrame([(1, 0, [1.0])], "document_id int, ordinal int, embedding array<float>")
    with pytest.raises(ValueError):
        T.with_vectors(p, v)
    assert T.with_vectors(p.filter("ordinal = 0"), v).count() == 1


# --- crawl ------------------------------------------------------------------------


def crawled(spark, seeds, links, pages, depth, **options):
    s = spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, position int")
    e = spark.createDataFrame(links, "src string, dst string, position int")
    return [(r.url, r.depth) for r in sorted(C.crawl_frontier(s, e, pages, depth, **options).collect(), key=lambda r: r.visit)]


def test_frontier(spark):
    links = [("a", "c", 0), ("a", "b", 1), ("c", "d", 0), ("b", "e", 0), ("d", "a", 0), ("e", "f", 0)]
    assert crawled(spark, ["a"], links, 25, 1) == [("a", 0), ("c", 1), ("b", 1)]
    assert crawled(spark, ["a"], links, 25, 3) == [("a", 0), ("c", 1), ("b", 1), ("d", 2), ("e", 2), ("f", 3)]
    assert crawled(spark, ["a", "a", "b"], links, 3, 3) == [("a", 0), ("b", 0), ("c", 1)]
    only = spark.createDataFrame([("b",), ("e",)], "url string")
    assert crawled(spark, ["a"], links, 25, 2, allowed=only) == [("a", 0), ("b", 1), ("e", 2)]
    assert crawled(spark, ["a"], links, 25, 2, followed=F.col("url") != "c") == [("a", 0), ("c", 1), ("b", 1), ("e", 2)]
    with pytest.raises(ValueError):
        crawled(spark, ["a"], links, 101, 1)


def test_frontier_against_a_queue(spark):
    rng = random.Random(3)
    links = [(str(rng.randrange(30)), str(rng.randrange(30)), k) for k in range(90)]
    queue, seen, out = [("0", 0)], set(), []
    while queue and len(out) < 20:
        u, d = queue.pop(0)
        if u in seen:
            continue
        seen.add(u)
        out.append((u, d))
        if d < 3:
            queue += [(b, d + 1) for a, b, _ in links if a == u]
    assert crawled(spark, ["0"], links, 20, 3) == out


def test_stored_versions(spark):
    docs = spark.createDataFrame(
        [("u", "1", "h", "2026-01-01T00:00:00Z", "e", ""), ("u", "2", "h2", "2026-01-01T00:10:00+00:00", "", "m"), ("n", "3", "h", "2026-01-01T00:00:00", "e", None), ("x", "4", "h", "nonsense", None, None)],
        "url string, document_id string, content_hash string, fetched_at string, etag string, last_modified string",
    )
    now = F.lit("2026-01-01T00:20:00Z").cast("timestamp")
    asked = spark.createDataFrame([("u",), ("n",), ("x",), ("none",)], "url string")
    got = {r.url: r for r in C.stored_version(asked, docs, now).collect()}
    assert (got["u"].document_id, got["u"].age_s, got["u"].etag, got["u"].last_modified) == ("2", 600.0, None, "m")
    assert all(got[k].age_s is None for k in ("n", "x", "none"))
    fresh = lambda a: spark.range(1).select(C.is_fresh(F.lit(a), F.lit(900))).first()[0]
    assert fresh(600.0) and not fresh(900.0) and not fresh(None)


def test_refresh_scenarios(spark):
    """The five cases of a 262144-byte page with a validator and an hour's window."""
    rows = [("fresh", 120.0, False, False, True), ("fresh leaf", 120.0, True, False, True), ("stale", 7200.0, False, False, True), ("304", 7200.0, True, True, True), ("touch fails", 7200.0, True, True, False)]
    df = spark.createDataFrame(rows, "url string, age_s double, revalidate_leaves boolean, returns_304 boolean, touch_ok boolean")
    df = df.select("*", F.lit(1).alias("depth"), F.lit(1).alias("max_depth"), F.lit(3600).alias("refresh_after_s"), F.lit("v1").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(262144).alias("body_bytes"))
    plan = C.refresh_plan(df)
    got = {r.url: (r.conditional_gets, r.unconditional_gets, r.body_bytes, r.extractions, r.index_writes, r.touches) for r in plan.collect()}
    assert got == {"fresh": (0, 1, 262144, 0, 0, 0), "fresh leaf": (0, 0, 0, 0, 0, 0), "stale": (0, 1, 262144, 1, 1, 0), "304": (1, 0, 0, 0, 0, 1), "touch fails": (1, 1, 262144, 1, 1, 1)}
    saved = C.savings(plan.filter("url = 'stale'"), plan.filter("url = '304'")).first()
    assert (saved.unconditional_gets_saved, saved.body_bytes_saved, saved.extractions_saved, saved.index_writes_saved) == (100.0, 100.0, 100.0, 100.0)


def test_redirects(spark):
    s = spark.createDataFrame([("a",), ("x",), ("loop",)], "url string")
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("loop", "pool"), ("pool", "loop")], "src string, dst string")
    got = {x.url: (x.final_url, x.hops, x.ok) for x in C.redirect_targets(s, r).collect()}
    assert got["a"] == ("c", 2, True) and got["x"] == ("x", 0, True) and not got["loop"][2]


# --- rules ------------------------------------------------------------------------

STATIC = "<html><body><main><p>Useful body</p><div class='promo'>Buy now</div></main></body></html>"
RENDERED = "<html><body><main><p>Useful body late_part</p></main></body></html>"


def bundle(**changes):
    b = {"bundle_id": "b", "host": "docs.example", "url": "https://docs.example/a", "candidate_rule": {"remove_selectors": [".promo"]}, "static_html": STATIC, "rendered_html": None, "required_markers": ["Useful body"], "forbidden_markers": ["Buy now"]}
    return b | changes


CONTROLS = [("https://clean.example/", "<main><p>Plain</p><div class='promo'>Kept</div></main>")]


def test_admission(spark):
    force = {"candidate_rule": {"force_browser": True}, "rendered_html": RENDERED, "required_markers": ["late_part"], "forbidden_markers": []}
    cases = {
        "fine": {},
        "other host": {"host": "other.example"},
        "address": {"host": "10.0.0.1", "url": "https://10.0.0.1/a"},
        "needless": {"forbidden_markers": []},
        "useless": {"candidate_rule": {"remove_selectors": [".none"]}},
        "broken": {"candidate_rule": {"remove_selectors": ["p >> q"]}},
        "empty": {"candidate_rule": {"force_browser": False}},
        "browser": force,
        "both": force | {"candidate_rule": {"force_browser": True, "remove_selectors": [".promo"]}},
        "not rendered": force | {"rendered_html": None, "static_html": STATIC},
        "clean host": {"host": "Clean.example.", "url": "https://clean.example/a"},
    }
    rows = [bundle(**c) | {"bundle_id": name} for name, c in cases.items()]
    rows = [r | {"candidate_rule": {"remove_selectors": None, "force_browser": None} | r["candidate_rule"]} for r in rows]
    df = spark.createDataFrame(rows, L.BUNDLE)
    controls = spark.createDataFrame(CONTROLS, "url string, html string")
    got = {r.bundle_id: (r.decision, r.selected, r.reasons) for r in L.admissions(df, controls).collect()}
    assert got["fine"] == ("ADMIT", ["remove_selectors"], [])
    assert got["other host"][2] == ["page is of another host"] and got["address"][2] == ["host is no DNS name"]
    assert "page needs no rule" in got["needless"][2]
    assert got["useless"] == ("REJECT", [], ["rule doesn't help"])
    assert got["broken"] == ("REJECT", [], ["selectors can't be used", "rule doesn't help"])
    assert "rule has no parts" in got["empty"][2]
    assert got["browser"] == ("ADMIT", ["force_browser"], []) and got["both"] == ("ADMIT", ["force_browser"], [])
    assert got["not rendered"][2] == ["rule doesn't help"]
    assert got["clean host"][2] == ["rule touches a control page"]
    assert {r.bundle_id: r.decision for r in L.admissions(df).collect()}["clean host"] == "ADMIT"
    assert L.trials(df).filter("bundle_id = 'both'").count() == 4 and L.trials(df).filter("bundle_id = 'fine'").count() == 2


def test_rule_checks(spark):
    L.check_rules([{"host": "a.example", "remove_selectors": [".x"]}])
    for bad in ([{"host": "a.example"}], [{"host": "1.2.3.4", "force_browser": True}], [{"host": "a.example", "force_browser": True}] * 2, [{"host": f"h{k}.example", "force_browser": True} for k in range(101)]):
        with pytest.raises(ValueError):
            L.check_rules(bad)
    assert L.minimal_cover({"a": {"x"}, "b": {"x", "y"}, "c": {"y"}}, {"x", "y"}) == ["b"]
    assert L.minimal_cover({"a": {"x"}}, {"y"}) is None and L.minimal_cover({}, set()) == []
    t = spark.createDataFrame([("keep\\_me here",)], "t string")
    ok = lambda req, ban: t.select(L.meets_contract(F.col("t"), F.array(*map(F.lit, req)), F.array(*map(F.lit, ban)))).first()[0]
    assert ok(["keep_me"], ["nope"]) and not ok(["keep_me"], ["here"])


# --- logs, settings, entry points ---------------------------------------------------


def test_counters(spark):
    rows = [("ok", True, True, False, "no capacity left", 5.0, None), ("ok", False, True, True, None, float("nan"), 3.0), ("error", True, True, True, "x", 1.0, 1.0), ("ok", False, True, False, "broken", -1.0, float("inf"))]
    df = spark.createDataFrame(rows, "status string, degraded boolean, rerank_enabled boolean, rerank_used boolean, rerank_reason string, queue_ms double, inference_ms double")
    r = request_metrics(df).first()
    assert (r.requests, r.successes, r.backend_errors, r.degraded, r.rerank_used) == (4, 3, 1, 1, 1)
    assert (r.rerank_degraded, r.capacity_fallbacks, r.other_degradations) == (2, 1, 1)
    assert (r.queue_ms_count, r.queue_ms_sum, r.inference_ms_count, r.inference_ms_max) == (1, 5.0, 1, 3.0)


def test_settings():
    assert Settings.from_env({"LODESTONE_LIMIT": "7"}).limit == 7
    for bad in ({"limit": 0}, {"mode": "x"}, {"max_depth": 4}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_indexing(spark):
    html = "<html><head><title>T</title><link rel=canonical href='https://a.example/c'></head><body><nav>menu</nav><main><h1>Head</h1><p>Body text here</p></main></body></html>"
    pages = spark.createDataFrame([("https://a.example/x", html), ("https://a.example/y", "<main></main>"), ("https://a.example/z", None)], "url string, html string")
    docs, parts, outcomes = index_pages(pages)
    assert [r.title for r in docs.collect()] == ["T"]
    p = parts.first()
    assert (p.section_path, p.text) == ("Head", "# Head\n\nBody text here") and p.passage_id.endswith(":0")
    got = {r.url[-1]: (r.indexed, r.error) for r in outcomes.collect()}
    assert got["x"] == (True, None) and not got["y"][0] and got["z"] == (False, "HTML is empty or too large")
    made = embedded(parts.withColumn("t", F.col("text")), "t", hashed_words(16)).first().embedding
    assert len(made) == 16
    c = {r.url[-1]: r for r in build_contexts(pages.withColumn("q", F.lit("body")), query="q").collect()}
    assert c["x"].context == "# Head\n\nBody text here" and c["y"].error == "no content"


def test_passage_function_equals_the_passages(spark, sf_dir):
    import __spark_entry__ as E

    q = E.queries()
    key = lambda df: sorted(map(str, df.select("doc_id", "ordinal", "section_path", "text", "approx_tokens").collect()))
    assert key(q["passages_lateral"](spark, sf_dir)) == key(q["passages"](spark, sf_dir))
    assert spark.sql("SELECT p.ordinal, p.text FROM VALUES ('# A\n\nb'), (NULL), ('') AS t(x), LATERAL passages(x, 128) p").collect() == [(0, "# A\n\nb")]
    for bad in ("passages(1)", "passages('x', 5)", "passages('x', 'y')"):
        with pytest.raises(Exception, match="passages|target_tokens"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_only_admitted_model_files_score(spark, tmp_path):
    import hashlib

    from lodestone.operators import retrieval as R

    (tmp_path / "weights.txt").write_text("2.5")
    path, good = str(tmp_path / "weights.txt"), hashlib.sha256(b"2.5").hexdigest()
    pairs = spark.createDataFrame([("q", "long text"), ("q", "t")], "query string, text string")

    def load(places):
        w = float(open(places[0]).read())
        return lambda qs, ts: [w * len(t) for t in ts]

    assert sorted(r.rerank_score for r in R.scored_by(pairs, R.verified(spark, {path: good}, "1", "1", load)).collect()) == [2.5, 22.5]
    for digest, version, why in (("0" * 64, "1", "checksum"), (good, "2", "isn't the admitted")):
        with pytest.raises(Exception, match=why):
            R.scored_by(pairs, R.verified(spark, {path: digest}, version, "1", load)).collect()


def test_a_failed_model_stays_failed(spark, tmp_path):
    from lodestone.operators import retrieval as R

    (tmp_path / "model.bin").write_text("x")
    calls = []
    scorer = R.verified(spark, {str(tmp_path / "model.bin"): "0" * 64}, "3", "4", calls.append)
    for _ in range(2):
        with pytest.raises(R.ModelError, match="admitted"):
            scorer()
    assert not calls and len([k for k in R._FAILED if k[0] == "3"]) == 1
