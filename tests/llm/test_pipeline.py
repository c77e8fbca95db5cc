"""The pipeline's stages against what the operators decide."""

import corpus_pipeline as P
from lodestone.llm import bpe, mixing, neardup, quality, toxicity
from lodestone.llm.common import scratch


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, documents, labels):
    docs, columns = documents, documents.columns
    for (name, stage), wanted in zip(P.STAGES, ("toxic", "quality", "near", "mix", "bpe")):
        path = scratch(spark, "test-pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if wanted == "toxic":
            keep = [r.doc_id for r in toxicity.op9(docs, labels).filter("predicted = 0").collect()]
            assert ids(out) == sorted(keep)
        elif wanted == "quality":
            assert ids(out) == sorted(r.doc_id for r in quality.op2(docs, labels).filter("predicted = 1").collect())
        elif wanted == "near":
            assert ids(out) == sorted(r.doc_id for r in neardup.op5(docs).filter("kept").collect())
        elif wanted == "mix":
            taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
            got = ids(out)
            for k, r in taken.items():
                assert abs(got.count(k) * r.size - r.taken) <= r.size / 2
        else:
            assert sorted(map(str, out.collect())) == sorted(map(str, bpe.op7(docs).select(out.columns).collect()))
        if wanted != "bpe":
            assert out.columns == columns
            docs = out
    assert P.run(spark, sf_dir).count() == docs.count()


def test_order_of_training_is_kept(spark, sf_dir, documents):
    """Sorted by its places the last stage's result is the mix in its order, whatever files Spark packs together."""
    want = [r.doc_id for r in mixing.mixed_documents(documents).select("doc_id").toLocalIterator()]
    path = scratch(spark, "test-order")
    P.mix_sources(spark, documents, sf_dir).write.option("maxRecordsPerFile", 37).parquet(path)
    got = P.encode(spark, spark.read.parquet(path), sf_dir)
    rows = sorted(got.select(*P.ORDER, "doc_id").collect())
    assert [r.doc_id for r in rows] == want and len({tuple(r)[:3] for r in rows}) == len(rows)
    assert [r.doc_id for r in got.orderBy(*P.ORDER).select("doc_id").collect()] == want


def test_empty_and_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "word " * 50, "en", "a", 250), (3, "word " * 50, "en", "a", 250), (4, "word " * 50, "en", None, 250)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_null_and_repeated_ids_are_rows_of_their_own(spark, sf_dir):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(50))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (5, text(3)), (7, text(3)), (8, text(0)), (9, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {(None, text(1)), (5, text(2)), (5, text(3)), (8, text(0)), (9, text(4))}
    kept = P.drop_copies(spark, docs, sf_dir)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and set(got) == want and kept.columns == docs.columns
    mixed = P.mix_sources(spark, kept, sf_dir)
    assert sorted((r.doc_id or 0, r.text) for r in mixed.collect()) == sorted((i or 0, t) for i, t in want)
    assert P.encode(spark, mixed, sf_dir).count() == 5


def test_rows_with_ids_of_their_own_are_not_stored_again(spark, sf_dir, documents):
    """Near-duplicates and the mix write no copy of the texts where ids tell rows apart; the rows are those of numbered ones."""
    from pathlib import Path

    from lodestone.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file://"))
    tables = lambda: {f.name for f in shared.iterdir() if f.name.startswith(("pipeline-rows", "mixing-rows"))}
    before = tables()
    kept = P.drop_copies(spark, documents, sf_dir)
    mixed = P.mix_sources(spark, kept, sf_dir)
    got = [r.doc_id for r in mixed.select("doc_id").collect()]
    assert tables() == before and kept.columns == mixed.columns == documents.columns
    assert ids(kept) == sorted(r.doc_id for r in neardup.op5(documents).filter("kept").collect())
    numbered = kept.withColumn("doc_id", kept.doc_id.cast("decimal(20,0)"))  # in the same order, but not taken as they are
    assert [int(r.doc_id) for r in P.mix_sources(spark, numbered, sf_dir).select("doc_id").collect()] == got and tables() > before
