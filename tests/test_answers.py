"""Answers and the line sink; run totals; the second extractor."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import operations as O
from lodestone.sources import answers as A
from lodestone.sources import markup as M


def lines(spark, *values, parts=2):
    return spark.createDataFrame([(v,) for v in values], "value string").repartition(parts)


def read(spark, path):
    return sorted(r.value for r in A.read_lines(spark, str(path)).collect())


def test_answer(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame(
        [(1, 1, "a", None, "x", 1), (1, 2, None, "https://b", None, None), (1, 3, "c", "https://c", "z", 9), (1, 4, "d", "", "z", 9), (3, 1, "t", "https://t", "z", 1)],
        "query_id long, rank int, title string, url string, description string, position int",
    )
    got = {r.query_id: json.loads(r.answer) for r in A.answers(asked, hits, F.when(F.col("query_id") == 3, "down")).collect()}
    assert got[1] == {"success": True, "data": {"web": [{"title": "", "url": "https://b", "description": "", "position": 2}, {"title": "c", "url": "https://c", "description": "z", "position": 9}]}}
    assert got[2] == {"success": True, "data": {"web": []}}
    assert got[3] == {"success": False, "error": "down"}


def test_sink_appends_and_overwrites(spark, tmp_path):
    A.write_lines(lines(spark, "a", "é", ""), str(tmp_path))
    A.write_lines(lines(spark, "a"), str(tmp_path))
    assert read(spark, tmp_path) == ["", "a", "a", "é"]
    A.write_lines(lines(spark, "b"), str(tmp_path), "overwrite")
    assert read(spark, tmp_path) == ["b"]
    A.write_lines(lines(spark, "c"), str(tmp_path))
    assert read(spark, tmp_path) == ["b", "c"]
    A.write_lines(lines(spark).limit(0), str(tmp_path), "overwrite")
    assert read(spark, tmp_path) == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    A.write_lines(lines(spark, "kept"), str(tmp_path))
    many = spark.range(4000).repartition(4).select(F.when(F.col("id") != 3999, F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="null or has a line break"):
        A.write_lines(many, str(tmp_path))
    assert read(spark, tmp_path) == ["kept"]
    A.write_lines(many.filter("value IS NOT NULL"), str(tmp_path))
    assert len(read(spark, tmp_path)) == 4000


def test_second_attempts_and_concurrent_writers(spark, tmp_path):
    batch = [pa.RecordBatch.from_pydict({"value": ["x", "y"]})]
    one, two = A._Writer(f"file://{tmp_path}", False), A._Writer(f"file://{tmp_path}", False)
    lost, counted, other = one.write(iter(batch)), one.write(iter(batch)), two.write(iter(batch))
    two.commit([other])
    one.commit([counted, None])
    assert lost.file not in {r.file for r in A.committed_files(spark, str(tmp_path)).collect()}
    assert read(spark, tmp_path) == ["x", "x", "y", "y"]
    three = A._Writer(f"file://{tmp_path}", False)
    three.abort([three.write(iter(batch))])
    assert len(list(Path(tmp_path, "data").glob("*.txt"))) == 3


def test_damaged_file_is_an_error(spark, tmp_path):
    A.write_lines(lines(spark, "a", "b", parts=1), str(tmp_path))
    file = next(Path(tmp_path, "data").glob("*.txt"))
    file.write_text("a\n")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="missing or not whole"):
        A.read_lines(spark, str(tmp_path)).collect()


def test_measured_write(spark, tmp_path):
    got = O.measured_write(spark.range(1000), f"{tmp_path}/t", F.count("*").alias("n"), F.sum("id").alias("s"))
    assert got == {"n": 1000, "s": 499500} and spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_run_totals(spark, tmp_path):
    def end(executor, cpu, peak, tree=0, failed=False):
        return json.dumps({
            "Event": "SparkListenerTaskEnd", "Task Info": {"Executor ID": executor, "Failed": failed},
            "Task Metrics": {"Executor CPU Time": cpu * 10**9, "Executor Run Time": 3000, "JVM GC Time": 500, "Peak Execution Memory": peak << 20, "Memory Bytes Spilled": 1, "Disk Bytes Spilled": 2, "Input Metrics": {"Bytes Read": 10}, "Shuffle Write Metrics": {"Shuffle Bytes Written": 7}},
            "Task Executor Metrics": {"JVMHeapMemory": 5 << 20, "JVMOffHeapMemory": 1 << 20, "ProcessTreeJVMRSSMemory": tree << 20, "ProcessTreePythonRSSMemory": tree << 19},
        })

    (tmp_path / "local-1").write_text("\n".join(['{"Event":"SparkListenerApplicationStart","App Name":"SparkListenerTaskEnd"}', end("0", 2, 4), end("1", 3, 9, failed=True), end("1", 1, 1)[:-40]]))
    rolled = tmp_path / "eventlog_v2_local-2"
    rolled.mkdir()
    (rolled / "events_1_local-2").write_text(end("0", 1, 1, 8))
    (rolled / "events_2_local-2.inprogress").write_text(end("0", 1, 2, 10) + "\n" + json.dumps({"Event": "SparkListenerTaskEnd", "Task Info": {"Executor ID": "3", "Failed": True}}) + "\n" + json.dumps({"Event": "SparkListenerStageExecutorMetrics", "Executor ID": "9", "Executor Metrics": {"ProcessTreeJVMRSSMemory": 16 << 20}}))
    got = {r.application: r.asDict() for r in O.run_totals(spark, str(tmp_path)).collect()}
    assert got["local-2"]["tasks"] == 3 and got["local-2"]["cpu_seconds"] == 2.0 and got["local-2"]["peak_process_mib"] == 16.0 and got["local-2"]["executors"] == 2
    one = got["local-1"]
    assert (one["cpu_seconds"], one["run_seconds"], one["gc_seconds"], one["peak_task_mib"], one["peak_process_mib"], one["failed_tasks"]) == (5.0, 6.0, 1.0, 9.0, 6.0, 1)
    assert (one["tasks"], one["input_bytes"], one["shuffle_bytes"], one["spilled_bytes"]) == (2, 20, 14, 6)


def test_run_totals_of_a_real_run(spark, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.logStageExecutorMetrics", "true").config("spark.executor.metrics.pollingInterval", "50ms").config("spark.eventLog.dir", "file://{tmp_path}").getOrCreate()
s.range(100000, numPartitions=5).write.parquet("{tmp_path}-out")
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"PYTHONPATH": ""}, capture_output=True)
    (row,) = O.run_totals(spark, str(tmp_path)).collect()
    assert row.tasks == 5 and row.failed_tasks == 0 and row.cpu_seconds > 0 and row.peak_process_mib > 1 and row.application.startswith("local-")


PAGE = """<html><head><title> Of  rivers </title><link rel="canonical" href="/r"></head><body><article> </article>
<div class="a"><ul><li><a href="/1">one</a></li><li><a href="/2">two</a></li><li><a href="/3">three</a></li></ul></div>
<div class="b"><h2>Of rivers</h2><p>The river rises in hills that are wet all year and runs for days to the sea.</p>
<div><a href="/4">more</a> <a href="/5">and more</a></div><p>Its banks are lined with alders, and <a href="/6">herons</a> stand in the shallows.</p><script>x = 1</script></div>
<div class="c"><p>All rights kept.</p></div></body></html>"""


def test_second_extractor():
    assert M.extract(PAGE)["markdown"] == ""
    page = M.extract_any(PAGE)
    assert page["extractor"] == "density" and page["title"] == "Of rivers" and page["canonical"] == "/r" and page["error"] is None
    assert page["markdown"].startswith("## Of rivers\n\nThe river rises") and "[herons](/6)" in page["markdown"]
    assert not any(w in page["markdown"] for w in ("more", "rights", "three", "x = 1"))
    own = M.extract_any(PAGE.replace("<article> </article>", "<article><p>Here.</p></article>"))
    assert own["extractor"] == "article" and own["markdown"] == "Here."
    assert M.extract_any("<article></article>")["extractor"] is None and M.extract_any("")["error"] and M.extract_any(None)["error"]
    assert M.extract_any("<article></article>bare words")["markdown"] == "bare words"
    assert M.extract_dense(PAGE, [".b"])["markdown"] == "All rights kept."


def test_densities_by_brute_force():
    root = M.parse(PAGE)

    def below(n):
        return [x for c in n.children if isinstance(c, M.Node) for x in (c, *below(c))]

    def strings(n, linked):
        linked = linked or n.tag == "a"
        return [x for c in n.children for x in ([(len("".join(c.split())), linked)] if isinstance(c, str) else strings(c, linked))]

    for n, d in M.densities(root).items():
        up, above = n.parent, False
        while up:
            above, up = above or up.tag == "a", up.parent
        s = strings(n, False)
        assert (d.characters, d.tags) == (sum(k for k, _ in s), len(below(n)))
        assert d.linked == sum(k for k, linked in s if linked)


def test_second_extractor_is_linear():
    deep = "<article></article>" + "<div>" * 20000 + "<p>words that are kept</p>"
    assert M.extract_dense(deep)["markdown"] == "words that are kept"
    wide = "<article></article><div>" + "<p>some words</p><p><a href='/x'>a link</a></p>" * 20000 + "</div>"
    assert M.extract_dense(wide)["markdown"].count("some words") == 20000


def test_second_extractor_on_pages(spark, sf_dir):
    from lodestone.plans.urls import extract_fallback

    rows = extract_fallback(spark, sf_dir).collect()
    assert {r.extractor for r in rows if r.page_id % 2 == 0 and r.error is None} <= {"density"}
    assert sum(r.extractor == "density" for r in rows) > len(rows) / 3
