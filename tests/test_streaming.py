import datetime
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.tables import _log
from lodestone.streaming import cache, cycles, index, metrics


@pytest.fixture(scope="module")
def events_folder(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").write.mode("overwrite").parquet(folder)
    return folder


def test_incremental_table_equals_batch(spark, events_folder, tmp_path):
    schema = spark.read.parquet(events_folder).schema
    table = index.VersionedTable(spark, f"file://{tmp_path}/table", schema)
    assert table.read().count() == 0
    order = [F.desc("ts"), F.desc("event_id")]
    # Files come in any order: only keys matter, so each batch brings its newest and replaces.
    stream = index.read_stream(spark, events_folder, schema)
    index.keep_current(stream, table, ["user_id"], order, str(tmp_path / "c")).awaitTermination()
    want = index.latest_by_key(spark.read.parquet(events_folder), ["user_id"], order)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert not table.apply(want, table.version(), ["user_id"], order)


def test_two_writers_of_one_table_lose_nothing(spark, tmp_path):
    """Writers that replace keys of the same buckets at the same time; batches are applied once."""
    import threading

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("bucket", T.StringType())])
    table = index.VersionedTable(spark, str(tmp_path / "t"), schema, buckets=4)
    rows = lambda who, n: spark.range(n * 20, n * 20 + 30).select("id", F.concat(F.lit(f"{who}{n}-"), "id").alias("v"), F.lit("clash").alias("bucket"))

    def work(who, shift):
        for n in range(2):
            assert table.apply(rows(who, n).withColumn("id", F.col("id") + shift), n, ["id"], [F.col("v")], who)

    threads = [threading.Thread(target=work, args=a) for a in (("a", 0), ("b", 1000))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.id: r.v for r in table.read().collect()}
    assert got == {k + s: f"{w}{1 if k >= 20 else 0}-{k}" for w, s in (("a", 0), ("b", 1000)) for k in range(50)}
    assert not table.apply(rows("a", 1), 1, ["id"], [F.col("v")], "a") and table.version("a") == 1 and table.version() == -1


def test_only_touched_buckets_are_written_and_old_parts_go(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    table = index.VersionedTable(spark, str(tmp_path / "t"), schema, buckets=8)
    table.apply(spark.range(100).select("id", F.lit(0).cast("long").alias("v")), 0, ["id"], [F.col("v")])
    first = table.commits.latest()[1]["buckets"]
    table.apply(spark.createDataFrame([(5, 1)], schema), 1, ["id"], [F.col("v")])
    second = table.commits.latest()[1]["buckets"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    part = next(p for p in second.values() if p not in first.values())
    assert spark.read.parquet(f"{tmp_path}/t/parts/{part}").select("bucket").distinct().count() == 1
    table.apply(spark.range(100).select("id", F.lit(2).cast("long").alias("v")), 2, ["id"], [F.col("v")])
    assert len(table.vacuum(keep=1)) == 2 and table.read().agg(F.count("*"), F.sum("v")).first() == (100, 200)


def test_counters_equal_batch(spark, sf_dir, events_folder, tmp_path):
    schema = spark.read.parquet(events_folder).schema
    stream = index.read_stream(spark, events_folder, schema, files_per_batch=2)
    log = stream.select(
        F.when(F.col("event_id") % 10 == 3, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        (F.col("event_id") % 4 == 0).alias("degraded"),
        (F.col("event_id") % 2 == 0).alias("rerank_enabled"),
        (F.col("event_id") % 6 == 0).alias("rerank_used"),
        F.when(F.col("event_id") % 8 == 2, F.lit("no capacity left")).when(F.col("event_id") % 8 == 4, F.lit("model failed")).alias("rerank_reason"),
        F.when(F.col("event_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("value")).alias("queue_ms"),
        F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("inference_ms"),
    )
    metrics.count_requests(log, "counted", str(tmp_path / "c")).awaitTermination()
    assert spark.table("counted").first() == metrics.request_metrics(_log(spark, sf_dir)).first()


def test_windows_equal_batch(spark, events_folder, tmp_path):
    schema = spark.read.parquet(events_folder).schema
    q = index.windowed(index.read_stream(spark, events_folder, schema)).writeStream.outputMode("complete").format("memory").queryName("windows")
    q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, index.windowed(spark.read.parquet(events_folder)).collect()))


def test_cache(spark, tmp_path):
    rows = [("a", 0, "1"), ("a", 50, "2"), ("a", 100, "3"), ("b", 10, "4"), ("a", 130, "5")]
    df = spark.createDataFrame([(k, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s), v) for k, s, v in rows], "key string, ts timestamp, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = cache.cached(stream, 100).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.ts.second + 60 * r.ts.minute, r.hit, r.value) for r in spark.table("cached").collect())
    assert got == [("a", 0, False, "1"), ("a", 50, True, "1"), ("a", 100, False, "3"), ("a", 130, True, "3"), ("b", 10, False, "4")]
    with pytest.raises(ValueError):
        cache.cached(df, 0)


def test_cycles():
    slept, ran = [], []

    def cycle(k):
        ran.append(k)
        if k == 1:
            raise RuntimeError("broken")

    log = cycles.run_cycles(cycle, 60, lambda: len(ran) >= 3, slept.append)
    assert ran == [0, 1, 2] and slept == [60, 60] and [x["error"] for x in log] == [None, "broken", None]
    with pytest.raises(ValueError):
        cycles.check_interval(59)


def test_admission_and_loading():
    a, hold, held = cycles.Admission(1, 0.05), threading.Event(), threading.Event()
    t = threading.Thread(target=lambda: a.run(lambda: (held.set(), hold.wait(5))))
    t.start()
    held.wait(5)
    with pytest.raises(cycles.CapacityError):
        a.run(lambda: 1)
    hold.set()
    t.join()
    assert a.run(lambda: 2)[0] == 2
    calls = []

    def load():
        calls.append(1)
        raise OSError("gone")

    once = cycles.Once(load)
    for _ in range(2):
        with pytest.raises(OSError):
            once.get()
    assert len(calls) == 1 and cycles.Once(lambda: 5).get() == 5
