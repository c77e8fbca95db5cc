"""Operational counters over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CAPACITY = "capacity"


def observed(c: Column) -> Column:
    """A finite, non-negative measurement, or null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")) & (c >= 0), c)


def timing(name: str, c: Column) -> list[Column]:
    v = observed(c)
    return [F.count(v).alias(f"{name}_count"), F.round(F.coalesce(F.sum(v), F.lit(0.0)), 6).alias(f"{name}_sum"), F.coalesce(F.max(v), F.lit(0.0)).alias(f"{name}_max")]


def request_metrics(log: DataFrame, *by: str) -> DataFrame:
    """`log`: status (ok or error), degraded, rerank_enabled, rerank_used,
    rerank_reason (null unless the rerank was degraded), queue_ms, inference_ms."""
    ok = F.col("status") == "ok"
    capacity = F.contains("rerank_reason", F.lit(CAPACITY))
    reason = F.col("rerank_reason").isNotNull()
    sums = [
        F.count("*").alias("requests"),
        F.count_if(ok).alias("successes"),
        F.count_if(F.col("status") == "error").alias("backend_errors"),
        F.count_if(ok & F.col("degraded")).alias("degraded"),
        F.count_if(ok & F.col("rerank_enabled")).alias("rerank_enabled"),
        F.count_if(ok & F.col("rerank_used")).alias("rerank_used"),
        F.count_if(ok & reason).alias("rerank_degraded"),
        F.count_if(ok & reason & capacity).alias("capacity_fallbacks"),
        F.count_if(ok & reason & ~capacity).alias("other_degradations"),
        *timing("queue_ms", F.when(ok, F.col("queue_ms"))),
        *timing("inference_ms", F.when(ok, F.col("inference_ms"))),
    ]
    return log.groupBy(*by).agg(*sums) if by else log.agg(*sums)


def outcomes(rows: DataFrame, key: str, value: str, error: Column) -> DataFrame:
    """One row per input, in error or not: key, ok, value (null in error), error."""
    return rows.select(key, error.isNull().alias("ok"), F.when(error.isNull(), F.col(value)).alias("value"), error.alias("error"))


def measured_write(df: DataFrame, path: str, *totals: Column) -> dict:
    """Writes `df` as Parquet and returns totals (named aggregates) of what was written, gathered by the same pass."""
    seen = Observation()
    df.observe(seen, *totals).write.parquet(path)
    return seen.get


#: What a run's totals are made of, as event logs hold it.
TASK = """Event string, `Task Info` struct<`Executor ID`:string, Failed:boolean>,
  `Task Metrics` struct<`Executor CPU Time`:bigint, `Executor Run Time`:bigint, `JVM GC Time`:bigint, `Peak Execution Memory`:bigint,
    `Memory Bytes Spilled`:bigint, `Disk Bytes Spilled`:bigint, `Input Metrics`:struct<`Bytes Read`:bigint>, `Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint>>,
  `Task Executor Metrics` {memory}, `Executor Metrics` {memory}""".format(memory="struct<JVMHeapMemory:bigint, JVMOffHeapMemory:bigint, ProcessTreeJVMRSSMemory:bigint, ProcessTreePythonRSSMemory:bigint>")
MIB = 1024.0 * 1024.0


def run_totals(spark: SparkSession, logs: str) -> DataFrame:
    """One row an application of the event logs below `logs` (spark.eventLog.dir, written with spark.eventLog.compress=false): tasks,
    failed_tasks, executors, cpu_seconds, run_seconds, gc_seconds, peak_task_mib, peak_process_mib, input_bytes, shuffle_bytes,
    spilled_bytes. Times and bytes are of all attempts. peak_process_mib is the largest executor's resident set, JVM and Python
    together, where spark.executor.processTreeMetrics.enabled is set, else its JVM's heap and other memory; it is of polls (set
    spark.executor.metrics.pollingInterval, and spark.eventLog.logStageExecutorMetrics for those of stages), null where there was none. Lines
    that are cut off don't count; an application without tasks has no row."""
    lines = spark.read.option("recursiveFileLookup", "true").text(logs).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.filter(F.col("value").rlike('"SparkListener(TaskEnd|StageExecutorMetrics)"'))
    rows = lines.select(F.regexp_extract("path", r"(?:eventlog_v2_|events_[0-9]+_)?([^/]+?)(?:\.inprogress)?$", 1).alias("application"), F.from_json("value", TASK).alias("e"))
    ended = F.col("e.Event") == "SparkListenerTaskEnd"
    of = lambda part, name: F.coalesce(F.col(f"e.`{part}`.{name}"), F.lit(0))
    m = lambda name: of("Task Metrics", name)
    p = lambda name: F.coalesce(F.col(f"e.`Task Executor Metrics`.{name}"), of("Executor Metrics", name))
    tree = p("ProcessTreeJVMRSSMemory") + p("ProcessTreePythonRSSMemory")
    memory = F.when(tree > 0, tree).otherwise(p("JVMHeapMemory") + p("JVMOffHeapMemory"))
    seconds = lambda c, unit: F.round(F.sum(c) / unit, 3)
    return rows.groupBy("application").agg(
        F.count_if(ended).alias("tasks"),
        F.count_if(F.col("e.`Task Info`.Failed")).alias("failed_tasks"),
        F.count_distinct("e.`Task Info`.`Executor ID`").alias("executors"),
        seconds(m("`Executor CPU Time`"), 1e9).alias("cpu_seconds"),
        seconds(m("`Executor Run Time`"), 1e3).alias("run_seconds"),
        seconds(m("`JVM GC Time`"), 1e3).alias("gc_seconds"),
        F.round(F.max(m("`Peak Execution Memory`")) / MIB, 3).alias("peak_task_mib"),
        F.round(F.max(F.nullif(memory, F.lit(0))) / MIB, 3).alias("peak_process_mib"),
        F.sum(m("`Input Metrics`.`Bytes Read`")).alias("input_bytes"),
        F.sum(m("`Shuffle Write Metrics`.`Shuffle Bytes Written`")).alias("shuffle_bytes"),
        F.sum(m("`Memory Bytes Spilled`") + m("`Disk Bytes Spilled`")).alias("spilled_bytes"),
    ).filter("tasks > 0")
