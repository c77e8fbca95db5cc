"""Session settings that operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir itself, for tables that other sessions open by name."""
    ensure_checkpoints(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table below the checkpoint folder, read again: computed once, with columns that can be
    pruned, and nothing to recompute if an executor is lost."""
    ensure_checkpoints(df.sparkSession)
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; only in a
    local session that names none, as in tests, to a temporary one. Elsewhere that is an error:
    driver and executors would write to different disks."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(folder)
