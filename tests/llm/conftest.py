import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(schema, rows): a DataFrame, in several partitions where it has several rows."""

    def make(schema, rows, parts=3):
        df = spark.createDataFrame(rows, schema)
        return df.repartition(parts) if len(rows) > 1 else df

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
