"""Every registered query against its SQL; those without SQL must return rows."""

import pytest
from same import same_rows

from lodestone.plans import evaluation, holdout, refresh, retrieval, tables, text, urls

ALL = text.QUERIES | retrieval.QUERIES | evaluation.QUERIES | urls.QUERIES | tables.QUERIES | refresh.QUERIES | holdout.QUERIES


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, duck, name):
    query, sql = ALL[name]
    if sql:
        same_rows(query(spark, sf_dir), duck, sql)
    else:
        assert query(spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    query, _ = retrieval.QUERIES["hybrid_search"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(query(spark, sf_dir).collect()))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
