import pytest

import __spark_entry__ as entry
from earshot.oracle import ORACLE
from earshot.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_merges_occur(spark, sf):
    assert QUERIES["auto_merge"](spark, sf).where("level = 'parent'").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_result_does_not_depend_on_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, QUERIES["auto_merge"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, QUERIES["auto_merge"](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scope_reaches_the_scan(spark, sf):
    plan = QUERIES["knn_scoped"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan
