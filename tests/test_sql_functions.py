"""SQL functions against the column functions and plain Python."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.functions.sql import register_functions


@pytest.fixture(scope="module")
def sql(spark):
    register_functions(spark)
    register_functions(spark)
    return spark.sql


def test_nice_div(sql):
    assert tuple(sql("select nice_div(7, 2), nice_div(1, 0), nice_div(null, 2), nice_div(1, null)").first()) == (3.5, None, None, None)


def test_issued(sql):
    some = codes.FUNDED_STATUSES[0]
    assert tuple(sql(f"select issued('{some}'), issued('declined'), issued(null)").first()) == (True, False, None)


@pytest.mark.parametrize("n", [1, 4, 5, 11])
def test_business_days(spark, sql, n):
    days = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i),) for i in range(30)] + [(None,)], "d date")
    rows = spark.sql(f"select d, add_business_days(d, {n}) as got from {{days}}", days=days).withColumn(
        "want", S.add_business_days(F.col("d"), n)).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(r["got"] is not None for r in rows) == 30


def test_series(sql):
    assert [r.n for r in sql("select n from integer_series(2, 5)").collect()] == [2, 3, 4, 5]
    assert sql("select n from integer_series(3, 2)").count() == 0


def test_series_beside_rows_is_no_cross_join(spark, sql):
    rows = spark.sql("select t.id, s.n from {t} t, lateral integer_series(1, cast(t.id as int)) s", t=spark.range(4))
    assert sorted(map(tuple, rows.collect())) == [(i, n) for i in range(4) for n in range(1, i + 1)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
