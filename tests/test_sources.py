"""Catalog, written tables, declared schemas, and the contract file."""

import pytest
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from cohortloom.sources.catalog import Catalog, declared, integer_series, parquet_catalog, remote_query
from cohortloom.sources.stages import stage


def test_stage_reads_back_the_same_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, v string")
    assert sorted(stage(df, "t").collect()) == sorted(df.collect())


def test_catalog_loads_on_first_use(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    tables = parquet_catalog(spark, str(tmp_path), ["a", "missing"])
    assert tables["a"].count() == 3 and "missing" in tables
    with pytest.raises(KeyError, match="known"):
        Catalog({})["b"]


def test_declared_schema(spark):
    schema = StructType([StructField("k", LongType()), StructField("v", DecimalType(10, 2))])
    out = declared(spark.createDataFrame([("7", "1.5")], "a string, b string"), schema)
    assert out.schema == schema and str(out.collect()[0].v) == "1.50"
    with pytest.raises(ValueError):
        declared(spark.range(1), schema)


def test_remote_query_takes_secrets_from_the_environment_only(spark, monkeypatch):
    monkeypatch.delenv("REMOTE_DB_URL", raising=False)
    with pytest.raises(KeyError, match="REMOTE_DB_URL"):
        remote_query(spark, "select 1", StructType([]))


def test_integer_series(spark):
    assert [r.n for r in integer_series(spark, 1, 30).collect()] == list(range(1, 31))
