"""Published marts: whole versions only, old ones kept on failure, keyed ones joined without a shuffle."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators.curves import horizon_fee_lookup
from cohortloom.sources.marts import current_version, drop_old_versions, publish_mart, read_mart


def test_nothing_is_published_at_first(spark, tmp_path):
    assert current_version(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        read_mart(spark, str(tmp_path / "none"))


def test_a_build_reads_the_version_it_replaces(spark, tmp_path):
    path = str(tmp_path / "mart")
    publish_mart(spark.range(5).withColumn("v", F.lit("x")), path)
    before = read_mart(spark, path)
    after = publish_mart(before.withColumn("id", F.col("id") + 5).unionByName(before), path)
    assert sorted(r.id for r in after.collect()) == list(range(10)) and before.count() == 5


def test_a_failed_build_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "mart")
    publish_mart(spark.range(3), path)
    broken = spark.range(10).withColumn("id", F.when(F.col("id") > 8, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        publish_mart(broken, path)
    assert read_mart(spark, path).count() == 3


def test_versions_are_cleaned_up(spark, tmp_path):
    path = str(tmp_path / "mart")
    for n in range(4):
        publish_mart(spark.range(n), path)
    assert drop_old_versions(spark, path, keep=1) == 2 and drop_old_versions(spark, path, keep=1) == 0
    assert read_mart(spark, path).count() == 3


def test_partitions_are_pruned_and_empty_marts_are_read(spark, tmp_path):
    path = str(tmp_path / "mart")
    rows = spark.createDataFrame([(1, "202001"), (2, "202002")], "id long, month string")
    back = publish_mart(rows, path, partition_by="month")
    assert [r.id for r in back.where("month = '202002'").collect()] == [2]
    assert "PartitionFilters: [isnotnull(month" in back.where("month = '202002'")._jdf.queryExecution().executedPlan().toString()
    assert publish_mart(rows.limit(0), path, partition_by="month").count() == 0


def test_keyed_marts_join_and_fold_without_a_shuffle(spark, tmp_path, monkeypatch):
    """The reads behind the horizon fees: a fold and a join on the customer."""
    loans = spark.range(300).select(F.col("id").alias("loan_id"), (F.col("id") % 40).alias("customer_id"),
                                    F.lit("2015-01-01").cast("date").alias("funding_date_actual"))
    curve = spark.range(40 * 20).select((F.col("id") % 40).alias("customer_id"), (F.col("id") / 40 + 1).cast("int").alias("month_calculated"),
                                        F.col("id").cast("decimal(18,2)").alias("net_fees"))
    as_of = F.lit("2018-01-01").cast("date")
    want = sorted(horizon_fee_lookup(loans, curve, as_of).collect())
    publish_mart(loans, str(tmp_path / "loans"), key="customer_id", buckets=4)
    publish_mart(curve, str(tmp_path / "curve"), key="customer_id", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = horizon_fee_lookup(read_mart(spark, str(tmp_path / "loans")), read_mart(spark, str(tmp_path / "curve")), as_of)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_a_keyed_mart_needs_buckets(spark, tmp_path):
    with pytest.raises(ValueError):
        publish_mart(spark.range(1), str(tmp_path / "m"), key="id")
