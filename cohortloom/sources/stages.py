"""Written stages inside one job. Tables that others read are published: see ``marts``."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    There is no fallback: a folder on one machine would be empty for the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage that several later steps read, and go on from the file.

    This cuts the lineage in storage all executors share, so losing an executor
    costs no recomputation, and the file's size lets AQE choose join sides.
    """
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """Write frames of one schema one after the other, and go on from all their files. Each is asked
    for when the one before it is written."""
    paths = []
    for df in frames:
        if not paths:
            folder = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        paths.append(f"{folder}/{len(paths)}")
        df.write.mode("errorifexists").parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Jobs that begin inside remove their shuffle files when they end. Else these stay until the
    driver happens to collect its garbage, and those of many stages lie on disk together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def no_stage(df: DataFrame, name: str) -> DataFrame:
    """In place of ``stage`` where one lazy plan is wanted."""
    return df
