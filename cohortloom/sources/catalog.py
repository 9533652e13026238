"""Named input tables and the adapters that load them."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Catalog:
    """``{logical name -> DataFrame}``; a loader in its place runs on first use."""

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"table {name!r} is not in the catalog; known: {sorted(self._tables)}")
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return Catalog({**self._tables, **tables})


def parquet_catalog(spark: SparkSession, folder: str, names: list[str]) -> Catalog:
    """One parquet path per table; column pruning and filters reach the scan."""
    return Catalog({n: partial(spark.read.parquet, f"{folder}/{n}.parquet") for n in names})


def declared(df: DataFrame, schema: StructType) -> DataFrame:
    """Give rows from elsewhere a declared schema, by position."""
    if len(df.columns) != len(schema):
        raise ValueError(f"expected {len(schema)} columns, got {len(df.columns)}")
    return df.select(
        *[F.col(f"`{have}`").cast(f.dataType).alias(f.name) for have, f in zip(df.columns, schema)]
    )


def remote_query(
    spark: SparkSession,
    query: str,
    schema: StructType,
    env_prefix: str = "REMOTE_DB",
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """Rows of a query that a second database runs.

    Connection details come from ``<prefix>_URL``, ``_USER`` and ``_PASSWORD``;
    none are kept in code. ``split`` = (column, low, high, parts) reads the
    result in that many parallel parts instead of through one task.
    """
    options = {
        "url": os.environ[f"{env_prefix}_URL"],
        "user": os.environ[f"{env_prefix}_USER"],
        "password": os.environ[f"{env_prefix}_PASSWORD"],
    }
    if split:
        column, low, high, parts = split
        options.update(
            dbtable=f"({query}) q", partitionColumn=column,
            lowerBound=str(low), upperBound=str(high), numPartitions=str(parts),
        )
    else:
        options["query"] = query
    return declared(spark.read.format("jdbc").options(**options).load(), schema)


def integer_series(spark: SparkSession, low: int, high: int, name: str = "n") -> DataFrame:
    """Whole numbers from low to high, both included."""
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(name))
