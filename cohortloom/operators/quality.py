"""Checks that run inside the plan and data-drift reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expect_one(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Fail the job when a key has two rows.

    Placed just before a join on the same keys, the count uses the shuffle and
    sort the join needs anyway.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat_ws(" ", F.lit(f"{what}: more than one row for"), *[F.col(k).cast("string") for k in keys])
    return (
        df.withColumn("__n", n)
        .where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        .drop("__n")
    )


def drift_report(df: DataFrame, **checks) -> DataFrame:
    """One row per named condition with the number of rows that meet it."""
    counts = df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in checks.items()])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(n), F.lit(0)).alias("row_count")) for n in checks]
    )
    return counts.select(F.inline(pairs))
