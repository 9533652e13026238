"""Leads around an application and activity before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.operators.temporal import count_where, lookup, lookup_between, pick_min, total

BEFORE = "-3 days"
AFTER = "30 minutes"


def _purchased(type_cd: Column) -> Column:
    return type_cd.isin(*codes.PURCHASED_LEAD_TYPES)


def lead_flags(
    left: DataFrame, leads: DataFrame, by: dict[str, str], at: Column,
    low: str = BEFORE, high: str = AFTER,
    purchased_types=codes.PURCHASED_LEAD_TYPES,
) -> DataFrame:
    """Was there a lead, a bought one, a rejected one from three days before to
    half an hour after the moment, and who provided the first bought one."""
    bought = F.col("type_cd").isin(*purchased_types)
    found = lookup_between(
        left, leads, by, at, low, high, F.col("created_on"),
        [
            pick_min("__any", "id"),
            pick_min("__bought", "id", ["source_type_cd"], bought),
            pick_min("__rejected", "id", where=~bought),
        ],
    )
    return found.select(
        *left.columns,
        S.flag(F.col("__any").isNotNull()).alias("appeared_in_leads_flg"),
        S.flag(F.col("__bought").isNotNull()).alias("purchased_leads_flg"),
        S.flag(F.col("__rejected").isNotNull()).alias("rejected_leads_flg"),
        # A bought lead without a provider keeps its NULL.
        F.when(F.col("__bought").isNotNull(), F.col("__bought.source_type_cd"))
        .otherwise(F.lit(codes.ORGANIC)).alias("lead_provider"),
    )


def purchased_provider(left: DataFrame, leads: DataFrame, by: dict[str, str], at: Column, name: str) -> DataFrame:
    """Only the provider of the first bought lead in the window."""
    found = lookup_between(
        left, leads.where(_purchased(F.col("type_cd"))), by, at, BEFORE, AFTER, F.col("created_on"),
        [pick_min("__bought", "id", ["source_type_cd"])],
    )
    return found.withColumn(
        name, F.when(F.col("__bought").isNotNull(), F.col("__bought.source_type_cd")).otherwise(F.lit(codes.ORGANIC))
    ).drop("__bought")


def earlier_days(left: DataFrame, right: DataFrame, by: dict[str, str], at: Column, time: str, name: str) -> DataFrame:
    """Distinct calendar days with a right row strictly before the moment.

    A day counts from its first row on, so folding each (key, day) to its
    earliest moment turns the distinct count into a running count.
    """
    key = list(by.values())
    firsts = right.groupBy(*key, F.col(time).cast("date").alias("__day")).agg(F.min(time).alias("__first"))
    found = lookup(left, firsts, by, at, F.col("__first"), [count_where(name)], "before")
    return found.withColumn(name, F.coalesce(name, F.lit(0)))


def earlier_leads(
    left: DataFrame, leads: DataFrame, by: dict[str, str], at: Column,
    days_name: str, purchased_name: str, purchased_types=codes.PURCHASED_LEAD_TYPES,
) -> DataFrame:
    """Distinct lead days and bought leads whose *day* lies before the moment."""
    key = list(by.values())
    days = (
        leads.withColumn("__day", F.col("created_on").cast("date"))
        .groupBy(*key, "__day")
        .agg(F.count_if(F.col("type_cd").isin(*purchased_types)).alias("__bought"))
        .withColumn("__midnight", F.col("__day").cast("timestamp_ntz"))
    )
    found = lookup(left, days, by, at, F.col("__midnight"),
                   [count_where(days_name), total(purchased_name, F.col("__bought"))], "before")
    return found.withColumns({n: F.coalesce(n, F.lit(0)) for n in (days_name, purchased_name)})
