"""Picking the loans to model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.operators.temporal import first_per_key, without_earlier

MATURITY_DAYS = 90


def first_time_cohort(
    loans: DataFrame,
    product: str,
    since: Column | date,
    as_of: Column | date,
    maturity: DataFrame,
    maturity_days: int = MATURITY_DAYS,
) -> DataFrame:
    """Base loans of a product by customers with no earlier closed base loan.

    ``maturity`` has (loan_id, matures_on); a loan counts once that day is
    ``maturity_days`` or more before ``as_of``. Output: loan_id, customer_id.
    """
    as_of = F.lit(as_of)
    ripe = maturity.where(F.col("matures_on") <= F.date_sub(as_of, maturity_days)).select("loan_id")
    base = loans.where(F.col("base_loan_id").isNull())
    picked = (
        base.where(
            (F.col("loan_type_cd") == product)
            & (F.col("funding_date_actual") >= since)
            & ~F.col("status_cd").isin(*codes.UNFUNDED_STATUSES)
        )
        .select("id", "customer_id")
        .join(ripe, F.col("id") == F.col("loan_id"), "left_semi")
    )
    closed = base.where(F.col("status_cd").isin(*codes.REPEAT_STATUSES)).select("id", "customer_id")
    return without_earlier(picked, closed, "customer_id", "id").select(F.col("id").alias("loan_id"), "customer_id")


def chain_maturity(chains: DataFrame) -> DataFrame:
    """A payday chain matures on its due date."""
    return chains.select(F.col("base_loan_id").alias("loan_id"), F.col("loan_chain_due_date").cast("date").alias("matures_on"))


def installment_maturity(installments: DataFrame, number: int = 4) -> DataFrame:
    """An installment loan matures when installment ``number`` is due; two such
    rows for a loan are an error."""
    due = installments.where(F.col("installment_number") == number).groupBy("loan_id").agg(
        F.max(F.col("due_date").cast("date")).alias("matures_on"), F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit(f"installment {number} is not unique for loan "), F.col("loan_id").cast("string"))
    return due.where(
        F.when(F.col("n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).select("loan_id", "matures_on")


def statement_maturity(statements: DataFrame) -> DataFrame:
    """A line of credit matures when its first statement is due."""
    return statements.groupBy("loan_id").agg(F.min("due_date").cast("date").alias("matures_on"))


def first_funded(loans: DataFrame, as_of: Column | date, months: int = 36) -> DataFrame:
    """Each customer's lowest-id funded loan, if funded in the last ``months``."""
    as_of = F.lit(as_of)
    funded = loans.where(F.col("status_cd").isin(*codes.FUNDED_STATUSES) & F.col("customer_id").isNotNull())
    first = first_per_key(funded, ["customer_id"], ["id"], ["funding_date_actual"])
    return first.where(F.col("funding_date_actual") >= F.add_months(as_of, -months)).select(
        "customer_id", F.col("id").alias("loan_id"), "funding_date_actual")
