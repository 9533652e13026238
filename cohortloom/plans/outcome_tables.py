"""Loan-level outcome tables, one per product family. The trailing rates read them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.operators import outcomes as O
from cohortloom.operators.features import gather, pick
from cohortloom.operators.leads import purchased_provider
from cohortloom.operators.temporal import first_per_key, lookup, pick_max
from cohortloom.sources.stages import no_stage


def _funded_base_loans(loans: DataFrame, loan_type: str) -> DataFrame:
    return loans.where(
        (F.col("loan_type_cd") == loan_type)
        & F.col("base_loan_id").isNull()
        & ~F.col("status_cd").isin(*codes.UNFUNDED_STATUSES)
    ).withColumnRenamed("id", "loan_id")


def _segments(rows: DataFrame, sources) -> list[DataFrame]:
    """Provider, score tier and existing flag of each loan, as parts to gather."""
    asked = rows.select("loan_id", "customer_id", "requested_time")
    request = F.col("requested_time")
    provider = purchased_provider(
        asked, sources["customer_sources"], {"customer_id": "customer_id"}, request, "lead_provider")
    approved = lookup(asked, sources["approvals"], "customer_id", request, F.col("processed_on"),
                      [pick_max("__approval", "id", ["risk_view_report_id"])], "until")
    approved = approved.select("loan_id", F.col("__approval.risk_view_report_id").alias("__report"))
    score = pick(approved, sources["risk_view_reports"], "__report", "id", [F.col("score").alias("__score")])
    existing = O.existing_flag(rows.select("loan_id", "customer_id", "funding_date_actual"), sources["loans"])
    return [provider.select("loan_id", "lead_provider"), score, existing.select("loan_id", "existing_flg")]


def _result(rows: DataFrame, parts: list[DataFrame], day: str, first: list[str], flags: list[str]) -> DataFrame:
    return gather(rows, parts).select(
        "loan_id", *first, F.col(day).cast("date").alias(day), S.month_key(F.col(day)).alias("month_year"),
        F.col("gov_law_state_cd").alias("state"), "lead_provider", S.score_tier(F.col("__score")).alias("rv_score_tier"),
        "existing_flg", *flags,
    )


_LOAN_COLUMNS = ["loan_id", "customer_id", "requested_time", "funding_date_actual", "gov_law_state_cd"]


def payday_outcomes(sources, low: date, high: date, loan_type: str = "payday", keep=no_stage) -> DataFrame:
    """Default and extension flags by loan due date."""
    rows = _funded_base_loans(sources["loans"], loan_type).where(F.col("due_date_adjusted").between(low, high))
    rows = keep(rows.select(*_LOAN_COLUMNS, "due_date_adjusted"), "payday-loans")
    ids = rows.select("loan_id")
    parts = [
        *_segments(rows, sources),
        O.status_default_flag(ids, sources["loan_statuses"], "initial_default_flg"),
        O.extended_flag(ids, sources["loans"]),
    ]
    return _result(rows, parts, "due_date_adjusted", [], ["initial_default_flg", "extended_flg"])


def installment_outcomes(sources, low: date, high: date, loan_type: str = "installment", keep=no_stage) -> DataFrame:
    """Default flag of the first installment, by its due date."""
    first = first_per_key(
        sources["installments"].where(F.col("installment_number") == 1), ["loan_id"], ["id"], ["due_date"],
    ).select("loan_id", F.col("id").alias("first_installment_id"), F.col("due_date").alias("first_installment_due_date"))
    rows = _funded_base_loans(sources["loans"], loan_type).select(*_LOAN_COLUMNS).join(
        first.where(F.col("first_installment_due_date").between(low, high)), "loan_id")
    rows = keep(rows, "installment-loans")
    flag = "first_installment_initial_default_flg"
    bad = O.installment_default_flag(rows.select("loan_id", "first_installment_id"),
                                     sources["installment_status_history"], flag, "first_installment_id")
    parts = [*_segments(rows, sources), bad.select("loan_id", flag)]
    return _result(rows, parts, "first_installment_due_date", ["first_installment_id"], [flag])


def line_of_credit_outcomes(
    sources, low: date, high: date, loan_type: str = "oec", holidays=(), keep=no_stage
) -> DataFrame:
    """Default flag of the first statement, by its due date."""
    first = first_per_key(sources["statements"], ["loan_id"], ["id"], ["due_date", "due_date_adjusted"]).select(
        "loan_id", F.col("id").alias("first_statement_id"), F.col("due_date").alias("first_statement_due_date"),
        F.coalesce("due_date_adjusted", "due_date").cast("date").alias("__due"))
    rows = _funded_base_loans(sources["loans"], loan_type).select(*_LOAN_COLUMNS).join(
        first.where(F.col("first_statement_due_date").between(low, high)), "loan_id")
    rows = keep(rows, "line-of-credit-loans")
    flag = "first_statement_initial_default_flag"
    bad = O.uncollected_default_flag(rows.select("loan_id", "__due"), sources["payment_transactions"], F.col("__due"),
                                     flag, holidays=holidays)
    parts = [*_segments(rows, sources), bad.select("loan_id", flag)]
    return _result(rows, parts, "first_statement_due_date", ["first_statement_id"], [flag])
