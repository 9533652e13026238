"""The two fee marts: first-platform curves and the merged curves."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from cohortloom.operators import curves as C
from cohortloom.operators.cohort import first_funded
from cohortloom.sources.stages import no_stage


def customer_net_fees(
    sources, as_of: date, customer_months: int = 36, curve_months: int = 30, keep=no_stage
) -> DataFrame:
    """Fee curve of each customer whose first funded loan is recent enough."""
    first = first_funded(sources["loans"], as_of, customer_months)
    curve = keep(C.cumulative_fee_curve(first, sources["cash_flow"], as_of, curve_months), "fee-curve")
    return C.status_switched_fees(curve, sources["loans"], sources["loan_statuses"], keep)


def second_platform_net_fees(sources, as_of: date, months: int = 48, keep=no_stage) -> DataFrame:
    """Fee curve of each account of the second platform, one folded row per account."""
    loans, statuses = sources["second_loans"], sources["second_loan_statuses"]
    accounts = C.second_platform_first_loan(
        loans, sources["second_loan_applications"], statuses, sources["second_identities"], sources["loans"], as_of)
    accounts = keep(accounts, "accounts")
    cashout = keep(
        C.monthly_cashout(accounts, loans, sources["second_loan_status_history"], as_of, months, folded=True), "cashout")
    net = C.monthly_net_cash(
        cashout, loans, statuses, sources["second_payments"], sources["second_activities"],
        sources["second_entries"], sources["second_entry_types"], sources["second_ledger_accounts"],
        folded=["net_fees"])
    return C.second_platform_fees(net)


def all_customer_net_fees(
    sources, as_of: date, cutoff: date, customer_months: int = 36, keep=no_stage
) -> DataFrame:
    """Both platforms in one curve per customer."""
    first = keep(customer_net_fees(sources, as_of, customer_months, keep=keep), "customer-net-fees")
    second = keep(second_platform_net_fees(sources, as_of, keep=keep), "second-net-fees")
    return C.merge_curves(first, second, cutoff)
