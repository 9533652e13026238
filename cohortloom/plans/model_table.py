"""The whole model table of a product, from cohort to outcomes.

The narrow spine (one row per loan, ids and moments) is staged once. Report,
feature, rate and outcome stages each work on the few spine columns they need
and return (loan_id, new columns); they meet on loan_id at the end, so wide rows
are never shuffled by a second key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.operators import cohort as K
from cohortloom.operators import curves as C
from cohortloom.operators import features as X
from cohortloom.operators import outcomes as O
from cohortloom.operators import rates as R
from cohortloom.operators.leads import earlier_days, earlier_leads, lead_flags
from cohortloom.operators.temporal import first_event_within, lookup, pick_max, value_as_of
from cohortloom.plans.reports import REPORT_KEYS, REPORTS
from cohortloom.sources.stages import no_stage
from cohortloom.sources.stages import stage as write_stage

APPROVAL_COLUMNS = (
    "processed_on", "amount", "default_rate", "credit_score", "profitability_rate", "reason_cd", "pre_approved_flg",
    "existing_flg", "long_term_result_id", *REPORT_KEYS,
)
BANK_RATE_COLUMNS = (
    "routing_num", "bad_rate", "bad_rate_individual", "bad_rate_30", "bad_rate_individual_30", "bad_rate_60",
    "bad_rate_individual_60", "credit_union_flg", "bank_bad_rate_month",
)


@dataclass(frozen=True)
class Product:
    """How one product differs from the others."""

    loan_type: str
    maturity: Callable[..., DataFrame]
    outcome_table: str
    outcome_day: str
    outcome_flags: dict[str, str]  # rate name -> outcome column
    performance: Callable[..., list[DataFrame]]
    loan_columns: Sequence[str] = ()
    scores: dict[str, str] = field(default_factory=dict)  # output -> long-term result column
    fee_horizons: Sequence[int] = (6, 9, 12, 15, 18)
    first_statement: bool = False
    schedule: bool = False


# --- stage 1: spine ----------------------------------------------------------
def _with_approval(product: Product, sources, since: date, as_of: date, keep=no_stage) -> DataFrame:
    """Cohort loans with the latest earlier approval of a new customer. The lookup reads the cohort
    twice, to count and to fold, so it is kept."""
    loans = sources["loans"]
    cohort = K.first_time_cohort(loans, product.loan_type, since, as_of, product.maturity(sources))
    base = loans.join(cohort.select("loan_id"), F.col("id") == F.col("loan_id"), "left_semi").select(
        F.col("id").alias("loan_id"), "customer_id", "requested_time", "funding_date_actual", *product.loan_columns,
        F.col("amount").alias("loan_amount"), F.col("status_cd").alias("loan_status"),
        F.col("gov_law_state_cd").alias("state"))
    base = keep(base, "cohort")
    found = lookup(base, sources["approvals"], "customer_id", F.col("requested_time"), F.col("processed_on"),
                   [pick_max("a", "id", APPROVAL_COLUMNS)], "before").where(~F.col("a.existing_flg"))
    pre_approved = (F.col("a.profitability_rate") == 1) | (F.col("a.reason_cd") == "pre-approved") | F.col("a.pre_approved_flg")
    return found.select(
        *base.columns, F.col("a.id").alias("approval_id"), F.col("a.processed_on").alias("approval_processed"),
        F.col("a.amount").alias("approval_amount"), F.col("a.default_rate").alias("app_default_rate"),
        F.col("a.credit_score").alias("app_credit_score"), F.col("a.profitability_rate").alias("app_profitability_rate"),
        S.flag(pre_approved).alias("pre_approved_flg"), F.col("a.long_term_result_id").alias("__ltr"),
        *[F.col(f"a.{k}").alias(k) for k in REPORT_KEYS])


def build_spine(
    product: Product, sources, since: date, as_of: date, keep=no_stage
) -> DataFrame:
    """Cohort loans with what was known at application: one row per loan."""
    base = keep(_with_approval(product, sources, since, as_of, keep), "approved")
    application = sources["applications"].groupBy(F.col("loan_id").alias("__al")).agg(
        F.max("application_id").alias("application_id"))
    customer = [F.col("id").alias("__known"), F.col("person_id"), F.col("created_on").alias("customer_created")]
    asked, by = base.select("loan_id", "customer_id", "approval_processed"), {"customer_id": "customer_id"}
    at = F.col("approval_processed")
    shortly_before = at - F.expr("interval 3 days")
    parts = [
        X.pick(base, application, "loan_id", "__al", [F.col("application_id")]),
        X.pick(base, sources["customers"], "customer_id", "id", customer),
        earlier_days(asked, sources["approvals"], by, shortly_before, "processed_on",
                     "previous_application_count_dist_day"),
        earlier_leads(asked, sources["customer_sources"], by, shortly_before,
                      "previous_customer_sources_count_dist_day", "previously_purchased_count"),
        lead_flags(asked, sources["customer_sources"], by, at),
    ]
    parts[2:] = [p.drop("customer_id", "approval_processed") for p in parts[2:]]
    if product.scores:
        scores = [F.col(c).alias(out) for out, c in product.scores.items()]
        parts.append(X.pick(base, sources["long_term_results"], "__ltr", "id", scores))
    if product.first_statement:
        first = sources["statements"].groupBy(F.col("loan_id").alias("__sl")).agg(F.min("id").alias("first_statement_id"))
        parts.append(X.pick(base, first, "loan_id", "__sl", [F.col("first_statement_id")]))
    if product.schedule:
        dated = O.expected_schedule(base.select("loan_id", "funding_date_actual"), sources["installments"])
        parts.append(dated.drop("funding_date_actual"))
    return X.gather(base, parts).where(F.col("__known").isNotNull()).drop("__ltr", "__known")


# --- stages 2 and 3: reports and codes --------------------------------------
def report_stage(spine: DataFrame, sources) -> DataFrame:
    reports = X.report_star(spine.select("loan_id", *REPORT_KEYS), sources, REPORTS)
    flagged = X.code_flags(reports, "csidf_idfraud_indicators", codes.FRAUD_INDICATORS, "exact")
    flagged = X.code_flags(flagged, "csidf_reason_codes", codes.REASON_CODES, "contains")
    return flagged.drop(*REPORT_KEYS)


# --- stage 4: features -------------------------------------------------------
def feature_stage(spine: DataFrame, sources) -> DataFrame:
    at = F.col("approval_processed")
    base = spine.select("loan_id", "customer_id", "person_id", "application_id", "approval_processed", "customer_created")
    now = [F.col(c).alias(f"__now_{c}") for c in ("email", "income_type_cd", "income_payment_cd")]
    person = [F.col(c) for c in ("birth_date", "first_name", "last_name")]
    pay = [F.col(c) for c in ("paychecks_per_year", "income_freq_type_cd", "income_monthly_net")]
    # The address chain stays narrow: application -> address -> county.
    address_ids = X.pick(base, sources["application_address"], "application_id", "application_id", [F.col("address_id")])
    address = X.pick(address_ids, sources["addresses"], "address_id", "id", [F.col(c) for c in ("line1", "city", "zip")])
    bank = lookup(base, sources["bank_accounts"], "person_id", at, F.col("created_on"),
                  [pick_max("__bank", ["created_on", "payment_instrument_id"], ["routing_number"])], "until")
    bank = bank.select("loan_id", "approval_processed", F.col("__bank.routing_number").alias("__routing"))
    bank = R.month_rate_join(bank, sources["bank_bad_rates"], F.col("__routing"), at, "routing_num",
                             "bank_bad_rate_month", BANK_RATE_COLUMNS).drop("approval_processed", "__routing")
    day = at.cast("date")
    payday = first_event_within(base, sources["customer_paydates"], {"customer_id": "customer_id"}, day, "next_paydate",
                                F.date_add(day, 35), "__payday", side="after")
    tracked = ("email", "income_type_cd", "income_payment_cd")
    changed = value_as_of(base, sources["data_changes"], {"customer_id": "record_id"}, at, tracked, "customers")
    out = X.gather(base, [
        X.pick(base, sources["customers"], "customer_id", "id", now),
        X.pick(base, sources["people"], "person_id", "id", person),
        X.pick(base, sources["application_income"], "application_id", "application_id", pay),
        address,
        X.pick(address, sources["counties"], "zip", "zip", [F.col("gmt")]),
        bank,
        payday.select("loan_id", F.datediff("__payday.next_paydate", day).alias("days_before_next_payday")),
        changed.select("loan_id", *[F.col(f"{c}_before").alias(f"__old_{c}") for c in tracked]),
    ])
    out = out.withColumns({
        **{c: F.coalesce(f"__old_{c}", f"__now_{c}") for c in tracked},
        "customer_vintage_months": X.vintage_months(at, F.col("customer_created")),
    })
    out = X.calendar_features(out, "approval_processed", "gmt")
    out = X.contact_features(out, "email", "approval_processed", "birth_date", "first_name", "last_name", "line1", "city")
    out = X.income_features(out, "income_monthly_net", "paychecks_per_year")
    helpers = ("customer_id", "person_id", "application_id", "approval_processed", "customer_created", "birth_date",
               "first_name", "last_name", "line1", "city", "zip", "gmt")
    return out.drop(*helpers, *[f"__{w}_{c}" for w in ("now", "old") for c in tracked])


# --- stage 5: rates ----------------------------------------------------------
def rate_stage(spine: DataFrame, reports: DataFrame, product: Product, sources) -> DataFrame:
    base = spine.select("loan_id", "state", "lead_provider", "approval_processed").join(
        reports.select("loan_id", "rv_score"), "loan_id")
    new_customers = sources[product.outcome_table].where(~F.col("existing_flg"))
    rated = R.trailing_rates(
        base, new_customers, F.col("approval_processed"), product.outcome_day,
        {
            "state": (F.col("state"), F.col("state")),
            "lead": (F.col("lead_provider"), F.col("lead_provider")),
            "rv_score": (S.score_tier(F.col("rv_score")), F.col("rv_score_tier")),
        },
        {name: F.col(c) for name, c in product.outcome_flags.items()},
    )
    return rated.drop("state", "lead_provider", "approval_processed", "rv_score")


# --- stage 6: outcomes -------------------------------------------------------
_OUTCOME_BASE = ("loan_id", "customer_id", "funding_date_actual", "loan_amount", "loan_status", "approval_amount")


def payday_performance(base: DataFrame, sources, as_of: date) -> list[DataFrame]:
    used = base.withColumn("utilization_ratio", X.utilization_ratio(F.col("loan_amount"), F.col("approval_amount")))
    return [
        O.loan_performance_join(used, sources["payday_chains_performance"], sources["payday_loans_performance"]),
        O.repeat_loan_counts(base, sources["loans"], as_of),
    ]


def installment_loan_performance(base: DataFrame, sources, as_of: date) -> list[DataFrame]:
    return [
        O.installment_performance(base, sources["installments"], sources["installment_status_history"],
                                  sources["installment_loans_performance"], as_of),
        O.repeat_loan_counts(base, sources["loans"], as_of, all_loans=False),
    ]


def line_of_credit_performance(base: DataFrame, sources, as_of: date) -> list[DataFrame]:
    return [
        O.statement_performance(base, sources["statements"], sources["payment_transactions"], as_of),
        O.cash_flow_outcomes(base, sources["cash_flow"], as_of),
        O.payback_ratio(base, sources["statement_performance"]),
    ]


def outcome_parts(spine: DataFrame, product: Product, sources, as_of: date) -> list[DataFrame]:
    base = spine.select(*_OUTCOME_BASE)
    fees = C.horizon_fee_lookup(base, sources["all_customer_net_fees"], as_of, product.fee_horizons)
    known = [c for c in _OUTCOME_BASE if c != "loan_id"]
    return [part.drop(*known) for part in (*product.performance(base, sources, as_of), fees)]


# --- all ---------------------------------------------------------------------
def build_model_table(
    product: Product, sources, since: date, as_of: date, stage: bool = True
) -> DataFrame:
    """The complete table, one row per cohort loan.

    ``sources`` must hold the product's outcome table and
    ``all_customer_net_fees``, which are marts of their own. With ``stage`` the
    spine and the reports, which several stages read, are written once.
    """
    keep = write_stage if stage else no_stage
    spine = keep(build_spine(product, sources, since, as_of, keep), "spine")
    reports = keep(report_stage(spine, sources), "reports")
    return X.gather(spine.drop("person_id"), [
        reports,
        feature_stage(spine, sources),
        rate_stage(spine, reports, product, sources),
        *outcome_parts(spine, product, sources, as_of),
    ])


PAYDAY = Product(
    loan_type="payday",
    maturity=lambda s: K.chain_maturity(s["payday_chains_performance"]),
    outcome_table="payday_outcomes",
    outcome_day="due_date_adjusted",
    outcome_flags={"def": "initial_default_flg", "ext": "extended_flg"},
    performance=payday_performance,
    loan_columns=("due_date_adjusted",),
    scores={"app_six_month_score": "six_month_score", "app_twelve_month_score": "twelve_month_score"},
    fee_horizons=(3, 6, 9, 12, 15, 18),
)
# Payday loans through a credit services organisation: same flow, other code, no six-month score.
CSO = Product(**{**PAYDAY.__dict__, "loan_type": "cso", "scores": {"app_twelve_month_score": "twelve_month_score"}})
INSTALLMENT = Product(
    loan_type="installment",
    maturity=lambda s: K.installment_maturity(s["installments"]),
    outcome_table="installment_outcomes",
    outcome_day="first_installment_due_date",
    outcome_flags={"def": "first_installment_initial_default_flg"},
    performance=installment_loan_performance,
    loan_columns=("due_date", "due_date_adjusted"),
    scores={**PAYDAY.scores, "app_twelve_month_score_adjusted": "twelve_month_score_adj"},
    schedule=True,
)
LINE_OF_CREDIT = Product(
    loan_type="oec",
    maturity=lambda s: K.statement_maturity(s["statements"]),
    outcome_table="line_of_credit_outcomes",
    outcome_day="first_statement_due_date",
    outcome_flags={"def": "first_statement_initial_default_flag"},
    performance=line_of_credit_performance,
    first_statement=True,
)
PRODUCTS = {"payday": PAYDAY, "cso": CSO, "installment": INSTALLMENT, "line_of_credit": LINE_OF_CREDIT}
