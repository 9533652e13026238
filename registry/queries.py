"""Every registered Spark query: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.functions.sql import register_functions
from cohortloom.operators import cohort as K
from cohortloom.operators import curves as C
from cohortloom.operators import features as X
from cohortloom.operators import leads as L
from cohortloom.operators import outcomes as O
from cohortloom.operators import rates as R
from cohortloom.operators import temporal as T
from cohortloom.operators.quality import drift_report
from cohortloom.plans import fee_marts, model_table, outcome_tables
from cohortloom.plans.reports import REPORTS
from cohortloom.session import configure
from cohortloom.sources.marts import publish_mart, read_mart
from cohortloom.sources.stages import stage, stage_folder
from registry.edge import plain
from registry.views import catalog, raw

SINCE = date(1995, 6, 1)
AS_OF = date(2001, 6, 30)
OUTCOMES_FROM, OUTCOMES_TO = date(1995, 3, 1), date(2001, 12, 31)
MERGE_CUTOFF = date(1998, 1, 1)
CURVE_AGE_MONTHS = 72

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(fn(configure(spark), folder))

    QUERIES[fn.__name__] = run
    return fn


def _events(spark, folder, kind):
    return raw(spark, folder, "events").where(F.col("event_type") == kind)


# --- cohorts -----------------------------------------------------------------
def _cohort(spark, folder, product):
    s = catalog(spark, folder)
    p = model_table.PRODUCTS[product]
    return K.first_time_cohort(s["loans"], p.loan_type, SINCE, AS_OF, p.maturity(s))


@query
def first_time_cohort(spark, folder):
    return _cohort(spark, folder, "payday")


@query
def matured_first_item(spark, folder):
    return _cohort(spark, folder, "line_of_credit")


@query
def matured_nth_item(spark, folder):
    return _cohort(spark, folder, "installment")


# --- point-in-time lookups ---------------------------------------------------
def _latest_click(spark, folder, side):
    found = T.lookup(_events(spark, folder, "purchase"), _events(spark, folder, "click"), "user_id", F.col("ts"),
                     F.col("ts"), [T.pick_max("click", "event_id", ["value", "props"])], side)
    return found.select("event_id", "user_id", F.col("click.event_id").alias("click_id"),
                        F.col("click.value").alias("click_value"), F.col("click.props").alias("click_props"))


@query
def asof_latest_strict(spark, folder):
    return _latest_click(spark, folder, "before")


@query
def asof_latest_inclusive(spark, folder):
    """Every event looks at all events of its user, so it also finds itself."""
    events = raw(spark, folder, "events")
    found = T.lookup(events, events, "user_id", F.col("ts"), F.col("ts"), [T.pick_max("latest", "event_id")], "until")
    return found.select("event_id", "user_id", F.col("latest.event_id").alias("latest_id"))


@query
def asof_latest_by_time(spark, folder):
    s = catalog(spark, folder)
    found = T.lookup(s["approvals"], s["bank_accounts"], {"customer_id": "person_id"}, F.col("processed_on"),
                     F.col("created_on"),
                     [T.pick_max("bank", ["created_on", "payment_instrument_id"], ["routing_number"])], "until")
    return found.select("id", F.col("bank.payment_instrument_id").alias("instrument_id"),
                        F.col("bank.routing_number").alias("routing_number"))


@query
def asof_next_within(spark, folder):
    s = catalog(spark, folder)
    day = F.col("processed_on").cast("date")
    found = T.first_event_within(s["approvals"], s["customer_paydates"], {"customer_id": "customer_id"}, day,
                                 "next_paydate", F.date_add(day, 35), "payday", side="after")
    return found.select("id", F.datediff("payday.next_paydate", day).alias("days_before_next_payday"))


def _lead_flags(spark, folder, *window):
    leads = raw(spark, folder, "events").where(F.col("event_type") != "purchase").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_on"), F.col("event_type").alias("type_cd"),
        F.col("props").alias("source_type_cd"))
    return L.lead_flags(_events(spark, folder, "purchase").select("event_id", "user_id", "ts"), leads,
                        {"user_id": "user_id"}, F.col("ts"), *window, purchased_types=("click", "view"))


@query
def window_pick_flags(spark, folder):
    return _lead_flags(spark, folder)


@query
def window_pick_half_hour(spark, folder):
    return _lead_flags(spark, folder, "-30 minutes", "0 minutes")


@query
def window_pick_months(spark, folder):
    return _lead_flags(spark, folder, "-18 months", "-1 day")


@query
def history_counts(spark, folder):
    purchases = _events(spark, folder, "purchase").select("event_id", "user_id", "ts")
    before = F.col("ts") - F.expr("interval 3 days")
    out = L.earlier_days(purchases, _events(spark, folder, "signup"), {"user_id": "user_id"}, before, "ts", "signup_days")
    leads = raw(spark, folder, "events").where(F.col("event_type") != "purchase").select(
        "user_id", F.col("ts").alias("created_on"), F.col("event_type").alias("type_cd"))
    return L.earlier_leads(out, leads, {"user_id": "user_id"}, before, "lead_days", "bought_leads", ("click", "view"))


@query
def value_as_of(spark, folder):
    s = catalog(spark, folder)
    base = s["approvals"].select("id", "customer_id", "processed_on").join(
        s["customers"].select(F.col("id").alias("__c"), "email", "income_type_cd", "income_payment_cd"),
        F.col("customer_id") == F.col("__c"))
    tracked = ("email", "income_type_cd", "income_payment_cd")
    found = T.value_as_of(base, s["data_changes"], {"customer_id": "record_id"}, F.col("processed_on"), tracked, "customers")
    return found.select("id", *[F.coalesce(f"{c}_before", c).alias(f"{c}_then") for c in tracked])


@query
def latest_status(spark, folder):
    s = catalog(spark, folder)
    return T.last_per_key(s["loan_statuses"], ["loan_id"], ["id"], ["status_cd", "eff_start_time"])


@query
def first_rows_with_ties(spark, folder):
    s = catalog(spark, folder)
    return T.first_with_ties(s["cash_flow"].where(F.col("sub_type_cd") == codes.PAYMENT), ["loan_id"],
                             "loan_task_committed_id", {"amount": F.col("total_amount")})


@query
def distinct_on_first(spark, folder):
    s = catalog(spark, folder)
    flows = s["cash_flow"].select("loan_id", "eff_date", "sub_type_cd", "misc_fees", "loan_task_committed_id", "total_amount")
    return T.distinct_on(flows, ["loan_id"], [
        *T.nulls_last(F.col("sub_type_cd")), *T.negated_nulls_first(F.col("misc_fees")), F.col("eff_date"),
        F.col("loan_task_committed_id"), F.col("total_amount")])


# --- features ----------------------------------------------------------------
@query
def report_star(spark, folder):
    s = catalog(spark, folder)
    keys = [spec.key for spec in REPORTS]
    out = X.report_star(s["approvals"].select(F.col("id").alias("loan_id"), *keys), s, REPORTS)
    return out.drop(*keys)


@query
def code_flags_exact(spark, folder):
    reports = catalog(spark, folder)["subprime_id_fraud_reports"].select("id", "csidf_idfraud_indicators")
    return X.code_flags(reports, "csidf_idfraud_indicators", codes.FRAUD_INDICATORS, "exact")


@query
def code_flags_contains(spark, folder):
    reports = catalog(spark, folder)["subprime_id_fraud_reports"].select("id", "csidf_reason_codes")
    return X.code_flags(reports, "csidf_reason_codes", codes.REASON_CODES, "contains")


@query
def calendar_features(spark, folder):
    zones = raw(spark, folder, "customer").join(raw(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    zones = zones.select(F.col("c_custkey").alias("user_id"), (F.col("n_regionkey") - 10).alias("gmt"))
    return X.calendar_features(raw(spark, folder, "events").select("event_id", "user_id", "ts").join(zones, "user_id", "left"),
                               "ts", "gmt")


@query
def contact_features(spark, folder):
    s = catalog(spark, folder)
    base = s["approvals"].select(F.col("id").alias("loan_id"), "customer_id", "processed_on")
    base = X.gather(base, [
        X.pick(base, s["customers"], "customer_id", "id", [F.col("email")]),
        X.pick(base, s["people"], "customer_id", "id", [F.col(c) for c in ("birth_date", "first_name", "last_name")]),
        X.pick(base, s["addresses"], "customer_id", "id", [F.col("line1"), F.col("city")]),
    ])
    out = X.contact_features(base, "email", "processed_on", "birth_date", "first_name", "last_name", "line1", "city")
    return out.drop("customer_id", "processed_on", "birth_date", "first_name", "last_name", "line1", "city")


@query
def url_text_features(spark, folder):
    """The same text functions on page addresses: host, digits, their place."""
    url = F.col("url")
    host = S.part(url, "/", 3)
    path = F.substr(url, F.lit(9))
    run = S.first_digit_run(path)
    return raw(spark, folder, "pages").select(
        "page_id", host.alias("host"), S.digit_count(path).alias("digits"), run.alias("first_run"),
        (F.position(run, path) != F.length(path) - F.length(run) + 1).alias("digit_not_end"),
        url.rlike("[-._]").alias("has_mark"), F.levenshtein(host, F.lit("www.example.org")).alias("distance"),
        S.flag(url == F.lower(url)).alias("is_lower"), F.right(url, F.lit(2)).alias("tail"))


@query
def income_features(spark, folder):
    income = catalog(spark, folder)["application_income"]
    return X.income_features(income, "income_monthly_net", "paychecks_per_year")


@query
def vintage_and_utilization(spark, folder):
    s = catalog(spark, folder)
    joined = s["approvals"].join(s["customers"].select(F.col("id").alias("__c"), "created_on"),
                                 F.col("customer_id") == F.col("__c"))
    return joined.select("id", X.vintage_months(F.col("processed_on"), F.col("created_on")).alias("customer_vintage_months"),
                         X.utilization_ratio(F.col("amount"), F.col("credit_score")).alias("utilization_ratio"))


@query
def month_key_rate_join(spark, folder):
    s = catalog(spark, folder)
    base = s["bank_accounts"].select("payment_instrument_id", "created_on", "routing_number")
    return R.month_rate_join(base, s["bank_bad_rates"], F.col("routing_number"), F.col("created_on"), "routing_num",
                             "bank_bad_rate_month", model_table.BANK_RATE_COLUMNS)


@query
def score_tier(spark, folder):
    reports = catalog(spark, folder)["risk_view_reports"]
    score = F.when(F.col("score") > 505, F.col("score"))
    return reports.select("id", S.score_tier(score).alias("rv_score_tier"))


@query
def business_days(spark, folder):
    s = catalog(spark, folder)
    holidays = (date(1997, 12, 25), date(1998, 1, 1), date(1998, 7, 3))
    due = F.col("due_date_adjusted")
    return s["loans"].select("id", S.add_business_days(due, 5).alias("five_on"), S.add_business_days(due, 1).alias("one_on"),
                             S.add_business_days(due, 5, holidays).alias("five_on_with_holidays"),
                             S.weekday_from_sunday(due).alias("weekday"), S.month_key(due).alias("month_year"))


@query
def sql_text_functions(spark, folder):
    """A query in SQL text that calls the registered scalar and table functions."""
    register_functions(spark)
    return spark.sql("""
        select l.id as loan_id, s.n, add_business_days(l.due_date_adjusted, s.n) as due_on, issued(l.status_cd) as is_issued,
               round(nice_div(l.amount, s.n - 2), 6) as part
        from {loans} l, lateral integer_series(1, 1 + month(l.due_date_adjusted) % 3) s""", loans=catalog(spark, folder)["loans"])


@query
def regex_ledger_flags(spark, folder):
    account = F.col("account")
    return catalog(spark, folder)["second_ledger_accounts"].select(
        "account_id", S.matches_any(account, codes.CASH_IN_WORDS).alias("cash_word"),
        S.matches_any(account, codes.FEE_WORDS, ignore_case=True).alias("fee_word"),
        S.any_word_matches(codes.KNOWN_WORDS, account).alias("known_word"))


@query
def drift_counts(spark, folder):
    s = catalog(spark, folder)
    return drift_report(s["second_loans"], unexpected_region=~F.col("region_id").isin(*codes.SECOND_REGIONS),
                        unfunded_status=~F.col("loan_status_id").isin(*codes.SECOND_FUNDED_STATUS_IDS))


# --- outcome tables and rates ------------------------------------------------
def _outcome_table(spark, folder, build, loan_type):
    return build(catalog(spark, folder), OUTCOMES_FROM, OUTCOMES_TO, loan_type, keep=stage)


@query
def loan_outcomes_child(spark, folder):
    return _outcome_table(spark, folder, outcome_tables.payday_outcomes, "payday")


@query
def loan_outcomes_first_item(spark, folder):
    return _outcome_table(spark, folder, outcome_tables.installment_outcomes, "installment")


@query
def loan_outcomes_business_days(spark, folder):
    return _outcome_table(spark, folder, outcome_tables.line_of_credit_outcomes, "oec")


@query
def existing_and_extended_flags(spark, folder):
    loans = catalog(spark, folder)["loans"]
    base = loans.select(F.col("id").alias("loan_id"), "customer_id", "funding_date_actual")
    flagged = O.extended_flag(O.existing_flag(base, loans), loans)
    return flagged.select("loan_id", "existing_flg", "extended_flg")


def _rate_sides(spark, folder):
    """Approvals with their segment values, and sold items as outcomes."""
    s = catalog(spark, folder)
    customers = raw(spark, folder, "customer").select(F.col("c_custkey").alias("__c"), "c_nationkey", "c_acctbal")
    tier = S.score_tier(F.lit(500) + F.col("c_acctbal") / 75)
    base = s["approvals"].select("id", "customer_id", "processed_on", F.col("reason_cd")).join(
        customers, F.col("customer_id") == F.col("__c")).join(
        raw(spark, folder, "orders").select(F.col("o_orderkey").alias("__o"), "o_orderpriority"), F.col("id") == F.col("__o"))
    base = base.select("id", "processed_on", F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"),
                       tier.alias("tier"))
    sold = raw(spark, folder, "lineitem").join(raw(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("__c")).select(
        "l_shipdate", F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), tier.alias("tier"),
        S.flag(F.col("l_returnflag") == "R").alias("returned"), S.flag(F.col("l_linestatus") == "F").alias("finished"))
    return base, sold


RATE_FLAGS = ("returned", "finished")


def _rates(spark, folder, name):
    base, sold = _rate_sides(spark, folder)
    out = R.trailing_rates(base, sold, F.col("processed_on"), "l_shipdate", {name: (F.col(name), F.col(name))},
                           {n: F.col(n) for n in RATE_FLAGS})
    return out.drop("processed_on", "nation", "priority", "tier")


@query
def trailing_rate_nation(spark, folder):
    return _rates(spark, folder, "nation")


@query
def trailing_rate_priority(spark, folder):
    return _rates(spark, folder, "priority")


@query
def trailing_rate_tier(spark, folder):
    return _rates(spark, folder, "tier")


@query
def trailing_rate_refreshed(spark, folder):
    """Rates from published daily sums that were built in three steps, the second one done twice."""
    base, sold = _rate_sides(spark, folder)
    path = _mart_folder(spark, "daily-rates")
    bounds = [date(1900, 1, 1), date(1994, 7, 1), date(1997, 3, 15), date(2100, 1, 1)]
    steps = list(zip(bounds, bounds[1:]))
    for since, until in [*steps[:2], *steps[1:]]:
        R.refresh_daily_rates(path, sold, "l_shipdate", {"priority": F.col("priority")},
                              {n: F.col(n) for n in RATE_FLAGS}, since, until)
    out = R.rates_from_daily(base, read_mart(spark, path), F.col("processed_on"), {"priority": F.col("priority")}, RATE_FLAGS)
    return out.drop("processed_on", "nation", "priority", "tier")


# --- curves ------------------------------------------------------------------
def _first(s):
    return K.first_funded(s["loans"], AS_OF, CURVE_AGE_MONTHS)


def _curve(s):
    return C.cumulative_fee_curve(_first(s), s["cash_flow"], AS_OF)


@query
def first_funded(spark, folder):
    return _first(catalog(spark, folder))


@query
def cumulative_fee_curve(spark, folder):
    return _curve(catalog(spark, folder))


@query
def status_switched_fees(spark, folder):
    return _switched(catalog(spark, folder))


def _switched(s):
    return C.status_switched_fees(stage(_curve(s), "fee-curve"), s["loans"], s["loan_statuses"], keep=stage)


def _accounts(s):
    return C.second_platform_first_loan(s["second_loans"], s["second_loan_applications"], s["second_loan_statuses"],
                                        s["second_identities"], s["loans"], AS_OF)


def _cashout(s, accounts=None, folded=False):
    return C.monthly_cashout(accounts or _accounts(s), s["second_loans"], s["second_loan_status_history"], AS_OF, folded=folded)


def _net_cash(s, by_payment_date=False, cashout=None, folded=(), cents=False):
    return C.monthly_net_cash(
        cashout or stage(_cashout(s, folded=True), "cashout"), s["second_loans"], s["second_loan_statuses"],
        s["second_payments"], s["second_activities"], s["second_entries"], s["second_entry_types"],
        s["second_ledger_accounts"], by_payment_date, folded, cents)


@query
def second_platform_first_loan(spark, folder):
    return _accounts(catalog(spark, folder))


@query
def monthly_cashout(spark, folder):
    out = _cashout(catalog(spark, folder))
    return out.withColumn("defaulted_principal", F.round("defaulted_principal", 2))


@query
def monthly_net_cash(spark, folder):
    out = _net_cash(catalog(spark, folder))
    return out.select("account_id", "mon", "total_cash_in", "net_cash", F.round("net_fees", 2).alias("net_fees"),
                      "is_broken", "row_count", "entry_amount")


@query
def monthly_net_cash_by_payment_date(spark, folder):
    out = _net_cash(catalog(spark, folder), True)
    return out.select("account_id", "mon", F.round("net_fees", 2).alias("net_fees"))


def _merged(s):
    first = stage(_switched(s), "customer-net-fees")
    accounts = stage(_accounts(s), "accounts")
    cashout = stage(_cashout(s, accounts, folded=True), "cashout")
    # Fees of the second platform are rounded to cents before they enter the mart.
    second = C.second_platform_fees(_net_cash(s, cashout=cashout, folded=["net_fees"], cents=True))
    return C.merge_curves(first, stage(second, "second-net-fees"), MERGE_CUTOFF)


@query
def merge_curves(spark, folder):
    return _merged(catalog(spark, folder))


@query
def all_customer_net_fees(spark, folder):
    """The fee mart as the plan builds it, with unrounded second-platform fees."""
    out = fee_marts.all_customer_net_fees(catalog(spark, folder), AS_OF, MERGE_CUTOFF, CURVE_AGE_MONTHS, keep=stage)
    return out.withColumn("net_fees", F.round("net_fees", 2))


def _fee_mart(s):
    """Both platforms' curve: one row per (customer, month), as the lookup demands."""
    return _merged(s).select("customer_id", "month_calculated", "net_fees")


def _fee_loans(s):
    return s["loans"].select(F.col("id").alias("loan_id"), "customer_id", "funding_date_actual")


@query
def horizon_fee_lookup(spark, folder):
    s = catalog(spark, folder)
    return C.horizon_fee_lookup(_fee_loans(s), _fee_mart(s), AS_OF).drop("customer_id", "funding_date_actual")


def _mart_folder(spark, name):
    return f"{stage_folder(spark)}/marts-{uuid.uuid4().hex}/{name}"


@query
def horizon_fee_lookup_keyed(spark, folder):
    """The same from published marts keyed by customer: neither side is shuffled by the lookup."""
    s = catalog(spark, folder)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loans = publish_mart(_fee_loans(s), _mart_folder(spark, "loans"), key="customer_id", buckets=buckets)
    fees = publish_mart(_fee_mart(s), _mart_folder(spark, "fees"), key="customer_id", buckets=buckets)
    return C.horizon_fee_lookup(loans, fees, AS_OF).drop("customer_id", "funding_date_actual")


@query
def mart_roundtrip(spark, folder):
    """A published fee mart and the version that a build makes of it, reading what it replaces."""
    path = _mart_folder(spark, "fees")
    first = publish_mart(_fee_mart(catalog(spark, folder)), path, partition_by="month_calculated")
    second = publish_mart(read_mart(spark, path).where("month_calculated % 2 = 0"), path, partition_by="month_calculated")
    both = first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))
    return both.groupBy("month_calculated", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("net_fees").alias("net_fees"))


# --- outcomes ----------------------------------------------------------------
def _base_loans(s, loan_type=None):
    loans = s["loans"] if loan_type is None else s["loans"].where(F.col("loan_type_cd") == loan_type)
    return loans.select(F.col("id").alias("loan_id"), "customer_id", "funding_date_actual",
                        F.col("amount").alias("loan_amount"), F.col("status_cd").alias("loan_status"))


def _results(df):
    return df.drop("customer_id", "funding_date_actual", "loan_amount", "loan_status")


@query
def repeat_counts(spark, folder):
    s = catalog(spark, folder)
    return _results(O.repeat_loan_counts(_base_loans(s), s["loans"], AS_OF))


@query
def profit_rate_join(spark, folder):
    s = catalog(spark, folder)
    return _results(O.loan_performance_join(_base_loans(s), s["payday_chains_performance"], s["payday_loans_performance"]))


@query
def expected_schedule(spark, folder):
    s = catalog(spark, folder)
    return _results(O.expected_schedule(_base_loans(s), s["installments"]))


@query
def installment_performance(spark, folder):
    s = catalog(spark, folder)
    return _results(O.installment_performance(_base_loans(s), s["installments"], s["installment_status_history"],
                                              s["installment_loans_performance"], AS_OF))


@query
def statement_performance(spark, folder):
    s = catalog(spark, folder)
    return _results(O.statement_performance(_base_loans(s), s["statements"], s["payment_transactions"], AS_OF))


@query
def withdrawal_stats(spark, folder):
    s = catalog(spark, folder)
    return _results(O.withdrawal_stats(_base_loans(s), s["cash_flow"], AS_OF))


@query
def survival_stats(spark, folder):
    s = catalog(spark, folder)
    return _results(O.survival_stats(_base_loans(s), s["cash_flow"], AS_OF))


@query
def first_payback(spark, folder):
    s = catalog(spark, folder)
    return _results(O.first_payback(_base_loans(s), s["cash_flow"]))


@query
def payback_ratio(spark, folder):
    s = catalog(spark, folder)
    return _results(O.payback_ratio(_base_loans(s), s["statement_performance"]))


# --- the whole thing ---------------------------------------------------------
_OUTCOME_BUILDERS = {
    "payday_outcomes": outcome_tables.payday_outcomes,
    "installment_outcomes": outcome_tables.installment_outcomes,
    "line_of_credit_outcomes": outcome_tables.line_of_credit_outcomes,
}


#: Views that join or group whole driver tables and that a model table reads several times.
_SHARED_VIEWS = {"installment": ["loans", "installments"], "oec": ["loans", "statements"]}


def _model_table(spark, folder, product):
    s = catalog(spark, folder)
    p = model_table.PRODUCTS[product]
    s = s.with_tables(**{name: stage(s[name], name) for name in _SHARED_VIEWS.get(p.loan_type, ["loans"])})
    build = _OUTCOME_BUILDERS[p.outcome_table]
    loan_type = "payday" if p.outcome_table == "payday_outcomes" else p.loan_type
    s = s.with_tables(**{
        p.outcome_table: stage(build(s, OUTCOMES_FROM, OUTCOMES_TO, loan_type, keep=stage), p.outcome_table),
        "all_customer_net_fees": stage(_fee_mart(s), "fees"),
    })
    return model_table.build_model_table(p, s, SINCE, AS_OF)


@query
def build_model_table_payday(spark, folder):
    return _model_table(spark, folder, "payday")


@query
def build_model_table_cso(spark, folder):
    return _model_table(spark, folder, "cso")


@query
def build_model_table_installment(spark, folder):
    return _model_table(spark, folder, "installment")


@query
def build_model_table_line_of_credit(spark, folder):
    return _model_table(spark, folder, "line_of_credit")


@query
def first_customers_with_trailing_rates(spark, folder):
    """The smallest whole slice: cohort, latest earlier approval, trailing rates."""
    s = catalog(spark, folder)
    p = model_table.PAYDAY
    cohort = K.first_time_cohort(s["loans"], p.loan_type, SINCE, AS_OF, p.maturity(s))
    base = s["loans"].join(cohort.select("loan_id"), F.col("id") == F.col("loan_id"), "left_semi").select(
        F.col("id").alias("loan_id"), "customer_id", "requested_time", F.col("gov_law_state_cd").alias("state"))
    base = T.lookup(base, s["approvals"], "customer_id", F.col("requested_time"), F.col("processed_on"),
                    [T.pick_max("a", "id", ["processed_on"])], "before")
    base = base.select("loan_id", "state", F.col("a.id").alias("approval_id"), F.col("a.processed_on").alias("approval_processed"))
    outcomes = outcome_tables.payday_outcomes(s, OUTCOMES_FROM, OUTCOMES_TO, keep=stage).where(~F.col("existing_flg"))
    return R.trailing_rates(base, outcomes, F.col("approval_processed"), "due_date_adjusted",
                            {"state": (F.col("state"), F.col("state"))}, {"def": F.col("initial_default_flg")})
