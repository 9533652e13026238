"""What became of a loan: defaults, repeat loans, payback, withdrawals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.operators.quality import expect_one
from cohortloom.operators.temporal import (
    count_above_until,
    count_where,
    first_event_within,
    first_per_key,
)
from cohortloom.sources.stages import stage

BUSINESS_DAYS = 5
SETTLED_DAYS = 90


# --- flags by key ------------------------------------------------------------
def flag_by_key(left: DataFrame, key: str, hits: DataFrame, hit_key: str, name: str) -> DataFrame:
    """1 where any row of ``hits`` has the key, else 0."""
    keys = hits.where(F.col(hit_key).isNotNull()).select(F.col(hit_key).alias("__h")).distinct()
    return left.join(keys, left[key] == keys["__h"], "left").select(
        *left.columns, S.flag(F.col("__h").isNotNull()).alias(name))


def status_default_flag(left: DataFrame, statuses: DataFrame, name: str, key: str = "loan_id") -> DataFrame:
    """Did the loan ever have a default status."""
    return flag_by_key(left, key, statuses.where(F.col("status_cd").isin(*codes.DEFAULT_STATUSES)), "loan_id", name)


def installment_default_flag(left: DataFrame, history: DataFrame, name: str, key: str) -> DataFrame:
    """Did the installment ever have a default status."""
    hits = history.where(F.col("installment_status_id").isin(*codes.INSTALLMENT_DEFAULT_IDS))
    return flag_by_key(left, key, hits, "installments_static_id", name)


def uncollected_default_flag(
    left: DataFrame, transactions: DataFrame, due: Column, name: str, key: str = "loan_id",
    business_days: int = BUSINESS_DAYS, holidays=(),
) -> DataFrame:
    """Was an uncollected amount booked from the due day to some business days on."""
    booked = transactions.where(
        F.col("debit_account_cd").like(codes.UNCOLLECTED_ACCOUNT) & S.ilike_any(F.col("name"), codes.UNCOLLECTED_NAMES))
    found = first_event_within(
        left, booked, {key: "loan_id"}, due, "eff_date", S.add_business_days(due, business_days, holidays), "__hit")
    return found.withColumn(name, S.flag(F.col("__hit").isNotNull())).drop("__hit")


def existing_flag(left: DataFrame, loans: DataFrame, name: str = "existing_flg") -> DataFrame:
    """Had the customer a loan paid out strictly before this one (boolean).

    The customer's earliest such date decides, so the history folds to one row."""
    earliest = (
        loans.where(~F.col("status_cd").isin(*codes.UNFUNDED_STATUSES) & F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("__c")).agg(F.min("funding_date_actual").alias("__first"))
    )
    earlier = F.coalesce(F.col("__first") < F.col("funding_date_actual"), F.lit(False))
    return left.join(earliest, left["customer_id"] == earliest["__c"], "left").select(*left.columns, earlier.alias(name))


def extended_flag(left: DataFrame, loans: DataFrame, name: str = "extended_flg", key: str = "loan_id") -> DataFrame:
    """Has the base loan a follow-on loan that was paid out."""
    follow_on = loans.where(~F.col("status_cd").isin(*codes.UNFUNDED_STATUSES))
    return flag_by_key(left, key, follow_on, "base_loan_id", name)


# --- repeat business ---------------------------------------------------------
REPEAT_HORIZONS = {6: "six", 12: "twelve", 18: "eighteen"}


def repeat_loan_counts(
    base: DataFrame, loans: DataFrame, as_of: Column | date, horizons: Sequence[int] = tuple(REPEAT_HORIZONS),
    all_loans: bool = True,
) -> DataFrame:
    """Later loans (by id) paid out within so many months, base loans and all;
    NULL until the horizon has passed."""
    as_of = F.lit(as_of)
    funded = loans.where(~F.col("status_cd").isin(*codes.UNFUNDED_STATUSES)).select(
        F.col("id").alias("loan_id"), "customer_id", F.col("funding_date_actual").alias("__day"),
        F.col("base_loan_id").isNull().alias("__base"))
    folds = [count_where("base_loans", F.col("__base"))]
    if all_loans:
        folds.append(count_where("loan_objects"))
    limits = {str(h): F.add_months("funding_date_actual", h) for h in horizons}
    counted = count_above_until(base, funded, "customer_id", "loan_id", limits, "__day", folds, "loan_id")

    def ripe(fold: str, h: int) -> Column:
        passed = F.col("funding_date_actual") <= F.add_months(as_of, -h)
        return F.when(passed, F.coalesce(f"{fold}_{h}", F.lit(0))).alias(f"additional_{fold}_{REPEAT_HORIZONS.get(h, h)}_months")

    return counted.select(*base.columns, *[ripe(f.name, h) for f in folds for h in horizons])


# --- payday ------------------------------------------------------------------
def loan_performance_join(base: DataFrame, chains: DataFrame, performance: DataFrame) -> DataFrame:
    """Duration, extensions, defaults, fees and profit rate from the marts."""
    chains = chains.select(
        F.col("base_loan_id").alias("__b"), F.col("loan_duration").alias("actual_loan_duration_days"),
        F.col("number_funded_extensions").alias("extension_count"),
        F.col("count_initial_default").alias("loan_chain_initial_default_count"),
        S.flag(F.col("count_final_default") > 0).alias("loan_chain_final_default_flg"),
        F.col("net_fees").alias("loan_chain_net_fees"))
    chains = expect_one(chains, ["__b"], "chain performance")
    performance = performance.select(
        F.col("loan_id").alias("__l"), F.col("initial_default_flg").alias("base_loan_initial_default_flg"),
        F.col("final_default_flg").alias("base_loan_final_default_flg"))
    performance = expect_one(performance, ["__l"], "loan performance")
    joined = base.join(chains, base["loan_id"] == chains["__b"], "left").join(
        performance, base["loan_id"] == performance["__l"], "left")
    return joined.select(
        *base.columns, "actual_loan_duration_days", "extension_count", "base_loan_initial_default_flg",
        "base_loan_final_default_flg", "loan_chain_initial_default_count",
        # A loan without a chain row has not finally defaulted.
        F.coalesce("loan_chain_final_default_flg", F.lit(0)).alias("loan_chain_final_default_flg"),
        "loan_chain_net_fees",
        S.nice_div(F.col("loan_chain_net_fees"), F.col("loan_amount")).alias("profit_rate"))


# --- installments ------------------------------------------------------------
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth",
            "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")


def expected_schedule(base: DataFrame, installments: DataFrame) -> DataFrame:
    """Last installment due date and the loan length it implies."""
    last = installments.groupBy(F.col("loan_id").alias("__l")).agg(
        F.max("due_date").cast("date").alias("due_date_expected"))
    return base.join(last, base["loan_id"] == last["__l"], "left").select(
        *base.columns, "due_date_expected",
        F.datediff("due_date_expected", "funding_date_actual").alias("loan_duration_days_expected"))


def installment_performance(
    base: DataFrame, installments: DataFrame, history: DataFrame, performance: DataFrame, as_of: Column | date,
    settled_days: int = SETTLED_DAYS,
) -> DataFrame:
    """Installment counts, early payoff, initial defaults by installment 1, 4 and
    6, final default of installments 1-12. One grouped pass over installments.

    ``base`` needs loan_id, loan_status, loan_amount.
    """
    as_of = F.lit(as_of)
    bad_ids = codes.INSTALLMENT_DEFAULT_IDS
    went_bad = history.where(F.col("installment_status_id").isin(*bad_ids)).select(
        F.col("installments_static_id").alias("__i")).distinct()
    rows = installments.join(went_bad, installments["id"] == went_bad["__i"], "left")
    number = F.col("installment_number")
    cutoff = F.date_sub(as_of, settled_days)
    come_due, settled = F.col("due_date") <= cutoff, F.col("due_date") < cutoff
    bad_now = F.col("installment_status_id").isin(*bad_ids)
    ever_bad = F.col("__i").isNotNull()

    finals = []
    for n, word in enumerate(ORDINALS, 1):
        mine = settled & (number == n)
        finals += [F.max(F.when(mine, S.flag(bad_now))).alias(f"{word}_inst_fin_def_flg"),
                   F.count_if(mine).alias(f"__n{n}")]
    grouped = rows.groupBy(F.col("loan_id").alias("__l")).agg(
        F.count(F.lit(1)).alias("__expected"),
        F.count_if(come_due).alias("__due"),
        F.count_if(come_due & F.col("installment_status_id").isin(*codes.INSTALLMENT_PAID_IDS)).alias("__paid"),
        F.count_if(ever_bad & (number == 1)).alias("__bad1"),
        F.count_if(ever_bad & (number <= 4)).alias("__bad4"),
        F.count_if(ever_bad & (number <= 6)).alias("__bad6"),
        *finals,
    )
    marts = expect_one(
        performance.select(F.col("loan_id").alias("__p"), "number_paid_installments", "net_fees"),
        ["__p"], "installment performance")
    joined = base.join(grouped, base["loan_id"] == grouped["__l"], "left").join(
        marts, base["loan_id"] == marts["__p"], "left")

    def zero(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    early = (zero("__expected") > F.col("number_paid_installments")) & (F.col("loan_status") == "paid_off")

    def final(n: int, word: str) -> Column:
        message = F.concat(F.lit(f"installment {n} is not unique for loan "), F.col("__l").cast("string"))
        name = f"{word}_inst_fin_def_flg"
        return F.when(F.col(f"__n{n}") > 1, F.raise_error(message).cast("int")).otherwise(F.col(name)).alias(name)

    return joined.select(
        *base.columns,
        zero("__expected").alias("number_installments_expected"),
        zero("__due").alias("number_installments_come_due"),
        zero("__paid").alias("number_installments_paid"),
        S.flag(early).alias("early_payoff_flg"),
        F.when(early, S.nice_div(F.col("number_paid_installments").cast("double"), zero("__expected")))
        .alias("percent_through_early_payoff"),
        zero("__bad1").alias("first_inst_ini_def_flg"),
        S.flag(F.col("__bad4") > 0).alias("fourth_inst_ini_def_flg"),
        S.flag(F.col("__bad6") > 0).alias("sixth_inst_ini_def_flg"),
        zero("__bad4").alias("fourth_inst_ini_def_count"),
        zero("__bad6").alias("sixth_inst_ini_def_count"),
        *[final(n, word) for n, word in enumerate(ORDINALS, 1)],
        "net_fees",
        S.nice_div(F.col("net_fees"), F.col("loan_amount")).alias("profit_rate"),
    )


# --- line of credit ----------------------------------------------------------
def statement_performance(
    base: DataFrame, statements: DataFrame, transactions: DataFrame, as_of: Column | date, holidays=()
) -> DataFrame:
    """First statement: was a positive amount due and is it past; did it default."""
    as_of = F.lit(as_of)
    first = first_per_key(
        statements, ["loan_id"], ["id"],
        ["due_date", "due_date_adjusted", "total_interest_due", "principal_due", "fees_due"],
    ).select(F.col("loan_id").alias("__l"),
             F.coalesce("due_date_adjusted", "due_date").cast("date").alias("__due"),
             (F.col("total_interest_due") + F.col("principal_due") + F.col("fees_due")).alias("__owed"))
    joined = base.join(first, base["loan_id"] == first["__l"], "left").drop("__l")
    flagged = uncollected_default_flag(joined, transactions, F.col("__due"), "statement_initial_default_flag",
                                       holidays=holidays)
    return flagged.select(
        *base.columns,
        S.flag((F.col("__owed") > 0) & (F.col("__due") < as_of)).alias("positive_amount_due_flag"),
        "statement_initial_default_flag")


WITHDRAWN = ("total_withdrawn_3m", "total_withdrawn_6m", "total_withdrawn_12m", "total_withdrawn")
WITHDRAWS = ("total_withdraws_3m", "total_withdraws_6m", "total_withdraws_12m", "total_withdraws_1m", "total_withdraws")
SURVIVAL = ("last_activity", "time_alive", "censored")
PAYBACK = ("in_money", "out_money", "full_payback_first_payment")


def cash_flow_outcomes(
    base: DataFrame, cash_flow: DataFrame, as_of: Column | date, active_months: int = 3, booked_cash: bool = True
) -> DataFrame:
    """What the cash flow says of each loan, from one scan of it:

    - amount and number of withdrawals within 1, 3, 6 and 12 months and in all, and the cash
      booked up to and with the first withdrawal;
    - the last activity up to ``as_of``, days from funding to it, and whether the loan is still
      active. Missing types and statuses count as activity;
    - the first withdrawal against the first payment. All rows tied at the lowest id count, and
      each tied payment counts once per tied withdrawal (and the reverse), as a join of the
      two would have it; the products below give that without making the pairs.

    ``base`` needs loan_id, one row each, and funding_date_actual. Rows of its loans fold to (loan,
    id), so a loan with very many rows is folded by many tasks before its sums meet; a row without
    an id is never the first. The cash up to the first withdrawal needs these folds twice, so they are
    staged; without ``booked_cash`` that column is left out and nothing is staged.
    """
    as_of = F.lit(as_of)
    rows = cash_flow.join(
        base.select(F.col("loan_id").alias("__l"), F.col("funding_date_actual").alias("__start")),
        F.col("loan_id") == F.col("__l"))
    kind, status, day, start = F.col("sub_type_cd"), F.col("status_cd"), F.col("eff_date"), F.col("__start")
    valid = ~status.isin(*codes.RETURNED_STATUSES)
    kept = status.isNull() | valid
    out = (kind == codes.PRINCIPAL_OUT) & kept
    active = (day <= as_of) & (kind.isNull() | kind.isin(*codes.ACTIVITY_TYPES)) & kept

    def until(name: str) -> Column:
        months = name.rsplit("_", 1)[-1]
        return F.add_months(start, int(months[:-1])) if months[0].isdigit() else as_of

    amount = -F.col("total_amount")
    sums = {n: F.sum(F.when(out & day.between(start, until(n)), amount)) for n in WITHDRAWN[:-1]}
    sums |= {"total_withdrawn": F.sum(F.when(out, amount))}
    sums |= {n: F.count_if(out & day.between(start, until(n))) for n in WITHDRAWS}
    first = {}
    for tag, code in (("o", codes.PRINCIPAL_OUT), ("p", codes.PAYMENT)):
        first[f"__{tag}_n"] = F.count_if(valid & (kind == code))
        first[f"__{tag}_sum"] = F.sum(F.when(valid & (kind == code), F.abs("total_amount")))
    by_task = rows.groupBy("__l", F.col("loan_task_committed_id").alias("__task")).agg(
        *[c.alias(n) for n, c in (sums | first).items()], F.max(F.when(active, day)).alias("last_activity"),
        F.sum(amount).alias("__booked"))
    if booked_cash:
        by_task = stage(by_task, "cash-by-task")

    def lowest(tag: str) -> Column:
        has = F.col("__task").isNotNull() & (F.col(f"__{tag}_n") > 0)
        return F.min(F.when(has, F.struct("__task", f"__{tag}_n", f"__{tag}_sum"))).alias(f"__{tag}")

    by_loan = by_task.groupBy("__l").agg(
        *[F.sum(n).alias(n) for n in sums], F.max("last_activity").alias("last_activity"), lowest("o"), lowest("p"))
    found, counted = base.join(by_loan, base["loan_id"] == by_loan["__l"], "left"), [*WITHDRAWN, *WITHDRAWS]
    if booked_cash:
        begun = by_task.where("__o_n > 0").groupBy(F.col("__l").alias("__f")).agg(F.min("__task").alias("__first"))
        upto = (F.col("__l") == F.col("__f")) & (F.col("__task") <= F.col("__first"))
        booked = by_task.join(begun, upto).groupBy("__f").agg(F.sum("__booked").alias("first_withdraw_amount"))
        found = found.join(booked, base["loan_id"] == booked["__f"], "left")
        counted.append("first_withdraw_amount")

    in_money = F.col("__p.__p_sum") * F.coalesce("__o.__o_n", F.lit(1))
    out_money = F.col("__o.__o_sum") * F.coalesce("__p.__p_n", F.lit(1))
    return found.select(
        *base.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in counted],
        "last_activity", F.datediff("last_activity", "funding_date_actual").alias("time_alive"),
        S.flag(F.col("last_activity") > F.add_months(as_of, -active_months)).alias("censored"),
        in_money.alias("in_money"), out_money.alias("out_money"),
        S.flag(in_money >= out_money).alias("full_payback_first_payment"))


def withdrawal_stats(base: DataFrame, cash_flow: DataFrame, as_of: Column | date) -> DataFrame:
    """The withdrawals of ``cash_flow_outcomes``."""
    found = cash_flow_outcomes(base, cash_flow, as_of)
    return found.select(*base.columns, *WITHDRAWN, *WITHDRAWS, "first_withdraw_amount")


def survival_stats(base: DataFrame, cash_flow: DataFrame, as_of: Column | date, active_months: int = 3) -> DataFrame:
    """The activity of ``cash_flow_outcomes``."""
    return cash_flow_outcomes(base, cash_flow, as_of, active_months, booked_cash=False).select(*base.columns, *SURVIVAL)


def first_payback(base: DataFrame, cash_flow: DataFrame) -> DataFrame:
    """The first withdrawal against the first payment, of ``cash_flow_outcomes``."""
    no_day = F.lit(None).cast("date")
    return cash_flow_outcomes(base, cash_flow, no_day, booked_cash=False).select(*base.columns, *PAYBACK)


def payback_ratio(base: DataFrame, statements: DataFrame, months: int = 3) -> DataFrame:
    """1 where the mean paid share of the first months' statements is exactly 1."""
    share = S.nice_div(F.col("amount_paid"), F.col("amount_paid") + F.col("unpaid_balance"))
    early = (
        base.select("loan_id", "funding_date_actual")
        .join(statements.select(F.col("loan_id").alias("__s"), F.col("statement_due_date").alias("__due"),
                                share.cast("double").alias("__share")),
              (F.col("loan_id") == F.col("__s"))
              & F.col("__due").between(F.col("funding_date_actual"), F.add_months("funding_date_actual", months)))
        .groupBy(F.col("loan_id").alias("__l")).agg(F.avg("__share").alias("__mean"))
    )
    return base.join(early, base["loan_id"] == early["__l"], "left").select(
        *base.columns, S.flag(F.col("__mean") == 1).alias("payback_100"))
