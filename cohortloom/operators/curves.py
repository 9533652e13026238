"""Customer-by-month fee curves of two lending platforms, and their merge.

A running total by month is never built by joining to a month series. Every
amount falls in the first month that covers it; amounts fold to one row per
(owner, month); a window over at most a few dozen month rows makes the running
totals, and each row then spans the months up to the next one.

Between steps the second platform's curves travel folded: one row per account, with its spans
or months in an array of at most a few dozen entries. Month rows are made at the end, after the
last shuffle. ``folded=True`` gives that form; steps that read a curve take either form.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S
from cohortloom.operators.temporal import first_per_key, lookup, pick_max
from cohortloom.sources.stages import no_stage, stage


def _running_spans(
    buckets: DataFrame, owner: Sequence[str], month: str, last_month: Column, sums: Sequence[str]
) -> DataFrame:
    """Running totals of ``sums`` from each bucket's month on, up to ``__until``, the month before the
    owner's next bucket or its last month. ``buckets`` has one row per (owner, month)."""
    order = Window.partitionBy(*owner).orderBy(month)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumns({
        **{s: F.sum(s).over(so_far) for s in sums},
        "__until": F.coalesce(F.lead(month).over(order) - 1, last_month),
    })


def _running_by_month(
    buckets: DataFrame, owner: Sequence[str], month: str, last_month: Column, sums: Sequence[str]
) -> DataFrame:
    """Running totals of ``sums`` for every month from an owner's first bucket to its last month."""
    spans = _running_spans(buckets, owner, month, last_month, sums)
    kept = [c for c in buckets.columns if c != month]
    return spans.select(*kept, F.explode(F.sequence(F.col(month), F.col("__until"))).alias(month))


def _fold(rows: DataFrame, owner: Sequence[str | Column], entry: Sequence[Column], name: str) -> DataFrame:
    """One row per owner with its rows as a sorted array of ``entry`` structs."""
    return rows.groupBy(*owner).agg(F.sort_array(F.collect_list(F.struct(*entry))).alias(name))


def _each_month(spans: Column, values: Sequence[str]) -> Column:
    """Spans (mon, until, values) as one entry (mon, values) per month."""
    return F.flatten(F.transform(spans, lambda s: F.transform(
        F.sequence(s["mon"], s["until"]), lambda m: F.struct(m.alias("mon"), *[s[v].alias(v) for v in values]))))


# --- first platform ----------------------------------------------------------
def cumulative_fee_curve(first: DataFrame, cash_flow: DataFrame, as_of: Column | date, months: int = 30) -> DataFrame:
    """Two running fee totals per customer and elapsed average month.

    ``first``: customer_id, loan_id, funding_date_actual. Final-status fees are
    all cash but reconciliations, in-flight fees are interest and misc fees of
    payments and reconciliations. Customers without cash flow have no rows.
    """
    as_of = F.lit(as_of)
    flows = cash_flow.where(
        F.col("status_cd").isin(*codes.CASH_STATUSES)
        & F.col("sub_type_cd").isin(codes.PRINCIPAL_OUT, codes.PAYMENT, codes.RECONCILIATION)
        & F.col("eff_date").isNotNull()
    )
    reconciled = F.col("sub_type_cd") == codes.RECONCILIATION
    earning = F.col("sub_type_cd").isin(codes.RECONCILIATION, codes.PAYMENT)
    # Rows meet the customer's one start unfolded: most customers have few rows a day, and a join
    # splits a hot customer, whose rows then fold to months in several tasks.
    flows = flows.select(
        "customer_id", "eff_date", F.coalesce(F.when(~reconciled, F.col("total_amount")), F.lit(0)).alias("net_fees_final_status"),
        F.coalesce(F.when(earning, F.col("interest") + F.col("misc_fees")), F.lit(0)).alias("net_fees_in_flight"))
    age = S.elapsed_average_months(F.datediff(as_of, F.col("funding_date_actual")))
    sums = ["net_fees_final_status", "net_fees_in_flight"]
    buckets = (
        flows.join(first, "customer_id")
        .withColumn("month_calculated", S.average_month_bucket(F.datediff("eff_date", "funding_date_actual")))
        .where(F.col("month_calculated") <= F.least(F.lit(months), age))
        .groupBy("customer_id", F.col("loan_id").alias("first_funded_loan_id"),
                 F.col("funding_date_actual").alias("first_funding_date_actual"), "month_calculated")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    owner = ["customer_id", "first_funded_loan_id", "first_funding_date_actual"]
    last = F.least(F.lit(months), S.elapsed_average_months(F.datediff(as_of, F.col("first_funding_date_actual"))))
    return _running_by_month(buckets, owner, "month_calculated", last, sums).select(
        *owner, "month_calculated",
        S.average_month_date(F.col("first_funding_date_actual"), F.col("month_calculated")).alias("calc_date"), *sums,
    )


def status_switched_fees(curve: DataFrame, loans: DataFrame, statuses: DataFrame, keep=no_stage) -> DataFrame:
    """Choose the fee definition by the status, at each curve date, of the
    customer's latest funded loan by then. Both the counting job and the fold of
    the second lookup read the first one's result, so ``keep`` may write it."""
    funded = loans.where(F.col("status_cd").isin(*codes.FUNDED_STATUSES))
    with_loan = lookup(curve, funded, "customer_id", F.col("calc_date"), F.col("funding_date_actual").cast("date"),
                       [pick_max("__loan", "id")], "until").withColumn("loan_id", F.col("__loan.id")).drop("__loan")
    with_loan = keep(with_loan, "curve-loans")
    with_status = lookup(with_loan, statuses, "loan_id", F.col("calc_date"), F.col("eff_start_time").cast("date"),
                         [pick_max("__status", "id", ["status_cd"])], "until")
    closed = F.col("__status.status_cd").isin(*codes.CLOSED_STATUSES)
    return with_status.select(
        "customer_id", "first_funded_loan_id", "first_funding_date_actual", "month_calculated", "calc_date", "loan_id",
        F.when(closed, F.col("net_fees_final_status")).otherwise(F.col("net_fees_in_flight")).alias("net_fees"),
    )


# --- second platform ---------------------------------------------------------
def second_platform_first_loan(
    loans: DataFrame, applications: DataFrame, statuses: DataFrame, identities: DataFrame,
    first_platform_loans: DataFrame, as_of: Column | date,
) -> DataFrame:
    """One row per second-platform account: its first funded loan, matched to the
    customer's earliest loan on the first platform.

    The order is disbursement date, loan id, earliest start, first-platform id,
    with NULLs last going up and first going down. Account loans and customer
    loans are each reduced to their leaders before they meet, so no pairs of the
    two lists are made.
    """
    as_of = F.lit(as_of)
    named = statuses.where(F.col("loan_status").isin(*codes.SECOND_LOAN_STATUSES))
    branded = applications.where(F.col("brand_id") == codes.SECOND_BRAND).select("loan_agreement_id")
    funded = loans.join(branded, ["loan_agreement_id"], "left_semi").join(named, ["loan_status_id"])
    first = (
        funded.groupBy("account_id")
        .agg(F.min(F.struct(F.col("disbursement_date").isNull().alias("late"), "disbursement_date", "loan_id",
                            "region_id", "loan_status")).alias("__p"))
        .select("account_id", F.col("__p.loan_id").alias("first_funded_loan_id"),
                F.col("__p.disbursement_date").cast("date").alias("first_funding_date"),
                F.col("__p.region_id").alias("region_id"), F.col("__p.loan_status").alias("loan_status"))
        .join(identities.select("account_id", F.col("public_identifier").cast("long").alias("customer_id")), ["account_id"])
    )
    day = F.col("funding_date_actual").cast("date")
    leaders = (
        first_platform_loans.where(
            F.col("status_cd").isin(*codes.FUNDED_STATUSES) & F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("__c"))
        .agg(F.min(F.when(day.isNotNull(), F.struct(day.alias("day"), F.col("id")))).alias("__early"),
             F.min(F.struct(F.col("id"), day.alias("day"))).alias("__lowest"),
             F.min(F.when(day.isNull(), F.col("id"))).alias("__undated"))
    )
    joined = first.join(leaders, F.col("customer_id") == F.col("__c"), "left")
    own = F.col("first_funding_date")
    undated_first = own.isNull() & F.col("__undated").isNotNull()
    use_early = own.isNull() | (F.col("__early.day") < own)
    matched_id = (
        F.when(undated_first, F.col("__undated"))
        .when(use_early, F.col("__early.id"))
        .otherwise(F.col("__lowest.id"))
    )
    matched_day = (
        F.when(undated_first, F.lit(None).cast("date"))
        .when(use_early, F.col("__early.day"))
        .otherwise(F.col("__lowest.day"))
    )
    state = None
    for region, code in codes.SECOND_REGIONS.items():
        hit = F.col("region_id") == region
        state = F.when(hit, code) if state is None else state.when(hit, code)
    return joined.select(
        "first_funded_loan_id", "account_id", "customer_id", "first_funding_date", "region_id",
        state.otherwise(codes.UNEXPECTED_REGION).alias("state"), "loan_status",
        matched_id.alias("first_platform_loan_id"), matched_day.alias("first_platform_funding_date"),
    ).withColumn(
        "days_since_first_funding", F.datediff(as_of, F.least("first_platform_funding_date", "first_funding_date"))
    )


def _start() -> Column:
    return F.least(F.col("first_funding_date"), F.col("first_platform_funding_date"))


def _elapsed_months(as_of: Column, months: int) -> Column:
    """How many whole calendar months after the start are over by ``as_of``."""
    start = _start()
    apart = (F.year(as_of) - F.year(start)) * 12 + F.month(as_of) - F.month(start)
    over = F.when(F.add_months(start, apart) <= as_of, apart).otherwise(apart - 1)
    return F.when(start.isNotNull(), F.least(F.lit(months), over)).cast("int")


def monthly_cashout(
    accounts: DataFrame, loans: DataFrame, history: DataFrame, as_of: Column | date, months: int = 48,
    folded: bool = False,
) -> DataFrame:
    """Per account and elapsed calendar month since its start: cash lent so far,
    and discounted principal of loans in default by then. ``folded``: one row per account,
    its curve as ``by_span``.

    A loan's cash counts from the month of its disbursement. Its principal
    counts as defaulted from the later of that month and the month of its first
    default event.
    """
    as_of = F.lit(as_of)
    owners = accounts.withColumns({"__start": _start(), "__last": _elapsed_months(as_of, months)}).where(
        F.col("__last") >= 1)
    lent = loans.where(F.col("loan_status_id").isin(*codes.SECOND_FUNDED_STATUS_IDS))
    event = first_per_key(
        history.where(F.col("to_status").isin(*codes.SECOND_DEFAULT_EVENTS)), ["loan_id"], ["id"], ["created_at"]
    ).select(F.col("loan_id").alias("__loan"), "created_at")
    lent = lent.join(event, lent["loan_id"] == event["__loan"], "left").select(
        "account_id", F.col("disbursement_date").cast("date").alias("__day"), "amount",
        F.when(F.col("loan_status_id").isin(*codes.SECOND_DEFAULT_STATUS_IDS), F.col("created_at")).alias("__event"),
    )
    paid_out = owners.select("account_id", "__start", "__last").join(lent, "account_id")
    out_month = S.calendar_month_bucket(F.col("__start"), F.col("__day"))
    bad_month = S.calendar_month_bucket(F.col("__start"), S.first_date_at_or_after(F.col("__event")))
    discounted = F.col("amount").cast("double") / S.discount_factor(F.datediff("__day", "__start"))
    no_amount = F.lit(None).cast("double")
    amounts = paid_out.where(F.col("__day").isNotNull()).select(
        "account_id", "__last",
        F.explode(F.array(
            F.struct(out_month.alias("mon"), F.col("amount").alias("cash"), no_amount.alias("bad")),
            F.struct(F.greatest(out_month, bad_month).alias("mon"), F.lit(None).cast(lent.schema["amount"].dataType).alias("cash"),
                     F.when(bad_month.isNotNull(), discounted).alias("bad")),
        )).alias("__a"),
    ).select("account_id", "__last", "__a.*").where(F.col("cash").isNotNull() | F.col("bad").isNotNull())
    seeds = owners.select("account_id", "__last", F.lit(1).alias("mon"))  # every account starts at month 1
    buckets = (
        amounts.where(F.col("mon") <= F.col("__last")).unionByName(seeds, allowMissingColumns=True)
        .groupBy("account_id", "__last", "mon")
        .agg(F.sum("cash").alias("total_cash_out"), F.sum("bad").alias("defaulted_principal"))
    )
    spans = _running_spans(buckets, ["account_id"], "mon", F.col("__last"), list(_CASH_OUT))
    curve = _fold(spans, ["account_id"], [
        F.col("mon"), F.col("__until").alias("until"), "total_cash_out",
        F.coalesce("defaulted_principal", F.lit(0.0)).alias("defaulted_principal")], "by_span")
    found = accounts.join(curve, "account_id").select(*accounts.columns, "by_span")
    if folded:
        return found
    return found.select(*accounts.columns, F.inline(_each_month(F.col("by_span"), _CASH_OUT))).select(
        *accounts.columns, "mon", _month_end(F.col("mon")), *_CASH_OUT)


_CASH_OUT = ("total_cash_out", "defaulted_principal")


def _month_end(mon: Column) -> Column:
    return F.add_months(_start(), mon).alias("max_date_of_interest")


def monthly_net_cash(
    cashout: DataFrame, loans: DataFrame, statuses: DataFrame, payments: DataFrame, activities: DataFrame,
    entries: DataFrame, entry_types: DataFrame, ledger_accounts: DataFrame,
    discount_by_payment_date: bool = False, folded: Sequence[str] = (), cents: bool = False,
) -> DataFrame:
    """Add the cash that came in by each month and the discounted net fees. ``cashout`` is a
    ``monthly_cashout``, folded or not. ``folded`` names values, such as ``net_fees``: the result is then
    one row per account with these by month as ``by_month``, and sums behind other values aren't moved.
    ``cents`` rounds net fees to ``decimal(18,2)``.

    Ledger tests run on the small account table, entries fold to one row per
    payment, payments to one row per (account, month). By default payments are
    discounted from the loan's disbursement date; the switch uses their own date.
    """
    # Ledger accounts -> entry types: all name tests happen here.
    side = ledger_accounts.select(
        F.col("account_id").alias("__acc"), "account",
        S.matches_any(F.col("account"), codes.CASH_IN_WORDS).alias("__cash_word"),
        S.matches_any(F.col("account"), codes.FEE_WORDS, ignore_case=True).alias("__fee_word"),
        S.any_word_matches(codes.KNOWN_WORDS, F.col("account")).cast("int").alias("__odd"),
    )
    credit, debit = side.alias("credit"), side.alias("debit")
    types = (
        entry_types.join(credit, F.col("credit_account_id") == F.col("credit.__acc"), "left")
        .join(debit, F.col("debit_account_id") == F.col("debit.__acc"), "left")
        .select(F.col("entry_type_id").alias("__type"),
                (F.col("credit.__cash_word") & (F.col("debit.account") == codes.CASH_ACCOUNT)).alias("__is_cash"),
                (F.col("credit.__fee_word") & (F.col("debit.account") == codes.CASH_ACCOUNT)).alias("__is_fee"),
                F.col("credit.__odd").alias("__odd"))
    )
    # Written, so that the planner sees how small it is and does not deal the entries out by type.
    types = stage(types, "entry-types")
    one = F.lit(1).cast("long")
    by_activity = (
        entries.where(F.col("ledger_id") == codes.OPERATIONAL_LEDGER_ID)
        .join(types, F.col("entry_type_id") == F.col("__type"), "left")
        .groupBy(F.col("activity_id").alias("__activity"))
        .agg(F.sum(F.when(F.col("__is_cash"), F.col("amount"))).alias("cash"),
             F.sum(F.when(F.col("__is_fee"), F.col("amount"))).alias("fee"),
             F.sum("__odd").alias("odd"), F.sum("amount").alias("booked"), F.count(one).alias("rows"))
    )
    measures = ["cash", "fee", "odd", "booked", "rows"]
    by_payment = (
        activities.where(F.col("payment_id").isNotNull()).select("activity_id", "payment_id")
        .join(by_activity, F.col("activity_id") == F.col("__activity"), "left")
        .groupBy(F.col("payment_id").alias("__payment"))
        .agg(*[F.sum(F.coalesce("rows", one)).alias("rows") if m == "rows" else F.sum(m).alias(m) for m in measures])
    )
    paid = payments.where(
        F.col("payment_status_id").isin(*codes.PAID_PAYMENT_STATUS_IDS)
        & (F.col("payment_purpose_id") == codes.LOAN_PAYMENT_PURPOSE_ID)
        & ~F.col("repayment_method_id").isin(*codes.EXCLUDED_REPAYMENT_METHOD_IDS)
        & F.col("effective_date").isNotNull()
    ).select("payment_id", F.col("loan_id").alias("__loan"), F.col("effective_date").cast("date").alias("__paid"))
    paid = paid.join(by_payment, F.col("payment_id") == F.col("__payment"), "left")

    named = statuses.where(F.col("loan_status").isin(*codes.SECOND_LOAN_STATUSES)).select("loan_status_id")
    if "by_span" not in cashout.columns:
        known = [c for c in cashout.columns if c not in ("mon", "max_date_of_interest", *_CASH_OUT)]
        cashout = _fold(cashout, known, [F.col("mon"), F.col("mon").alias("until"), *_CASH_OUT], "by_span")
    known = [c for c in cashout.columns if c != "by_span"]
    # One row per account: its start and its number of elapsed months.
    owners = cashout.groupBy("account_id").agg(
        F.max(F.array_max(F.transform("by_span", lambda s: s["until"]))).alias("__last"), F.min(_start()).alias("__start"))
    owned = (
        loans.join(named, "loan_status_id", "left_semi")
        .select("account_id", "loan_id", F.col("disbursement_date").cast("date").alias("__out")).join(owners, "account_id")
    )
    flows = paid.join(owned, F.col("__loan") == F.col("loan_id")).withColumn(
        "mon", S.calendar_month_bucket(F.col("__start"), F.col("__paid"))
    ).where(F.col("mon") <= F.col("__last"))
    discount_day = F.col("__paid") if discount_by_payment_date else F.col("__out")
    factor = S.discount_factor(F.datediff(discount_day, F.col("__start")))
    by_loan = flows.groupBy("account_id", "__last", "loan_id", "mon").agg(
        F.sum("cash").alias("cash"),
        F.sum(F.col("cash").cast("double") / factor).alias("cash_disc"),
        F.sum(F.col("fee").cast("double") / factor).alias("fee_disc"),
        F.sum("odd").alias("odd"), F.sum("booked").alias("booked"), F.sum(F.coalesce("rows", one)).alias("rows"),
    )
    # A loan shows as one row until its first payment, then as its payment rows.
    before_first = by_loan.groupBy("account_id", "__last", "loan_id").agg(F.min("mon").alias("mon")).select(
        "account_id", "__last", "mon", (-one).alias("rows"))
    seeds = owned.select("account_id", "__last", F.lit(1).alias("mon"), one.alias("rows"))
    sums = ["cash", "cash_disc", "fee_disc", "odd", "booked", "rows"]
    buckets = (
        by_loan.drop("loan_id").unionByName(before_first, allowMissingColumns=True)
        .unionByName(seeds, allowMissingColumns=True)
        .groupBy("account_id", "__last", "mon").agg(*[F.sum(s).alias(s) for s in sums])
    )
    # The sums that each value is made of, and how.
    values = {
        "total_cash_out": ([], lambda got, out, bad: out),
        "defaulted_principal": ([], lambda got, out, bad: bad),
        "total_cash_in": (["cash"], lambda got, out, bad: F.round(F.coalesce(got["cash"], F.lit(0)), 2)),
        "net_cash": (["cash"], lambda got, out, bad: F.round(F.coalesce(F.coalesce(got["cash"], F.lit(0)) - out, -out), 2)),
        "net_fees": (["cash_disc", "fee_disc"], lambda got, out, bad: F.when(
            bad != 0, F.coalesce(got["cash_disc"], F.lit(0.0)) - bad).otherwise(got["fee_disc"])),
        "is_broken": (["odd"], lambda got, out, bad: F.when(got["odd"] > 0, True).otherwise(False)),
        "row_count": (["rows"], lambda got, out, bad: got["rows"]),
        "entry_amount": (["booked"], lambda got, out, bad: got["booked"]),
    }
    if cents:
        exact = values["net_fees"]
        values["net_fees"] = (exact[0], lambda *a: F.round(exact[1](*a), 2).cast("decimal(18,2)"))
    wanted = list(folded or values)
    sums = list(dict.fromkeys(c for v in wanted for c in values[v][0]))
    spans = _running_spans(buckets, ["account_id"], "mon", F.col("__last"), sums)
    curve = _fold(spans, [F.col("account_id").alias("__a")], ["mon", F.col("__until").alias("until"), *sums], "__in")
    # Months of the account without a gap: an entry's place follows from its month.
    joined = cashout.join(curve, cashout["account_id"] == curve["__a"]).select(
        *known, "by_span", "__in",
        # Per month its span's place: numbers, for a struct a month costs more than all else here.
        F.flatten(F.transform("__in", lambda s, i: F.array_repeat(i, s["until"] - s["mon"] + 1))).alias("__place"))

    joined = joined.withColumn("__begin", F.get("__in", F.lit(0))["mon"])

    def got(m: Column) -> Column:
        return F.get("__in", F.get("__place", m - F.col("__begin")))

    def row(m: Column, s: Column, g: Column) -> list[Column]:
        return [m.alias("mon"), *[
            values[v][1](g, s["total_cash_out"], s["defaulted_principal"]).alias(v) for v in wanted]]

    def by_covered_month(entry) -> Column:
        """``entry(month, span)`` for each month of the cash-out spans that the other curve has too."""
        def first(s: Column) -> Column:
            return F.greatest(s["mon"], F.col("__begin"))

        def last(s: Column) -> Column:
            return F.least(s["until"], F.col("__begin") + F.size("__place") - 1)

        spans = F.filter("by_span", lambda s: first(s) <= last(s))
        return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(first(s), last(s)), lambda m: entry(m, s))))

    if folded:
        by_month = by_covered_month(lambda m, s: F.struct(*row(m, s, got(m))))
        return joined.select(*known, by_month.alias("by_month"))
    pairs = joined.select(*known, F.inline(by_covered_month(
        lambda m, s: F.struct(m.alias("__m"), s.alias("__s"), got(m).alias("__g")))))
    found = row(F.col("__m"), F.col("__s"), F.col("__g"))
    return pairs.select(*known, found[0], _month_end(F.col("__m")), *found[1:])


def second_platform_fees(net_cash: DataFrame) -> DataFrame:
    """The columns the merge reads. A folded curve is one of ``net_fees`` alone."""
    curve = ["by_month"] if "by_month" in net_cash.columns else ["mon", "net_fees"]
    return net_cash.select(
        F.col("first_funded_loan_id").alias("second_first_funded_loan_id"), "account_id", "customer_id",
        F.col("first_funding_date").alias("second_first_funding"), _start().alias("true_first_funding"), "state",
        "first_platform_loan_id", *curve,
    )


# --- both --------------------------------------------------------------------
def merge_curves(first: DataFrame, second: DataFrame, cutoff: Column | date) -> DataFrame:
    """All first-platform rows with the second platform's fees added, plus
    second-platform rows without a partner that start at or after ``cutoff``.

    ``second`` is ``second_platform_fees``, folded or not. Both curves fold to one row per owner and
    meet by customer: each account's months look up the customer's, and the customer's months that
    no account has stand alone. Accounts are on the left of the join, so Spark can split a hot
    customer's. Equal rows of the result are one row.
    """
    own = ("first_funded_loan_id", "first_funding_date_actual")
    account = ("account_id", "second_first_funded_loan_id", "second_first_funding", "true_first_funding", "state")
    if "by_month" not in second.columns:
        second = _fold(second, ["customer_id", *account], [F.col("mon"), F.col("net_fees")], "by_month")
    second = second.select(F.col("customer_id").alias("__c"), *account, "by_month")
    first = first.select("customer_id", *own, F.col("month_calculated").alias("month"), "net_fees")
    # A customer and month should occur once; where they don't, each such row is met.
    by_customer = _fold(
        first.where(F.col("customer_id").isNotNull()).repartition("customer_id"), [F.col("customer_id").alias("__k")],
        ["month", *own, "net_fees"], "__first")
    # Made below the join: beside the lambdas that read them, Spark would work them out for every month anew.
    months = F.col("__first")["month"]
    repeats = F.size(F.array_distinct(months)) < F.size(months)
    gapless = ~repeats & (F.get(months, F.size(months) - 1) - F.get(months, F.lit(0)) + 1 == F.size(months))
    looked_up = by_customer.withColumns({
        "__months": months, "__repeats": repeats,
        "__from": F.when(gapless, F.get(months, F.lit(0)))})

    def only(m: Column) -> Column:
        place = F.coalesce(m["mon"] - F.col("__from"), F.array_position("__months", m["mon"]) - 1).cast("int")
        return F.get("__first", place)

    def met(m: Column) -> Column:
        same = F.filter("__first", lambda e: e["month"] == m["mon"])
        return F.when(F.size(same) > 0, same).otherwise(F.array(F.lit(None).cast(entry_type)))

    def merged(m: Column, e: Column) -> Column:
        f, s = e["net_fees"], m["net_fees"]
        fees = F.when(f.isNotNull() | s.isNotNull(), F.coalesce(f, F.lit(0)) + F.coalesce(s, F.lit(0)))
        return F.struct(*[e[c].alias(c) for c in own], m["mon"].alias("month_calculated"), fees.alias("net_fees"),
                        F.lit(True).alias("__there"))

    entry_type = by_customer.schema["__first"].dataType.elementType.simpleString()
    # A month without a partner is one row of the account's own, or none before the cutoff.
    late = F.coalesce(F.col("true_first_funding").cast("date") >= cutoff, F.lit(False))
    several = F.flatten(F.transform(
        F.filter("by_month", lambda m: F.coalesce(F.array_contains("__months", m["mon"]), F.lit(False)) | late),
        lambda m: F.transform(met(m), lambda e: merged(m, e))))
    one = F.transform(F.filter("by_month", lambda m: only(m).isNotNull() | late), lambda m: merged(m, only(m)))
    paired = second.join(looked_up, F.col("__c") == F.col("__k"), "left").select(
        "__c", *account, F.when(F.col("__repeats"), several).otherwise(one).alias("__rows"))
    both = paired.groupBy("__c", *account).agg(
        F.flatten(F.collect_list("__rows")).alias("__rows"))

    taken = second.where(F.col("__c").isNotNull()).groupBy("__c").agg(
        F.array_distinct(F.flatten(F.collect_set(F.col("by_month")["mon"]))).alias("__taken"))
    nothing = F.expr(f"named_struct('mon', int(null), 'net_fees', cast(null as {_fee_type(second)}))")

    def alone(entries: Column) -> Column:
        return F.transform(entries, lambda e: merged(nothing, e).withField("month_calculated", e["month"]))

    free = F.filter("__first", lambda e: ~F.coalesce(F.array_contains(F.col("__taken"), e["month"]), F.lit(False)))
    first_only = by_customer.join(taken, F.col("__k") == F.col("__c"), "left").select(
        F.col("__k").alias("__c"), alone(free).alias("__rows"))
    unowned = first.where(F.col("customer_id").isNull()).distinct().select(
        F.lit(None).cast(first.schema["customer_id"].dataType).alias("__c"),
        alone(F.array(F.struct("month", *own, "net_fees"))).alias("__rows"))
    every = both.unionByName(first_only, allowMissingColumns=True).unionByName(unowned, allowMissingColumns=True)
    # Equal rows have equal months, and few owners have a month twice.
    once = F.size(F.array_distinct(F.col("__rows")["month_calculated"])) == F.size("__rows")
    rows = every.withColumn("__rows", F.when(once, F.col("__rows")).otherwise(F.array_distinct("__rows")))
    # An outer generator, for Spark filters before any other by the size of what it makes, which makes it again.
    # A row without months gives one of NULLs, told by its missing mark.
    return rows.select("__c", *account, F.inline_outer("__rows")).where("__there").select(
        F.col("__c").alias("customer_id"), "account_id", *own, *account[1:], "month_calculated", "net_fees")


def _fee_type(folded: DataFrame) -> str:
    return folded.schema["by_month"].dataType.elementType["net_fees"].dataType.simpleString()


# Fee horizons in months -> output name.
FEE_HORIZONS = {3: "three", 6: "six", 9: "nine", 12: "twelve", 15: "fifteen", 18: "eighteen"}


def horizon_fee_lookup(
    base: DataFrame, curve: DataFrame, as_of: Column | date, horizons: Sequence[int] = tuple(FEE_HORIZONS), wait: int = 3
) -> DataFrame:
    """The customer's fees at fixed months, once the loan is ``wait`` months
    older than that. Two curve rows for one (customer, month) are an error."""
    as_of = F.lit(as_of)
    wanted = curve.where(F.col("month_calculated").isin(*horizons))
    month = F.col("month_calculated")
    wide = wanted.groupBy(F.col("customer_id").alias("__c")).agg(
        *[F.max(F.when(month == m, F.col("net_fees"))).alias(f"__f{m}") for m in horizons],
        *[F.count_if(month == m).alias(f"__n{m}") for m in horizons],
    )
    joined = base.join(wide, base["customer_id"] == wide["__c"], "left")

    def fee(m: int) -> Column:
        ripe = F.col("funding_date_actual") <= F.add_months(as_of, -(m + wait))
        message = F.concat(F.lit(f"more than one fee at month {m} for customer "), F.col("__c").cast("string"))
        value = F.when(F.col(f"__n{m}") > 1, F.raise_error(message).cast(curve.schema["net_fees"].dataType)).otherwise(
            F.col(f"__f{m}"))
        return F.when(ripe, value).alias(f"{FEE_HORIZONS.get(m, m)}_month_net_fees")

    return joined.select(*base.columns, *[fee(m) for m in horizons])
