"""Hand-written cases for the composite operators: ties, NULLs, exact bounds, kept quirks."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as K
from cohortloom.operators import curves as C
from cohortloom.operators import features as X
from cohortloom.operators import leads as L
from cohortloom.operators import outcomes as O
from cohortloom.operators import rates as R
from cohortloom.operators.quality import drift_report, expect_one
from cohortloom.session import configure

D = Decimal
AS_OF = date(2020, 1, 1)
FLOW = ("loan_task_committed_id long, loan_id long, customer_id long, eff_date date, sub_type_cd string, "
        "status_cd string, total_amount decimal(18,2), interest decimal(18,2), misc_fees decimal(18,2)")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def flow(i, loan, day, kind, status, amount, interest=None, misc=None, customer=1):
    dec = lambda x: None if x is None else D(str(x))
    return (i, loan, customer, day, kind, status, dec(amount), dec(interest), dec(misc))


def test_cohort_skips_repeat_customers(spark):
    day = date(2018, 1, 1)
    loans = spark.createDataFrame([
        (1, 1, None, "payday", "paid_off", day), (2, 1, None, "payday", "issued", day),  # 2 has an earlier closed loan
        (3, 2, None, "payday", "in_default_pmt_proc", day), (4, 2, None, "payday", "issued", day),  # not a closing status
        (5, 3, None, "payday", "declined", day), (6, 3, 5, "payday", "paid_off", day),
        (7, 3, None, "payday", "issued", day), (8, 4, None, "payday", None, day), (9, 5, None, "cso", "issued", day),
    ], "id long, customer_id long, base_loan_id long, loan_type_cd string, status_cd string, funding_date_actual date")
    ripe = spark.createDataFrame([(i, date(2019, 10, 3)) for i in range(1, 10)], "loan_id long, matures_on date")
    got = K.first_time_cohort(loans, "payday", date(2017, 1, 1), AS_OF, ripe)
    assert rows(got, "loan_id") == [(1,), (3,), (4,), (7,)]
    late = ripe.withColumn("matures_on", F.lit(date(2019, 10, 4)))
    assert K.first_time_cohort(loans, "payday", date(2017, 1, 1), AS_OF, late).count() == 0


def test_installment_maturity_must_be_unique(spark):
    twice = spark.createDataFrame([(1, 4, AS_OF), (1, 4, AS_OF)], "loan_id long, installment_number int, due_date date")
    with pytest.raises(Exception, match="not unique"):
        K.installment_maturity(twice).collect()


def test_lead_window_bounds(spark):
    t = datetime(2020, 1, 10, 12)
    left = spark.createDataFrame([(1, 1, t), (2, 2, t), (3, 3, t), (4, 4, t)], "lid long, c long, t timestamp_ntz")
    leads = spark.createDataFrame([
        (9, 1, t - timedelta(days=3), "import", "late id"), (5, 1, t + timedelta(minutes=30), "import", "low id"),
        (1, 2, t - timedelta(days=3, seconds=1), "import", "a"), (2, 2, t + timedelta(minutes=30, seconds=1), "import", "b"),
        (3, 3, t, "bounced", "c"), (4, 4, t, "import", None),
    ], "id long, c long, created_on timestamp_ntz, type_cd string, source_type_cd string")
    got = L.lead_flags(left, leads, {"c": "c"}, F.col("t"))
    assert rows(got, "lid", "appeared_in_leads_flg", "purchased_leads_flg", "rejected_leads_flg", "lead_provider") == [
        (1, 1, 1, 0, "low id"), (2, 0, 0, 0, "organic"), (3, 1, 0, 1, "organic"), (4, 1, 1, 0, None)]


def test_history_counts(spark):
    t = datetime(2020, 1, 10, 12)
    lag = F.col("t") - F.expr("interval 3 days")
    left = spark.createDataFrame([(1, t), (2, t)], "c long, t timestamp_ntz")
    seen = spark.createDataFrame([
        (1, datetime(2020, 1, 7, 11, 59)), (1, datetime(2020, 1, 7, 12)), (1, datetime(2020, 1, 2, 1)),
        (1, datetime(2020, 1, 2, 5)), (2, datetime(2020, 1, 7, 12))], "c long, p timestamp_ntz")
    assert rows(L.earlier_days(left, seen, {"c": "c"}, lag, "p", "n"), "c", "n") == [(1, 2), (2, 0)]
    leads = seen.select("c", F.col("p").alias("created_on"), F.lit("import").alias("type_cd"))
    # Leads compare their day: 7 January at midnight lies before 7 January noon.
    got = L.earlier_leads(left, leads, {"c": "c"}, lag, "days", "bought")
    assert rows(got, "c", "days", "bought") == [(1, 2, 4), (2, 1, 1)]


def test_trailing_rate_day_bounds(spark):
    noon, midnight = datetime(2020, 3, 10, 12), datetime(2020, 3, 10)
    base = spark.createDataFrame([(1, noon, "a"), (2, midnight, "a"), (3, noon, None), (4, noon, "zz"), (5, None, "a")],
                                 "lid long, t timestamp_ntz, s string")
    day = date(2020, 3, 10)
    outcomes = spark.createDataFrame(
        [(day - timedelta(days=k), "a", v) for k, v in ((34, 1), (33, 1), (32, 0), (3, 0), (2, 1))] + [(day, None, 1)],
        "d date, s string, v int")
    got = R.trailing_rates(base, outcomes, F.col("t"), "d", {"s": (F.col("s"), F.col("s"))}, {"v": F.col("v")}, horizons=(30,))
    assert rows(got, "lid", "s_v_rate_30_day") == [(1, 0.0), (2, 1 / 3), (3, None), (4, None), (5, None)]


def test_daily_rates_by_steps_equal_the_full_build(spark, tmp_path):
    """Days folded in parts, added up, put in place twice, and restated with a row less."""
    day = date(2020, 1, 1)
    sold = [(day + timedelta(days=i % 50), "ab"[i % 2] if i % 7 else None, i % 3 == 0) for i in range(300)] + [(None, "a", True)]
    make = lambda rows: spark.createDataFrame(rows, "d date, s string, v boolean")
    args = "d", {"s": F.col("s"), "all": F.lit("x")}, {"v": F.col("v").cast("int")}
    columns = "kind", "value", "day", "sum_v", "n_v"
    full = rows(R.daily_rates(make(sold), *args), *columns)
    parts = [R.daily_rates(make(sold[i::3]), *args) for i in range(3)]
    assert rows(R.add_daily_rates(R.add_daily_rates(parts[0], parts[1]), parts[2]), *columns) == full

    path, mid, end = str(tmp_path / "daily"), day + timedelta(days=20), day + timedelta(days=50)
    gone = [r for r in sold if r[0] != mid]
    for outcomes, since, until in ((sold, day, mid), (gone, mid, end), (gone, mid, end), (sold, mid, mid + timedelta(days=1))):
        state = R.refresh_daily_rates(path, make(outcomes), *args, since, until)
    assert rows(state, *columns) == full
    state = R.refresh_daily_rates(path, make(gone), *args, mid, mid + timedelta(days=1))
    assert rows(state, *columns) == rows(R.daily_rates(make(gone), *args), *columns)


def test_gather_keeps_base_rows_and_refuses_duplicates(spark):
    base = spark.createDataFrame([(1, 10), (2, None)], "loan_id long, k long")
    table = spark.createDataFrame([(10, "x"), (11, "y")], "id long, v string")
    got = X.gather(base, [X.pick(base, table, "k", "id", [F.col("v")])])
    assert rows(got, "loan_id", "k", "v") == [(1, 10, "x"), (2, None, None)]
    twice = table.union(table)
    with pytest.raises(Exception, match="more than one row"):
        X.gather(base, [X.pick(base, twice, "k", "id", [F.col("v")])]).collect()
    with pytest.raises(Exception, match="more than one row"):
        expect_one(twice, ["id"], "table").collect()


def test_local_hours_are_not_wrapped(spark):
    df = spark.createDataFrame([(h, datetime(2020, 5, 3, h), g) for h, g in ((0, -10), (5, -5), (6, -6), (19, -5), (20, -6), (23, 2), (9, None))],
                               "h int, t timestamp_ntz, g int")
    got = X.calendar_features(df, "t", "g")
    assert rows(got, "h", "apply_at_localmorning", "apply_at_localafternoon", "apply_at_localevening") == [
        (0, 0, 0, 1), (19, 0, 0, 1), (20, 0, 0, 1), (23, 0, 0, 1), (5, 1, 0, 0), (6, 1, 0, 0), (9, 0, 0, 0)]


def test_contact_features(spark):
    t = datetime(2020, 5, 3)
    df = spark.createDataFrame([
        (1, "Jo.Smith85@gmail.com", t, date(1985, 3, 4), "jo", "smith", "1 MAIN", "Town"),
        (2, "x12y34@ymail.co", t, date(1990, 12, 1), "a_", "Y34", "1 main", "town"),
        (3, None, t, None, None, None, None, None), (4, "nosign", t, date(1990, 1, 1), "no", "zz", "A", "A"),
    ], "i int, e string, t timestamp_ntz, b date, f string, l string, a string, c string")
    got = {r.i: r for r in X.contact_features(df, "e", "t", "b", "f", "l", "a", "c").collect()}
    assert (got[1].email_domain, got[1].email_gmail, got[1].email_num_digit, got[1].email_digit_not_end) == ("gmail.com", 1, 2, False)
    assert got[1].email_had_dob and got[1].email_has_first_name and got[1].email_has_hyphen_dot_underscore
    assert (got[2].email_yahoo, got[2].email_ymail, got[2].email_num_digit, got[2].email_digit_not_end) == (1, 1, 4, True)
    assert (got[2].email_has_first_name, got[2].email_has_last_name, got[2].address_lower) == (False, True, 1)
    assert (got[3].email_num_digit, got[3].email_digit_not_end, got[3].email_has_first_name) == (0, None, None)
    assert (got[4].email_domain, got[4].email_digit_not_end, got[4].address_upper) == ("", None, 1)


def test_fee_curve(spark):
    start = date(2018, 1, 1)
    first = spark.createDataFrame([(1, 11, start), (2, 22, start), (3, 33, AS_OF - timedelta(days=30))],
                                  "customer_id long, loan_id long, funding_date_actual date")
    flows = [
        flow(1, 11, start - timedelta(days=9), "principal_out", "ach", -100),
        flow(2, 11, start + timedelta(days=487), "payment", "created", 50, 5, 1),  # exactly 16 months
        flow(3, 11, start + timedelta(days=488), "customer_balance_reconciliation", "ach", 7, 2, None),
        flow(4, 11, start, "payment", "returned", 900, 9, 9), flow(5, 33, AS_OF, "payment", "ach", 1, 1, 1, 3),
    ]
    got = C.cumulative_fee_curve(first, spark.createDataFrame(flows, FLOW), AS_OF)
    by_month = {r.month_calculated: r for r in got.collect()}
    assert sorted(by_month) == list(range(1, 24))  # 730 days are 23 whole months; customers 2 and 3 have no rows
    assert [by_month[m].net_fees_final_status for m in (1, 15, 16, 17)] == [D(-100), D(-100), D(-50), D(-50)]
    assert [by_month[m].net_fees_in_flight for m in (15, 16, 17)] == [D(0), D(6), D(6)]
    assert by_month[16].calc_date == start + timedelta(days=487)


def test_status_switch(spark):
    day = date(2019, 3, 1)
    curve = spark.createDataFrame([(1, 10, day, 1, day, D(7), D(3)), (2, 20, day, 1, day, D(7), D(3))],
                                  "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, "
                                  "calc_date date, net_fees_final_status decimal(18,2), net_fees_in_flight decimal(18,2)")
    loans = spark.createDataFrame([(10, 1, "issued", day), (11, 1, "issued", day), (12, 1, "issued", day + timedelta(days=1)),
                                   (13, 1, "declined", day), (20, 2, "issued", day)],
                                  "id long, customer_id long, status_cd string, funding_date_actual date")
    statuses = spark.createDataFrame([(1, 10, "issued", datetime(2019, 1, 1)), (2, 11, "issued", datetime(2019, 1, 1)),
                                      (3, 11, "paid_off", datetime(2019, 3, 1, 23)), (4, 11, "issued", datetime(2019, 3, 2))],
                                     "id long, loan_id long, status_cd string, eff_start_time timestamp_ntz")
    assert rows(C.status_switched_fees(curve, loans, statuses), "customer_id", "loan_id", "net_fees") == [(1, 11, D(7)), (2, 20, D(3))]


def test_merge_curves(spark):
    first = spark.createDataFrame([(1, 10, AS_OF, 1, D(5)), (2, 20, AS_OF, 1, None)],
                                  "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, net_fees decimal(18,2)")
    early, late = date(2013, 12, 31), date(2014, 1, 1)
    second = spark.createDataFrame(
        [(1, 1, 7, 70, early, early, "OH", D(2)), (2, 1, 8, 80, early, early, "OH", None), (3, 1, 9, 90, early, early, "TX", D(1)),
         (4, 1, 5, 50, late, late, "TX", D(1)), (4, 1, 5, 50, late, late, "TX", D(1)), (None, 1, 6, 60, late, late, "TX", D(4))],
        "customer_id long, mon int, account_id long, second_first_funded_loan_id long, second_first_funding date, "
        "true_first_funding date, state string, net_fees decimal(18,2)")
    got = C.merge_curves(first, second, late)
    assert rows(got, "customer_id", "account_id", "net_fees") == [(1, 7, D(7)), (2, 8, None), (4, 5, D(1)), (None, 6, D(4))]
    assert rows(C.merge_curves(first, second.where("false"), late), "customer_id", "net_fees") == [(1, D(5)), (2, None)]


def test_horizon_fee_needs_age_and_one_row(spark):
    ripe = date(2019, 4, 1)  # nine months before the as-of date
    base = spark.createDataFrame([(1, 1, ripe), (2, 1, ripe + timedelta(days=1))], "loan_id long, customer_id long, funding_date_actual date")
    curve = spark.createDataFrame([(1, 6, D(5))], "customer_id long, month_calculated int, net_fees decimal(18,2)")
    assert rows(C.horizon_fee_lookup(base, curve, AS_OF, (6,)), "loan_id", "six_month_net_fees") == [(1, D(5)), (2, None)]
    with pytest.raises(Exception, match="more than one fee"):
        C.horizon_fee_lookup(base, curve.union(curve), AS_OF, (6,)).collect()


def test_installment_performance(spark):
    old, new = date(2019, 1, 1), date(2019, 10, 3)  # the second is exactly 90 days before the as-of date
    inst = spark.createDataFrame([(1, 1, 1, old, 5), (2, 1, 2, old, 5), (3, 1, 3, new, 5), (4, 1, 4, old, 3), (5, 1, 5, AS_OF, 1)],
                                 "id long, loan_id long, installment_number int, due_date date, installment_status_id int")
    history = spark.createDataFrame([(4, 3), (4, 4), (5, 3), (2, 5)], "installments_static_id long, installment_status_id int")
    mart = spark.createDataFrame([(1, 3, D(20))], "loan_id long, number_paid_installments int, net_fees decimal(18,2)")
    base = spark.createDataFrame([(1, "paid_off", D(100)), (2, "issued", D(100))], "loan_id long, loan_status string, loan_amount decimal(18,2)")
    got = {r.loan_id: r for r in O.installment_performance(base, inst, history, mart, AS_OF).collect()}
    a, b = got[1], got[2]
    assert (a.number_installments_expected, a.number_installments_come_due, a.number_installments_paid) == (5, 4, 3)
    assert (a.early_payoff_flg, a.percent_through_early_payoff, float(a.profit_rate)) == (1, 0.6, 0.2)
    assert (a.first_inst_ini_def_flg, a.fourth_inst_ini_def_count, a.sixth_inst_ini_def_count) == (0, 1, 2)
    assert (a.first_inst_fin_def_flg, a.third_inst_fin_def_flg, a.fourth_inst_fin_def_flg, a.fifth_inst_fin_def_flg) == (0, None, 1, None)
    assert (b.number_installments_expected, b.early_payoff_flg, b.sixth_inst_ini_def_flg, b.first_inst_fin_def_flg) == (0, 0, 0, None)


def test_withdrawals_survival_payback(spark):
    start = date(2019, 1, 31)
    base = spark.createDataFrame([(1, start), (2, start), (3, start)], "loan_id long, funding_date_actual date")
    flows = spark.createDataFrame([
        flow(1, 1, start, "payment", "ach", 30), flow(2, 1, date(2019, 4, 30), "principal_out", "ach", -100),
        flow(2, 1, date(2019, 5, 1), "principal_out", None, -50), flow(3, 1, start, "principal_out", "returned", -999),
        flow(4, 1, date(2019, 10, 1), None, "ach", 5), flow(5, 1, date(2020, 1, 2), "payment", "ach", 1),
        flow(6, 2, date(2019, 10, 2), "principal_out", "ach", -10), flow(6, 2, date(2019, 10, 2), "principal_out", "ach", -20),
        flow(7, 2, date(2019, 10, 2), "payment", "ach", 40),
    ], FLOW)
    w = {r.loan_id: r for r in O.withdrawal_stats(base, flows, AS_OF).collect()}
    # 31 January and three months end on 30 April; a missing status counts; all cash up to the first withdrawal counts.
    assert (w[1].total_withdrawn_3m, w[1].total_withdrawn, w[1].total_withdraws_6m) == (D(100), D(150), 2)
    assert w[1].first_withdraw_amount == D(120)  # -30 + 100 + 50
    assert (w[3].total_withdrawn, w[3].total_withdraws, w[3].first_withdraw_amount) == (0, 0, 0)
    s = {r.loan_id: (r.last_activity, r.time_alive, r.censored) for r in O.survival_stats(base, flows, AS_OF).collect()}
    assert s == {1: (date(2019, 10, 1), 243, 0), 2: (date(2019, 10, 2), 244, 1), 3: (None, None, 0)}
    p = {r.loan_id: (r.in_money, r.out_money, r.full_payback_first_payment) for r in O.first_payback(base, flows).collect()}
    assert p == {1: (D(30), D(100), 0), 2: (D(80), D(30), 1), 3: (None, None, 0)}  # two tied withdrawals count the payment twice


def test_cash_flow_is_read_once(spark, tmp_path):
    """The result reads the staged folds alone, and a row without an id counts but is never the first."""
    start, path = date(2019, 1, 31), str(tmp_path / "flows")
    base = spark.createDataFrame([(1, start)], "loan_id long, funding_date_actual date")
    spark.createDataFrame([flow(None, 1, start, "principal_out", "ach", -7), flow(4, 1, start, "principal_out", "ach", -5),
                           flow(9, 1, start, "payment", "ach", 3)], FLOW).write.parquet(path)
    got = O.cash_flow_outcomes(base, spark.read.parquet(path), AS_OF)
    assert got.inputFiles() and not [f for f in got.inputFiles() if path in f]
    r = got.first()
    assert (r.total_withdrawn, r.total_withdraws, r.first_withdraw_amount, r.in_money, r.out_money) == (D(12), 2, D(5), D(3), D(5))


def test_statement_performance_last_business_day(spark):
    due = date(2019, 3, 1)  # a Friday; five business days end on the 8th
    statements = spark.createDataFrame([(1, 1, due, None, D(1), D(0), D(0)), (2, 2, due, None, D(0), D(0), D(0)), (3, 3, due, AS_OF, D(1), D(0), D(0))],
                                       "id long, loan_id long, due_date date, due_date_adjusted date, total_interest_due decimal(18,2), principal_due decimal(18,2), fees_due decimal(18,2)")
    booked = spark.createDataFrame([(1, date(2019, 3, 8), "uncollectedX", "late FEES_DUE"), (2, date(2019, 3, 9), "uncollected_a", "fees_due"),
                                    (3, due, "uncollected_a", "fees_due")], "loan_id long, eff_date date, debit_account_cd string, name string")
    base = spark.createDataFrame([(1,), (2,), (3,), (4,)], "loan_id long")
    got = O.statement_performance(base, statements, booked, AS_OF)
    assert rows(got, "loan_id", "positive_amount_due_flag", "statement_initial_default_flag") == [(1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0)]


def test_payback_ratio(spark):
    start = date(2019, 1, 31)
    base = spark.createDataFrame([(i, start) for i in (1, 2, 3)], "loan_id long, funding_date_actual date")
    st = spark.createDataFrame([(1, date(2019, 4, 30), D(5), D(0)), (1, start, D(0), D(0)), (1, date(2019, 5, 1), D(1), D(9)),
                                (2, date(2019, 4, 30), D(5), D(1))],
                               "loan_id long, statement_due_date date, amount_paid decimal(18,2), unpaid_balance decimal(18,2)")
    assert rows(O.payback_ratio(base, st), "loan_id", "payback_100") == [(1, 1), (2, 0), (3, 0)]


def test_existing_flag_is_strict(spark):
    a, b = date(2019, 1, 1), date(2019, 1, 2)
    loans = spark.createDataFrame([(1, 1, "issued", a), (2, 1, "issued", a), (3, 1, "issued", b), (4, 2, "declined", a), (5, 2, "issued", b),
                                   (6, 3, "issued", None), (7, None, "issued", a), (8, None, "issued", b)],
                                  "loan_id long, customer_id long, status_cd string, funding_date_actual date")
    assert rows(O.existing_flag(loans, loans), "loan_id", "existing_flg") == [
        (1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False)]


def test_drift_report(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    assert rows(drift_report(df, big=F.col("a") > 1, small=F.col("a") < 0), "check_name", "row_count") == [("big", 1), ("small", 0)]


def test_second_platform_pick(spark):
    d = date(2018, 3, 1)
    loans = spark.createDataFrame([(2, 1, 2, 6, d, 43), (1, 1, 1, 6, d, 43), (3, 2, 3, 6, d, 1), (4, 3, 4, 9, d, 35), (5, 4, 5, 6, d, 35)],
                                  "loan_id long, account_id long, loan_agreement_id long, loan_status_id int, disbursement_date date, region_id int")
    applications = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 4), (5, 3)], "loan_agreement_id long, brand_id int")
    statuses = spark.createDataFrame([(6, "paid_off"), (9, "issued")], "loan_status_id int, loan_status string")
    identities = spark.createDataFrame([(i, str(100 + i)) for i in (1, 2, 3, 4)], "account_id long, public_identifier string")
    other = spark.createDataFrame([
        (50, 101, "issued", d + timedelta(days=1)), (40, 101, "issued", d), (30, 101, "declined", d - timedelta(days=9)),
        (70, 102, "issued", d - timedelta(days=5)), (60, 102, "issued", None), (80, 102, "paid_off", d - timedelta(days=5)),
    ], "id long, customer_id long, status_cd string, funding_date_actual date")
    got = C.second_platform_first_loan(loans, applications, statuses, identities, other, AS_OF)
    # Account 1: both dates tie with or follow the disbursement, so the lowest id wins. Account 2: the earlier start wins.
    assert rows(got, "account_id", "first_funded_loan_id", "state", "first_platform_loan_id") == [
        (1, 1, "TX", 40), (2, 3, "unexpected", 70)]


def test_cashout_and_net_cash(spark):
    start, as_of = date(2019, 1, 31), date(2019, 4, 30)
    accounts = spark.createDataFrame([(1, 9, 5, start, 43, "TX", "called_due", None, None, 0)],
                                     "first_funded_loan_id long, account_id long, customer_id long, first_funding_date date, region_id int, state string, "
                                     "loan_status string, first_platform_loan_id long, first_platform_funding_date date, days_since_first_funding int")
    loans = spark.createDataFrame([(1, 9, 7, start, D(100)), (2, 9, 6, date(2019, 3, 31), D(50))],
                                  "loan_id long, account_id long, loan_status_id int, disbursement_date date, amount decimal(18,2)")
    statuses = spark.createDataFrame([(6, "paid_off"), (7, "called_due")], "loan_status_id int, loan_status string")
    # The first default event is exactly at the second horizon, midnight of 31 March.
    history = spark.createDataFrame([(2, 1, "past_due", datetime(2019, 3, 31)), (1, 1, "current", datetime(2019, 2, 1))],
                                    "id long, loan_id long, to_status string, created_at timestamp_ntz")
    cash = C.monthly_cashout(accounts, loans, history, as_of)
    assert rows(cash, "mon", "total_cash_out", "defaulted_principal") == [(1, D(100), 0.0), (2, D(150), 100.0), (3, D(150), 100.0)]
    payments = spark.createDataFrame([(1, 1, date(2019, 3, 1), 3, 2, 1), (2, 1, date(2019, 2, 1), 1, 2, 1), (3, 2, date(2019, 4, 30), 4, 2, 1)],
                                     "payment_id long, loan_id long, effective_date date, payment_status_id int, payment_purpose_id int, repayment_method_id int")
    activities = spark.createDataFrame([(1, 1), (3, 3)], "activity_id long, payment_id long")
    entries = spark.createDataFrame([(1, 2, 1, D(30)), (1, 2, 2, D(60)), (1, 1, 1, D(999)), (3, 2, 3, D(7))],
                                    "activity_id long, ledger_id int, entry_type_id int, amount decimal(18,2)")
    types = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0)], "entry_type_id int, credit_account_id int, debit_account_id int")
    ledger = spark.createDataFrame([(0, "cso_cash"), (1, "interest"), (2, "principal_x"), (3, "rubbish")], "account_id int, account string")
    net = C.monthly_net_cash(cash, loans, statuses, payments, activities, entries, types, ledger)
    got = {r.mon: r for r in net.collect()}
    # Before any payment in good standing there are no fees, not zero fees; after the default they are cash less principal.
    assert (got[1].total_cash_in, got[1].net_cash, got[1].net_fees, got[1].row_count) == (D(0), D(-100), None, 2)
    assert (got[2].total_cash_in, got[2].net_cash, got[2].net_fees, got[2].row_count) == (D(90), D(-60), -10.0, 3)
    assert (got[3].total_cash_in, got[3].is_broken, got[3].row_count, got[3].entry_amount) == (D(90), True, 3, D(97))


def test_merge_curves_repeats_and_folded_fees(spark):
    early, late = date(2013, 12, 31), date(2014, 1, 1)
    # Month 1 of customer 1 occurs twice, month 2 has no partner; a customer without a key stands alone.
    first = spark.createDataFrame([(1, 10, AS_OF, 1, D(5)), (1, 11, AS_OF, 1, D(6)), (1, 10, AS_OF, 2, D(7)), (None, 30, AS_OF, 1, D(8))],
                                  "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, net_fees decimal(18,2)")
    kind = ("customer_id long, account_id long, second_first_funded_loan_id long, second_first_funding date, "
            "true_first_funding date, state string, mon int, net_fees decimal(18,2)")
    second = spark.createDataFrame(
        [(1, 7, 70, early, early, "OH", 1, D(0)), (1, 7, 70, early, early, "OH", 1, None), (1, 8, 80, late, late, "OH", 3, D(2)),
         (1, 9, 90, early, early, "OH", 4, D(3))], kind)
    want = [(1, 7, 10, 1, D(5)), (1, 7, 11, 1, D(6)), (1, 8, None, 3, D(2)), (1, None, 10, 2, D(7)), (None, None, 30, 1, D(8))]
    names = ("customer_id", "account_id", "first_funded_loan_id", "month_calculated", "net_fees")
    folded = second.groupBy(*second.columns[:6]).agg(F.collect_list(F.struct("mon", "net_fees")).alias("by_month"))
    for form in (second, folded, folded.union(folded)):
        assert rows(C.merge_curves(first, form, late), *names) == sorted(want, key=repr)


def test_merge_curves_moves_no_month_rows(spark):
    """Month rows are made after the last shuffle, and equal ones are found without dealing them out."""
    first = spark.createDataFrame([(1, 10, AS_OF, m, D(5)) for m in range(1, 4)],
                                  "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, net_fees decimal(18,2)")
    second = spark.createDataFrame([(1, m, 7, 70, AS_OF, AS_OF, "OH", D(2)) for m in range(1, 6)],
                                   "customer_id long, mon int, account_id long, second_first_funded_loan_id long, second_first_funding date, "
                                   "true_first_funding date, state string, net_fees decimal(18,2)")
    got = C.merge_curves(first, second, AS_OF)
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Generate inline" in plan and "Exchange" not in plan.split("Generate inline")[0]
    assert got.count() == 5


def test_merge_curves_works_out_nothing_again_for_each_month(spark):
    """Spark moved the search for repeated months into the lambda that runs per month, and made all rows
    anew in a filter before the generator."""
    kind = "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, net_fees decimal(18,2)"
    # Customer 1 has a month missing, customer 2 none, customer 3 no account.
    first = spark.createDataFrame([(c, 10 * c, AS_OF, m, D(m)) for c, months in ((1, (2, 4)), (2, (2, 3)), (3, (1,))) for m in months], kind)
    second = spark.createDataFrame(
        [(c, m, c + 6, 70, AS_OF, day, "OH", D(2)) for c, day in ((1, date(2013, 12, 31)), (2, AS_OF)) for m in range(1, 5)],
        "customer_id long, mon int, account_id long, second_first_funded_loan_id long, second_first_funding date, "
        "true_first_funding date, state string, net_fees decimal(18,2)")
    got = C.merge_curves(first, second, date(2014, 1, 1))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "array_distinct" in line and "lambdafunction" in line]
    assert rows(got, "customer_id", "month_calculated", "first_funded_loan_id", "net_fees") == [
        (1, 2, 10, D(4)), (1, 4, 10, D(6)), (2, 1, None, D(2)), (2, 2, 20, D(4)), (2, 3, 20, D(5)), (2, 4, None, D(2)), (3, 1, 30, D(1))]


def test_status_switch_keeps_what_two_passes_read(spark):
    curve = spark.createDataFrame([(1, 10, AS_OF, 1, AS_OF, D(5), D(3))],
                                  "customer_id long, first_funded_loan_id long, first_funding_date_actual date, month_calculated int, "
                                  "calc_date date, net_fees_final_status decimal(18,2), net_fees_in_flight decimal(18,2)")
    loans = spark.createDataFrame([(10, 1, "issued", AS_OF)], "id long, customer_id long, status_cd string, funding_date_actual date")
    statuses = spark.createDataFrame([(1, 10, "issued", AS_OF)], "id long, loan_id long, status_cd string, eff_start_time date")
    kept = []
    got = C.status_switched_fees(curve, loans, statuses, keep=lambda df, name: kept.append(name) or df)
    assert kept == ["curve-loans"] and rows(got, "loan_id", "net_fees") == [(10, D(3))]


def test_model_table_writes_views_that_steps_share(spark, monkeypatch):
    """Each step grouped or joined the whole driver tables of its view anew."""
    from cohortloom.plans import model_table
    from cohortloom.sources.catalog import Catalog
    from registry import queries

    staged = []
    monkeypatch.setattr(queries, "stage", lambda df, name: staged.append(name) or df)
    monkeypatch.setattr(queries, "_fee_mart", lambda s: None)
    monkeypatch.setattr(queries, "_OUTCOME_BUILDERS", dict.fromkeys(queries._OUTCOME_BUILDERS, lambda *a, **k: None))
    monkeypatch.setattr(model_table, "build_model_table", lambda p, s, since, as_of: None)
    monkeypatch.setattr(queries, "catalog", lambda spark, folder: Catalog(dict.fromkeys(("loans", "installments", "statements"), spark.range(1))))
    for product, views in (("payday", ["loans"]), ("cso", ["loans"]), ("installment", ["loans", "installments"]),
                           ("line_of_credit", ["loans", "statements"])):
        staged.clear()
        queries._model_table(spark, "unread", product)
        assert staged[:len(views)] == views


def test_session_begins_with_many_partitions(spark):
    """A fixed small number of partitions made the task that folds the cash flow grow with the input."""
    session = configure(spark)
    assert int(session.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 200
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
