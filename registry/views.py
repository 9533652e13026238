"""The driver's tables seen as the credit tables the operators expect.

Both sides of a check must read the same input, so each view is one SQL text
with the few dialect differences filled in. The work under test is never here:
views only rename, derive codes from values, and shift dates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, lru_cache, partial

from pyspark.sql import DataFrame, SparkSession

from cohortloom.sources.catalog import Catalog


@dataclass(frozen=True)
class Dialect:
    folder: str | None  # a folder of parquet files for Spark, None for DuckDB views

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`" if self.folder else name

    def minutes(self, ts: str, n: str) -> str:
        if self.folder:
            return f"({ts} + make_dt_interval(0, 0, cast({n} as int)))"
        return f"({ts} + to_minutes(cast({n} as bigint)))"

    def days(self, d: str, n: str) -> str:
        if self.folder:
            return f"date_add({d}, cast({n} as int))"
        return f"({d} + cast({n} as integer))"


CENTS = "cast(round(o_totalprice * 100) as bigint)"
LINE_CENTS = "cast(round(l_extendedprice * 100) as bigint)"


def views(d: Dialect) -> dict[str, str]:
    orders, lines, customer = d.table("orders"), d.table("lineitem"), d.table("customer")
    day = "cast(o_orderdate as date)"
    ship = "cast(l_shipdate as date)"
    line_key = "l_orderkey * 8 + l_linenumber"
    applications = f"""
        select o_orderkey * 2 as application_id, o_orderkey, o_custkey, o_orderpriority, {CENTS} as cents from {orders}
        union all
        select o_orderkey * 2 + 1, o_orderkey, o_custkey, o_orderpriority, {CENTS} from {orders} where o_orderstatus = 'F'
    """
    return {
        # --- core ---
        "loans": f"""
            select o_orderkey as id, o_custkey as customer_id,
                   case when o_orderpriority = '4-NOT SPECIFIED' then o_orderkey - 1 end as base_loan_id,
                   case o_orderpriority when '1-URGENT' then 'payday' when '2-HIGH' then 'installment'
                        when '3-MEDIUM' then 'oec' when '5-LOW' then 'cso' else 'payday' end as loan_type_cd,
                   case when o_orderstatus = 'F' then 'paid_off' when o_orderstatus = 'P' then 'in_default'
                        when o_totalprice < 60000 then 'declined' when o_totalprice < 120000 then 'in_default_pmt_proc'
                        else 'issued' end as status_cd,
                   {d.minutes("o_orderdate", "720")} as requested_time,
                   {day} as funding_date_actual,
                   {d.days(day, "30")} as due_date,
                   {d.days(day, f"30 + {CENTS} % 3")} as due_date_adjusted,
                   cast(o_totalprice as decimal(18,2)) as amount,
                   'S' || cast(c_nationkey as string) as gov_law_state_cd
            from {orders} join {customer} on o_custkey = c_custkey""",
        "approvals": f"""
            select o_orderkey as id, o_custkey as customer_id,
                   {d.minutes("o_orderdate", f"{CENTS} % 1440")} as processed_on,
                   cast(o_totalprice * 2 as decimal(18,2)) as amount,
                   cast({CENTS} % 1000 as double) / 1000 as default_rate,
                   cast(300 + {CENTS} % 400 as double) as credit_score,
                   case when o_orderstatus = 'P' then 0.5 else 0.25 end as profitability_rate,
                   case when o_totalprice > 450000 then 'pre-approved' else 'scored' end as reason_cd,
                   o_totalprice < 20000 as pre_approved_flg,
                   o_orderpriority = '4-NOT SPECIFIED' as existing_flg,
                   o_custkey as long_term_result_id, o_custkey as risk_view_report_id,
                   o_custkey as subprime_id_fraud_report_id, o_custkey as idscore_report_id,
                   o_custkey as clearinquiry_report_id, o_custkey as home_phone_report_id,
                   case when o_orderstatus <> 'F' then o_custkey end as work_phone_report_id,
                   o_custkey as bank_behavior_report_id, o_custkey as flex_id_report_id
            from {orders}""",
        "customer_sources": f"""
            select o_orderkey as id, o_custkey as customer_id,
                   {d.minutes("o_orderdate", f"{CENTS} % 8640 - 4320")} as created_on,
                   case o_orderstatus when 'F' then 'import' when 'P' then 'lead_reject_import' else 'bounced' end as type_cd,
                   o_orderpriority as source_type_cd
            from {orders}""",
        "customers": f"""
            select c_custkey as id, c_custkey as person_id, {d.days("date '1994-01-01'", "c_nationkey * 7")} as created_on,
                   lower(replace(c_name, '#', '.')) || case c_mktsegment when 'HOUSEHOLD' then '@hotmail.com'
                        when 'MACHINERY' then '@ymail.com' when 'BUILDING' then '@gmail.com' else '@example.org' end as email,
                   c_mktsegment as income_type_cd, case when c_acctbal > 5000 then 'deposit' else 'check' end as income_payment_cd
            from {customer}""",
        "people": f"""
            select c_custkey as id, {d.days("date '1950-01-01'", "(c_custkey * 37) % 15000")} as birth_date,
                   split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name
            from {customer}""",
        "addresses": f"""
            select c_custkey as id, case when c_acctbal > 3000 then upper(c_name) else lower(c_name) end as line1,
                   case when c_acctbal > 6000 then 'TOWN' when c_acctbal > 2000 then 'Town' else 'town' end as city,
                   cast(10000 + c_nationkey as string) as zip
            from {customer}""",
        "counties": f"""
            select cast(10000 + n_nationkey as string) as zip, n_regionkey - 10 as gmt from {d.table("nation")}""",
        "long_term_results": f"""
            select c_custkey as id, c_acctbal / 10 as six_month_score, c_acctbal / 5 as twelve_month_score,
                   c_acctbal / 4 as twelve_month_score_adj from {customer}""",
        "applications": f"select application_id, o_orderkey as loan_id from ({applications}) a",
        "application_address": f"select application_id, o_custkey as address_id from ({applications}) a",
        "application_income": f"""
            select application_id, case o_orderpriority when '1-URGENT' then 12 when '2-HIGH' then 24
                        when '3-MEDIUM' then 26 else 52 end as paychecks_per_year,
                   o_orderpriority as income_freq_type_cd,
                   cast(cast(100000 + cents % 900000 as decimal(18,2)) / 100 as decimal(18,2)) as income_monthly_net
            from ({applications}) a""",
        "customer_paydates": f"""
            select o_orderkey as id, o_custkey as customer_id, {d.days(day, f"14 + {CENTS} % 90")} as next_paydate
            from {orders}""",
        "data_changes": f"""
            select o_orderkey as id, o_custkey as record_id,
                   case when o_totalprice > 400000 then 'people' else 'customers' end as table_name,
                   case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'email'
                        when o_orderpriority = '3-MEDIUM' then 'income_type_cd' else 'income_payment_cd' end as column_name,
                   {d.minutes("o_orderdate", f"{CENTS} % 1440")} as change_time,
                   case when o_orderstatus = 'O' and o_totalprice > 300000 then null
                        else 'jo-' || cast(o_orderkey as string) || '@sky.com' end as old_value
            from {orders}""",
        "bank_accounts": f"""
            select o_orderkey as payment_instrument_id, o_custkey as person_id,
                   {d.minutes("o_orderdate", f"{CENTS} % 2000")} as created_on,
                   case when o_totalprice > 490000 then 'none' else '0' || cast({CENTS} % 50 as string) end as routing_number
            from {orders}""",
        "bank_bad_rates": f"""
            select {CENTS} % 50 as routing_num,
                   cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as bank_bad_rate_month,
                   cast(count(*) as double) / 8 as bad_rate, cast(min({CENTS}) % 1000 as double) / 1000 as bad_rate_individual,
                   cast(max({CENTS}) % 100 as double) / 100 as bad_rate_30, cast(min({CENTS}) % 70 as double) / 100 as bad_rate_individual_30,
                   cast(max({CENTS}) % 50 as double) / 100 as bad_rate_60, cast(min({CENTS}) % 30 as double) / 100 as bad_rate_individual_60,
                   max(case when o_orderstatus = 'F' then 1 else 0 end) as credit_union_flg
            from {orders} group by {CENTS} % 50, year(o_orderdate) * 100 + month(o_orderdate)""",
        "loan_statuses": f"""
            select o_orderkey * 2 as id, o_orderkey as loan_id, 'issued' as status_cd, o_orderdate as eff_start_time from {orders}
            union all
            select o_orderkey * 2 + 1, o_orderkey, case o_orderstatus when 'F' then 'paid_off' when 'P' then 'in_default'
                   else 'issued_pmt_proc' end, {d.minutes("o_orderdate", f"60000 + {CENTS} % 400000")} from {orders}""",
        # --- reports ---
        "risk_view_reports": f"""
            select c_custkey as id, c_custkey + 7 as credit_report_id, date '1994-02-01' as created_on,
                   500 + c_acctbal / 75 as score, c_nationkey as addr_stability from {customer}""",
        "subprime_id_fraud_reports": f"""
            select p_partkey as id, p_partkey + 9 as credit_report_id,
                   case when p_type = 'PROMO' then null when p_type = 'SMALL' then ''
                        else cast(p_size as string) || ',' || cast(p_partkey % 31 as string) || ',1' end as csidf_idfraud_indicators,
                   case when p_type = 'LARGE' then null else 'CL0' || cast(p_size % 10 as string) || ' B' || cast(p_size as string)
                        || ' CL' || cast(10 + p_partkey % 14 as string) end as csidf_reason_codes
            from {d.table("part")}""",
        "idscore_reports": f"""
            select s_suppkey as id, s_suppkey + 1 as credit_report_id, s_acctbal as idscore from {d.table("supplier")}""",
        "clearinquiry_reports": f"""
            select s_suppkey as id, s_nationkey as occupation_type, s_name as created_by from {d.table("supplier")}""",
        "phone_reports": f"""
            select n_nationkey as id, n_regionkey as phone_type, n_name as phone_provider from {d.table("nation")}""",
        "bank_behavior_reports": f"""
            select p_partkey as id, p_size as score, p_retailprice as avg_amount_of_checks_attempted_one_year_ago
            from {d.table("part")}""",
        "flex_id_reports": f"""
            select c_custkey as id, cast(c_nationkey % 2 as string) as verified_first_name,
                   case when c_acctbal > 0 then '1' end as verified_dob, c_nationkey as verification_index_id from {customer}""",
        # --- products ---
        "installments": f"""
            select {line_key} as id, l_orderkey as loan_id, l_linenumber as installment_number,
                   max({ship}) as due_date,
                   max(case l_returnflag when 'R' then 3 when 'A' then 5 else 1 end) as installment_status_id
            from {lines} group by l_orderkey, l_linenumber""",
        "installment_status_history": f"""
            select {line_key} as installments_static_id,
                   case when l_returnflag = 'R' then 4 when l_linestatus = 'F' then 5 else 2 end as installment_status_id
            from {lines}""",
        "statements": f"""
            select {line_key} as id, l_orderkey as loan_id, max({ship}) as due_date,
                   case when min(l_linestatus) = 'F' then null else {d.days(f"max({ship})", "2")} end as due_date_adjusted,
                   cast(sum(l_quantity) as decimal(18,2)) as total_interest_due,
                   cast(sum(case when l_returnflag = 'N' then 0 else {LINE_CENTS} end) as decimal(18,2)) as principal_due,
                   cast(sum(case when l_returnflag = 'N' then -60 else 5 end) as decimal(18,2)) as fees_due
            from {lines} group by l_orderkey, l_linenumber""",
        "payment_transactions": f"""
            select l_orderkey as loan_id, {d.days(ship, f"{LINE_CENTS} % 12")} as eff_date,
                   case when l_returnflag = 'N' then 'principal' when l_linestatus = 'F' then 'uncollected_fees'
                        else 'uncollectedX' end as debit_account_cd,
                   case when l_quantity < 10 then 'other' when l_quantity < 30 then 'Late Fees_Due' else 'PRINCIPAL_DUE now' end as name
            from {lines}""",
        "cash_flow": f"""
            select l_orderkey * 16 + l_linenumber as loan_task_committed_id, l_orderkey as loan_id, o_custkey as customer_id,
                   {ship} as eff_date,
                   case when l_returnflag = 'N' then 'principal_out' when l_linestatus = 'F' then 'payment'
                        when l_quantity < 8 then null when l_quantity < 25 then 'customer_balance_reconciliation'
                        else 'other_credit' end as sub_type_cd,
                   case when l_discount > 0.085 then 'returned' when l_discount > 0.075 then null
                        when l_discount > 0.04 then 'ach' else 'created' end as status_cd,
                   cast(case when l_returnflag = 'N' then -l_extendedprice else l_extendedprice end as decimal(18,2)) as total_amount,
                   cast(l_quantity as decimal(18,2)) as interest,
                   case when l_tax > 0.07 then null else cast(l_tax * 100 as decimal(18,2)) end as misc_fees
            from {lines} join {orders} on l_orderkey = o_orderkey""",
        "payday_chains_performance": f"""
            select o_orderkey as base_loan_id, {d.days(day, "45")} as loan_chain_due_date, {CENTS} % 60 as loan_duration,
                   {CENTS} % 4 as number_funded_extensions, {CENTS} % 3 as count_initial_default,
                   {CENTS} % 2 as count_final_default, cast(o_totalprice as decimal(18,2)) - 100000 as net_fees
            from {orders} where o_orderstatus <> 'P' or o_totalprice > 40000""",
        "payday_loans_performance": f"""
            select o_orderkey as loan_id, case when o_orderstatus = 'P' then 1 else 0 end as initial_default_flg,
                   case when o_totalprice > 250000 then 1 else 0 end as final_default_flg from {orders}""",
        "installment_loans_performance": f"""
            select l_orderkey as loan_id, sum(case when l_returnflag = 'A' then 1 else 0 end) as number_paid_installments,
                   cast(sum({LINE_CENTS}) as decimal(18,2)) as net_fees
            from {lines} group by l_orderkey""",
        "statement_performance": f"""
            select l_orderkey as loan_id, {ship} as statement_due_date, cast(l_quantity as decimal(18,2)) as amount_paid,
                   cast(case when l_returnflag = 'R' then l_quantity when l_tax = 0 then -l_quantity else 0 end as decimal(18,2)) as unpaid_balance
            from {lines}""",
        # --- second platform ---
        "second_loans": f"""
            select o_orderkey as loan_id, o_custkey as account_id, o_orderkey as loan_agreement_id,
                   case when o_orderstatus = 'F' then 6 when o_orderstatus = 'O' then 3 when o_totalprice < 100000 then 5
                        when o_totalprice < 200000 then 7 when o_totalprice < 350000 then 11 else 12 end as loan_status_id,
                   {day} as disbursement_date,
                   case when c_nationkey < 10 then 43 when c_nationkey < 22 then 35 else 1 end as region_id,
                   cast(o_totalprice as decimal(18,2)) as amount
            from {orders} join {customer} on o_custkey = c_custkey""",
        "second_loan_applications": f"""
            select o_orderkey as loan_agreement_id, case when o_orderpriority = '5-LOW' then 3 else 4 end as brand_id from {orders}""",
        "second_loan_statuses": f"""
            select case r_regionkey when 0 then 3 when 1 then 6 when 2 then 7 when 3 then 11 else 12 end as loan_status_id,
                   case r_regionkey when 0 then 'current' when 1 then 'paid_off' when 2 then 'called_due' when 3 then 'past_due'
                        else 'discharged' end as loan_status
            from {d.table("region")}""",
        "second_identities": f"""
            select c_custkey as account_id, cast(c_custkey + 1 as string) as public_identifier from {customer}""",
        "second_loan_status_history": f"""
            select o_orderkey * 2 as id, o_orderkey as loan_id, 'current' as to_status, o_orderdate as created_at from {orders}
            union all
            select o_orderkey * 2 + 1, o_orderkey, case when o_totalprice > 300000 then 'discharged' else 'past_due' end,
                   {d.minutes("o_orderdate", f"40000 + {CENTS} % 300000")} from {orders}""",
        "second_payments": f"""
            select {line_key} as payment_id, l_orderkey as loan_id, max({ship}) as effective_date,
                   case when max(l_quantity) < 5 then 1 when max(l_quantity) < 25 then 3 else 4 end as payment_status_id,
                   case when max(l_tax) > 0.07 then 1 else 2 end as payment_purpose_id,
                   case when max(l_discount) < 0.01 then 9 else 1 end as repayment_method_id
            from {lines} group by l_orderkey, l_linenumber""",
        "second_activities": f"""
            select distinct {line_key} as activity_id, {line_key} as payment_id from {lines} where l_quantity > 2""",
        "second_entries": f"""
            select {line_key} as activity_id, case when l_linestatus = 'F' or l_quantity > 20 then 2 else 1 end as ledger_id,
                   {LINE_CENTS} % 25 as entry_type_id, cast(l_extendedprice as decimal(18,2)) as amount
            from {lines}""",
        "second_entry_types": f"""
            select n_nationkey as entry_type_id, n_nationkey as credit_account_id, 100 + n_regionkey as debit_account_id
            from {d.table("nation")}""",
        "second_ledger_accounts": f"""
            select n_nationkey as account_id, case n_nationkey % 6 when 0 then 'interest_due' when 1 then 'principal'
                   when 2 then 'cso_fee_due' when 3 then 'Interest_late' when 4 then 'other_' || lower(n_name) else 'fee' end as account
            from {d.table("nation")}
            union all
            select 100 + r_regionkey, case when r_regionkey < 4 then 'cso_cash' else 'suspense' end from {d.table("region")}""",
    }


@lru_cache(maxsize=16)
def catalog(spark: SparkSession, folder: str) -> Catalog:
    """All credit tables over one folder of driver tables, each resolved once."""
    return Catalog({name: cache(partial(spark.sql, text)) for name, text in views(Dialect(folder)).items()})


@lru_cache(maxsize=256)
def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_views(body: str, names: list[str], extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: the named views, then further common tables, then the body."""
    all_views = views(Dialect(None))
    parts = [f"{n} as materialized ({all_views[n].strip()})" for n in names]
    parts += [f"{n} as materialized ({text.strip()})" for n, text in (extra or {}).items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
