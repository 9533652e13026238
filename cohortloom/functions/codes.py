"""Fixed code values the credit tables use. All are plain facts of the data."""

# Loan statuses of a loan that never paid out money.
UNFUNDED_STATUSES = ("declined", "withdrawn", "on_hold", "approved", "applied")
# Loan statuses of a loan whose money went out.
FUNDED_STATUSES = ("issued", "issued_pmt_proc", "in_default", "in_default_pmt_proc", "paid_off")
# Funded statuses after which no more fees are expected.
CLOSED_STATUSES = ("in_default", "in_default_pmt_proc", "paid_off")
# A customer with an earlier base loan in one of these is a repeat customer.
REPEAT_STATUSES = ("paid_off", "in_default")
# Loan statuses that mark an initial default.
DEFAULT_STATUSES = ("in_default", "in_default_pmt_proc")

# Lead types that count as bought.
PURCHASED_LEAD_TYPES = ("import", "lead_reject_import", "pass_active_customer")
ORGANIC = "organic"

# Installment status ids.
INSTALLMENT_DEFAULT_IDS = (3, 4)
INSTALLMENT_PAID_IDS = (5,)

# Cash-flow codes.
CASH_STATUSES = ("created", "ach")
RETURNED_STATUSES = ("returned", "cancelled")
PRINCIPAL_OUT = "principal_out"
PAYMENT = "payment"
RECONCILIATION = "customer_balance_reconciliation"
ACTIVITY_TYPES = ("principal_out", "payment", "other_credit")

# Ledger pattern and transaction names of an uncollected statement.
UNCOLLECTED_ACCOUNT = "uncollected_%"
UNCOLLECTED_NAMES = ("%fees_due%", "%principal_due%", "%interest_due%")

# Fraud indicators are numbered 1-30 with 22, 23 and 24 not in use.
FRAUD_INDICATORS = tuple(str(n) for n in range(1, 31) if n not in (22, 23, 24))
# Reason codes: CL01-CL23, then five others.
REASON_CODES = tuple(f"CL{n:02d}" for n in range(1, 24)) + ("C405", "B7", "B11", "B12", "B13")

# Score tier floors, best tier first; anything lower or missing is tier 4.
SCORE_TIERS = ((600.0, 1), (578.0, 2), (556.0, 3))
LOWEST_TIER = 4

# E-mail providers: output flag -> LIKE patterns.
EMAIL_PROVIDERS = {
    "hotmail": ("%@hotmail.co%",),
    "gmail": ("%@gmail.com%",),
    "yahoo": ("%@yahoo.co%", "%@ymail.%"),
    "ymail": ("%@ymail.%",),
    "live": ("%@live.co%",),
    "btinternet": ("%@btinternet.%",),
    "aol": ("%@aol.%",),
    "sky": ("%@sky.%",),
    "msn": ("%@msn.%",),
}

# Second lending platform.
SECOND_LOAN_STATUSES = ("current", "paid_off", "called_due", "past_due", "discharged")
SECOND_BRAND = 4
SECOND_REGIONS = {43: "TX", 35: "OH"}
UNEXPECTED_REGION = "unexpected"
SECOND_FUNDED_STATUS_IDS = (3, 6, 7, 11, 12)
SECOND_DEFAULT_STATUS_IDS = (7, 11, 12)
SECOND_DEFAULT_EVENTS = ("called_due", "past_due", "discharged")
PAID_PAYMENT_STATUS_IDS = (3, 4)
LOAN_PAYMENT_PURPOSE_ID = 2
EXCLUDED_REPAYMENT_METHOD_IDS = (9, 10)
OPERATIONAL_LEDGER_ID = 2
CASH_ACCOUNT = "cso_cash"
CASH_IN_WORDS = ("interest", "cso_fee", "principal")
FEE_WORDS = ("interest", "cso_fee")
KNOWN_WORDS = ("interest", "fee", "principal")

# Average month in days; exact in binary.
MONTH_DAYS = 30.4375
# Yearly discount rate and the year length it is spread over.
YEARLY_RATE = 0.12
YEAR_DAYS = 365.25
