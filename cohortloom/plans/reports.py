"""Which bureau reports a model table carries.

Columns are taken from each report's own schema, so a wider report needs no
change here.
"""

from __future__ import annotations

from cohortloom.operators.features import ReportSpec

# Text-like verification results that the model wants as numbers.
FLEX_ID_CASTS = {
    f"verified_{part}": "int"
    for part in ("first_name", "last_name", "street_address", "city", "state", "zip", "dob")
}

REPORTS = (
    ReportSpec("risk_view_reports", "risk_view_report_id", "rv"),
    ReportSpec("subprime_id_fraud_reports", "subprime_id_fraud_report_id", "csidf"),
    ReportSpec("idscore_reports", "idscore_report_id", "ids"),
    ReportSpec("clearinquiry_reports", "clearinquiry_report_id", "cr"),
    # One table in two roles.
    ReportSpec("phone_reports", "home_phone_report_id", "trhp"),
    ReportSpec("phone_reports", "work_phone_report_id", "trwp"),
    ReportSpec("bank_behavior_reports", "bank_behavior_report_id", "cbb"),
    ReportSpec("flex_id_reports", "flex_id_report_id", "flex", casts=FLEX_ID_CASTS),
)
REPORT_KEYS = tuple(spec.key for spec in REPORTS)
