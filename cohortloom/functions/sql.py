"""The scalar and table functions under their SQL names, for queries written as SQL text.

They are SQL functions: Spark puts their bodies in the plan, so nothing leaves its expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cohortloom.functions import codes


def register_functions(spark: SparkSession) -> None:
    """Make these known to a session, replacing what it has under the names.

    - ``nice_div(a, b)``: NULL for a missing value or a zero divisor;
    - ``issued(status)``: whether a status is a funded one, NULL for NULL;
    - ``add_business_days(d, n)``: the n-th Monday-to-Friday day after d (n >= 1);
    - ``integer_series(low, high)``: rows from low to high, both included; none if high is below low.
    """
    statuses = ", ".join(f"'{s}'" for s in codes.FUNDED_STATUSES)
    for text in (
        "nice_div(a double, b double) returns double return try_divide(a, b)",
        f"issued(status string) returns boolean return status in ({statuses})",
        """add_business_days(d date, n int) returns date return date_add(d, cast(
            n - greatest(weekday(d) - 4, 0) + 2 * floor((least(weekday(d), 4) + n) / 5) as int))""",
        """integer_series(low int, high int) returns table (n int)
            return select explode(case when low <= high then sequence(low, high) else array() end) as n""",
    ):
        spark.sql(f"create or replace temporary function {text}")
