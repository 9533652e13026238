"""Application features: report columns, code flags, calendar, contact, income."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions import scalars as S


@dataclass(frozen=True)
class ReportSpec:
    """Which table to attach by which key, under which prefix."""

    table: str
    key: str
    prefix: str
    columns: Sequence[str] | None = None  # default: every column of the table
    casts: dict[str, str] = field(default_factory=dict)
    id: str = "id"

    def output(self, source: DataFrame) -> list[Column]:
        tag = f"{self.prefix}_"
        out = []
        for c in self.columns or source.columns:
            value = F.col(c).cast(self.casts[c]) if c in self.casts else F.col(c)
            out.append(value.alias(c if c.startswith(tag) else tag + c))
        return out


def gather(base: DataFrame, parts: Sequence[DataFrame], anchor: str = "loan_id") -> DataFrame:
    """Base rows with the columns of every part that shares their anchor.

    A chain of joins on one key would hold a sort per part in a single task. All
    rows go through one union, one shuffle on the anchor and one grouped pass
    instead, each part travelling as one struct. Two rows of a part for an
    anchor are an error; an anchor without a part's row gets NULLs.
    """
    everything = [base, *parts]
    fields = [[c for c in df.columns if c != anchor] for df in everything]
    rows = None
    for i, (df, columns) in enumerate(zip(everything, fields)):
        piece = df.select(F.col(anchor).alias("__k"), F.struct(*columns).alias(f"__p{i}"))
        rows = piece if rows is None else rows.unionByName(piece, allowMissingColumns=True)
    grouped = rows.groupBy("__k").agg(
        *[F.first(f"__p{i}", ignorenulls=True).alias(f"__p{i}") for i in range(len(everything))],
        *[F.count(f"__p{i}").alias(f"__n{i}") for i in range(len(everything))],
    )
    worst = F.greatest(*[F.col(f"__n{i}") for i in range(len(everything))], F.lit(0))
    message = F.concat(F.lit(f"more than one row to attach for {anchor} "), F.col("__k").cast("string"))
    kept = F.when(worst > 1, F.raise_error(message).cast("boolean")).otherwise(F.col("__n0") == 1)
    return grouped.where(kept).select(
        F.col("__k").alias(anchor),
        *[F.col(f"__p{i}.`{c}`").alias(c) for i, columns in enumerate(fields) for c in columns],
    )


def pick(base: DataFrame, table: DataFrame, key: str, table_key: str, columns: Sequence[Column],
         anchor: str = "loan_id") -> DataFrame:
    """(anchor, columns) of the table's rows that the base refers to by key.

    Only the pairs (anchor, key) meet the table, in an inner join: its small side
    can be broadcast once its size is known, or prune the table's scan, neither
    of which a left join from the base allows. Missing keys never enter it.
    """
    return (
        base.where(F.col(key).isNotNull())
        .select(F.col(anchor).alias("__anchor"), F.col(key).alias("__key"))
        .join(table.select(F.col(table_key).alias("__id"), *columns), F.col("__key") == F.col("__id"))
        .drop("__key", "__id")
        .withColumnRenamed("__anchor", anchor)
    )


def report_star(base: DataFrame, sources, specs: Sequence[ReportSpec], anchor: str = "loan_id") -> DataFrame:
    """Attach many wide reports, each by its own key, and keep every base row.

    Joining the growing base to one report after another would shuffle hundreds
    of columns once per report. Each report's columns move once here.
    """
    picks = [pick(base, sources[s.table], s.key, s.id, s.output(sources[s.table]), anchor) for s in specs]
    return gather(base, picks, anchor)


def code_flags(df: DataFrame, column: str, wanted: Sequence[str], mode: str, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per code, NULL where the text is NULL.

    ``exact`` tests members of a comma list, ``contains`` tests for an infix
    (so the code B7 is also found in B70).
    """
    prefix = prefix or column
    if mode == "exact":
        tests = {c: S.has_token(F.col(column), c) for c in wanted}
    elif mode == "contains":
        tests = {c: S.holds(F.col(column), F.lit(c)) for c in wanted}
    else:
        raise ValueError("mode is 'exact' or 'contains'")
    return df.select("*", *[t.cast("int").alias(f"{prefix}_{c}") for c, t in tests.items()])


def calendar_features(df: DataFrame, at: str, gmt: str) -> DataFrame:
    """Quarter, weekday, day of month and the part of the applicant's day.

    The local hour is not wrapped at 24, so 24 and later count as evening.
    """
    quarter = F.quarter(F.col(at))
    local = F.hour(F.col(at)) + F.col(gmt) + 6
    return df.select(
        "*",
        *[S.flag(quarter == n).alias(f"requested_q{n}") for n in (1, 2, 3, 4)],
        S.weekday_from_sunday(F.col(at)).alias("weekday_application"),
        F.dayofmonth(F.col(at)).alias("monthday_application"),
        S.flag((local >= 6) & (local < 12)).alias("apply_at_localmorning"),
        S.flag((local >= 12) & (local < 20)).alias("apply_at_localafternoon"),
        S.flag((local >= 20) | (local < 6)).alias("apply_at_localevening"),
    )


def contact_features(
    df: DataFrame,
    email: str,
    at: str,
    birth: str,
    first_name: str,
    last_name: str,
    line1: str,
    city: str,
) -> DataFrame:
    """What an e-mail address and the typing of an address tell."""
    # The part before the @ and its first digits serve many features: compute them once.
    work = df.withColumn("__local", S.part(F.col(email), "@", 1)).withColumn(
        "__digits", S.first_digit_run(F.col("__local")))
    local, digits = F.col("__local"), F.col("__digits")
    year = F.year(F.col(birth)).cast("string")
    month_day = F.concat(F.month(F.col(birth)).cast("string"), F.dayofmonth(F.col(birth)).cast("string"))
    tail_start = F.length(local) - F.length(digits) + 1
    return work.select(
        *df.columns,
        S.part(F.col(email), "@", 2).alias("email_domain"),
        *[S.flag(S.like_any(F.col(email), p)).alias(f"email_{n}") for n, p in codes.EMAIL_PROVIDERS.items()],
        S.digit_count(local).alias("email_num_digit"),
        (F.position(digits, local) != tail_start).alias("email_digit_not_end"),
        S.holds(local, F.year(F.col(at)).cast("string")).alias("email_has_current_year"),
        (S.holds(local, year) | S.holds(local, F.right(year, F.lit(2))) | S.holds(local, month_day)).alias("email_had_dob"),
        local.rlike("[-._]").alias("email_has_hyphen_dot_underscore"),
        S.ilike_infix(local, F.col(first_name)).alias("email_has_first_name"),
        S.ilike_infix(local, F.col(last_name)).alias("email_has_last_name"),
        F.levenshtein(F.col(last_name), local).alias("levenshtein_distance_lastname"),
        S.flag(F.col(line1) == F.lower(F.col(line1))).alias("address_lower"),
        S.flag(F.col(line1) == F.upper(F.col(line1))).alias("address_upper"),
        S.flag(F.col(city) == F.lower(F.col(city))).alias("city_lower"),
        S.flag(F.col(city) == F.upper(F.col(city))).alias("city_upper"),
    )


def income_features(df: DataFrame, monthly: str, paychecks: str, cap: int = 5000) -> DataFrame:
    """Capped monthly income and the amount of one paycheck."""
    income = S.exact(F.col(monthly))
    capped = F.when(income > cap, S.exact(F.lit(cap))).otherwise(income)

    def per_paycheck(c: Column) -> Column:
        return F.round(c * 12 / F.col(paychecks).cast("decimal(10,0)"), 2)

    return df.select(
        "*",
        capped.alias(f"{monthly}_capped5k"),
        per_paycheck(income).alias("paycheck_amount"),
        per_paycheck(capped).alias("paycheck_amount_capped5k"),
    )


def vintage_months(at: Column, created: Column) -> Column:
    """Months since the customer was created, rounded half up."""
    days = F.datediff(at, created).cast("decimal(12,2)")
    return F.round(days * 12 / F.lit(codes.YEAR_DAYS).cast("decimal(5,2)"), 0)


def utilization_ratio(loan_amount: Column, approval_amount: Column) -> Column:
    return F.round(S.nice_div(S.exact(loan_amount), S.exact(approval_amount)), 5)
