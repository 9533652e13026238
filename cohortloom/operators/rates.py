"""Trailing default rates by segment, and the bank-by-month rate lookup."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import scalars as S
from cohortloom.operators.quality import expect_one
from cohortloom.sources.marts import current_version, publish_mart, read_mart

HORIZONS = (30, 60, 90)
LAG_DAYS = 3


def daily_rates(
    outcomes: DataFrame, outcome_day: str, segments: dict[str, Column], flags: dict[str, Column]
) -> DataFrame:
    """Per segment kind, value and day: sum and number of each flag, as ``sum_{flag}`` and ``n_{flag}``.

    This is all that trailing rates need of the outcomes, and it grows with the days of the
    calendar, not with the loans. Outcomes without a day or without a segment value count nowhere.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), c.cast("string").alias("value")) for n, c in segments.items()])
    return (
        outcomes.select(
            F.col(outcome_day).cast("date").alias("day"),
            *[f.cast("double").alias(f"__f_{n}") for n, f in flags.items()], F.explode(kinds).alias("__seg"))
        .where(F.col("__seg.value").isNotNull() & F.col("day").isNotNull())
        .groupBy(F.col("__seg.kind").alias("kind"), F.col("__seg.value").alias("value"), "day")
        .agg(*[F.sum(f"__f_{n}").alias(f"sum_{n}") for n in flags], *[F.count(f"__f_{n}").alias(f"n_{n}") for n in flags])
    )


def add_daily_rates(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The daily sums of outcomes that were folded apart. Each outcome must be in one part only."""
    both = state.unionByName(fresh)
    return both.groupBy("kind", "value", "day").agg(
        *[F.sum(c).alias(c) for c in state.columns if c not in ("kind", "value", "day")])


def refresh_daily_rates(
    path: str, outcomes: DataFrame, outcome_day: str, segments: dict[str, Column], flags: dict[str, Column],
    since: date, until: date,
) -> DataFrame:
    """Fold the outcomes of the days from ``since`` to before ``until`` and put them in the place of
    those days in the published daily sums at ``path``; the first call publishes them.

    Only outcomes of these days are read, by a filter on ``outcome_day`` alone, so that it reaches
    their files. A day folded twice, or folded anew after its outcomes changed or went, counts once.
    """
    within = (F.col(outcome_day) >= F.lit(since)) & (F.col(outcome_day) < F.lit(until))
    fresh = daily_rates(outcomes.where(within), outcome_day, segments, flags)
    spark = outcomes.sparkSession
    if current_version(spark, path):
        state = read_mart(spark, path)
        fresh = state.where((F.col("day") < F.lit(since)) | (F.col("day") >= F.lit(until))).unionByName(fresh)
    return publish_mart(fresh, path)


def trailing_rates(
    base: DataFrame,
    outcomes: DataFrame,
    at: Column,
    outcome_day: str,
    segments: dict[str, tuple[Column, Column]],
    flags: dict[str, Column],
    horizons: Sequence[int] = HORIZONS,
    lag: int = LAG_DAYS,
) -> DataFrame:
    """Mean of each flag over outcomes of the same segment whose day, taken at
    midnight, lies in ``[at - (h + lag) days, at - lag days]``.

    ``segments``: name -> (column on base, column on outcomes). Output columns
    are ``{segment}_{flag}_rate_{h}_day``, NULL where the window is empty.
    """
    daily = daily_rates(outcomes, outcome_day, {n: theirs for n, (_, theirs) in segments.items()}, flags)
    return rates_from_daily(base, daily, at, {n: own for n, (own, _) in segments.items()}, list(flags), horizons, lag)


def rates_from_daily(
    base: DataFrame,
    daily: DataFrame,
    at: Column,
    segments: dict[str, Column],
    flags: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    lag: int = LAG_DAYS,
) -> DataFrame:
    """``trailing_rates`` from the daily sums of ``daily_rates``, kept up to date or just made.

    A window partition holds the days of one segment value, however many loans it has.
    One ordered pass over those days serves all horizons. When ``at`` has a time of day,
    the oldest midnight falls out of the window, which is why midnight questions are kept apart.
    """
    names = list(segments)
    days = daily.select(F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.unix_date("day").alias("__day"),
                        *[c for n in flags for c in (f"sum_{n}", f"n_{n}")])
    moment = at.cast("timestamp_ntz")
    asked = base.select(
        F.unix_date(moment.cast("date")).alias("__day"), S.is_midnight(moment).alias("__mid"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("kind"), own.cast("string").alias("value")) for n, own in segments.items()
        ])).alias("__seg"),
    ).select(F.col("__seg.kind").alias("__kind"), F.col("__seg.value").alias("__value"), "__day", "__mid")
    asked = asked.where(F.col("__value").isNotNull() & F.col("__day").isNotNull()).distinct()

    rows = days.withColumn("__mid", F.lit(None).cast("boolean")).unionByName(asked, allowMissingColumns=True)
    along = Window.partitionBy("__kind", "__value").orderBy("__day")
    outs = {}
    for n in flags:
        for h in horizons:
            full, short = (along.rangeBetween(-(h + lag) + drop, -lag) for drop in (0, 1))

            def of(w, n=n):
                return F.sum(f"sum_{n}").over(w) / F.nullif(F.sum(f"n_{n}").over(w), F.lit(0))

            outs[f"__r_{n}_{h}"] = F.when(F.col("__mid"), of(full)).otherwise(of(short))
    answers = rows.withColumns(outs).where(F.col("__mid").isNotNull())

    result = base.withColumns({"__day": F.unix_date(moment.cast("date")), "__mid": S.is_midnight(moment)})
    added = []
    for n in names:
        cols = {f"__r_{f}_{h}": f"{n}_{f}_rate_{h}_day" for h in horizons for f in flags}
        part = answers.where(F.col("__kind") == n).select(
            F.col("__value").alias("__v"), F.col("__day").alias("__d"), F.col("__mid").alias("__m"),
            *[F.col(c).alias(out) for c, out in cols.items()])
        on = [segments[n].cast("string") == part["__v"], result["__day"] == part["__d"], result["__mid"] == part["__m"]]
        result = result.join(part, reduce(lambda a, b: a & b, on), "left").drop("__v", "__d", "__m")
        added += cols.values()
    return result.select(*base.columns, *added)


def month_rate_join(
    base: DataFrame,
    rates: DataFrame,
    key: Column,
    at: Column,
    rate_key: str,
    rate_month: str,
    columns: Sequence[str],
) -> DataFrame:
    """Attach precomputed rates for a numeric key (text on the base side) and the
    ``yyyymm`` month of a moment. A text with a fraction meets no whole key."""
    rates = expect_one(
        rates.select(F.col(rate_key).cast("decimal(38,18)").alias("__k"), F.col(rate_month).cast("string").alias("__mon"),
                     *columns),
        ["__k", "__mon"], "month rates")
    keyed = base.withColumns({"__bk": key.try_cast("decimal(38,18)"),
                              "__bm": S.month_key(at)})
    return (
        keyed.join(rates, (keyed["__bk"] == rates["__k"]) & (keyed["__bm"] == rates["__mon"]), "left")
        .select(*base.columns, *columns)
    )
