"""Column functions: dates, numbers, text. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions import codes


# --- numbers -----------------------------------------------------------------
def nice_div(a: Column, b: Column) -> Column:
    """``a / b``; NULL when either is NULL or ``b`` is zero."""
    return F.try_divide(a, b)


def exact(c: Column, precision: int = 18, scale: int = 2) -> Column:
    """Money as a decimal, so that sums do not depend on row order."""
    return c.cast(f"decimal({precision},{scale})")


def score_tier(score: Column) -> Column:
    """1 is best; a missing score falls in the lowest tier."""
    out = None
    for floor, tier in codes.SCORE_TIERS:
        hit = score >= F.lit(floor)
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(codes.LOWEST_TIER)


def discount_factor(days: Column, rate: float = codes.YEARLY_RATE) -> Column:
    """Daily compounding of a yearly rate over ``days``, as a double."""
    return F.pow(F.lit(1 + rate / codes.YEAR_DAYS), days.cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0 (NULL counts as not true)."""
    return F.when(condition, 1).otherwise(0)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- dates -------------------------------------------------------------------
def month_key(d: Column) -> Column:
    """``yyyymm`` as text."""
    return F.date_format(d, "yyyyMM")


def weekday_from_sunday(d: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(d) - 1


def is_midnight(ts: Column) -> Column:
    return ts == ts.cast("date").cast("timestamp_ntz")


def first_date_at_or_after(ts: Column) -> Column:
    """The first date whose midnight is not before ``ts``."""
    day = ts.cast("date")
    return F.when(ts.cast("timestamp_ntz") == day.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1))


def average_month_date(start: Column, months: Column) -> Column:
    """``start`` plus ``months`` average months, cut to the day (months >= 0)."""
    return F.date_add(start, F.floor(months * F.lit(codes.MONTH_DAYS)).cast("int"))


def average_month_bucket(days: Column) -> Column:
    """First month number (1 or more) whose end is at or past ``days``."""
    # greatest() skips NULLs, so a missing day count must be kept out of it.
    return F.when(days.isNotNull(), F.greatest(F.lit(1), F.ceil(days / F.lit(codes.MONTH_DAYS)))).cast("int")


def elapsed_average_months(days: Column) -> Column:
    return F.floor(days / F.lit(codes.MONTH_DAYS)).cast("int")


def calendar_month_bucket(start: Column, d: Column) -> Column:
    """Smallest m >= 1 with ``add_months(start, m) >= d``."""
    apart = (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)
    month = F.when(F.add_months(start, apart) >= d, apart).otherwise(apart + 1)
    return F.when(apart.isNotNull(), F.greatest(F.lit(1), month)).cast("int")


def add_business_days(d: Column, n: int, holidays: Sequence[date] = ()) -> Column:
    """The n-th Monday-to-Friday day after ``d``, skipping listed holidays."""
    if not holidays:
        past_friday = F.greatest(F.weekday(d) - 4, F.lit(0))
        working = F.least(F.weekday(d), F.lit(4))
        weekends = F.floor((working + n) / F.lit(5)).cast("int")
        return F.date_add(d, (F.lit(n) - past_friday + weekends * 2).cast("int"))
    # Weekdays are numbered from a Monday on; less the holidays so far, that numbers the open days.
    closed = sorted({_weekdays_until(h) for h in holidays if h.weekday() < 5})
    since = F.datediff(d, F.lit(_MONDAY))
    weekdays = F.floor(since / F.lit(7)) * 5 + F.least(F.weekday(d), F.lit(4)) + 1
    # transform() names the intermediate number, which the comparisons would else repeat.
    wanted = F.transform(F.array(weekdays), lambda w: w - _count_up_to(closed, w) + n)
    before = [w - i for i, w in enumerate(closed, 1)]
    number = F.transform(wanted, lambda w: w + _count_up_to(before, w - 1) - 1)[0]
    return F.date_add(F.lit(_MONDAY), (F.floor(number / F.lit(5)) * 7 + F.pmod(number, F.lit(5))).cast("int"))


_MONDAY = date(1970, 1, 5)


def _weekdays_until(day: date) -> int:
    """Weekdays from the first Monday up to a weekday, itself included."""
    weeks, rest = divmod((day - _MONDAY).days, 7)
    return weeks * 5 + rest + 1


def _count_up_to(ordered: Sequence[int], x: Column) -> Column:
    """How many of the ordered numbers are ``x`` or less, by halving: few comparisons for long lists."""
    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(ordered[middle]) <= x, part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(ordered))


# --- text --------------------------------------------------------------------
def part(s: Column, separator: str, n: int) -> Column:
    return F.split_part(s, F.lit(separator), F.lit(n))


def digit_count(s: Column) -> Column:
    """How many digits the text holds; 0 for NULL."""
    return F.coalesce(F.length(F.regexp_replace(s, "[^0-9]", "")), F.lit(0))


def first_digit_run(s: Column) -> Column:
    """First run of digits, NULL when there is none."""
    return F.regexp_substr(s, F.lit(r"\d+"))


def holds(s: Column, piece: Column) -> Column:
    """Case-sensitive infix test where the piece is a plain value."""
    return F.contains(s, piece)


def ilike_infix(s: Column, name: Column) -> Column:
    """Case-blind LIKE with ``%name%``; wildcards inside the name stay wildcards."""
    # A backslash before an ordinary character just means that character.
    pattern = F.regexp_replace(name, r"\\([^\\_%])", "$1")
    return F.call_function("ilike", s, F.concat(F.lit("%"), pattern, F.lit("%")))


def has_token(s: Column, token: str) -> Column:
    """Exact member test in a comma-separated list."""
    return F.array_contains(F.split(s, ","), token)


def like_any(s: Column, patterns: Sequence[str]) -> Column:
    return any_of([s.like(p) for p in patterns])


def ilike_any(s: Column, patterns: Sequence[str]) -> Column:
    return any_of([s.ilike(p) for p in patterns])


def matches_any(s: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    """True when one of the regexes is found in ``s``."""
    prefix = "(?i)" if ignore_case else ""
    return any_of([s.rlike(prefix + w) for w in words])


def any_word_matches(words: Sequence[str], pattern: Column) -> Column:
    """The reversed test: the column holds the regex, the words are searched."""
    regex = F.concat(F.lit("(?i)"), pattern)
    return any_of([F.regexp_like(F.lit(w), regex) for w in words])
