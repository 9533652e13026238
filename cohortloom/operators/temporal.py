"""Point-in-time lookups that hold up when one key owns a third of all rows.

Every lookup asks, for each left row, for a min, max or sum over the right rows
of the same key on one side of a moment (or between two moments). Joining on the
key and filtering by time would make every pair within a key, and a window over
the key would put a hot key in one task.

``lookup`` lays left and right rows in one order of (key, moment) and folds along it, so
left rows meet their answer where they stand and no join back is needed. Right rows of
keys that the left side lacks are dropped before the shuffle. A key that owns more than
a slice's share of the rows is cut in ranges of that order (see ``spread``): each range is
folded by a task of its own, and the folds of the ranges before it, a few
thousand summary rows in all, are carried in.

``lookup_between`` folds right rows to one row per (key, moment) and questions to the
distinct points, cuts the timeline in slices and blocks of slices that follow from the window's
length, and answers go back to the left rows by an equi-join on (key, moment), whose right side
is unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from cohortloom.operators.dominance import sums_above_until
from cohortloom.operators.spread import Spread, measure, present, slice_of


@dataclass(frozen=True)
class Fold:
    """A min, max or sum over right rows, under an output name."""

    name: str
    kind: str
    value: Column

    def over_rows(self) -> Column:
        return _FOLDS[self.kind](F.col(self.name))

    def empty(self, df: DataFrame) -> Column:
        return F.lit(None).cast(df.schema[self.name].dataType).alias(self.name)


_FOLDS = {"min": F.min, "max": F.max, "sum": F.sum}


def _struct_of(rank: str | Sequence[str], carry: Sequence[str]) -> Column:
    ranks = [rank] if isinstance(rank, str) else list(rank)
    return F.struct(*[F.col(c) for c in [*ranks, *[c for c in carry if c not in ranks]]])


def pick_min(name: str, rank, carry: Sequence[str] = (), where: Column | None = None) -> Fold:
    """The right row with the lowest ``rank``, as a struct with ``carry``."""
    value = _struct_of(rank, carry)
    return Fold(name, "min", value if where is None else F.when(where, value))


def pick_max(name: str, rank, carry: Sequence[str] = (), where: Column | None = None) -> Fold:
    """The right row with the highest ``rank``, as a struct with ``carry``."""
    value = _struct_of(rank, carry)
    return Fold(name, "max", value if where is None else F.when(where, value))


def total(name: str, value: Column) -> Fold:
    return Fold(name, "sum", value)


def count_where(name: str, condition: Column | None = None) -> Fold:
    one = F.lit(1).cast("long")
    return Fold(name, "sum", one if condition is None else F.when(condition, one))


# --- shared pieces -----------------------------------------------------------
def _keys(by) -> list[tuple[str, str]]:
    if isinstance(by, str):
        return [(by, by)]
    if isinstance(by, dict):
        return list(by.items())
    return [(b, b) for b in by]


def _common_type(a, b):
    """Type in which two moments or keys are compared."""
    if a == b:
        return a
    both = (a, b)
    if any(isinstance(t, StringType) for t in both):
        raise TypeError("keys must have one type, and a moment must be a date, a timestamp or a number")
    for kind in (TimestampType, TimestampNTZType, DateType):
        if any(isinstance(t, kind) for t in both):
            return next(t for t in both if isinstance(t, kind))
    return max(both, key=lambda t: _WIDTH.index(t.typeName()) if t.typeName() in _WIDTH else len(_WIDTH))


_WIDTH = ("byte", "short", "integer", "long", "decimal", "float", "double")


def _sides(left, right, by, at, time, folds):
    """Both sides with common key and moment columns ``__k0``.. and ``__t``: all left rows with all
    their columns; of the right rows those that count, with their fold values."""
    pairs = _keys(by)
    keys = [f"__k{i}" for i in range(len(pairs))]
    asked = left.select("*", *[F.col(l).alias(k) for (l, _), k in zip(pairs, keys)], at.alias("__t"))
    rows = right.select(
        *[F.col(r).alias(k) for (_, r), k in zip(pairs, keys)], time.alias("__t"), *[f.value.alias(f.name) for f in folds])
    kinds = {c: _common_type(asked.schema[c].dataType, rows.schema[c].dataType) for c in [*keys, "__t"]}
    asked = asked.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
    rows = rows.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
    wanted = reduce(lambda a, b: a | b, [F.col(f.name).isNotNull() for f in folds])
    return pairs, keys, asked, rows.where(present([*keys, "__t"]) & wanted), kinds["__t"]


def _back_to_left(left, pairs, keys, at, answers, common, folds):
    """Give each left row its answer; unmatched rows get NULLs."""
    right = answers.select(
        *[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)], F.col("__t").alias("__at"),
        *[f.name for f in folds],
    )
    tagged = left.withColumn("__m", at.cast(common))
    on = reduce(
        lambda a, b: a & b,
        [tagged[l] == right[f"__a{i}"] for i, (l, _) in enumerate(pairs)] + [tagged["__m"] == right["__at"]],
    )
    return tagged.join(right, on, "left").select(*left.columns, *[f.name for f in folds])


# --- one-sided ---------------------------------------------------------------
_SIDES = {
    # side: (descending time, question's place among right rows of its moment)
    "before": (False, 0),
    "until": (False, 2),
    "after": (True, 0),
    "from": (True, 2),
}


def lookup(
    left: DataFrame,
    right: DataFrame,
    by,
    at: Column,
    time: Column,
    folds: Sequence[Fold],
    side: str = "before",
    slice_rows: int | None = None,
) -> DataFrame:
    """Fold the right rows of the same key on one side of each left moment.

    ``by`` is a column name, a list of them, or ``{left name: right name}``.
    ``side``: ``before`` (time < at), ``until`` (<=), ``after`` (>), ``from`` (>=).
    A left row with a NULL key or moment gets NULLs; right rows with one count nowhere.
    ``slice_rows`` is the least number of rows at which a key is cut (``spread.SLICE_ROWS``).
    A sum of decimals is as wide as its sums over slices, so it may be typed wider for a heavy key.
    """
    backwards, place = _SIDES[side]
    sign = -1 if backwards else 1
    _, keys, asked, rows, _ = _sides(left, right, by, at, time, folds)
    spread = measure(asked, rows, keys, slice_rows)
    rows = spread.prune(rows, asked)
    names = [f.name for f in folds]

    known = present([*keys, "__t"])
    # Left rows that ask nothing stand apart from all keys, those of each task by themselves.
    nowhere = (-1 - F.spark_partition_id()).cast("long")
    asked = asked.withColumn("__q", F.lit(sign * place))
    rows = rows.withColumn("__q", F.lit(sign))
    if spread.has_heavy:
        asked, rows, carry = _sliced(asked, rows, keys, folds, spread, backwards)
        asked = asked.withColumn("__s", F.when(known, F.col("__s")).otherwise(nowhere))
        rows = rows.unionByName(carry)
    else:
        asked = asked.withColumn("__s", F.when(known, F.lit(0).cast("long")).otherwise(nowhere))
        rows = rows.withColumn("__s", F.lit(0).cast("long"))

    along = [F.col("__t").desc_nulls_first(), F.col("__q").desc()] if backwards else [
        F.col("__t").asc_nulls_first(), F.col("__q").asc()]
    so_far = Window.partitionBy(*keys, "__s").orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = asked.withColumn("__ask", F.lit(True)).unionByName(rows, allowMissingColumns=True)
    return (
        points.withColumns({f.name: f.over_rows().over(so_far) for f in folds})
        .where("__ask").select(*left.columns, *names)
    )


def _sliced(asked, rows, keys, folds, spread: Spread, backwards: bool):
    """Slice numbers ``__s`` for both sides, and one carry row for each slice of a heavy key: the
    fold of all right rows in the slices that come before it."""
    large = spread.heavy_keys()
    heavy = F.broadcast(large)
    # Right rows of a heavy key fold to one row per moment first, so that copies can't fill a slice.
    own = rows.join(heavy, keys, "left_semi").groupBy(*keys, "__t", "__q").agg(
        *[f.over_rows().alias(f.name) for f in folds])
    rest = rows.join(heavy, keys, "left_anti")
    # Questions of one moment are told apart by the task that reads them.
    asked = asked.withColumn("__h", F.xxhash64(F.spark_partition_id()))
    own = own.withColumn("__h", F.xxhash64(*keys, "__t"))
    order = F.struct("__t", "__q", "__h")
    points = own.select(*keys, "__t", "__q", "__h").unionByName(
        asked.where(F.col("__t").isNotNull()).join(heavy, keys, "left_semi").select(*keys, "__t", "__q", "__h"))
    ends = F.broadcast(spread.bounds(large, points, order))

    def cut(df: DataFrame) -> DataFrame:
        return df.join(ends, keys, "left").withColumn("__s", slice_of(F.col("__ends"), order)).drop(
            "__h", "__ends")

    asked, own = cut(asked), cut(own)
    along = F.col("__s").desc() if backwards else F.col("__s").asc()
    earlier = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    # Every slice of a heavy key, also one without right rows, so that its questions get the carry.
    slices = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.size("__ends").cast("long"))).alias("__s"))
    carry = (
        own.select(*keys, "__s", *[f.name for f in folds])
        .unionByName(slices, allowMissingColumns=True)
        .groupBy(*keys, "__s").agg(*[f.over_rows().alias(f.name) for f in folds])
        .withColumns({f.name: f.over_rows().over(earlier) for f in folds})
    )
    # The carry comes first: its moment is NULL.
    carry = carry.select(*keys, *[f.name for f in folds], F.lit(0).alias("__q"), "__s")
    every = rest.withColumn("__s", F.lit(0).cast("long")).unionByName(own)
    return asked, every, carry.withColumn("__t", F.lit(None).cast(every.schema["__t"].dataType))


# --- two-sided ---------------------------------------------------------------
def lookup_between(
    left: DataFrame,
    right: DataFrame,
    by,
    at: Column,
    low: str,
    high: str,
    time: Column,
    folds: Sequence[Fold],
) -> DataFrame:
    """Fold right rows with time in ``[at + low, at + high]``, ends included.

    ``low`` and ``high`` are interval texts such as ``"-3 days"`` or ``"-18 months"``, in any
    unit from microseconds to years; a window may be as short as one moment. Months are
    calendar months, as ``timestamp + interval`` counts them.

    The timeline is cut in slices of a 64th of the window. A question is the tail of its first
    slice, the head of its last one, and the whole slices between. Those are gathered in blocks
    of 1, 2, 4, .. slices, each folded once; a window takes two blocks of a size at most.
    """
    pairs, keys, asked, rows, common = _sides(left, right, by, at, time, folds)
    if not isinstance(common, (TimestampType, TimestampNTZType)):
        raise TypeError("lookup_between works on timestamps")
    width, levels = _slicing(low, high)
    rows = measure(asked, rows, keys).prune(rows, asked)
    q = asked.where(present([*keys, "__t"])).select(*keys, "__t").distinct()
    r = rows.groupBy(*keys, "__t").agg(*[f.over_rows().alias(f.name) for f in folds])
    names = [f.name for f in folds]

    def slice_at(moment: str) -> Column:
        micros = _micros(F.col(moment), common)
        return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))

    q = q.select(*keys, F.col("__t").alias("__ask"),
                 (F.col("__t") + _shift(low)).alias("__lo"), (F.col("__t") + _shift(high)).alias("__hi"))
    q = q.withColumns({"__slo": slice_at("__lo"), "__shi": slice_at("__hi")})
    r = r.withColumn("__s", slice_at("__t"))

    # Roles within a slice: 1 data, 0 first-slice question, 2 last-slice question.
    nothing = [f.empty(r) for f in folds]
    data = r.select(*keys, "__s", "__t", F.lit(1).alias("__role"), *names, F.lit(None).cast(common).alias("__ask"))
    # Both ends in one slice: the window is one moment, and the head is all of it.
    starts = q.where("__slo < __shi").select(
        *keys, F.col("__slo").alias("__s"), F.col("__lo").alias("__t"), F.lit(0).alias("__role"), *nothing, "__ask")
    ends = q.select(
        *keys, F.col("__shi").alias("__s"), F.col("__hi").alias("__t"), F.lit(2).alias("__role"), *nothing, "__ask")
    cell = Window.partitionBy(*keys, "__s")
    head = cell.orderBy("__t", "__role").rowsBetween(Window.unboundedPreceding, 0)
    # Mirrored: with time descending, a start question comes after data of its own moment.
    tail = cell.orderBy(F.col("__t").desc(), F.col("__role").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"__{side}_{f.name}": f.over_rows().over(w) for f in folds for side, w in (("head", head), ("tail", tail))}
    edges = data.unionByName(starts).unionByName(ends).withColumns(seen).where("__role != 1").select(
        *keys, "__ask",
        *[F.when(F.col("__role") == 2, F.col(f"__head_{n}")).otherwise(F.col(f"__tail_{n}")).alias(n) for n in names])

    # Slices fold first, so that a right row is copied to its blocks only once per slice.
    slices = r.groupBy(*keys, "__s").agg(*[f.over_rows().alias(f.name) for f in folds])
    own = F.array(*[_block(level, F.shiftright("__s", level)) for level in range(levels)])
    blocks = slices.select(*keys, F.explode(own).alias("__b"), *names).select(*keys, "__b.*", *names).groupBy(
        *keys, "__level", "__block").agg(*[f.over_rows().alias(f.name) for f in folds])
    wanted = q.select(*keys, "__ask", F.explode(_blocks_between(F.col("__slo") + 1, F.col("__shi"), levels)).alias("__b"))
    between = wanted.select(*keys, "__ask", "__b.*").join(blocks, [*keys, "__level", "__block"]).select(
        *keys, "__ask", *names)

    answers = edges.unionByName(between).groupBy(*keys, F.col("__ask").alias("__t")).agg(
        *[f.over_rows().alias(f.name) for f in folds])
    return _back_to_left(left, pairs, keys, at, answers, common, folds)


#: Slices in the shortest form of a window.
WINDOW_SLICES = 64
_DAY = 86_400_000_000
#: Microseconds of a unit; months and years are counted apart.
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
          "day": _DAY, "week": 7 * _DAY}
_MONTHS = {"month": 1, "year": 12}


def _interval(text: str) -> tuple[int, int]:
    """Months and microseconds of a text of numbers and units, such as ``"-1 month 3 days"``."""
    words = text.split()
    months = micros = 0
    for number, unit in zip(words[::2], words[1::2], strict=True):
        unit = unit.lower().removesuffix("s")
        if unit in _MONTHS:
            months += int(number) * _MONTHS[unit]
        else:
            micros += int(number) * _UNITS[unit]
    return months, micros


def _shift(text: str) -> Column:
    months, micros = _interval(text)
    days, rest = divmod(micros, _DAY)
    return F.make_interval(months=F.lit(months), days=F.lit(days), secs=F.lit(rest).cast("decimal(18,6)") / 1_000_000)


def _slicing(low: str, high: str) -> tuple[int, int]:
    """Width of a slice in microseconds, and the block sizes that the longest form of the window needs."""
    (a_months, a), (b_months, b) = _interval(low), _interval(high)
    months = b_months - a_months
    shortest = b - a + _DAY * min(28 * months, 31 * months)
    longest = b - a + _DAY * max(28 * months, 31 * months)
    if shortest < 0:
        raise ValueError("the window must not end before it begins, whatever the months' lengths")
    width = max(1, shortest // WINDOW_SLICES)
    return width, max(1, (longest // width + 1).bit_length())


def _micros(moment: Column, kind) -> Column:
    """Microseconds since the origin; of a moment without a zone, those its clock shows."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(moment)
    days = F.unix_date(moment.cast("date")).cast("long")
    seconds = (days * 24 + F.hour(moment)) * 3600 + F.minute(moment) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def _block(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("__level"), number.alias("__block"))


def _blocks_between(first: Column, end: Column, levels: int) -> Column:
    """The blocks that together make the slices from ``first`` to before ``end``, none twice: at each
    size the odd block that the range begins with and the even one that it ends with."""
    found = []
    for level in range(levels):
        a, b = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(end, level)
        found.append(F.when((a < b) & (a.bitwiseAND(F.lit(1)) == 1), _block(level, a)))
        found.append(F.when((a < b) & (b.bitwiseAND(F.lit(1)) == 1), _block(level, b - 1)))
    return F.array_compact(F.array(*found))


# --- by key only -------------------------------------------------------------
def first_per_key(df: DataFrame, by: Sequence[str], rank: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per key: the one with the lowest ``rank``. Combined map-side."""
    return df.groupBy(*by).agg(F.min(_struct_of(rank, carry)).alias("__p")).select(*by, "__p.*")


def last_per_key(df: DataFrame, by: Sequence[str], rank: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per key: the one with the highest ``rank``. Combined map-side."""
    return df.groupBy(*by).agg(F.max(_struct_of(rank, carry)).alias("__p")).select(*by, "__p.*")


def without_earlier(df: DataFrame, earlier: DataFrame, by: str, rank: str) -> DataFrame:
    """Rows with no row of ``earlier`` for the same key and a lower rank.

    One minimum per key replaces the pairwise not-exists test.
    """
    floor = earlier.groupBy(F.col(by).alias("__k")).agg(F.min(rank).alias("__floor"))
    return (
        df.join(floor, df[by] == floor["__k"], "left")
        .where(F.col("__floor").isNull() | (F.col("__floor") >= F.col(rank)) | F.col(rank).isNull())
        .drop("__k", "__floor")
    )


def first_with_ties(df: DataFrame, by: Sequence[str], rank: str, sums: dict[str, Column]) -> DataFrame:
    """Per key, all rows at the lowest rank: their count ``n`` and the given sums."""
    at_rank = df.groupBy(*by, rank).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    return first_per_key(at_rank, by, [rank], ["n", *sums])


def distinct_on(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order. Spell out the null order in
    ``order``: Spark puts NULLs first going up, PostgreSQL last.

    Ordering columns become one sortable struct, so the pick is a map-side
    combined minimum and not a window over the whole key.
    """
    raise_order = F.struct(*order, F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.groupBy(*by).agg(F.min(raise_order).alias("__p")).select("__p.row.*")


def nulls_last(c: Column) -> list[Column]:
    """Ascending sort keys with NULL at the end, for ``distinct_on``."""
    return [c.isNull(), c]


def negated_nulls_first(c: Column) -> list[Column]:
    """Descending numeric sort keys with NULL at the front, for ``distinct_on``."""
    return [c.isNotNull(), -c]


def value_as_of(
    left: DataFrame, log: DataFrame, by: dict[str, str], at: Column, columns: Sequence[str], table: str
) -> DataFrame:
    """What a change log says tracked columns held at a moment: the old value of
    the lowest-id change after it, as ``{column}_before``. It is NULL when there
    is no such change or its old value is NULL; today's value holds then, so the
    caller writes ``coalesce(email_before, email)``. One pass over the log serves
    all columns.
    """
    changes = log.where((F.col("table_name") == table) & F.col("column_name").isin(*columns))
    folds = [pick_min(f"__c_{c}", "id", ["old_value"], F.col("column_name") == c) for c in columns]
    found = lookup(left, changes, by, at, F.col("change_time"), folds, side="after")
    return found.select(*left.columns, *[F.col(f"__c_{c}.old_value").alias(f"{c}_before") for c in columns])


def first_event_within(
    left: DataFrame,
    right: DataFrame,
    by: dict[str, str],
    at: Column,
    time: str,
    until: Column,
    name: str,
    carry: Sequence[str] = (),
    side: str = "from",
) -> DataFrame:
    """The earliest right row from a moment on, kept only up to ``until``."""
    found = lookup(left, right, by, at, F.col(time), [pick_min("__e", [time], carry)], side=side)
    keep = F.col(f"__e.{time}") <= until
    return found.withColumn(name, F.when(keep, F.col("__e"))).drop("__e")


# --- two orders at once ------------------------------------------------------
def count_above_until(
    left: DataFrame,
    right: DataFrame,
    by: str,
    rank: str,
    limits: dict[str, Column],
    time: str,
    folds: Sequence[Fold],
    anchor: str,
    slice_rows: int | None = None,
) -> DataFrame:
    """For each left row and limit: sums over right rows of the same key with ``rank`` above
    its own *and* ``time`` at or before the limit, as ``{fold}_{limit}`` (see ``dominance``)."""
    if any(f.kind != "sum" for f in folds):
        raise ValueError("only sums can be folded over two orders at once")
    return sums_above_until(left, right, by, rank, limits, time, {f.name: f.value for f in folds}, anchor, slice_rows)
