"""Sums over right rows that lie above a left row in one order and below a limit in another.

"Loans of the customer with a higher id, paid out until a date" needs two orders at once, so no
running fold answers it, and a join on the customer makes every pair within a key. Here the
right rows of a task stand in the order of (key, rank), and a wavelet matrix over their times is
walked from the highest bit down: a question is the stretch of its key's rows above its own rank,
each level keeps the part of it that may still lie below the limit and adds a difference of two
prefix sums. All questions of a task take a level together, some twenty array steps in all.

Keys are dealt out by hash, many small ones to a bucket. A heavy key (see ``spread``) is cut
twice, in ranges of rank and in ranges of time, and a question is the sum of three parts: right
rows of its own rank range; of its own time range in higher rank ranges; and of earlier time
ranges in higher rank ranges, which is a sum over a grid of at most spread.SLICES squared cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.spread import measure, present, slice_of

#: Rows of both sides that share a bucket, about.
BUCKET_ROWS = 200_000
_LAST = 2**63 - 1


def dominated(group, rank, time, weights, q_group, q_rank, q_until, q_known) -> np.ndarray:
    """Per question and limit, the summed weights of the rows of its group with a higher rank and a time
    at or below the limit: (questions, limits, weights). ``q_known`` is False where a limit is missing."""
    n, limits = len(group), q_until.shape[1]
    sums = np.zeros((len(q_group), limits, weights.shape[1]), dtype=np.int64)
    if not n or not len(q_group):
        return sums
    # A question stands behind the rows of its rank.
    kind = np.concatenate((np.zeros(n, dtype=np.int8), np.ones(len(q_group), dtype=np.int8)))
    order = np.lexsort((kind, np.concatenate((rank, q_rank)), np.concatenate((group, q_group))))
    is_row = kind[order] == 0
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(is_row)
    low = np.repeat(place[n:, None], limits, axis=1)
    rows = order[is_row]
    high = np.repeat(np.searchsorted(group[rows], q_group, side="right")[:, None], limits, axis=1)
    low = np.minimum(low, high)
    times, value = np.unique(time[rows], return_inverse=True)
    until = np.where(q_known, np.searchsorted(times, q_until, side="right"), 0)
    weight = weights[rows]
    for bit in reversed(range(len(times).bit_length())):
        one = value >> bit & 1
        zeros = np.concatenate(([0], np.cumsum(one == 0)))
        below = np.concatenate((np.zeros((1, weight.shape[1]), dtype=np.int64),
                                np.cumsum(np.where(one[:, None] == 0, weight, 0), axis=0)))
        passes = until >> bit & 1 == 1
        sums += np.where(passes[:, :, None], below[high] - below[low], 0)
        low = np.where(passes, zeros[-1] + low - zeros[low], zeros[low])
        high = np.where(passes, zeros[-1] + high - zeros[high], zeros[high])
        turned = np.argsort(one, kind="stable")
        value, weight = value[turned], weight[turned]
    return sums


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _groups(asked: pa.Table, rows: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys on both sides, in no set order; -1 where a key is NULL."""
    code = np.zeros(asked.num_rows + rows.num_rows, dtype=np.int64)
    known = np.ones(len(code), dtype=bool)
    for k in keys:
        both = pa.chunked_array([*asked.column(k).chunks, *rows.column(k).chunks], asked.schema.field(k).type)
        number, valid = _numbers(both.combine_chunks().dictionary_encode().indices)
        code = np.unique(code * (int(number.max(initial=0)) + 1) + number, return_inverse=True)[1]
        known &= valid
    code = np.where(known, code, -1)
    return code[:asked.num_rows], code[asked.num_rows:]


def _answer(asked: DataFrame, rights: DataFrame, keys: list[str], limits: list[str], sums: list[str], rows: int) -> DataFrame:
    """``asked`` (keys, ``__r``, limits and whatever else) with ``{sum}{limit}`` and the number of right
    values behind it, ``{sum}{limit}__n``, from ``rights`` (keys, ``__r``, ``__y``, sums)."""
    outs = [f"{s}{limit}{end}" for limit in limits for s in sums for end in ("", "__n")]
    schema = T.StructType([*asked.schema, *[T.StructField(o, T.LongType()) for o in outs]])
    buckets = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["__bucket"])
        q_group, group = _groups(left, right, keys)
        q_rank, ranked = _numbers(left.column("__r"))
        q_group = np.where(ranked, q_group, -1)
        values = [_numbers(right.column(s)) for s in sums]
        weights = np.stack([x.astype(np.int64) for v, ok in values for x in (v, ok)], axis=1)
        untils = [_numbers(left.column(u)) for u in limits]
        found = dominated(
            group, _numbers(right.column("__r"))[0], _numbers(right.column("__y"))[0], weights, q_group, q_rank,
            np.stack([u for u, _ in untils], axis=1), np.stack([ok for _, ok in untils], axis=1))
        flat = found.reshape(len(q_group), -1)
        for i, out in enumerate(outs):
            left = left.append_column(out, pa.array(flat[:, i]))
        return left

    # Left rows without a key ask nothing: those of each task go to a bucket of their own.
    spread_out = F.when(present(keys), bucket).otherwise(F.pmod(F.spark_partition_id().cast("long"), F.lit(buckets)))
    return (
        asked.withColumn("__bucket", spread_out).groupBy("__bucket")
        .cogroup(rights.withColumn("__bucket", bucket).groupBy("__bucket"))
        .applyInArrow(answer, schema))


def _as_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)
    return c.cast("long")


def sums_above_until(
    left: DataFrame, right: DataFrame, by: str, rank: str, limits: dict[str, Column], time: str,
    sums: dict[str, Column], anchor: str, slice_rows: int | None = None,
) -> DataFrame:
    """For each left row and limit, sums over right rows of the same key with ``rank`` above its own
    *and* ``time`` at or before the limit, as ``{sum}_{limit}``; NULL where no right value counts.

    Sums are of whole numbers. Ranks are whole numbers, times and limits dates, timestamps or whole
    numbers. Rows with a NULL key or rank, and right rows with a NULL time, count nowhere; a NULL
    limit has NULL sums. ``anchor`` identifies a left row; it is used for heavy keys only.
    """
    from cohortloom.operators.temporal import _common_type

    untils = left.select(*[c.alias(n) for n, c in limits.items()]).schema
    kind = reduce(_common_type, [right.schema[time].dataType, *[f.dataType for f in untils]])
    of = {f"__u{i}": n for i, n in enumerate(limits)}
    key_type = _common_type(left.schema[by].dataType, right.schema[by].dataType)
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    asked = left.select(
        "*", F.col(by).cast(key_type).alias("__k"), F.col(rank).cast("long").alias("__r"),
        *[_as_number(limits[n].cast(kind), kind).alias(u) for u, n in of.items()])
    rights = right.select(
        F.col(by).cast(key_type).alias("__k"), F.col(rank).cast("long").alias("__r"),
        _as_number(F.col(time).cast(kind), kind).alias("__y"), *[c.cast("long").alias(v) for v, c in values.items()],
    ).where(present(["__k", "__r", "__y"]))
    spread = measure(asked, rights, ["__k"], slice_rows)
    rights = spread.prune(rights, asked)
    names = [(u, v, f"{s}_{n}") for u, n in of.items() for v, s in zip(values, sums)]
    shown = [F.when(F.col(f"{v}{u}__n") > 0, F.col(f"{v}{u}")).alias(out) for u, v, out in names]
    if not spread.has_heavy:
        found = _answer(asked, rights, ["__k"], list(of), list(values), spread.rows)
        return found.select(*left.columns, *shown)

    large = spread.heavy_keys()
    heavy = F.broadcast(large)
    light = _answer(
        asked.join(heavy, "__k", "left_anti").select(asked.columns), rights.join(heavy, "__k", "left_anti"), ["__k"],
        list(of), list(values), spread.rows).select(*left.columns, *shown)
    own = asked.join(heavy, "__k", "left_semi").select(asked.columns)
    parts = _heavy_parts(own, rights.join(heavy, "__k", "left_semi"), large, spread, list(of), list(values), anchor)
    joined = own.join(parts, own[anchor].eqNullSafe(parts["__anchor"]), "left").select(*left.columns, *shown)
    return light.unionByName(joined)


def _up_to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))


def _heavy_parts(own: DataFrame, rights: DataFrame, large: DataFrame, spread, limits, values, anchor) -> DataFrame:
    """Per anchor of a left row with a heavy key the three parts added up."""
    # Copies fold first. Values are told from missing ones by a count of their own.
    counted = [f"{v}__n" for v in values]
    rights = rights.groupBy("__k", "__r", "__y").agg(
        *[F.sum(v).alias(v) for v in values], *[F.count(v).alias(n) for v, n in zip(values, counted)])
    by_rank, by_time = F.struct("__r", "__y"), F.struct("__y", "__r")
    ends = spread.bounds(large, rights, by_rank).withColumnRenamed("__ends", "__re").join(
        spread.bounds(large, rights, by_time).withColumnRenamed("__ends", "__ye"), "__k")
    placed = rights.join(F.broadcast(ends), "__k").withColumns({
        "__rs": slice_of(F.col("__re"), by_rank), "__ys": slice_of(F.col("__ye"), by_time)}).drop("__re", "__ye")
    last = F.lit(_LAST).cast("long")
    questions = own.where("__r is not null").select("__k", "__r", *limits, F.col(anchor).alias("__anchor")).join(F.broadcast(ends), "__k").withColumn(
        "__rs", slice_of(F.col("__re"), F.struct("__r", last.alias("__y"))))
    each = questions.select(
        "__k", "__rs", "__anchor", "__ye", F.explode(F.array(*[
            F.struct(F.lit(u).alias("u"), F.col(u).alias("until")) for u in limits])).alias("__q")
    ).select("__k", "__rs", "__anchor", F.col("__q.u").alias("__limit"), F.col("__q.until").alias("__until"),
             slice_of(F.col("__ye"), F.struct(F.col("__q.until").alias("__y"), last.alias("__r"))).alias("__ys")).where(
        "__until is not null")
    sums = [*values, *counted]

    in_rank = _answer(questions.select("__k", "__rs", "__r", "__anchor", *limits),
                      placed.select("__k", "__rs", "__r", "__y", *sums), ["__k", "__rs"], limits, sums, spread.rows)
    in_time = _answer(each.select("__k", "__ys", F.col("__rs").alias("__r"), "__anchor", "__limit", "__until"),
                      placed.select("__k", "__ys", F.col("__rs").alias("__r"), "__y", *sums),
                      ["__k", "__ys"], ["__until"], sums, spread.rows)
    # The grid: every cell of a heavy key, so that a question's cell exists.
    cells = placed.groupBy("__k", "__rs", "__ys").agg(*[F.sum(s).alias(s) for s in sums])
    grid = ends.select("__k", _up_to(F.size("__re")).alias("__rs"), "__ye").select(
        "__k", "__rs", _up_to(F.size("__ye")).alias("__ys"))
    earlier = Window.partitionBy("__k", "__rs").orderBy("__ys").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("__k", "__ys").orderBy(F.col("__rs").desc()).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(cells, ["__k", "__rs", "__ys"], "left")
    for window in (earlier, above):
        grid = grid.withColumns({s: F.sum(s).over(window) for s in sums})
    in_grid = each.join(grid, ["__k", "__rs", "__ys"])

    def wide(df: DataFrame, limit: str, suffix: str) -> list[Column]:
        return [F.when(F.col("__limit") == limit, F.col(f"{s}{suffix}")).alias(f"{s}{limit}") for s in sums]

    outs = [f"{s}{u}" for u in limits for s in sums]
    parts = [
        in_rank.select("__anchor", *outs),
        in_time.select("__anchor", *[c for u in limits for c in wide(in_time, u, "__until")]),
        in_grid.select("__anchor", *[c for u in limits for c in wide(in_grid, u, "")]),
    ]
    added = reduce(DataFrame.unionByName, parts).groupBy("__anchor").agg(*[F.sum(o).alias(o) for o in outs])
    return added.select("__anchor", *[F.col(f"{v}{u}") for u in limits for v in values],
                        *[F.col(f"{v}__n{u}").alias(f"{v}{u}__n") for u in limits for v in values])
