"""How the keys of a point-in-time lookup are spread over tasks.

One counting pass over the keys of both sides tells how many keys the left side has and how
many rows the largest key owns. From it follow

- a key filter under the right side's first shuffle: the hashes of the left keys where they
  are few, else the words of a Bloom filter over them. Either is at most ``FILTER_ROWS`` rows of two
  numbers, so its broadcast is bounded whatever the tables hold;
- slices of heavy keys. A key is heavy if it owns more than ``SLICE_ROWS`` rows and more than one
  part in ``SLICES`` of all rows, so there are at most ``SLICES`` such keys. A sample of their rows,
  in the order in which they are to be folded, gives each the bounds of its slices: ranges of
  (key, moment, a tie mark), of about equal size however ids or moments are distributed.

Keys that aren't heavy stay whole: one task holds them, and no carry is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.stages import stage

SLICE_ROWS = 1 << 20
SLICES = 1 << 12
#: Sampled rows for each slice.
SAMPLED = 16
FILTER_ROWS = 1 << 20
#: Left keys beyond which a filter of FILTER_ROWS words of 64 bits lets most others through.
FILTERED_KEYS = 1 << 24


def present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


@dataclass(frozen=True)
class Spread:
    """What the counting pass found for two sides with the same key columns."""

    keys: list[str]
    left_keys: int
    rows: int
    largest: int
    counted: DataFrame = field(repr=False)
    slice_rows: int = SLICE_ROWS

    @property
    def heavy_rows(self) -> int:
        return max(self.slice_rows, self.rows // SLICES)

    @property
    def has_heavy(self) -> bool:
        return self.largest > self.heavy_rows

    def heavy_keys(self) -> DataFrame:
        """At most SLICES rows."""
        return stage(self.counted.where(F.col("__l") + F.col("__r") > self.heavy_rows).select(*self.keys), "heavy-keys")

    def prune(self, right: DataFrame, left: DataFrame) -> DataFrame:
        """Right rows whose key the left side has, and few others."""
        key = F.xxhash64(*self.keys)
        hashes = left.where(present(self.keys)).select(key.alias("__h"))
        if self.left_keys <= FILTER_ROWS:
            return right.withColumn("__h", key).join(F.broadcast(hashes.distinct()), "__h", "left_semi").drop("__h")
        if self.left_keys > FILTERED_KEYS:
            return right
        # Two bits of one 64-bit word for each key.
        def word(h: Column) -> Column:
            return F.pmod(h, F.lit(FILTER_ROWS))

        def bits(h: Column) -> Column:
            one = F.lit(1).cast("long")
            low, high = (F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int") for k in (24, 32))
            return F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))

        words = hashes.groupBy(word(F.col("__h")).alias("__w")).agg(F.bit_or(bits(F.col("__h"))).alias("__b"))
        asked = right.withColumn("__h", key).withColumn("__w", word(F.col("__h")))
        return (
            asked.join(F.broadcast(words), "__w")
            .where(F.col("__b").bitwiseAND(bits(F.col("__h"))) == bits(F.col("__h")))
            .drop("__w", "__b", "__h")
        )

    def bounds(self, heavy: DataFrame, points: DataFrame, order: Column) -> DataFrame:
        """Per heavy key the sorted upper ends of its slices, from a sample of about
        SAMPLED * SLICES of its points at most."""
        share = min(1.0, SAMPLED / self.heavy_rows)
        sampled = points.sample(fraction=share, seed=11) if share < 1 else points
        found = sampled.groupBy(*self.keys).agg(F.sort_array(F.collect_list(order)).alias("__ends"))
        ends = F.filter(F.coalesce("__ends", F.array()), lambda x, i: i % SAMPLED == SAMPLED - 1)
        return stage(heavy.join(found, self.keys, "left").select(*self.keys, ends.alias("__ends")), "bounds")


def measure(left: DataFrame, right: DataFrame, keys: list[str], slice_rows: int | None = None) -> Spread:
    """Count rows by key on both sides, in one pass that reads the key columns only."""
    def ones(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.where(present(keys)).select(
            *keys, F.lit(l).cast("long").alias("__l"), F.lit(r).cast("long").alias("__r"))

    counted = ones(left, 1, 0).unionByName(ones(right, 0, 1)).groupBy(*keys).agg(
        F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).where("__l > 0")
    both = F.col("__l") + F.col("__r")
    n, rows, largest = counted.agg(F.count(F.lit(1)), F.sum(both), F.max(both)).first()
    return Spread(keys, n, rows or 0, largest or 0, counted, slice_rows or SLICE_ROWS)


def slice_of(ends: Column, order: Column, most: int = SLICES) -> Column:
    """How many of the sorted ``ends`` lie at or below ``order``, by halving; 0 without ends."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])

    def step(found, width):
        fits = (found + width <= F.size(ends)) & (F.get(ends, found + width - 1) <= order)
        return F.when(F.coalesce(fits, F.lit(False)), found + width).otherwise(found)

    return F.when(ends.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), step)).cast("long")
