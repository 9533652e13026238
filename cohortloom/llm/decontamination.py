"""Benchmark items inside documents, found by SimHash of item-sized windows.

A window of a document has as many words as the item it is held against, and only
windows placed by a shingle that the document shares with an item can reach the
threshold; all others are provably unlike and get no fingerprint. Each window's
fingerprint is looked up against the fingerprints of all items of its size: both
are cut in 8 blocks of 8 bits, and two fingerprints at most ``RADIUS`` = 23 bits
apart agree to within 2 bits in one block at least, so listing each item under all
block values within 2 bits of its own misses none of them. Candidates are then
compared exactly: every shingle weighs as often as it occurs, and similarity is the
sum of the smaller weights over the sum of the larger ones. Unlike pairs differ in
32 of 64 bits on average; at similarity 0.8 the mean is under 10 and the radius lies
more than four standard deviations above it.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.stages import stage

BLOCKS = 8
BLOCK_BITS = 8
BLOCK_RADIUS = 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Shingle places of items that are broadcast at most; with more, the join shuffles.
BROADCAST_ROWS = 1_000_000
_NEAR = [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= BLOCK_RADIUS]


def words(text: Column) -> Column:
    """Lower-case words between white space; none for a NULL text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(w: Column, width: int | Column) -> Column:
    """Hashes of all runs of ``width`` words."""
    if isinstance(width, int):
        at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    out = shingles(w, 5)
    for k in range(1, 5):
        out = F.when(width == k, shingles(w, k)).otherwise(out)
    return out


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeated ones counting again. Counts of 8 bits at a
    time are summed in four 16-bit lanes of two numbers, so a window may hold 65,535 shingles."""
    def lanes(part: int) -> Column:
        """Bits 4 * part to 4 * part + 3 of each hash, added up 16 bits apart."""
        def spread(x):
            four = F.shiftrightunsigned(x, 4 * part).bitwiseAND(F.lit(15))
            return sum((F.shiftleft(F.shiftrightunsigned(four, k).bitwiseAND(F.lit(1)), 16 * k) for k in range(1, 4)),
                       four.bitwiseAND(F.lit(1)))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + spread(x))

    # The sums enter as the start value, so that they are made once and not for every bit.
    start = F.struct(F.array(*[lanes(part) for part in range(16)]).alias("sums"), F.lit(0).cast("long").alias("bits"))

    def set_bit(state, i):
        lane = F.call_function("shiftrightunsigned", F.get(state["sums"], F.floor(i / 4).cast("int")), 16 * (i % 4))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        more = 2 * lane.bitwiseAND(F.lit(65535)) > F.size(hashes)
        return F.struct(state["sums"].alias("sums"), F.when(more, state["bits"].bitwiseOR(bit)).otherwise(
            state["bits"]).alias("bits"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, set_bit, lambda state: state["bits"])


def similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger occurrence weights; 0 for two empty arrays."""
    def occurs(x, value):
        return F.size(F.filter(x, lambda y: y == value))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(occurs(a, x), occurs(b, x)))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, start_word, n_words, similarity.

    One row per document and item, for the best window (the first of equals) among those
    of the item's length that a shared shingle of five words places, where it reaches
    ``threshold``. Items of fewer than five words are one shingle of their own length.

    NULL and empty texts and items hold nothing. NULL ids are carried as NULL. Repeated
    documents or items give their row once. Other columns are not read; an empty table
    gives no rows.
    """
    items = stage(
        benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
        .select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(5)).alias("width"),
                shingles(F.col("w"), F.least(F.size("w"), F.lit(5))).alias("item_hashes")), "items")
    # Where each shingle stands in items of each length.
    marks = stage(items.select("m", "width", F.posexplode("item_hashes").alias("at", "hash")).distinct(), "marks")
    n_marks, widths = marks.agg(F.count(F.lit(1)), F.collect_set("width")).first()
    held = F.broadcast(marks) if n_marks <= BROADCAST_ROWS else marks

    texts = docs.select(
        F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.hash("text", "doc_id").alias("row2"), "text")
    listed = texts.select("row", "row2", words(F.col("text")).alias("w"))
    hits = None
    for width in sorted(widths) or [5]:
        found = (
            listed.select("row", "row2", F.posexplode(shingles(F.col("w"), width)).alias("p", "hash"))
            .join(held.where(F.col("width") == width), "hash")
            .select("row", "row2", "m", "width", F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("start")))
        hits = found if hits is None else hits.unionByName(found)
    placed = stage(
        hits.distinct().groupBy("row", "row2").agg(F.collect_list(F.struct("start", "m", "width")).alias("places")),
        "windows")

    one = texts.join(placed, ["row", "row2"]).select("doc_id", words(F.col("text")).alias("w"), "places").distinct()
    windows = stage(
        one.select("doc_id", "w", F.explode("places").alias("x"))
        .select("doc_id", "x.*", F.slice("w", F.col("x.start") + 1, F.col("x.m")).alias("w"))
        .select("doc_id", "start", "m", shingles(F.col("w"), F.col("width")).alias("hashes"))
        .select("*", fingerprint(F.col("hashes")).alias("print")), "prints")

    def block(value: Column, k: int) -> Column:
        return F.shiftrightunsigned(value, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")

    asked = windows.select("m", "print").distinct().select(
        "m", "print", F.posexplode(F.array(*[block(F.col("print"), k) for k in range(BLOCKS)])).alias("k", "value"))
    near = F.array(*[F.lit(m) for m in _NEAR])
    filed = items.select("item_id", "m", "item_hashes", fingerprint(F.col("item_hashes")).alias("item_print"))
    keys = filed.select("m", "item_print").distinct().select(
        "m", "item_print", F.posexplode(F.array(*[block(F.col("item_print"), k) for k in range(BLOCKS)])).alias("k", "own"))
    keys = keys.select("m", "item_print", "k", F.explode(
        F.transform(near, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
    close = (
        asked.join(keys, ["m", "k", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("m", "print", "item_print").distinct())
    return (
        windows.join(close, ["m", "print"]).join(filed, ["m", "item_print"])
        .select("doc_id", "item_id", "start", "m", similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m")).alias("best"))
        .select("doc_id", "item_id", (-F.col("best.s")).cast("long").alias("start_word"),
                F.col("best.m").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item. A row without an id
    is dropped where any such row holds one."""
    found = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__leaked"]), "left_anti")
