"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Sizes are whole numbers up to the capacity, so the packing problem is fully
described by how many pieces there are of each size: a histogram of at most
``capacity`` rows, whatever the corpus. Spark counts it, the layout is worked out
on it, and each piece finds its place from its running number among the pieces of
its size. No step gathers pieces.

The layout: sizes above a third of the capacity go at most two to a bin, and each
of them, from the largest down, takes the largest other one that still fits;
smaller sizes, from the largest down, go to the tightest gap that takes them, and
open a bin where none does.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.bytepair import BATCH_BYTES, encoder
from cohortloom.llm.slices import by_bytes
from cohortloom.sources.stages import stage


@dataclass
class _Bins:
    """Some bins filled alike."""

    count: int
    gap: int
    content: list[tuple[int, int]] = field(default_factory=list)  # (size, how many)


def fill_bins(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Bins for so many pieces of each size. Steps: a few for each size, not for each piece."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        if n and not 1 <= size <= capacity:
            raise ValueError(f"a piece of {size} doesn't fit in {capacity}")
        left[size] = n
    third = capacity // 3
    made: list[_Bins] = []

    for size in range(capacity, third, -1):
        mate = min(size, capacity - size)
        while left[size]:
            while mate > third and (left[mate] < 2 if mate == size else not left[mate]):
                mate -= 1
            if mate <= third:
                made.append(_Bins(left[size], capacity - size, [(size, 1)]))
                left[size] = 0
            elif mate == size:
                made.append(_Bins(left[size] // 2, capacity - 2 * size, [(size, 2)]))
                left[size] %= 2
            else:
                n = min(left[size], left[mate])
                made.append(_Bins(n, capacity - size - mate, [(size, 1), (mate, 1)]))
                left[size] -= n
                left[mate] -= n

    by_gap: dict[int, list[_Bins]] = {}
    gaps: list[int] = []

    def put(bins: _Bins) -> None:
        if bins.gap not in by_gap:
            by_gap[bins.gap] = []
            insort(gaps, bins.gap)
        by_gap[bins.gap].append(bins)

    for bins in made:
        put(bins)
    for size in range(third, 0, -1):
        while left[size]:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                # New bins; they are split below as the tightest gap.
                put(_Bins(-(-left[size] // (capacity // size)), capacity))
                continue
            gap = gaps[at]
            bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            each = gap // size
            taken = min(bins.count, left[size] // each)
            if not taken:
                taken, each = 1, left[size]
            if taken < bins.count:
                put(_Bins(bins.count - taken, gap, list(bins.content)))
            put(_Bins(taken, gap - each * size, [*bins.content, (size, each)]))
            left[size] -= taken * each
    return [b for group in by_gap.values() for b in group if b.content]


def places(bins: list[_Bins]) -> np.ndarray:
    """Rows (size, first number, first bin, how many in a bin, offset), by size and number."""
    taken: dict[int, int] = {}
    rows, bin_id = [], 0
    for group in bins:
        offset = 0
        for size, each in group.content:
            rows.append((size, taken.get(size, 0), bin_id, each, offset))
            taken[size] = taken.get(size, 0) + group.count * each
            offset += size * each
        bin_id += group.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _pieces(batches, path: str, capacity: int, id_type: pa.DataType):
    """Pieces of each document, numbered within this task among those of their size."""
    coder, seen = encoder(path), np.zeros(capacity + 1, dtype=np.int64)
    part = TaskContext.get().partitionId()
    for batch in by_bytes(batches, 1, BATCH_BYTES):
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(coder.encode([t or "" for t in batch.column(1).to_pylist()])):
            whole = np.append(ids, np.uint32(0)).astype("<u4")
            edges = [0, *range(len(whole) % capacity or capacity, len(whole) + 1, capacity)]
            for k in range(len(edges) - 1):
                row.append(i)
                piece.append(k)
                start.append(edges[k])
                length.append(edges[k + 1] - edges[k])
                crc.append(zlib.crc32(whole[edges[k]:edges[k + 1]].tobytes()))
        sizes = np.array(length, dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        rank = np.empty(len(sizes), dtype=np.int64)
        rank[order] = np.arange(len(sizes)) - np.searchsorted(ordered, ordered)
        rank += seen[sizes]
        seen += np.bincount(sizes, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())).cast(id_type), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()),
             pa.array(np.full(len(sizes), part, dtype=np.int64)), pa.array(rank)],
            names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])


def _seat(batches, table: np.ndarray):
    """Sequence and offset of each piece from its number among those of its size."""
    first = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
    for batch in batches:
        size, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        seat = np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            mine = size == s
            rows = table[first[s]:first[s + 1], 1]
            seat[mine] = first[s] + np.searchsorted(rows, number[mine], side="right") - 1
        _, low, bin_id, each, offset = table[seat].T
        turn = number - low
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(5)]
            + [pa.array(bin_id + turn // each), pa.array(offset + turn % each * size)],
            names=[*batch.schema.names[:5], "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pack all documents in as few sequences of at most ``capacity`` tokens as best fit gives.

    A document is its token ids followed by id 0. Only a longer one is cut: its
    first piece takes the odd rest, the others are full. Returns one row per piece:
    the id column, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text is the single closing id. Rows with a NULL or repeated id
    are packed like any other, one document per row. Other columns of ``docs`` are
    not read. An empty table gives no rows.
    """
    id_field = docs.schema[id_column]
    schema = T.StructType([
        T.StructField("id", id_field.dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])
    numbered = T.StructType([*schema, T.StructField("part", T.LongType()), T.StructField("rank", T.LongType())])
    seated = T.StructType([*schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def tokenise(batches):
        from itertools import chain

        batches = iter(batches)
        head = next(batches, None)
        if head is not None:
            yield from _pieces(chain([head], batches), tokenizer, capacity, head.schema.field(0).type)

    # Written once: numbers within a task hold only for the attempt that wrote them.
    pieces = stage(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
                   .mapInArrow(tokenise, numbered), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most `capacity` rows, however large the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(fill_bins(counts, capacity))

    return (
        pieces.join(base, ["part", "length"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("number"))
        .mapInArrow(lambda batches: _seat(batches, table), seated)
        .withColumnRenamed("id", id_column)
    )
