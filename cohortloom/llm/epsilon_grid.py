"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a
distance epsilon. The leading principal directions of all vectors span a grid with
cells of that width; sorted by their cells (the epsilon grid order), vectors form a
sequence that is cut in pages. Two pages can only hold a pair if the boxes around
them lie within epsilon, so pages meet by neighbouring cells and by their boxes.

Vectors travel by tiles, runs of neighbouring pages. Where boxes prune little, each tile meets
each other one, so what is moved grows faster than the input; it is moved in rounds of not much
more bytes than all vectors have, and the shuffle files of a round go before the next begins. Disk
so stays in proportion to the input, while the time still follows the pairs of pages. Vectors
travel in the bytes of the input's own type, and rows find theirs by a digest.

Inside a task, pages whose boxes are close are compared by their leading directions and the length
of the rest, which bound the cosine from above. Pairs that this leaves are compared in single precision,
and whatever lies within its rounding error of the threshold in double precision.

Vectors equal in every component become one node first, with a count.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.graph import components
from cohortloom.llm.slices import by_bytes
from cohortloom.sources.stages import shuffles_freed, stage, stage_all

#: Leading directions that give the order and the boxes; the first PREFIX give the page's cell.
DIRECTIONS = 8
PREFIX = 2
PAGE = 256
#: Numbers that bound a cosine from above: leading directions, and the length of the rest.
BOUND = 24
#: Bytes of the vectors of a tile at most, and vectors of it at least, where there are as many.
TILE_BYTES = 8 << 20
TILE_ROWS = 8 * PAGE
#: Vectors that one page is compared with at once.
RUN = 8 * PAGE
#: What a round may move, as a multiple of all vectors and in bytes, whichever is more.
ROUND_SHARE = 1.5
ROUND_BYTES = 128 << 20
#: Rows of (tile, tile, page) up to which a round sends them to all tasks.
BROADCAST_ROWS = 1_000_000
#: Links between unlike groups that a task gathers before it merges the groups.
MERGE_LINKS = 1 << 18
_SLACK = 1e-6
_STEP = 1024


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each run between the offsets ``at``."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def _packed(batch: pa.RecordBatch, real: type) -> pa.RecordBatch:
    """Ids and lists as ids and bytes; NULL for a row that can't be linked."""
    column = batch.column(1)
    at = column.offsets.to_numpy().astype(np.int64)
    x = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(real) + real(0)
    at -= at[0]
    sound = (_sums(~np.isfinite(x), at) == 0) & (_sums(x != 0, at) > 0)
    for c in batch.columns:
        sound &= c.is_valid().to_numpy(zero_copy_only=False)
    v = pa.Array.from_buffers(pa.binary(), len(sound), [
        pa.py_buffer(np.packbits(sound, bitorder="little").tobytes()),
        pa.py_buffer((at * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([batch.column(0), v], names=["id", "v"])


def _values(column: pa.Array, real: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column without NULL, one after the other, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    return data.view(real), np.diff(at) // np.dtype(real).itemsize


def _filled(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of a matrix, shorter ones filled with zeros."""
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, as doubles. Scaling by the largest component first keeps squares finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(column: pa.Array, real: type, width: int) -> np.ndarray:
    return _unit(_filled(*_values(column, real), width))


def _directions(vectors: DataFrame, width: int, real: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and leading principal directions of all unit vectors, and orthonormal directions that hold
    the mean and more of them. Each task sends sums of fixed size, which Spark adds up."""
    def sums(batches):
        both = np.zeros(1 + width + width * width)
        for batch in by_bytes(batches, 0):
            x = _units(batch.column(0), real, width)
            both += np.concatenate(([float(len(x))], x.sum(axis=0), (x.T @ x).ravel()))
        if both[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["k", "v"])

    rows = vectors.select("v").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + width + width * width)
    for r in rows:
        flat[r["k"]] = r["v"]
    n = max(flat[0], 1.0)
    mean = flat[1:1 + width] / n
    spread = flat[1 + width:].reshape(width, width) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, ::-1]
    basis = np.linalg.qr(np.column_stack((mean, axes[:, :BOUND - 2])))[0]
    axes = axes[:, :DIRECTIONS]
    return mean, np.pad(axes, ((0, 0), (0, DIRECTIONS - axes.shape[1]))), basis


def _close(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, limit: float) -> np.ndarray:
    """Which of many boxes lie within the root of ``limit`` of one."""
    gap = np.maximum(0, np.maximum(low - highs, lows - high))
    return (gap * gap).sum(axis=1) <= limit


def _hits(products: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of products from ``least`` on."""
    rows = np.flatnonzero(products.max(axis=1) >= np.float32(least))
    i, j = np.nonzero(products[rows] >= np.float32(least))
    return rows[i], j


def _error(numbers: int) -> float:
    """The rounding of two vectors to single precision and of the sum of their products, twice over."""
    return (numbers + 8) * 2.0**-23


def _merged(label: np.ndarray, links: list) -> np.ndarray:
    """Labels after linked labels became one, the smallest place of each group."""
    root = np.arange(len(label))
    i, j = (np.concatenate(c) for c in zip(*links))
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root[label]


class _Side:
    """The pages of one tile in a task, in the order of the sequence."""

    def __init__(self, pages: pa.Table, real: type, basis: np.ndarray):
        pages = pages.sort_by("page")
        values, lengths = _values(pages.column("vectors").combine_chunks(), real)
        sizes, self.dims = (pages.column(c).to_numpy() for c in ("size", "dim"))
        width = int(self.dims.max())
        self.raw = _filled(values, np.repeat(self.dims, sizes), width)
        self.single = np.empty(self.raw.shape, dtype=np.float32)
        self.bound = np.empty((len(self.raw), BOUND), dtype=np.float32) if len(basis) > BOUND else None
        for k in range(0, len(self.raw), RUN):
            self.single[k:k + RUN] = unit = _unit(self.raw[k:k + RUN])
            if self.bound is not None:
                self.bound[k:k + RUN, :-1] = lead = unit @ basis[:width]
                self.bound[k:k + RUN, -1] = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)) + 1e-12)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.low, self.high = (
            pages.column(c).combine_chunks().flatten().to_numpy().reshape(-1, DIRECTIONS) for c in ("low", "high"))
        self.nodes, copies = (pages.column(c).combine_chunks().flatten() for c in ("nodes", "copies"))
        self.weights = copies.to_numpy().astype(np.float64)
        self.counts = np.zeros(len(self.raw))


def _runs(close: np.ndarray, at: np.ndarray):
    """Rows of neighbouring pages among those that are close, ``RUN`` rows at once."""
    for pages in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
        for k in range(at[pages[0]], at[pages[-1] + 1], RUN):
            yield k, min(k + RUN, at[pages[-1] + 1])


def _linked_rows(a: _Side, b: _Side, s: int, e: int, k: int, l: int, dim: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two runs with cosine ``least`` or more."""
    error, products = _error(dim), None
    if a.bound is not None:
        i, j = _hits(a.bound[s:e] @ b.bound[k:l].T, least - _error(BOUND))
        if len(i) <= (e - s) * (l - k) // 128:
            cosines = np.concatenate([np.zeros(0, dtype=np.float32), *[
                (a.single[s + i[u:u + RUN], :dim] * b.single[k + j[u:u + RUN], :dim]).sum(axis=1) for u in range(0, len(i), RUN)]])
            near = cosines >= np.float32(least - error)
            i, j, cosines = i[near], j[near], cosines[near]
        else:
            products = a.single[s:e, :dim] @ b.single[k:l, :dim].T
    else:
        products = a.single[s:e, :dim] @ b.single[k:l, :dim].T
    if products is not None:
        i, j = _hits(products, least - error)
        cosines = products[i, j]
    keep, unsure = np.ones(len(i), dtype=bool), np.flatnonzero(cosines < least + error)
    i, j = i + s, j + k
    for u in range(0, len(unsure), RUN):
        at = unsure[u:u + RUN]
        keep[at] = (_unit(a.raw[i[at], :dim]) * _unit(b.raw[j[at], :dim])).sum(axis=1) >= least
    return i[keep], j[keep]


def join_tiles(a: _Side, b: _Side, limit: float, least: float) -> np.ndarray:
    """Count the links of each row with cosine ``least`` or more, and label the rows of both tiles
    by their groups; ``a`` is ``b`` for the links inside a tile. Pages whose boxes lie further than
    the root of ``limit`` apart are skipped."""
    same = a is b
    shift = 0 if same else len(a.raw)
    label, links, waiting = np.arange(shift + len(b.raw)), [], 0
    for page in range(len(a.dims)):
        s, e, dim = int(a.at[page]), int(a.at[page + 1]), int(a.dims[page])
        first = page if same else 0
        close = first + np.flatnonzero(
            (b.dims[first:] == dim) & _close(a.low[page], a.high[page], b.low[first:], b.high[first:], limit))
        for k, l in _runs(close, b.at) if len(close) else ():
            i, j = _linked_rows(a, b, s, e, k, l, dim, least)
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            a.counts[s:e] += np.bincount(i - s, weights=b.weights[j], minlength=e - s)
            b.counts[k:l] += np.bincount(j - k, weights=a.weights[i], minlength=l - k)
            p, q = label[i], label[shift + j]
            apart = p != q
            links.append((p[apart], q[apart]))
            waiting += len(links[-1][0])
            if waiting > MERGE_LINKS:
                label, links, waiting = _merged(label, links), [], 0
    return _merged(label, links) if links else label


def link_vectors(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Links and group of each vector: id, n_links, component_id, kept.

    Vectors are linked where their cosine, in double precision, is ``cosine`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable by links, itself included, and ``kept`` marks the row that has it.

    A vector that is NULL, empty or zero, or has a NULL or non-finite component, has no link, and
    vectors of unlike length have none with each other. A row with a NULL id isn't linked: its
    component is NULL and it is kept. Rows that share an id count as one node of the
    groups, each with its own links. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    with shuffles_freed(vectors.sparkSession):
        return _linked(vectors, cosine, id_column, vector_column)


def _linked(vectors: DataFrame, cosine: float, id_column: str, vector_column: str) -> DataFrame:
    spark = vectors.sparkSession
    id_type, vector_type = vectors.schema[id_column].dataType, vectors.schema[vector_column].dataType
    epsilon = float(np.sqrt(2 - 2 * cosine))
    single = isinstance(vector_type, T.ArrayType) and isinstance(vector_type.elementType, T.FloatType)
    real = np.float32 if single else np.float64
    item = np.dtype(real).itemsize

    def pack(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _STEP):
                yield _packed(batch.slice(k, _STEP), real)

    packed = vectors.select(
        F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("v")
    ).mapInArrow(pack, T.StructType([T.StructField("id", id_type), T.StructField("v", T.BinaryType())]))
    digest = F.unhex(F.sha2("v", 256))
    # Copies: one node with the smallest id.
    nodes = stage(packed.where("v is not null").groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).select(
        "v", (F.octet_length("v") / item).cast("int").alias("dim"), "node", "copies"), "nodes")
    width = nodes.agg(F.max("dim")).first()[0] or 1
    mean, axes, basis = _directions(nodes, width, real)

    cells = [f"c{k}" for k in range(DIRECTIONS)]

    def place(batches):
        for batch in by_bytes(batches, 0):
            at = (_units(batch.column(0), real, width) - mean) @ axes
            grid = np.floor(at / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(grid[:, k]) for k in range(DIRECTIONS)]], names=[*batch.schema.names, *cells])

    placed = nodes.mapInArrow(place, T.StructType([*nodes.schema, *[T.StructField(c, T.IntegerType()) for c in cells]]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "dim", *cells, "node").sortWithinPartitions("dim", *cells, "node")
    prefix = [f"p{k}" for k in range(PREFIX)]
    page_type = T.StructType([
        T.StructField("page", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("size", T.IntegerType()), T.StructField("dim", T.IntegerType()), *[T.StructField(p, T.IntegerType()) for p in prefix],
        T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("nodes", T.ArrayType(id_type)), T.StructField("copies", T.ArrayType(T.LongType())),
        T.StructField("vectors", T.BinaryType())])

    def cut(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in by_bytes(batches, 0):
            at = (_units(batch.column(0), real, width) - mean) @ axes
            values, lengths = _values(batch.column(0), real)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", *cells[:PREFIX])], axis=1)
            turns = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            edges = [0, *turns.tolist(), len(at)]
            bounds = [(s, min(s + PAGE, e)) for b, e in zip(edges, edges[1:]) for s in range(b, e, PAGE)]
            out = []
            for s, e in bounds:
                out.append({
                    "page": (part << 32) + number, "part": part, "first": before + s, "size": e - s, "dim": int(keys[s, 0]),
                    **{p: int(keys[s, 1 + k]) for k, p in enumerate(prefix)},
                    "low": at[s:e].min(axis=0).tolist(), "high": at[s:e].max(axis=0).tolist(),
                    "nodes": batch.column("node").slice(s, e - s).to_pylist(), "copies": batch.column("copies").slice(s, e - s).to_pylist(),
                    "vectors": values[ends[s]:ends[e]].tobytes()})
                number += 1
            before += len(at)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("page", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("size", pa.int32()), ("dim", pa.int32()),
                *[(p, pa.int32()) for p in prefix], ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                ("nodes", pa.list_(batch.schema.field("node").type)),
                ("copies", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    pages = stage(ordered.mapInArrow(cut, page_type), "pages")
    total, whole = pages.agg(F.sum("size"), F.sum(F.col("size").cast("long") * F.col("dim") * item)).first()
    # Tiles that fit a task, but so many that their pairs keep all cores busy.
    tile = min(max(PAGE, TILE_BYTES // (item * width)),
               max(TILE_ROWS, math.ceil((total or 0) / math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))))
    # Where each part begins in the whole sequence: one row per part, and so the tile of each page.
    sizes = pages.groupBy("part").agg(F.sum("size").alias("rows"))
    begins = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    boxes = stage(pages.select("page", "part", "first", "size", "dim", *prefix, "low", "high").join(
        sizes.select("part", begins.alias("begins")), "part").select(
        F.struct("page", F.floor((F.col("begins") + F.col("first")) / tile).alias("tile"),
                 (F.col("size").cast("long") * F.col("dim") * item).alias("bytes")).alias("at"),
        "dim", *prefix, "low", "high"), "boxes")
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"p{k}") for k, x in enumerate(move)])
                      for move in itertools.product((-1, 0, 1), repeat=PREFIX)])
    a = boxes.select(F.col("at").alias("a"), "dim", F.explode(steps).alias("step"), *prefix,
                     F.col("low").alias("a_low"), F.col("high").alias("a_high")).select(
        "a", "dim", "a_low", "a_high", *[(F.col(p) + F.col(f"step.{p}")).alias(p) for p in prefix])
    b = boxes.select(F.col("at").alias("b"), "dim", *prefix, F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    gap = sum((F.greatest(F.lit(0.0), F.col("a_low")[k] - F.col("b_high")[k], F.col("b_low")[k] - F.col("a_high")[k]) ** 2
               for k in range(DIRECTIONS)), F.lit(0.0))
    limit = epsilon * epsilon + _SLACK
    close = a.join(b, ["dim", *prefix]).where((F.col("a.page") <= F.col("b.page")) & (gap <= limit)).select("a", "b")
    # Every page that has a close one goes to a pair of tiles once, however many pairs of pages the two have.
    wanted = stage(close.select(F.col("a.tile").alias("x"), F.col("b.tile").alias("y"), F.explode(F.array("a", "b")).alias("at")).select(
        "x", "y", "at.*").distinct(), "wanted")
    moves, moved = wanted.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    rounds = max(1, math.ceil((moved or 0) / max(ROUND_SHARE * (whole or 0), ROUND_BYTES)))
    met = pages.select("page", "size", "dim", "low", "high", "nodes", "copies", "vectors")

    def join(given: pa.Table) -> pa.Table:
        """Links of two tiles: for each node how many rows of the other one it is linked to, and one
        link to a node that the two tiles connect it with."""
        x, y = given.column("x")[0].as_py(), given.column("y")[0].as_py()
        a = _Side(given.filter(pc.equal(given.column("tile"), x)), real, basis)
        b = a if x == y else _Side(given.filter(pc.equal(given.column("tile"), y)), real, basis)
        label = join_tiles(a, b, limit, cosine)
        sides = [a] if x == y else [a, b]
        found = pa.concat_arrays([s.nodes for s in sides])
        counts = np.concatenate([s.counts for s in sides]).astype(np.int64)
        hit = np.flatnonzero(counts)
        return pa.table([found.take(pa.array(hit)), found.take(pa.array(label[hit])), pa.array(counts[hit])], names=["node", "other", "n"])

    def moving():
        for k in range(rounds):
            now = wanted.where(F.pmod(F.col("x") + F.col("y"), F.lit(rounds)) == k).select("x", "y", "tile", "page")
            if moves / rounds <= BROADCAST_ROWS:
                now = F.broadcast(now)
            yield now.join(met, "page").groupBy("x", "y").applyInArrow(join, T.StructType([
                T.StructField("node", id_type), T.StructField("other", id_type), T.StructField("n", T.LongType())]))

    linked = stage_all(moving(), "linked")
    # Rows find their node by a digest of the vector.
    rows = stage(packed.select("id", F.when(F.col("v").isNotNull(), digest).alias("digest")), "rows")
    known = stage(rows.where("digest is not null").join(
        nodes.select(digest.alias("digest"), "node", "copies"), "digest").select("id", "node", "copies"), "known")
    # One id with several vectors is one node of the groups.
    several = known.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    again = known.join(several, "id").select(F.col("a"), F.col("node").alias("b"))
    groups = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(again))
    counted = linked.groupBy("node").agg(F.sum("n").alias("n"))
    # Rows without a vector meet nothing and stay out of the joins.
    joined = known.join(counted, "node", "left").join(groups, "node", "left").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component")).unionByName(
        rows.where("digest is null").select("id"), allowMissingColumns=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
