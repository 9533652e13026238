"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both token rows of a text spell the same bytes. Byte offsets where tokens of both end cut
them into groups, and every token of one row is linked with every token of the other in its
group. For each pair of ids a container (the documents of one stretch of a task, at
most 65,536) holds bitmaps of its documents: plane k has those where bit k of the number
of links is set. The planes ORed together are the documents that hold the pair linked, and
containers share no document, so popcounts add up to the pair's document count, and popcounts
of the planes weighed by 2^k to its link count. Only counts meet across containers; with
the count and best mark of its pair, a container's posting then returns scores to its documents.

A plane is written as the shorter of a list of 16-bit document numbers and a plain bitmap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.bytepair import encoder
from cohortloom.llm.piece_encoder import piece_encoder, take_runs
from cohortloom.llm.slices import by_bytes
from cohortloom.sources.stages import stage

#: A container is closed at so many documents or postings.
CONTAINER_DOCS = 1 << 16
CONTAINER_POSTINGS = 2 << 20
BLOCK_BYTES = 2 << 20
#: Links of a group that are listed one by one; in a larger one equal ids are counted first.
LISTED = 1 << 12
_LIST, _BITS = 0, 1


# --- bitmaps -------------------------------------------------------------------
def write_bitmaps(row: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """Bitmaps of the documents of each row, given as (row, doc) pairs in order: the rows and their bitmaps."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    counts = np.diff(np.append(first, len(row)))
    width = (n_docs + 7) // 8
    dense = 2 * counts > width
    sizes = 1 + np.where(dense, width, 2 * counts)
    ends = np.cumsum(sizes)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - sizes
    data[starts] = np.where(dense, _BITS, _LIST)
    if (~dense).any():
        listed = take_runs(doc, first[~dense], counts[~dense]).astype("<u2").view(np.uint8)
        lengths = 2 * counts[~dense]
        at = np.repeat(starts[~dense] + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(listed))
        data[at] = listed
    step = max(1, (4 << 20) // max(1, width * 8))
    heavy = np.flatnonzero(dense)
    for k in range(0, len(heavy), step):
        some = heavy[k:k + step]
        bits = np.zeros((len(some), width * 8), dtype=np.uint8)
        bits[np.repeat(np.arange(len(some)), counts[some]), take_runs(doc, first[some], counts[some])] = 1
        data[(starts[some] + 1)[:, None] + np.arange(width)] = np.packbits(bits, axis=1, bitorder="little")
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return row[first], pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def read_bitmaps(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, doc) pairs of the bitmaps, in no set order."""
    if not len(bitmaps):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], dtype=np.int32)[
        bitmaps.offset:bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], dtype=np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    dense = data[starts] == _BITS
    rows, docs = [], []
    light = np.flatnonzero(~dense)
    if len(light):
        docs.append(take_runs(data, starts[light] + 1, lengths[light] - 1).view("<u2").astype(np.int64))
        rows.append(np.repeat(light, (lengths[light] - 1) // 2))
    heavy = np.flatnonzero(dense)
    for width in np.unique(lengths[heavy]) - 1:
        same = heavy[lengths[heavy] - 1 == width]
        step = max(1, (4 << 20) // max(1, width * 8))
        for k in range(0, len(same), step):
            some = same[k:k + step]
            bits = np.unpackbits(data[(starts[some] + 1)[:, None] + np.arange(width)], axis=1, bitorder="little")
            r, d = np.nonzero(bits)
            rows.append(some[r])
            docs.append(d)
    return np.concatenate(rows), np.concatenate(docs)


# --- links of one block ----------------------------------------------------------
class _Aligner:
    """Groups and links of blocks of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a), piece_encoder(path_b)
        if not self.a.by_rank:
            raise ValueError("the byte-level vocabulary must list its ids in the order of its merges")
        by_id = [b""] * len(self.a.lengths)
        for token, i in self.a.by_rank._mergeable_ranks.items():
            by_id[i] = token
        self.a_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.a_starts = np.cumsum(self.a.lengths) - self.a.lengths
        self.n_b = len(self.b.lengths)
        self.written = [f"{i}{end}" for i in range(max(self.n_b, len(by_id))) for end in ",|;"]

    def _tokens(self, texts: list[str]):
        """Ids of both rows and numbers of tokens per text, none for texts that the rows don't spell."""
        a_rows = self.a.encode([" " + t for t in texts])
        b, b_edges = self.b.encode(texts)
        a = np.concatenate([*a_rows, np.zeros(0, dtype=np.uint32)])
        n_a = np.fromiter(map(len, a_rows), dtype=np.int64, count=len(texts))
        n_b = np.diff(b_edges)
        raw = [(" " + t).encode() for t in texts]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(texts))

        def spelled(lengths, counts):
            ends = np.concatenate(([0], np.cumsum(lengths)))
            return np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

        held = (size > 1) & (spelled(self.a.lengths[a], n_a) == size) & (spelled(self.b.lengths[b], n_b) == size)

        def keep(ids, counts, held):
            return take_runs(ids, (np.cumsum(counts) - counts)[held], counts[held])

        a, b = keep(a, n_a, held), keep(b, n_b, held)
        n_a, n_b = np.where(held, n_a, 0), np.where(held, n_b, 0)
        text = np.frombuffer(b"".join(r for r, h in zip(raw, held) if h), dtype=np.uint8)
        unlike = (take_runs(self.a_bytes, self.a_starts[a], self.a.lengths[a]) != text) | (self.b.spelled(b) != text)
        if unlike.any():
            ends = np.cumsum(np.where(held, size, 0))
            wrong = np.zeros(len(texts), dtype=bool)
            wrong[np.searchsorted(ends, np.flatnonzero(unlike), side="right")] = True
            a, b = keep(a, n_a, ~wrong), keep(b, n_b, ~wrong)
            n_a, n_b = np.where(wrong, 0, n_a), np.where(wrong, 0, n_b)
        return a.astype(np.int64), b.astype(np.int64), n_a, n_b

    def __call__(self, texts: list[str]):
        """Per text n_a, n_b, n_groups, n_links and groups as text; and (text, pair, links) postings in the
        order of pair and text, the pair as a * n_b + b."""
        a, b, n_a, n_b = self._tokens(texts)
        if not len(a):
            empty = np.zeros(0, dtype=np.int64)
            return n_a, n_b, np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), [""] * len(texts), (
                empty, empty, empty)
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        seen = np.zeros(int(ends_a[-1]) + 1, dtype=np.uint8)
        seen[ends_a] = 1
        seen[ends_b] += 2
        shared = np.cumsum(seen == 3)
        group_a, group_b = shared[ends_a - 1], shared[ends_b - 1]
        total = int(shared[-1])
        in_a, in_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc_of = np.repeat(np.arange(len(texts)), n_a)[first_a]
        n_groups = np.bincount(doc_of, minlength=len(texts))
        many = in_a * in_b
        n_links = np.bincount(doc_of, weights=many, minlength=len(texts)).astype(np.int64)

        pairs, docs, links = [], [], []
        small = np.flatnonzero(many <= LISTED)
        each = many[small]
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        width = np.repeat(in_b[small], each)
        pairs.append(a[np.repeat(first_a[small], each) + k // width] * self.n_b
                     + b[np.repeat(first_b[small], each) + k % width])
        docs.append(np.repeat(doc_of[small], each))
        links.append(np.ones(len(k), dtype=np.int64))
        for g in np.flatnonzero(many > LISTED):
            x, n = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            pairs.append((x[:, None] * self.n_b + y).ravel())
            docs.append(np.full(len(x) * len(y), doc_of[g]))
            links.append((n[:, None] * m).ravel())
        return n_a, n_b, n_groups, n_links, self._groups(a, b, n_a, n_b, group_a, group_b, first_a, first_b), summed(
            np.concatenate(pairs), np.concatenate(docs), np.concatenate(links))

    def _groups(self, a, b, n_a, n_b, group_a, group_b, first_a, first_b) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2``."""
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        after = np.append(first_a, len(a))[1:]
        codes[np.arange(len(a)) + first_b[group_a]] = 3 * a + last_a
        codes[np.arange(len(b)) + after[group_b]] = 3 * b + 2 * last_b
        bounds = np.concatenate(([0], np.cumsum(n_a + n_b)))
        return ["".join(map(self.written.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(bounds, bounds[1:])]


def summed(pair: np.ndarray, doc: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links added up by pair and document, in that order."""
    code = pair << 16 | doc
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    sums = np.add.reduceat(links[order], first) if len(first) else links
    return code[first] >> 16, code[first] & 0xFFFF, sums


# --- Spark -----------------------------------------------------------------------
def _schema(id_type: T.DataType) -> T.StructType:
    plane = T.StructType([T.StructField("bit", T.IntegerType()), T.StructField("docs", T.BinaryType())])
    return T.StructType([
        T.StructField("container", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("id", id_type),
        *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType()),
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n_docs", T.LongType()),
        T.StructField("links", T.LongType()), T.StructField("planes", T.ArrayType(plane))])


def _postings(pair, doc, links, n_docs: int, n_b: int):
    """One row per pair: a, b, documents, links, planes."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    bits = range(int(links.max()).bit_length())
    chosen = [np.flatnonzero(links >> k & 1) for k in bits]
    plane_row = np.concatenate([row[c] for c in chosen])
    plane_bit = np.concatenate([np.full(len(c), k) for k, c in zip(bits, chosen)])
    plane_doc = np.concatenate([doc[c] for c in chosen])
    order = np.argsort(plane_row << 6 | plane_bit, kind="stable")
    held, bitmaps = write_bitmaps((plane_row << 6 | plane_bit)[order], plane_doc[order], n_docs)
    planes = pa.StructArray.from_arrays(
        [pa.array(held & 63, pa.int32()), bitmaps], fields=[pa.field("bit", pa.int32()), pa.field("docs", pa.binary())])
    bounds = np.searchsorted(held >> 6, np.arange(len(first) + 1)).astype(np.int32)
    return {
        "a": pa.array(pair[first] // n_b, pa.int32()), "b": pa.array(pair[first] % n_b, pa.int32()),
        "n_docs": pa.array(np.bincount(row)), "links": pa.array(np.add.reduceat(links, first)),
        "planes": pa.ListArray.from_arrays(pa.array(bounds), planes)}


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, keep_groups: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Groups of every whole text and inverted pair bitmaps of its links, as one written stage that
    ``pair_counts`` and ``score_documents`` read: rows with ``number`` are documents, rows with ``a`` postings.

    The rows spelled are a space and the text, by a byte-level and a SentencePiece vocabulary. A text that
    is NULL or empty, or whose bytes one of the rows doesn't spell, has no tokens. Rows with a NULL or
    repeated id are documents of their own. Other columns are not read; an empty table gives no rows.
    ``keep_groups`` carries the groups themselves beside their digest.
    """
    schema = _schema(docs.schema[id_column].dataType)

    def align(batches):
        aligner, part = _Aligner(byte_level, pieces), TaskContext.get().partitionId()
        container, n_docs, held, waiting = part << 24, 0, [], 0

        def batch_of(columns, n, id_type):
            kinds = [f.type for f in schema_of(id_type)]
            return pa.RecordBatch.from_arrays(
                [columns.get(f.name, None) if f.name in columns else pa.nulls(n, k) for f, k in zip(schema, kinds)],
                schema=schema_of(id_type))

        def schema_of(id_type):
            plane = pa.struct([("bit", pa.int32()), ("docs", pa.binary())])
            kinds = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}
            return pa.schema([(f.name, id_type if f.name == "id" else pa.list_(plane) if f.name == "planes"
                               else kinds[f.dataType.typeName()]) for f in schema])

        def close():
            pair, doc, links = (np.concatenate(x) for x in zip(*held))
            if len(pair):
                rows = _postings(*summed(pair, doc, links), n_docs, aligner.n_b)
                n = len(rows["a"])
                whole = batch_of(rows | {"container": pa.array(np.full(n, container))}, n, id_type)
                for at in range(0, n, 10_000):
                    yield whole.slice(at, 10_000)

        id_type = pa.null()
        for block in by_bytes(batches, 1, BLOCK_BYTES):
            id_type = block.schema.field(0).type
            if held and (n_docs + block.num_rows > CONTAINER_DOCS or waiting > CONTAINER_POSTINGS):
                yield from close()
                container, n_docs, held, waiting = container + 1, 0, [], 0
            n_a, n_b, n_groups, n_links, groups, (pair, doc, links) = aligner([t or "" for t in block.column(1).to_pylist()])
            held.append((pair, doc + n_docs, links))
            waiting += len(pair)
            n = block.num_rows
            yield batch_of({
                "container": pa.array(np.full(n, container)), "number": pa.array(np.arange(n_docs, n_docs + n), pa.int32()),
                "id": block.column(0), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups),
                "n_links": pa.array(n_links), "groups": pa.array(groups if keep_groups else [None] * n, pa.string()),
                "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups])}, n, id_type)
            n_docs += n
        if held:
            yield from close()

    # Written once: containers and numbers hold only for the attempt that wrote them.
    return stage(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(align, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """The pairs of the corpus: a, b, n_docs (documents that hold it linked), links, best (whether n_docs
    is the highest of its ``a``, ties included)."""
    counts = aligned.where("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("links"))
    counts = stage(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "n_docs", "links", (F.col("n_docs") == F.col("highest")).alias("best"))


def score_documents(aligned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each document with the scores that its pairs return: the id column, n_a, n_b, n_groups, n_links,
    n_best (links whose pair is a best one), count_sum (their pairs' document counts, added over the
    links), groups_sha256, groups."""
    counts = pair_counts(aligned).select("a", "b", F.col("n_docs").alias("count"), "best")
    postings = aligned.where("a is not null").select("container", "a", "b", "planes")
    schema = "container long, number int, n_best long, count_sum long"

    def give(table: pa.Table) -> pa.Table:
        planes = table.column("planes").combine_chunks()
        planes = planes.chunk(0) if isinstance(planes, pa.ChunkedArray) else planes
        offsets = planes.offsets.to_numpy()
        flat = planes.values
        row, number = read_bitmaps(flat.field("docs"))
        owner = np.searchsorted(offsets, row, side="right") - 1
        links = np.left_shift(1, flat.field("bit").to_numpy().astype(np.int64))[row]
        n_docs = int(number.max()) + 1
        best, count = table.column("best").to_numpy()[owner].astype(bool), table.column("count").to_numpy()[owner]
        n_best, count_sum = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
        np.add.at(n_best, number[best], links[best])
        np.add.at(count_sum, number, links * count)
        return pa.table({
            "container": pa.array(np.full(n_docs, table.column("container")[0].as_py())),
            "number": pa.array(np.arange(n_docs), pa.int32()), "n_best": n_best, "count_sum": count_sum})

    scores = postings.join(counts, ["a", "b"]).select("container", "planes", "count", "best").groupBy("container").applyInArrow(
        give, schema)
    documents = aligned.where("number is not null").select(
        "container", "number", F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
    return documents.join(scores, ["container", "number"], "left").select(
        id_column, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256", "groups")
