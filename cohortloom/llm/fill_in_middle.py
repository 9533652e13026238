"""Fill-in-middle transformation by secondary sort.

A document is cut in units (lines) and, at two drawn unit ends, in prefix, middle and
suffix. Map tasks emit pieces, which are chunks of whole units, keyed by document and
by their position in the output; one shuffle deals them out by document, and every
partition is sorted by document and position (``repartitionAndSortWithinPartitions``,
as DataFrames spell it). Pieces then stream past in output order, into an incremental
digest, and no step holds a document. To restore a text, a reader that sees only the
output and its form finds the sentinels, and a second sort of the same partitions, without
a shuffle, brings the pieces back in the order of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.slices import SLICE_BYTES, by_bytes

#: Sentinels of the prefix, middle and suffix, in the order of the text.
SENTINELS = ("<P>", "<M>", "<S>")
#: Order of the sections in either form.
FORMS = {"plain": (), "psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Characters of a piece at most; units are only cut where one is longer.
PIECE_CHARS = 1 << 14
_KEY = ["k1", "k2", "k3"]
_DONE = len(SENTINELS)


def _draws(identity: Column, seed: int, n: int = 4) -> list[Column]:
    """Whole numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(n)]


def _unit_end(text: str, units: int) -> int:
    """Where the first ``units`` lines of a text end."""
    at = 0
    for _ in range(units):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def _chunks(text: str, size: int):
    """Runs of whole units of at most ``size`` characters; a longer unit is cut. At least one, if empty."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size) + 1 or at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def _sections(text: str, draws, rate: int, spm: int) -> tuple[int, str, tuple[str, str, str]]:
    """Number of units, form, and prefix, middle and suffix."""
    n = text.count("\n") + (bool(text) and not text.endswith("\n"))
    if not text or draws[2] % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", (text, "", "")
    first, last = sorted(_unit_end(text, d % (n + 1)) for d in draws[:2])
    return n, "spm" if draws[3] % 100 < spm else "psm", (text[:first], text[first:last], text[last:])


class _Rows:
    """Rows that leave as a batch once their texts fill a slice."""

    def __init__(self, schema: pa.Schema, text: int):
        self.schema, self.text, self.rows, self.size = schema, text, [], 0

    def add(self, row: tuple):
        self.rows.append(row)
        self.size += 64 + len(row[self.text] or b"")
        if self.size >= SLICE_BYTES:
            yield from self.flush()

    def flush(self):
        if self.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _arrow(schema: T.StructType, id_type: pa.DataType) -> pa.Schema:
    kinds = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, id_type if f.name == "id" else kinds[f.dataType.typeName()]) for f in schema])


def _piece_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        *[T.StructField(k, T.LongType()) for k in _KEY], T.StructField("position", T.IntegerType()),
        T.StructField("piece", T.BinaryType()), T.StructField("id", id_type), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType())])


def transform_pieces(
    docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The transformed documents as pieces of UTF-8 in output order: k1, k2, k3, position, piece, id, n,
    form, prefix_chars, middle_chars; a document's pieces stand together in one partition.

    Units are lines with their line feed. The prefix ends after the smaller, the middle after the
    larger of two drawn numbers of units. ``rate`` percent of the texts are transformed, ``spm``
    percent of these with the suffix first; draws depend on ``seed`` and the id alone. An empty text
    or one that contains a sentinel stays plain. Attributes stand on a document's first piece.

    A NULL text counts as empty and a NULL id as an empty one in the draws. Rows with a NULL or repeated id
    are documents of their own: the key is a hash of id and text, the task, and a number among
    equal rows of the task, so it doesn't depend on the order in which a task reads them. Other
    columns are not read; an empty table gives no rows.
    """
    schema = _piece_schema(docs.schema[id_column].dataType)

    def emit(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        rows = None
        for batch in by_bytes(batches, 3):
            rows = rows or _Rows(_arrow(schema, batch.schema.field(2).type), 4)
            for k1, k2, identity, text, *draws in zip(*(c.to_pylist() for c in batch.columns)):
                k3 = part << 32 | seen[k1, k2]
                seen[k1, k2] += 1
                n, form, sections = _sections(text, draws, rate, spm)
                cut = form != "plain"
                about = (identity, n, form, len(sections[0]) if cut else None, len(sections[1]) if cut else None)
                position = 0
                for section in FORMS[form] or (0,):
                    mark = SENTINELS[section] if cut else ""
                    for chunk in _chunks(sections[section], PIECE_CHARS):
                        yield from rows.add((k1, k2, k3, position, (mark + chunk).encode(),
                                             *(about if position == 0 else (None,) * 5)))
                        position, mark = position + 1, ""
        if rows:
            yield from rows.flush()

    identity, text = F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(
        F.xxhash64(identity, text).alias("k1"), F.xxhash64(text, identity).alias("k2"), identity.alias("id"),
        text.alias("text"), *_draws(identity, seed))
    return keyed.mapInArrow(emit, schema).repartition(*_KEY).sortWithinPartitions(*_KEY, "position")


def _by_document(batches):
    """Rows of sorted batches, with whether each begins a document."""
    last = None
    for batch in by_bytes(batches, 4):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[:3] != last, row
            last = row[:3]


def restore_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of the texts in their own order, from pieces of the output and its form: k1, k2, k3, section,
    position, piece, and after a document's last piece a row of section 3 with its attributes and the
    output's digest. Runs in the partitions of ``pieces``, without a shuffle."""
    base = pieces.schema
    schema = T.StructType([
        *[base[k] for k in _KEY], T.StructField("section", T.IntegerType()), base["position"], base["piece"],
        *[base[c] for c in ("id", "n", "form", "prefix_chars", "middle_chars")], T.StructField("output_sha256", T.StringType())])
    marks = {s.encode(): i for i, s in enumerate(SENTINELS)}
    split = re.compile(b"(" + b"|".join(map(re.escape, marks)) + b")")

    def read(batches):
        rows, digest, key, about, section = None, None, None, None, 0
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        rows = _Rows(_arrow(schema, first.schema.field(5).type), 5)
        for begins, row in _by_document(_again(first, batches)):
            if begins:
                if digest:
                    yield from rows.add((*key, _DONE, 0, None, *about, digest.hexdigest()))
                digest, key, about, section = hashlib.sha256(), row[:3], row[5:], 0
            digest.update(row[4])
            for part in split.split(row[4]) if about[2] != "plain" else [row[4]]:
                if part in marks and about[2] != "plain":
                    section = marks[part]
                elif part:
                    yield from rows.add((*key, section, row[3], part, *(None,) * 6))
        if digest:
            yield from rows.add((*key, _DONE, 0, None, *about, digest.hexdigest()))
        yield from rows.flush()

    return pieces.mapInArrow(read, schema).sortWithinPartitions(*_KEY, "section", "position")


def _again(first, rest):
    yield first
    yield from rest


def digest_documents(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests of output and restored text: the id column, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256. One row per document, an empty table gives none."""
    restored = restore_pieces(pieces)
    names = ("id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    schema = T.StructType([*[restored.schema[c] for c in names], T.StructField("restored_sha256", T.StringType())])

    def digest(batches):
        rows, state = None, None
        for batch in by_bytes(batches, 5):
            rows = rows or _Rows(_arrow(schema, batch.schema.field(6).type), 5)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                state = state or hashlib.sha256()
                if row[3] == _DONE:
                    yield from rows.add((*row[6:], state.hexdigest()))
                    state = None
                else:
                    state.update(row[5])
        if rows:
            yield from rows.flush()

    return restored.mapInArrow(digest, schema).withColumnRenamed("id", id_column)


def transform_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Whole transformed texts, for those who want them in one row: the id column, form, text. Options
    and edge cases as in ``transform_pieces``; a task holds one document at a time."""
    pieces = transform_pieces(docs, id_column=id_column, **options)
    schema = T.StructType([pieces.schema["id"], pieces.schema["form"], T.StructField("text", T.StringType())])

    def join(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        rows, about, parts = _Rows(_arrow(schema, first.schema.field(5).type), 2), None, []
        for begins, row in _by_document(_again(first, batches)):
            if begins:
                if about:
                    yield from rows.add((about[0], about[2], b"".join(parts).decode()))
                about, parts = row[5:], []
            parts.append(row[4])
        if about:
            yield from rows.add((about[0], about[2], b"".join(parts).decode()))
        yield from rows.flush()

    return pieces.mapInArrow(join, schema).withColumnRenamed("id", id_column)
