"""Token counts of the sections of whole documents.

A document is encoded once. The encoder is byte-level and lossless, so the byte
spans of its tokens follow from the token lengths; they become character spans
and meet the section spans in a sorted interval join inside the task that read the
document. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.bytepair import BATCH_BYTES, encoder
from cohortloom.llm.slices import by_bytes

RULES = ("first", "last")
_LENGTHS: dict[str, np.ndarray] = {}


def _byte_lengths(path: str, tokenizer) -> np.ndarray:
    """Bytes of each id: the byte-level alphabet writes each byte as one character."""
    if path not in _LENGTHS:
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            lengths[i] = len(token)
        _LENGTHS[path] = lengths
    return _LENGTHS[path]


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans (start, end exclusive) of the tokens; one that starts or ends inside
    a character covers that character."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(lengths[ids])
    start = end - lengths[ids]
    return character[start], character[end - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines of a text; a line keeps its line feed. At least one section."""
    at, starts = text.find("\n"), [0]
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, dtype=np.int64)


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, sections: np.ndarray, rule: str):
    """Per section: tokens given to it, and how many of those also reach into another one."""
    if not len(ids):
        return np.zeros(len(sections), dtype=np.int64), np.zeros(len(sections), dtype=np.int64)
    start, end = token_spans(text, ids, lengths)
    first = np.searchsorted(sections, start, side="right") - 1
    last = np.searchsorted(sections, end - 1, side="right") - 1
    owner = first if rule == "first" else last
    return (np.bincount(owner, minlength=len(sections)),
            np.bincount(owner[first != last], minlength=len(sections)))


def count_section_tokens(
    docs: DataFrame, tokenizer: str, rule: str = "first", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens of every line of every whole document, counted in the encoding of the whole.

    A token that crosses a section boundary goes to the section of its first
    character (``rule="first"``) or of its last one (``"last"``), so the sections of
    a document sum to its tokens. Returns one row per section: the id column, section
    (from 0), start and end (characters, end exclusive), n_tokens, n_crossing (those of
    its tokens that reach into another section), doc_tokens.

    A NULL or empty text has one section with no tokens. Rows with a NULL or repeated
    id are documents of their own. Other columns are not read; an empty table gives
    no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("section", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "end", "n_tokens", "n_crossing", "doc_tokens")]])

    def count(batches):
        coder = encoder(tokenizer)
        lengths = _byte_lengths(tokenizer, coder.tokenizer)
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, columns = [], [[] for _ in range(6)]
            for i, ids in enumerate(coder.encode(texts)):
                sections = line_sections(texts[i])
                owned, crossing = attribute(texts[i], ids, lengths, sections, rule)
                n = len(sections)
                rows.append(np.full(n, i))
                for column, values in zip(columns, (
                        np.arange(n), sections, np.append(sections[1:], len(texts[i])), owned, crossing,
                        np.full(n, len(ids)))):
                    column.append(values)
            arrays = [batch.column(0).take(pa.array(np.concatenate(rows)))]
            arrays.append(pa.array(np.concatenate(columns[0]).astype(np.int32)))
            arrays += [pa.array(np.concatenate(c).astype(np.int64)) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(count, schema)
