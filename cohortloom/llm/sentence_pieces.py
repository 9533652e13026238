"""SentencePiece encoding and decoding of whole documents.

Spark deals out the texts; a task cuts its Arrow batches in blocks by bytes, segments
the distinct marked words of a block once and joins their ids back by position (see
``piece_encoder``). There is no shuffle, and a block's table is bounded by its bytes. A
table of the words of the whole corpus, joined back by a shuffle of every place of every
text, would move many times the input and grow with it, to save a few
milliseconds a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.piece_encoder import BLOCK_BYTES, piece_encoder
from cohortloom.llm.slices import by_bytes


def encode_documents(
    docs: DataFrame, model: str, ends: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Ids and decoded text of every whole text: the id column, n_tokens, ids, decoded.

    ``ids`` holds the ids that the library's ``encode`` gives, as little-endian unsigned 32-bit
    numbers, begun and ended by the model's begin and end ids if ``ends``; ``decoded`` is what the
    library's ``decode`` makes of them.

    A NULL text counts as empty and has the begin and end ids only. Rows with a NULL or repeated
    id are encoded one by one. Other columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def encode(batches):
        coder = piece_encoder(model)
        begin = np.array([coder.model.bos_id()] if ends else [], dtype=np.uint32)
        end = np.array([coder.model.eos_id()] if ends else [], dtype=np.uint32)
        for part in by_bytes(batches, 1, BLOCK_BYTES):
            flat, edges = coder.encode([t or "" for t in part.column(1).to_pylist()])
            rows = [np.concatenate((begin, flat[edges[i]:edges[i + 1]], end)) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()),
                 pa.array([coder.model.decode(r.tolist()) for r in rows], pa.string())],
                names=schema.names)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        encode, schema).withColumnRenamed("id", id_column)


def decode_documents(
    encoded: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """Texts of stored ids (little-endian unsigned 32-bit numbers): the id column, text. A NULL
    list of ids gives a NULL text, an empty one an empty text; an empty table gives no rows."""
    schema = T.StructType([
        T.StructField("id", encoded.schema[id_column].dataType), T.StructField("text", T.StringType())])

    def decode(batches):
        decoder = piece_encoder(model).model
        for part in by_bytes(batches, 1, BLOCK_BYTES):
            texts = [None if b is None else decoder.decode(np.frombuffer(b, dtype="<u4").tolist()) if b else ""
                     for b in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInArrow(
        decode, schema).withColumnRenamed("id", id_column)
