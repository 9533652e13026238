"""SentencePiece ids for whole texts through a table of distinct marked words.

The model writes a space as a marker and puts one marker before a text. Where no
piece of the vocabulary has a marker after another character, no merge crosses the
place before a run of markers, so a text is a row of marked words (a run of markers and
what follows up to the next) and each can be segmented apart. The distinct words of
a block form a table that is segmented once; each place of a text holds the number of
its word, and the ids come back by joining places with the table.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: Bytes of text whose words share a table.
BLOCK_BYTES = 4 << 20
_WORDS = re.compile(" ( *[^ ]*)")
_ENCODERS: dict[str, "PieceEncoder"] = {}


def piece_encoder(path: str) -> "PieceEncoder":
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` from ``starts``, ``lengths`` long, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class PieceEncoder:
    """Equal to the library's ``encode`` without begin and end ids. Control strings in a text are text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        #: Whether words can be segmented apart: one marker is put in front, spaces are kept, no piece crosses.
        self.separable = model.encode("a  b ") == model.encode("a") + model.encode(" b") + [
            model.piece_to_id(MARK)] and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark = model.piece_to_id(MARK)
        coded = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i)
                 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Bytes that each id stands for: their number and, end to end, themselves.
        self.lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        self.bytes = np.frombuffer(b"".join(coded), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given without their first marker, end to end; how many each has."""
        found = self.model.encode(words, num_threads=1)
        found = [ids if w else [self.mark] for w, ids in zip(words, found)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin, with the end of the last."""
        if not self.separable:
            found = self.model.encode(texts, num_threads=1)
            bounds = np.cumsum([0, *map(len, found)])
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(bounds[-1])), bounds
        plain = [bool(t) and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.string()), " ")
        other = [_WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t, p in zip(texts, plain) if not p]
        counts = np.empty(len(texts), dtype=np.int64)
        is_plain = np.array(plain, dtype=bool)
        counts[is_plain] = np.diff(split.offsets.to_numpy())
        counts[~is_plain] = [len(o) for o in other]
        words = pa.concat_arrays([split.values, pa.array(list(chain.from_iterable(other)), pa.string())]).dictionary_encode()
        ids, sizes = self._table(words.dictionary.to_pylist())
        # Places in the order of the texts: first those of the plain ones, then the others'.
        at = words.indices.to_numpy().astype(np.int64)
        order = np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain)))
        starts = np.empty(len(texts), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        at = take_runs(at, starts, counts)
        lengths = sizes[at]
        flat = take_runs(ids, (np.cumsum(sizes) - sizes)[at], lengths)
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        return flat, edges

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, end to end."""
        return take_runs(self.bytes, self.starts[ids], self.lengths[ids])
