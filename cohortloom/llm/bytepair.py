"""Byte-level BPE ids for whole texts, encoding each distinct word of a batch once.

Cutting a text before each single space that stands between two other characters
is always a boundary of the tokenizer's own first split, so such pieces can be
encoded apart and their ids laid end to end. Arrow splits the texts and numbers
their distinct pieces; those are encoded as one text, by the same vocabulary in its
form as ranks, which gives the same ids where the merges are listed in the order of
their ids. Texts with two white-space characters in a row are encoded whole, and
all are where the vocabulary has no such order. The library's own splitter needs a
stack as deep as a run of white space is long; the first split makes one word of a
long run but for its last character (of the whole run at the end of a text), so such
runs are cut out first and merged as the one word they are.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded together: enough for words to repeat, and about a hundred MB at most.
BATCH_BYTES = 4 << 20
_ADJACENT = re.compile(r"\s\s")
#: Fixed value: the first split of the byte-level vocabulary.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space as that split knows it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{_SPACE}]{{1024,}}")
_ENCODERS: dict[str, "BytePairEncoder"] = {}


def encoder(path: str) -> "BytePairEncoder":
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from U+0100 on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, or None if its ids aren't in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, letters = model["vocab"], byte_alphabet()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    basic = {token: i for token, i in vocabulary.items() if i < 256 + len(merged)}
    return {bytes(letters[c] for c in token): i for token, i in basic.items()}


class BytePairEncoder:
    """Special-token strings inside a text are ordinary text; none are added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_rank = None
        if found := ranks(path):
            import tiktoken

            self.by_rank = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=found, special_tokens={})
            self.lengths = np.zeros(max(found.values()) + 1, dtype=np.int64)
            for token, i in found.items():
                self.lengths[i] = len(token)

    def _whole(self, text: str) -> np.ndarray:
        if not self.by_rank:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self.by_rank.encode_ordinary(text[at:run.start()]),
                      self.by_rank._encode_single_piece(text[run.start():end].encode())]
            at = end
        parts.append(self.by_rank.encode_ordinary(text[at:]))
        return np.concatenate([np.array(p, dtype=np.uint32) for p in parts])

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with one space in front, end to end; how many each has."""
        full = np.flatnonzero(pc.binary_length(words).to_numpy())
        ids = np.zeros(0, dtype=np.uint32)
        if len(full):
            listed = pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), words.take(pa.array(full)))
            ids = self._whole(" " + pc.binary_join(listed, " ")[0].as_py())
        word_ends = np.cumsum(pc.binary_length(words).to_numpy()[full] + 1)
        counts = np.zeros(len(words), dtype=np.int64)
        counts[full] = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), word_ends) + 1, prepend=0)
        if len(full) < len(words):  # the empty word after a space that ends a text
            at = int(np.flatnonzero(np.diff(np.append(full, len(words)), prepend=-1) > 1)[0])
            at = full[at - 1] + 1 if at else 0
            space = self._whole(" ")
            counts[at] = len(space)
            before = int(counts[:at].sum())
            ids = np.concatenate((ids[:before], space, ids[before:]))
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        simple = [i for i, t in enumerate(texts) if self.by_rank and not _ADJACENT.search(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        if simple:
            split = pc.split_pattern(pa.array([texts[i] for i in simple], pa.string()), " ")
            bounds = split.offsets.to_numpy()
            numbered = split.values.dictionary_encode()
            word_ids, counts = self._spaced(numbered.dictionary)
            firsts = [self._whole(t) for t in split.values.take(pa.array(bounds[:-1])).to_pylist()]
            ids = np.concatenate([word_ids, *firsts])
            counts = np.concatenate((counts, np.fromiter(map(len, firsts), dtype=np.int64, count=len(firsts))))
            starts = np.cumsum(counts) - counts
            at = numbered.indices.to_numpy().astype(np.int64)
            at[bounds[:-1]] = len(numbered.dictionary) + np.arange(len(firsts))
            lengths = counts[at]
            ends = np.cumsum(lengths)
            flat = ids[np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
            edges = np.concatenate(([0], ends))[bounds]
            for k, i in enumerate(simple):
                out[i] = flat[edges[k]:edges[k + 1]]
        return [self._whole(t) if x is None else x for t, x in zip(texts, out)]
