"""Language-model scores by context-tree weighting over bytes.

The model predicts each byte of a text, bit by bit, from the ``DEPTH`` bytes before
it. Every context of every length has, for every prefix of the next byte's bits, a
Krichevsky-Trofimov estimate from the training counts; going from the whole corpus
to longer contexts, each node mixes its own estimate and that of its children by
how well either has coded the training bits, with equal chances at first. A
context not seen in training has no say.

All that follows from the counts of byte strings of length ``DEPTH`` + 1:

1. Documents form chunks of bounded size. A chunk counts its byte strings and
   words, each once, and sends them in blocks by hash bucket.
2. A bucket adds up the counts of all chunks. What is gathered so is a table of all
   distinct strings and words, spread over the buckets; it grows with the corpus.
3. Strings with the same last two context bytes hold whole subtrees of the context
   tree; each such group works out its nodes from the longest contexts up. The nodes
   above them are 256 contexts of one byte and the empty one, tables of fixed size.
4. The finished chances go back to the buckets, and from there to each chunk in the
   order it asked, where documents add up the logarithms of their strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.toxicity import held_out
from cohortloom.llm.wordhash import Words, blocks, mix
from cohortloom.sources.stages import stage

DEPTH = 4
CHUNK_BYTES = 8 << 20
_STOP = 10  # ends a text, and stands before its start
_END = np.int64(0x0E4D_0E4D_0E4D_0E4D)  # the key of the end token among word hashes
_STRING, _WORD = 0, 1


def encode(texts: list[str]):
    """Byte-string codes, how many each text has, word keys, how many each text has.

    A text is its lower-cased words, each with a space after it, and a stop byte. A code holds
    ``DEPTH`` context bytes and the byte that follows them; word keys close with the end token.
    """
    codes, code_counts, keys, key_counts = [], [], [], []
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        counts = np.diff(words.bounds)
        edge = np.concatenate(([0], words.end + 1))[words.bounds]
        size = np.diff(edge)
        at = np.concatenate(([0], np.cumsum(size + DEPTH + 1)))
        laid = np.full(at[-1], _STOP, dtype=np.uint8)
        body = np.repeat(at[:-1] + DEPTH - edge[:-1], size) + np.arange(edge[-1])
        laid[body] = words.compact[:edge[-1]]
        wide = laid.astype(np.int64)
        code = wide[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            code |= wide[DEPTH - k:len(wide) - k] << (8 * k)
        real = np.ones(len(laid), dtype=bool)
        for k in range(DEPTH):
            real[at[:-1] + k] = False
        codes.append(code[real[DEPTH:]])
        code_counts.append(size + 1)
        token = np.full(len(words.start) + b - a, _END, dtype=np.int64)
        token[np.arange(len(words.start)) + np.repeat(np.arange(b - a), counts)] = words.words().view(np.int64)
        keys.append(token)
        key_counts.append(counts + 1)
    if not codes:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(map(np.concatenate, (codes, code_counts, keys, key_counts)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    z = x + 7
    i = 1 / z
    series = i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680 + i**9 / 1188
    return (z - 0.5) * np.log(z) - z + 0.918938533204672742 + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def weigh(keys: np.ndarray, counts: np.ndarray, lengths: range):
    """Nodes of the contexts of the given lengths, from long to short, for distinct strings ``keys``.

    Returns the chance of each bit of each string at the shortest length, -1 where that context is
    not seen, and its nodes: for each bit their first string, counts and weighted log probability.
    """
    chance, before = np.empty((8, len(keys))), None
    for length in lengths:
        mask = (1 << (8 * (length + 1))) - 1
        own_keys, row = np.unique(keys & mask, return_inverse=True)
        n = np.bincount(row, weights=counts, minlength=len(own_keys))
        level = []
        for bit in range(8):
            first = np.flatnonzero(np.diff(own_keys >> (8 - bit), prepend=-1))
            node = np.cumsum(np.diff(own_keys >> (8 - bit), prepend=-1) != 0) - 1
            one = (own_keys >> (7 - bit)) & 1
            ones = np.bincount(node, weights=n * one, minlength=len(first))
            zeros = np.bincount(node, weights=n * (1 - one), minlength=len(first))
            own, mine = log_kt(zeros, ones), node[row]
            taken = np.where((keys >> (7 - bit)) & 1, ones[mine], zeros[mine])
            estimate = (taken + 0.5) / (zeros + ones + 1)[mine]
            if before is None:
                block = own
                chance[bit] = estimate
            else:
                old_keys, old = before[0], before[1][bit]
                parent = node[np.searchsorted(own_keys, old_keys[old[0]] & mask)]
                children = np.bincount(parent, weights=old[3], minlength=len(first))
                block = np.logaddexp(own, children) - np.log(2)
                beta = np.exp(np.clip(own - children, -500, 500))[mine]
                chance[bit] = np.where(chance[bit] < 0, estimate, (beta * estimate + chance[bit]) / (beta + 1))
            chance[bit][(zeros + ones)[mine] == 0] = -1
            level.append((first, zeros, ones, block))
        before = own_keys, level
    return chance, before


class Top:
    """The nodes of contexts of one byte and of none: tables of 256 x 256 and of 256."""

    def __init__(self, rows):
        self.n0, self.n1, self.below = (np.zeros((256, 256)) for _ in range(3))
        for r in rows:
            at = r["latest"], r["code"]
            self.n0[at], self.n1[at], self.below[at] = r["n0"], r["n1"], r["block"]
        own = log_kt(self.n0, self.n1)
        self.beta1 = np.exp(np.clip(own - self.below, -500, 500))
        below = (np.logaddexp(own, self.below) - np.log(2)).sum(axis=0)
        self.m0, self.m1 = self.n0.sum(axis=0), self.n1.sum(axis=0)
        self.beta0 = np.exp(np.clip(log_kt(self.m0, self.m1) - below, -500, 500))

    def finish(self, keys: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of each string's chance, over all context lengths."""
        latest, total = (keys >> 8) & 255, np.zeros(len(keys))
        for bit in range(8):
            code = ((keys & 255) >> (8 - bit)) | (1 << bit)
            one = (keys >> (7 - bit)) & 1
            n0, n1 = self.n0[latest, code], self.n1[latest, code]
            p = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            beta = self.beta1[latest, code]
            p = np.where(chance[bit] < 0, p, (beta * p + chance[bit]) / (beta + 1))
            q = (np.where(one, self.m1[code], self.m0[code]) + 0.5) / (self.m0[code] + self.m1[code] + 1)
            total += np.log10(np.where(n0 + n1 == 0, q, (self.beta0[code] * q + p) / (self.beta0[code] + 1)))
        return total


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, positions) of sorted keys; positions keep their order."""
    bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _texts(table: pa.Table) -> list[str]:
    return [t or "" for t in table.column("text").to_pylist()]


def score_documents(docs: DataFrame, folds: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte.

    Documents whose crc32(doc_id as text) is divisible by ``folds`` are held out of all counts.
    ``base_score`` is the sum over tokens (words, then one end) of log10((c + 0.1) / (N + 0.1 * (V + 1)));
    ``score`` the context-tree model's log10 probability of the text as words with one space
    after each and a closing byte, ``n_bytes`` its length in those bytes.

    A NULL or empty text is the end alone. A row with a NULL id is never held out. Repeated
    rows count and are scored one by one. Other columns are not read. Where nothing is
    trained on, every bit has the chance one half. An empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(size // chunk_bytes) + 1
    texts = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"), "text")

    def count(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        codes, n_codes, keys, n_keys = encode(_texts(table))
        held = table.column("held_out").to_numpy()
        rows = []
        for kind, every, n in ((_STRING, codes, n_codes), (_WORD, keys, n_keys)):
            out = np.repeat(held, n)
            trained, times = np.unique(every[~out], return_counts=True)
            known = np.union1d(trained, every[out]) if out.any() else trained
            counts = np.zeros(len(known), dtype=np.int64)
            counts[np.searchsorted(known, trained)] = times
            for bucket, at in _by_bucket(known, chunks):
                rows.append((kind, bucket, chunk, _blob(known[at]), _blob(counts[at])))
        return pa.table(dict(zip(("kind", "bucket", "chunk", "keys", "counts"), zip(*rows))), schema=pa.schema([
            ("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    asked = stage(texts.groupBy("chunk").applyInArrow(
        count, "kind int, bucket long, chunk long, keys binary, counts binary"), "asked")

    def add_up(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        return pa.table({"kind": table.column("kind")[:1], "bucket": table.column("bucket")[:1],
                         "keys": pa.array([_blob(keys)]), "counts": pa.array([_blob(counts)]),
                         "total": pa.array([int(counts.sum())]), "seen": pa.array([int((counts > 0).sum())])})

    tables = stage(asked.groupBy("kind", "bucket").applyInArrow(
        add_up, "kind int, bucket long, keys binary, counts binary, total long, seen long"), "tables")
    sums = tables.where(F.col("kind") == _WORD).agg(F.sum("total"), F.sum("seen")).first()
    tokens, distinct = (int(x or 0) for x in sums)

    def by_context(batches):
        """Strings by their last two context bytes."""
        for batch in batches:
            for blob, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(blob, dtype=np.int64), np.frombuffer(numbers, dtype=np.int64)
                pair = (keys >> 8) & 0xFFFF
                order = np.argsort(pair, kind="stable")
                cuts = np.flatnonzero(np.diff(pair[order], prepend=-1))
                ends = np.append(cuts[1:], len(order))
                yield pa.RecordBatch.from_arrays([
                    pa.array(pair[order[cuts]].astype(np.int32)),
                    pa.array([_blob(keys[order[a:b]]) for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([_blob(counts[order[a:b]]) for a, b in zip(cuts, ends)], pa.binary())],
                    names=["pair", "keys", "counts"])

    def grow(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        chance, (own, level) = weigh(keys, counts, range(DEPTH, 1, -1))
        nodes = np.concatenate([np.stack([((own[first] & 255) >> (8 - bit)) | (1 << bit), n0, n1, block], axis=1)
                                for bit, (first, n0, n1, block) in enumerate(level)])
        return pa.table({"pair": table.column("pair")[:1], "keys": pa.array([_blob(keys)]),
                         "chance": pa.array([_blob(chance)]), "nodes": pa.array([_blob(nodes)])})

    tree = stage(
        tables.where(F.col("kind") == _STRING).select("keys", "counts")
        .mapInArrow(by_context, "pair int, keys binary, counts binary")
        .groupBy("pair").applyInArrow(grow, "pair int, keys binary, chance binary, nodes binary"), "tree")

    def upper(batches):
        for batch in batches:
            for pair, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = np.frombuffer(blob).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nodes), pair & 255, dtype=np.int32)), pa.array(nodes[:, 0].astype(np.int32)),
                     *[pa.array(np.ascontiguousarray(nodes[:, k])) for k in (1, 2, 3)]],
                    names=["latest", "code", "n0", "n1", "block"])

    # One row for each of 256 contexts and 255 bit prefixes at most, whatever the corpus.
    top = Top(tree.select("pair", "nodes").mapInArrow(
        upper, "latest int, code int, n0 double, n1 double, block double").groupBy("latest", "code").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("block").alias("block")).collect())

    def finish(batches):
        """Each string's log10 chance, back to the buckets."""
        for batch in batches:
            for blob, chances in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(blob, dtype=np.int64)
                value = top.finish(keys, np.frombuffer(chances).reshape(8, -1))
                rows = [(_STRING, bucket, _blob(keys[at]), _blob(value[at])) for bucket, at in _by_bucket(keys, chunks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                    names=["kind", "bucket", "keys", "values"])

    answers = tree.select("keys", "chance").mapInArrow(
        finish, "kind int, bucket long, keys binary, values binary").unionByName(
        tables.where(F.col("kind") == _WORD).select("kind", "bucket", "keys", F.col("counts").alias("values")))

    def answer(key, questions: pa.Table, known: pa.Table) -> pa.Table:
        """What each chunk asked of this bucket, in the order of its keys."""
        kind = key[0].as_py()
        dtype = np.float64 if kind == _STRING else np.int64
        keys = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in known.column("keys").to_pylist()])
        values = np.concatenate([np.frombuffer(v, dtype=dtype) for v in known.column("values").to_pylist()])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        blobs = questions.column("keys").to_pylist()
        out = [_blob(values[np.searchsorted(keys, np.frombuffer(b, dtype=np.int64))]) for b in blobs]
        return pa.table({"chunk": questions.column("chunk"), "kind": questions.column("kind"),
                         "keys": questions.column("keys"), "values": pa.array(out, pa.binary())})

    answered = asked.select("kind", "bucket", "chunk", "keys").groupBy("kind", "bucket").cogroup(
        answers.groupBy("kind", "bucket")).applyInArrow(answer, "chunk long, kind int, keys binary, values binary")

    result = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType())])

    def score(key, table: pa.Table, found: pa.Table) -> pa.Table:
        codes, n_codes, keys, n_keys = encode(_texts(table))
        lookup = {}
        for kind, dtype in ((_STRING, np.float64), (_WORD, np.int64)):
            mine = found.filter(pa.array(found.column("kind").to_numpy() == kind))
            known = np.concatenate([np.frombuffer(k, dtype=np.int64) for k in mine.column("keys").to_pylist()])
            values = np.concatenate([np.frombuffer(v, dtype=dtype) for v in mine.column("values").to_pylist()])
            order = np.argsort(known)
            lookup[kind] = known[order], values[order]

        def sums(values, n):
            return np.bincount(np.repeat(np.arange(len(n)), n), weights=values, minlength=len(n))

        known, values = lookup[_STRING]
        total = sums(values[np.searchsorted(known, codes)], n_codes)
        known, values = lookup[_WORD]
        seen = values[np.searchsorted(known, keys)]
        base = sums(np.log10((seen + 0.1) / (tokens + 0.1 * (distinct + 1))), n_keys)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n_keys),
            "n_known": pa.array(sums(seen > 0, n_keys).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n_keys), tokens)), "base_score": pa.array(base), "score": pa.array(total),
            "n_bytes": pa.array(n_codes), "bits_per_byte": pa.array(-total / np.log10(2) / n_codes)})

    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score, result)
