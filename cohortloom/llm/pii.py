"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (e-mail, IP address, card and telephone number) are the base and always
stay. The random field looks at runs of neighbouring words that hold digits or an at
sign: a segment of one to ``LONGEST`` of them may be an entity, is scored by features
of the whole span and its neighbours' types, and dynamic programming over all
segmentations chooses boundaries and types together. Words under a base span are
taken, the field decides on the rest. It is trained on what the patterns find in a
bounded sample, with forms that the patterns miss, such as numbers without the plus
sign, made from those.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.slices import by_bytes
from cohortloom.sources.stages import stage

KINDS = ("email", "ip", "card", "phone")
#: Most words of an entity.
LONGEST = 5
#: Bound on the documents with digits or at signs that are fitted.
FITTED = 1500

_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_OUTSIDE = ".,;:!?\"'[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and not overlapping within a kind, by
    start and kind. Every pattern runs in time linear in the text."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, 0, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    if _TRIGGER.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def runs(text: str, taken: list[tuple[int, int, int]] = ()) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words, as (start, end) without outer marks, that hold a digit or an at
    sign and lie outside the taken spans. Words of one run have one space between them."""
    out: list[list[tuple[int, int]]] = []
    held = sorted((s, e) for s, _, e in taken)
    last, k, reach = -2, 0, 0
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        while start > last and start > 0 and not _SPACE.match(text, start - 1):
            start -= 1
        stop = _SPACE.search(text, m.start())
        end = stop.start() if stop else len(text)
        while k < len(held) and held[k][0] < end:
            reach = max(reach, held[k][1])
            k += 1
        a, b = start, end
        while a < b and text[a] in _OUTSIDE:
            a += 1
        while b > a and text[b - 1] in _OUTSIDE:
            b -= 1
        if reach <= start and a < b:
            if out and last == start - 1 and text[last] == " " and out[-1][-1][1] == last:
                out[-1].append((a, b))
            else:
                out.append([(a, b)])
        last = end
        m = _TRIGGER.search(text, end)
    return out


def span_features(span: str, words: int) -> np.ndarray:
    """Binary features of a whole span."""
    short = span[:64]
    digits = _digits(short)
    n, letters = len(digits), any(c.isalpha() for c in short)
    shape = re.sub("[0-9]", "9", short)
    dots = short.split(".")
    return np.array([
        1, words == 1, words == 2, words == 3, words == 4, words >= 5, len(span) > 40,
        "@" in short, bool(re.fullmatch(r"[^@ ]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", short)), letters,
        len(dots) == 4 and all(d.isdigit() and int(d) <= 255 for d in dots), len(dots) == 4 and all(d.isdigit() for d in dots),
        n < 7, 7 <= n <= 8, n == 9, n == 10, 11 <= n <= 12, 13 <= n <= 15, n == 16, n > 16,
        12 <= n <= 19 and luhn(digits), span[0] == "+", span[0] == "(", "(" in short and ")" in short,
        bool(re.fullmatch(r"\+?[\d ().-]+", short)), short.isdigit(),
        bool(re.search(r"(^|\D)\(?9{3}\)?[ .-]9{3}[ .-]9{4}$", shape)),
        bool(re.fullmatch(r"9{4}([ -]9{4}){3}", shape)), any(c in "=/\\#$&*_~|" for c in short), "-" in short,
    ], dtype=np.float64)


N_FEATURES = 30
_TYPES = len(KINDS) + 1  # the last one is outside


class SpanField:
    """Weights of span features for each type and of each pair of neighbouring types."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @staticmethod
    def segments(text: str, run: list[tuple[int, int]]):
        """(first word, word after the last) of all segments and their features."""
        places, rows = [], []
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + LONGEST) + 1):
                places.append((i, j))
                rows.append(span_features(text[run[i][0]:run[j - 1][1]], j - i))
        return places, np.array(rows)

    def best(self, text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities in the likeliest segmentation of a run."""
        places, features = self.segments(text, run)
        scores = features @ self.weights.T
        ahead: dict[int, list] = {}
        for (i, j), row in zip(places, scores):
            ahead.setdefault(j, []).append((i, row))
        n = len(run)
        value = np.full((n + 1, _TYPES), -np.inf)
        value[0, -1] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i, row in ahead[j]:
                for kind in range(_TYPES):
                    if kind == _TYPES - 1 and j - i > 1:
                        continue
                    came = value[i] + self.pairs[:, kind]
                    p = int(came.argmax())
                    total = came[p] + (row[kind] if kind < _TYPES - 1 else 0)
                    if total > value[j, kind]:
                        value[j, kind], back[j, kind] = total, (i, p)
        out, j, kind = [], n, int(value[n].argmax())
        while j > 0:
            i, p = back[j, kind]
            if kind < _TYPES - 1:
                out.append((run[i][0], kind, run[j - 1][1]))
            j, kind = i, p
        return out[::-1]


def _gradient(field: SpanField, places, features, gold, n):
    """Log likelihood of a run's gold segmentation and its gradients, by the forward and backward
    sums over all segmentations."""
    scores = np.concatenate((features @ field.weights.T, np.zeros((len(places), 1))), axis=1)
    scores[[j - i > 1 for i, j in places], -1] = -np.inf
    forward = np.full((n + 1, _TYPES), -np.inf)
    forward[0, -1] = 0
    backward = np.zeros((n + 1, _TYPES))
    backward[:n] = -np.inf
    by_end = sorted(range(len(places)), key=lambda s: places[s][1])
    for s in by_end:
        i, j = places[s]
        come = np.logaddexp.reduce(forward[i][:, None] + field.pairs, axis=0)
        forward[j] = np.logaddexp(forward[j], come + scores[s])
    for s in sorted(range(len(places)), key=lambda s: -places[s][0]):
        i, j = places[s]
        backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(field.pairs + scores[s] + backward[j], axis=1))
    total = np.logaddexp.reduce(forward[n])
    g_weights, g_pairs = np.zeros_like(field.weights), np.zeros_like(field.pairs)
    for s, (i, j) in enumerate(places):
        p = np.exp(forward[i][:, None] + field.pairs + scores[s] + backward[j] - total)
        g_pairs -= p
        g_weights -= np.outer(p.sum(axis=0)[:-1], features[s])
    at, kind, likelihood = 0, _TYPES - 1, -total
    index = {p: s for s, p in enumerate(places)}
    for i, j, k in gold:
        s = index[i, j]
        likelihood += field.pairs[kind, k] + scores[s, k]
        g_pairs[kind, k] += 1
        if k < _TYPES - 1:
            g_weights[k] += features[s]
        at, kind = j, k
    return likelihood, g_weights, g_pairs


def examples(text: str) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """Runs of a text with the segmentation that the patterns give, and forms of numbers that
    the patterns miss: a telephone number without its plus sign, or without its country part."""
    spans, out = base_spans(text), []
    for run in runs(text):
        inside = [s for s in spans if s[0] < run[-1][1] and s[2] > run[0][0]]
        starts, ends = {a: i for i, (a, _) in enumerate(run)}, {b: i + 1 for i, (_, b) in enumerate(run)}
        if len(run) > 24 or any(a not in starts or e not in ends or not 0 < ends[e] - starts[a] <= LONGEST for a, _, e in inside):
            continue
        gold, at = [], 0
        for a, kind, e in inside:
            if starts[a] < at:
                break
            gold += [(i, i + 1, _TYPES - 1) for i in range(at, starts[a])] + [(starts[a], ends[e], kind)]
            at = ends[e]
        else:
            gold += [(i, i + 1, _TYPES - 1) for i in range(at, len(run))]
            out.append((text, run, gold))
        for a, kind, e in inside:
            if kind == 3 and "(" in text[a:e]:
                for form in (text[a + 1:e], text[a + text[a:e].index("("):e]):
                    form_run = runs(form)
                    if len(form_run) == 1 and len(form_run[0]) <= LONGEST:
                        out.append((form, form_run[0], [(0, len(form_run[0]), 3)]))
    return out


def fit(texts: list[str], epochs: int = 12, rate: float = 0.1, ridge: float = 1e-3, most: int = 1500, seed: int = 3) -> SpanField:
    """Stochastic gradient ascent (Adam) on the conditional likelihood of at most ``most`` runs."""
    field = SpanField(np.zeros((len(KINDS), N_FEATURES)), np.zeros((_TYPES, _TYPES)))
    field.weights[:, 0] = -3.0
    made = [e for t in texts for e in examples(t)]
    random = np.random.default_rng(seed)
    made = [made[i] for i in random.permutation(len(made))[:most]]
    data = [(*SpanField.segments(text, run), gold, len(run)) for text, run, gold in made]
    state = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros_like(field.pairs), np.zeros_like(field.pairs)]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(data))
        for a in range(0, len(order), 32):
            gw, gp = np.zeros_like(field.weights), np.zeros_like(field.pairs)
            for i in order[a:a + 32]:
                _, x, y = _gradient(field, *data[i])
                gw += x
                gp += y
            step += 1
            for k, (value, g) in enumerate(((field.weights, gw / 32 - ridge * field.weights), (field.pairs, gp / 32 - ridge * field.pairs))):
                m, s = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return field


def train(docs: DataFrame, fitted: int = FITTED) -> SpanField:
    """Fit on at most ``fitted`` different documents that hold a digit or an at sign, those of lowest
    hash. Only hashes are sorted; the next scan fetches the texts of the chosen ones."""
    hashed = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    chosen = stage(hashed.select("h").distinct().orderBy("h").limit(fitted), "chosen")
    rows = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    return fit([r["text"] for r in rows.orderBy("h").collect()])


def all_spans(text: str, field: SpanField) -> tuple[list, list]:
    """Base spans, and these with what the field adds, by start and kind."""
    base = base_spans(text)
    added = [s for run in runs(text, base) for s in field.best(text, run)]
    return base, sorted(base + added) if added else base


def _told(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base patterns; ``spans`` lists all spans as
    kind:start:end in characters, end exclusive, by start and then kind.

    A NULL or empty text has none. Rows with a NULL or repeated id are handled one by one.
    Other columns are not read; an empty table gives no rows. Where no text holds a
    digit or an at sign, the untrained field adds nothing.
    """
    field = train(docs)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def find(batches):
        for batch in by_bytes(batches, 1):
            found = [all_spans(t or "", field) for t in batch.column(1).to_pylist()]
            counts = np.zeros((len(found), len(KINDS)), dtype=np.int64)
            for row, (base, _) in zip(counts, found):
                for _, kind, _ in base:
                    row[kind] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, k].copy()) for k in range(len(KINDS))],
                 pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([_told(every) for _, every in found], pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(find, schema)


def redact(text: str, field: SpanField) -> str:
    """The text with its spans replaced by their kinds in square brackets; of overlapping spans the
    first one names the whole."""
    out, at = [], 0
    for start, kind, end in all_spans(text, field)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the text redacted and ``n_chars``, where there is one, set to
    its new length. A NULL text stays NULL."""
    field = train(docs)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches):
        for batch in by_bytes(batches, at):
            columns = [batch.column(i) for i in range(batch.num_columns)]
            texts = [None if t is None else redact(t, field) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
