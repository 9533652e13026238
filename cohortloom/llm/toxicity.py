"""Toxicity scores from a non-negative positive-unlabelled classifier.

Only confirmed toxic documents are taken as labelled; everything else is
unlabelled and may be toxic. With the class prior p, the risk of a scorer g under
the logistic loss l is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

where the second term, the risk on negatives, can't be below zero: where a batch
drives it there, the step goes the other way (non-negative estimator). The features
are hashed words, so one weight vector of fixed size scores every document in the
task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.slices import by_bytes
from cohortloom.llm.wordhash import Words, blocks, mix
from cohortloom.sources.stages import stage

BUCKETS = 1 << 17
_MARKS = np.frombuffer(b".,;:!?", dtype=np.uint8)
#: Bound on the rows fitted: this many confirmed toxic ones and this many of all.
POSITIVES = 3000
UNLABELLED = 9000


def word_features(texts: list[str]) -> list[np.ndarray]:
    """Per text: the distinct buckets of its words without trailing marks, and of the first four
    and the first five bytes of each of them."""
    out = []
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        end = words.end.copy()
        for _ in range(2):
            last = words.compact[np.maximum(end - 1, 0)]
            end = end - (np.isin(last, _MARKS) & (end - 1 > words.start))
        ends = [end, np.minimum(end, words.start + 4), np.minimum(end, words.start + 5)]
        bucket = np.stack([
            (mix(words.between(words.start, e) + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int64)
            for k, e in enumerate(ends)])
        for i in range(b - a):
            out.append(np.unique(bucket[:, words.bounds[i]:words.bounds[i + 1]]))
    return out


class Scorer:
    """Sum of the weights of a text's features plus a bias, through the logistic function."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, texts: list[str]) -> np.ndarray:
        logits = np.array([self.weights[i].sum() for i in word_features(texts)], dtype=np.float64) + self.bias
        return _logistic(logits)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, rate: float = 0.1,
        sparsity: float = 1e-5, seed: int = 7) -> Scorer:
    """Adam on the non-negative risk over shuffled batches of both samples, given by their features.

    Weights stay at or above zero and shrink by ``sparsity`` (an L1 penalty), so chance features
    of long texts don't add up."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        # Nothing to learn from: everyone gets the prior.
        return Scorer(np.zeros(BUCKETS), bias)
    random = np.random.default_rng(seed)
    data = [positive, unlabelled]
    w = np.zeros(BUCKETS + 1)
    w[BUCKETS] = bias
    m, s, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0
    batches = max(1, len(unlabelled) // 512)

    def gather(rows, chosen):
        return np.concatenate([rows[i] for i in chosen]), np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])

    for epoch in range(epochs):
        pos, unl = random.permutation(len(positive)), random.permutation(len(unlabelled))
        pace = rate * (1 - epoch / epochs)
        for k in range(batches):
            a, b = np.array_split(pos, batches)[k], np.array_split(unl, batches)[k]
            a = a if len(a) else pos[:1]
            (pi, pr), (ui, ur) = gather(data[0], a), gather(data[1], b)
            gp = np.bincount(pr, weights=w[pi], minlength=len(a)) + w[BUCKETS]
            gu = np.bincount(ur, weights=w[ui], minlength=len(b)) + w[BUCKETS]
            sp, su = _logistic(gp), _logistic(gu)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp, du = np.full(len(a), -prior / len(a)), su / len(b)
            else:
                # Climb back out of the negative part instead of fitting it further.
                dp, du = prior * sp / len(a), -su / len(b)
            gradient = np.bincount(pi, weights=dp[pr], minlength=BUCKETS + 1)
            gradient += np.bincount(ui, weights=du[ur], minlength=BUCKETS + 1)
            gradient[BUCKETS] = dp.sum() + du.sum()
            step += 1
            m = 0.9 * m + 0.1 * gradient
            s = 0.999 * s + 0.001 * gradient**2
            scale = pace / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            w -= scale * (m / (1 - 0.9**step))
            w[:BUCKETS] = np.maximum(w[:BUCKETS] - scale[:BUCKETS] * sparsity, 0)
    # The clipped risk leaves scores too low. Fix the scale by what a typical toxic text shows, and
    # the bias by the prior: over all texts the scores average to it. No evidence stays clean.
    shown = [np.array([w[i].sum() for i in rows]) for rows in data]
    scale = 16 / max(np.median(shown[0]), 1e-6)
    low, high = -40.0, -3.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if _logistic(scale * shown[1] + middle).mean() < prior else (low, middle)
    return Scorer(w[:BUCKETS] * scale, low)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the crc32 of the id as text is divisible by ``folds``. A NULL id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sample(rows: DataFrame, toxic: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """Features of the rows with the lowest hashes: (h, toxic, features).

    Only hashes are sorted and joined. The chosen ones, at most ``positives + unlabelled``,
    fetch their texts in the next scan, where the texts become features."""
    hashed = F.xxhash64("text", "id").alias("h")
    keyed = rows.select("id", hashed)
    chosen = stage(
        keyed.join(toxic, "id", "left_semi").orderBy("h").limit(positives).select("h", F.lit(True).alias("toxic"))
        .unionByName(keyed.orderBy("h").limit(unlabelled).select("h", F.lit(False).alias("toxic"))).distinct(), "chosen")

    def features(batches):
        for batch in by_bytes(batches, 2):
            found = word_features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["h", "toxic", "features"])

    found = rows.select(hashed, "text").join(F.broadcast(chosen), "h").select("h", "toxic", "text").mapInArrow(
        features, "h long, toxic boolean, features array<int>")
    return stage(found.dropDuplicates(["h", "toxic"]), "sample")


def _telling(sample: DataFrame, prior: float, toxic_rows: int, other_rows: int, least: int) -> np.ndarray:
    """Features that alone make a text likelier toxic than not: with the prior,
    ``prior * P(feature | toxic) / P(feature)`` estimates that chance, and its lower bound must
    reach one half over at least ``least`` toxic texts. There are at most BUCKETS of them."""
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("u"))
    sure = (F.col("t") - F.sqrt("t")) / toxic_rows
    chosen = counts.where((F.col("t") >= least) & (prior * sure >= 0.5 * F.col("u") / other_rows))
    out = np.zeros(BUCKETS, dtype=bool)
    out[[r["f"] for r in chosen.select("f").collect()]] = True
    return out


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
    least: int = 5,
) -> Scorer:
    """Fit on documents outside the held-out fold. At most ``positives`` confirmed toxic rows and
    ``unlabelled`` rows of the whole fold, toxic ones among them, are fitted; the class prior is the toxic share of all
    labelled rows of the same fold. Only telling features of the sample reach the driver."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(~held_out(F.col("id"), folds))
    share = own.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = 0.5 if share is None else float(share)
    sample = _sample(rows, own.where("toxic = 1").select("id"), positives, unlabelled)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return fit([], [], prior)
    telling = _telling(sample, prior, sizes[True], sizes[False], least)

    def narrow(batches):
        for batch in batches:
            lists = [np.asarray(f, dtype=np.int32) for f in batch.column(2).to_pylist()]
            kept = pa.array([f[telling[f]] for f in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["h", "toxic", "features"])

    both = {True: [], False: []}
    for r in sample.mapInArrow(narrow, sample.schema).orderBy("h").collect():
        both[r["toxic"]].append(np.array(r["features"], dtype=np.int64))
    return fit(both[True], both[False], prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted.

    A NULL or empty text has no words and gets the score of the bias alone. Rows with a
    NULL or repeated id are scored one by one; a NULL id is never trained on as labelled
    and isn't held out. Labels that are NULL or whose id is NULL are passed over, repeated
    ones count as toxic if any says so. Without labels every score is 0.5. Other columns
    are not read; an empty table gives no rows.
    """
    scorer = train(docs, labels, folds)
    weights, bias = scorer.weights.astype(np.float32), scorer.bias
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        mine = Scorer(weights, bias)
        for batch in by_bytes(batches, 2):
            scores = mine([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=schema.names)

    return docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text").mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``threshold``."""
    scorer = train(docs, labels, folds)
    weights, bias = scorer.weights.astype(np.float32), scorer.bias
    at = docs.columns.index("text")

    def keep(batches):
        mine = Scorer(weights, bias)
        for batch in by_bytes(batches, at):
            scores = mine([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
