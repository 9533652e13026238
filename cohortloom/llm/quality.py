"""Document quality by hierarchical empirical Bayes.

A logistic classifier on the shape of a text gives evidence for one document. The
share of good documents of a site, and of a path within it, says what to expect
before reading. Both shares come from one grouped aggregation of the classifier's
chances; a site is shrunk towards the global share and a path towards its site, the
more the fewer documents it has, with the strength of either prior estimated from
the spread between groups. The posterior odds of a document are its classifier odds
times the odds of its path, as the other documents there give them, over the global odds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.slices import by_bytes
from cohortloom.llm.toxicity import held_out
from cohortloom.llm.wordhash import Words, blocks
from cohortloom.sources.stages import stage

#: Bound on the labelled rows fitted, for each label.
FITTED = 4000
#: Numbers of a shape.
SHAPE = 12
_MARKS = np.zeros(256, dtype=bool)
_MARKS[np.frombuffer(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", dtype=np.uint8)] = True


def shape(texts: list[str]) -> np.ndarray:
    """Per text: length, capital, digit, mark and line-feed shares, words that are marks or end in
    them, mean word length, distinct words and the most frequent word's share."""
    out = np.zeros((len(texts), SHAPE))
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        hashes = words.words()
        size = words.end - words.start
        last = _MARKS[words.compact[words.end - 1]]
        marks = np.concatenate(([0], np.cumsum(_MARKS[words.compact])))
        alone = marks[words.end] - marks[words.start] == size
        for i in range(a, b):
            raw = np.frombuffer(texts[i].encode(), dtype=np.uint8)
            at = slice(words.bounds[i - a], words.bounds[i - a + 1])
            n = at.stop - at.start
            if not n:
                continue
            counts = np.unique(hashes[at], return_counts=True)[1]
            letters = max(1, int(((raw | 32) >= 97).sum() - (raw >= 128).sum()))
            out[i] = (1, np.log1p(n), ((raw >= 65) & (raw <= 90)).sum() / letters, ((raw >= 48) & (raw <= 57)).mean(),
                      _MARKS[raw].mean(), (raw == 10).mean(), last[at].mean(), alone[at].mean(),
                      np.log(size[at].mean()), len(counts) / n, counts.max() / n, np.log1p(counts.max()))
    return out


class Grader:
    """Logistic regression on standardised shapes and their squares."""

    def __init__(self, mean, spread, weights):
        self.mean, self.spread, self.weights = mean, spread, weights

    def __call__(self, texts: list[str]) -> np.ndarray:
        return _design(shape(texts), self.mean, self.spread) @ self.weights


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8, 8)
    return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)


def fit(good: np.ndarray, bad: np.ndarray, share: float, ridge: float = 1.0) -> Grader:
    """Newton's method on the penalised likelihood of shapes, the two samples weighed to ``share`` good ones."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(good) or not len(bad):
        return Grader(np.zeros(SHAPE), np.ones(SHAPE), np.append(np.log(share / (1 - share)), np.zeros(2 * SHAPE)))
    x = np.concatenate((good, bad))
    y = np.append(np.ones(len(good)), np.zeros(len(bad)))
    weight = np.where(y == 1, share * len(y) / len(good), (1 - share) * len(y) / len(bad))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = _design(x, mean, spread)
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty * w
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w += move * min(1, 5 / max(1e-9, np.abs(move).max()))
    return Grader(mean, spread, w)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fitted: int = FITTED) -> Grader:
    """Fit on the shapes of at most ``fitted`` labelled documents of each label outside the held-out fold.

    The ids with the lowest hashes are chosen; their texts become SHAPE numbers in the tasks that read
    them, and of rows that share an id the least shape counts."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    share = own.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    ids = docs.select(F.col("doc_id").alias("id"))
    known = own.join(ids, "id", "left_semi").select("id", "quality", F.xxhash64("id").alias("h"))
    chosen = stage(reduce(DataFrame.unionByName, [
        known.where(F.col("quality") == label).orderBy("h", "id").limit(fitted) for label in (0, 1)]), "chosen")

    def shapes(batches):
        for batch in by_bytes(batches, 2):
            found = shape([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["id", "quality", "shape"])

    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen.select("id", "quality")), "id")
    made = rows.select("id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(shapes, T.StructType([
        T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("quality", T.IntegerType()),
        T.StructField("shape", T.ArrayType(T.DoubleType()))]))
    # Numbers come first in an array of a shape, so the least one is well defined.
    least = made.groupBy("id", "quality").agg(F.min("shape").alias("shape")).orderBy("id").collect()
    good, bad = (np.array([r["shape"] for r in least if r["quality"] == label]).reshape(-1, SHAPE) for label in (1, 0))
    return fit(good, bad, 0.5 if share is None else float(share))


def _groups(scored: DataFrame, by: list[str]) -> DataFrame:
    """How many documents a group has and how many good ones are expected in it."""
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("chance").alias("good"))


def _strength(groups: DataFrame) -> float:
    """How many documents the prior counts as: by the method of moments, from the spread of group
    shares around what their prior says (``centre``) beyond what chance gives."""
    share, chance = F.col("good") / F.col("n"), F.col("centre") * (1 - F.col("centre"))
    r = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                   F.sum(F.col("n") * (share - F.col("centre")) ** 2).alias("ss"), F.sum(chance).alias("chances"),
                   F.sum(F.col("n") * chance).alias("weighed")).first()
    if not r["n"] or r["k"] < 2:
        return 1.0
    between = (r["ss"] - r["chances"] * (r["k"] - 1) / r["k"]) / max(r["n"] - r["n2"] / r["n"], 1.0)
    return float(min(max(r["weighed"] / r["n"] / between - 1, 1.0), 10_000.0)) if between > 0 else 10_000.0


def grade_documents(
    docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", folds: int = 5, threshold: float = 0.5
) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, classifier, site_share, path_share, score, keep.

    ``classifier`` is the chance from the text alone, ``site_share`` and ``path_share`` the
    shrunk shares of good documents among the others of its site and path, ``score`` the posterior chance, ``keep`` whether it
    reaches ``threshold``.

    A text that is NULL, empty or without words has a shape of zeros. NULL sites and paths are
    groups of their own. Rows with a NULL or repeated id are graded one by one. Labels that are
    NULL are passed over; repeated ones count as bad if any says so. Without labels the
    classifier says one half for all. Other columns are not read; an empty table gives no rows.
    """
    grader = train(docs, labels, folds)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("site", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("logit", T.DoubleType()), T.StructField("chance", T.DoubleType())])

    def grade(batches):
        for batch in by_bytes(batches, 4):
            logit = np.clip(grader([t or "" for t in batch.column(4).to_pylist()]), -12, 12)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(logit), pa.array(1 / (1 + np.exp(-logit)))],
                names=schema.names)

    scored = stage(docs.select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"),
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
        F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path"), "text").mapInArrow(grade, schema), "graded")
    paths = stage(_groups(scored, ["site", "path"]), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = sites.agg(F.sum("good") / F.sum("n")).first()[0]
    centre = min(max(total if total is not None else 0.5, 1e-6), 1 - 1e-6)
    by_site = _strength(sites.withColumn("centre", F.lit(centre)))

    def shrunk(good, n, strength: float, towards):
        return (good + strength * towards) / (n + strength)

    expected = paths.join(sites.select("site", F.col("n").alias("site_n"), F.col("good").alias("site_good")), "site")
    by_path = _strength(expected.withColumn("centre", shrunk(F.col("site_good"), F.col("site_n"), by_site, F.lit(centre))))
    # A document's own evidence enters its score once: its site and path are what the others there say.
    rest = {c: F.col(c) - (F.col("chance") if c.endswith("good") else 1) for c in ("n", "good", "site_n", "site_good")}
    site_share = shrunk(rest["site_good"], rest["site_n"], by_site, F.lit(centre))
    path_share = shrunk(rest["good"], rest["n"], by_path, site_share)
    # Rounding may leave a sum of chances a hair outside its bounds.
    inside = lambda share: F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
    joined = scored.join(expected, ["site", "path"]).withColumns(
        {"site_share": inside(site_share), "path_share": inside(path_share)})
    odds = F.ln(F.col("path_share") / (1 - F.col("path_share"))) - float(np.log(centre / (1 - centre)))
    score = 1 / (1 + F.exp(-(F.col("logit") + odds)))
    return joined.select(
        "doc_id", "held_out", F.col("chance").alias("classifier"), "site_share", "path_share",
        score.alias("score"), (score >= threshold).alias("keep"))
