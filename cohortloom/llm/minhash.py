"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingle hashes gives two signature values, the minimum and
the maximum, so 160 permutations fill 40 bands of 8 values. Two sets at the link
threshold of 0.85 agree in a band with probability 0.85^8 = 0.27 and miss all
bands with probability 3e-6; at 0.9 it is 1e-10.

Documents with equal shingle sets become one node first. Band buckets hold nodes,
and only which nodes are connected matters, so the pairs of a bucket are not
listed: nodes are first compared with one centre per bucket (two star rounds) and
linked nodes are contracted to components. The links that buckets across
components still hide are found from the differences to a hub c, the node with the
most links in the component that is most frequent in a bucket. With D(u) the
shingles that are in u or in c, but not in both, two sets u and v differ in
|D(u)| + |D(v)| - 2 |D(u) and D(v)| shingles, whatever c is. So a link needs a known
number of shingles in both differences, the larger the further both are from c, and
must share one in the first of them in a common order: first what c lacks, which
copies edited apart from each other don't share, then what c has. Only nodes that
share such a shingle are compared.
Every link is confirmed on the full sets, and no candidate of a band is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.graph import components
from cohortloom.llm.slices import by_bytes
from cohortloom.llm.wordhash import mix, shingle_sets
from cohortloom.sources.stages import stage

BANDS = 40
ROWS = 8
_PERMUTATIONS = BANDS * ROWS // 2
_random = np.random.default_rng(1997)
_FACTORS = _random.integers(0, 2**31, _PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 2**32, _PERMUTATIONS, dtype=np.uint32)
_WEIGHTS = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under every permutation: (BANDS, ROWS) values."""
    low = np.full(_PERMUTATIONS, 2**32 - 1, dtype=np.uint32)
    high = np.zeros(_PERMUTATIONS, dtype=np.uint32)
    values = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for at in range(0, len(values), _CHUNK):
        permuted = values[None, at:at + _CHUNK] * _FACTORS[:, None] + _OFFSETS[:, None]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.stack((low, high), axis=1).reshape(BANDS, ROWS)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands never share keys but by chance."""
    salted = signatures.astype(np.uint64) * _WEIGHTS + np.arange(BANDS, dtype=np.uint64)[:, None]
    return mix(mix(salted).sum(axis=-1, dtype=np.uint64)).view(np.int64)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit keys of each set, the same for equal sets."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    for i, s in enumerate(sets):
        out[i] = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)
    return out.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.ravel()))


def _sign(batches, size: int):
    for batch in by_bytes(batches, 1):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sets = shingle_sets(texts, size)
        signatures = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, BANDS, ROWS), dtype=np.uint32)
        keys = set_keys(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
             _lists(band_keys(signatures))],
            names=["id", "n", "s1", "s2", "bands"])


def _confirm(batches, size: int, percent: int):
    """Pairs whose full sets reach the threshold. A text that isn't the one its node stands for is passed over."""
    # Texts of a pair are of like length: one side's bytes measure both.
    for batch in by_bytes(batches, 3):
        a, b = batch.column("a"), batch.column("b")
        left = shingle_sets(batch.column("a_text").to_pylist(), size)
        right = shingle_sets(batch.column("b_text").to_pylist(), size)
        keys_a, keys_b = set_keys(left), set_keys(right)
        own = (keys_a[:, 0] == batch.column("a_key").to_numpy()) & (keys_b[:, 0] == batch.column("b_key").to_numpy())
        linked = []
        for i in np.flatnonzero(own):
            x, y = left[i], right[i]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                linked.append(i)
        at = pa.array(linked, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])


def _differ(batches, size: int, percent: int):
    """Nodes a against the hub b of their bucket: whether they are linked, how many shingles differ, and the
    first of these that a link with any partner can be found by.

    ``x`` is (100 + percent) * |D(a)| - (100 - percent) * |a|: two nodes are linked where twice
    (100 + percent) * |D(a) and D(v)| reaches the sum of their x. ``low`` is the least x that a linked
    partner can have by its size and by the number of its differences.
    """
    for batch in by_bytes(batches, 5):
        left = shingle_sets(batch.column("a_text").to_pylist(), size)
        texts = batch.column("b_text").dictionary_encode()
        hubs = shingle_sets(texts.dictionary.to_pylist(), size)
        right = texts.indices.to_numpy()
        own = (set_keys(left)[:, 0] == batch.column("a_key").to_numpy()) & (
            set_keys(hubs)[right, 0] == batch.column("b_key").to_numpy())
        at = np.flatnonzero(own)
        linked, differ, xs, lows, first = [], [], [], [], []
        for i in at:
            u, c = left[i], hubs[right[i]]
            only_u = np.setdiff1d(u, c, assume_unique=True)
            only_c = np.setdiff1d(c, u, assume_unique=True)
            d = len(only_u) + len(only_c)
            x = (100 + percent) * d - (100 - percent) * len(u)
            largest = 100 * len(u) // percent
            low = max(x - 2 * (100 - percent) * largest, -(100 - percent) * largest)
            need = max(1, -(-(x + low) // (2 * (100 + percent))))
            linked.append((100 + percent) * d <= (100 - percent) * (len(u) + len(c)))
            differ.append(d)
            xs.append(x)
            lows.append(low)
            first.append(np.concatenate((only_u, only_c))[:max(0, d - need + 1)].view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in first]))).astype(np.int32)
        values = np.concatenate([np.zeros(0, dtype=np.int64), *first])
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(rows) for c in ("a", "b", "component", "home", "n")], pa.array(linked, pa.bool_()),
             pa.array(differ, pa.int64()), pa.array(xs, pa.int64()), pa.array(lows, pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
            names=["a", "b", "component", "home", "n", "linked", "differ", "x", "low", "first"])


def near_duplicates(
    docs: DataFrame, percent: int = 85, shingle_words: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The near-duplicate group of each document: id, n_shingles, component_id, kept.

    Documents are linked where 100 * common >= ``percent`` * united over their sets of
    distinct shingles; ``component_id`` is the smallest id reachable by links, itself
    included, and ``kept`` marks the document that has it. ``percent`` must be 85 or
    more, for which the bands are laid out.

    NULL and empty texts, or texts without words, have an empty set and no link. A row with
    a NULL id isn't linked: its component is NULL and it is kept. Rows that share an id
    count as one document and are linked with each other. Other columns are not read;
    an empty table gives no rows.
    """
    if not 85 <= percent <= 100:
        raise ValueError("the bands are laid out for thresholds from 85 to 100 percent")
    id_type = docs.schema[id_column].dataType
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    signed = stage(texts.mapInArrow(
        lambda batches: _sign(batches, shingle_words),
        T.StructType([
            T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])), "signed")
    present = signed.where("id is not null and n > 0")
    # Equal sets: one node, named by the smallest id; a large group of copies combines before the shuffle.
    nodes = stage(present.groupBy("n", "s1", "s2").agg(
        F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    spread = nodes.select(F.explode("bands").alias("key"), "node")

    def with_texts(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) with the key of the first half of each node's set and its text."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = ids.join(nodes.select("node", "s1"), "node").join(texts, F.col("node") == F.col("id"))
        held = held.select("node", F.col("s1").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        x = held.select(F.col("node").alias("a"), F.col("key").alias("a_key"), F.col("text").alias("a_text"))
        y = held.select(F.col("node").alias("b"), F.col("key").alias("b_key"), F.col("text").alias("b_text"))
        return pairs.join(x, "a").join(y, "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b), each pair once."""
        return with_texts(pairs).select("a", "b", "a_key", "a_text", "b_key", "b_text").mapInArrow(
            lambda batches: _confirm(batches, shingle_words, percent),
            T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)]))

    def labelled(links: DataFrame) -> DataFrame:
        """Nodes with their component so far."""
        found = components(links)
        return nodes.select("node").join(found, "node", "left").select(
            "node", F.coalesce("component", "node").alias("component"))

    # One id with several sets is one document.
    several = present.join(nodes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"]).groupBy("id").agg(
        F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    again = present.join(several, "id").join(nodes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"])
    links = stage(again.select("a", F.col("node").alias("b")).where("a < b").distinct(), "same-id")

    # Star rounds: the first with the smallest node of each bucket, the second with the largest of those left over.
    buckets = spread.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where(
        "members > 1").select("key", "centre")
    for turn in range(2):
        near = spread.join(buckets, "key").where("node != centre").groupBy("node", "centre").agg(
            F.count(F.lit(1)).alias("bands"))
        best = near.groupBy("node").agg(
            F.max(F.struct("bands", F.col("centre"))).alias("p1"),
            F.min(F.struct("centre", "bands")).alias("p2")).select(
            F.explode(F.array_distinct(F.array("p1.centre", "p2.centre"))).alias("x"), "node")
        pairs = best.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        links = stage(links.unionByName(confirmed(pairs)), "confirmed")
        state = stage(labelled(links), "labels")
        apart = spread.join(state, "node").groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.max("node").alias("centre")).where("low < high").select("key", "centre")
        buckets = stage(apart, "buckets")

    # What is left: buckets across components, by the differences of their nodes to a hub.
    active = stage(spread.join(buckets.select("key"), "key").join(state, "node"), "active")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("links"))
    hubs = state.join(degrees, "node", "left").groupBy("component").agg(
        F.min(F.struct((-F.coalesce("links", F.lit(0))).alias("order"), "node")).alias("hub")).select(
        F.col("component").alias("home"), F.col("hub.node").alias("b"))
    most = active.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members")).groupBy("key").agg(
        F.max(F.struct("members", "component")).alias("most")).select("key", F.col("most.component").alias("home"))
    pairs = active.join(most.join(hubs, "home"), "key").where("node != b").select(
        F.col("node").alias("a"), "b", "component", "home").distinct()
    sized = pairs.join(nodes.select(F.col("node").alias("a"), "n"), "a")
    compared = stage(
        with_texts(stage(sized, "pairs")).select(
            "a", "b", "component", "home", "n", "a_text", "a_key", "b_key", "b_text").mapInArrow(
            lambda batches: _differ(batches, shingle_words, percent),
            T.StructType([
                T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("component", id_type),
                T.StructField("home", id_type), T.StructField("n", T.LongType()), T.StructField("linked", T.BooleanType()),
                T.StructField("differ", T.LongType()), T.StructField("x", T.LongType()),
                T.StructField("low", T.LongType()), T.StructField("first", T.ArrayType(T.LongType()))])), "compared")
    # Nodes inside are in the hub's component by now; only pairs with a node outside are open.
    inside = F.col("linked") | (F.col("component") == F.col("home"))
    bounds = compared.groupBy("b").agg(
        F.min(F.when(inside, F.struct("x", "a"))).alias("nearest"),
        F.min(F.when(~inside, F.col("x"))).alias("low_out")).where("low_out is not null").select(
        "b", F.col("nearest.a").alias("nearest"), F.col("nearest.x").alias("low_in"), "low_out")
    placed = compared.join(bounds, "b").withColumn("inside", inside)

    def filed(rows: DataFrame, low: str, side: str) -> DataFrame:
        """Nodes under the shingles that a link with a partner whose x is ``low`` or more can be found by."""
        need = F.greatest(F.lit(1), F.ceil((F.col("x") + F.greatest("low", low)) / (2 * (100 + percent))))
        length = F.greatest(F.lit(0), F.col("differ") - need + 1).cast("int")
        return rows.select(
            "b", F.explode(F.slice("first", F.lit(1), length)).alias("shingle"), F.col("a").alias(f"{side}_node"),
            F.col("component").alias(f"{side}_component"), F.col("n").alias(f"{side}_n"))

    alike = 100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n")
    outside = placed.where("not inside")
    both_out = filed(outside, "low_out", "u").join(filed(outside, "low_out", "v"), ["b", "shingle"]).where(
        (F.col("u_node") < F.col("v_node")) & (F.col("u_component") != F.col("v_component")) & alike)
    one_out = filed(placed.where("inside"), "low_out", "u").join(
        filed(outside.where("low_in is not null"), "low_in", "v"), ["b", "shingle"]).where(alike)
    # So near to the hub, both, that they are linked whatever their differences share.
    sure = outside.where("x + low_in <= 0").select(F.col("a").alias("u_node"), F.col("nearest").alias("v_node"))
    rest = both_out.select("u_node", "v_node").unionByName(one_out.select("u_node", "v_node")).unionByName(sure)
    candidates = stage(rest.select(
        F.least("u_node", "v_node").alias("a"), F.greatest("u_node", "v_node").alias("b")).distinct(), "rest")
    links = links.unionByName(compared.where("linked").select("a", "b")).unionByName(confirmed(candidates))
    links = stage(links, "confirmed")
    final = labelled(links)

    classes = nodes.select("n", "s1", "s2", "node").join(final, "node").select("n", "s1", "s2", "component")
    keyed = signed.select("id", "n", "s1", "s2")
    linked = keyed.join(classes, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return linked.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
