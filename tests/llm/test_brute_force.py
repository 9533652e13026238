"""Whole results of corpus queries against plain Python forms, and that every query has such a check."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cohortloom.llm import queries
from cohortloom.llm.attribution import count_section_tokens
from cohortloom.llm.bytepair import encoder
from cohortloom.llm.packing import pack_documents
from cohortloom.llm.pii import find_personal_data
from cohortloom.llm.queries import importable, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.abspath(__file__))
#: Where a query without SQL is held against a plain form, a round trip or held-out labels.
CHECKED = {
    "op1_best_fit_packing": "test_pieces_equal_slices_of_the_ids", "op2_token_counts": "test_line_counts_equal_offsets",
    "op3_hierarchical_quality": "test_a_site_moves_only_with_evidence", "op4_nonnegative_pu_toxicity": "test_toxicity",
    "op5_minmax_near_dedup": "test_near_duplicates", "op7_epsilon_grid_links": "test_vectors",
    "op8_context_tree_scores": "test_context_tree", "op9_semi_markov_pii": "test_base_spans_equal_patterns",
    "op11_distinct_chunk_pieces": "test_pieces_of_all_documents",
    "op12_inverted_pair_alignment": "test_alignment_of_all_documents",
    "op13_secondary_sort_fill_in_middle": "test_fill_in_middle_of_all_documents",
}


def test_every_query_is_checked():
    tests = "".join(open(f"{HERE}/{name}").read() for name in os.listdir(HERE) if name.endswith(".py"))
    for name in queries.QUERIES:
        assert name in queries.ORACLES or f"def {CHECKED[name]}(" in tests


TEXTS = [(1, None), (2, ""), (3, "one line"), (4, "a\n\nb <|endoftext|> c\n"), (None, "x y z"), (4, "again " * 700),
         (5, "blanks" + " " * 3000 + "end"), (6, "\n".join(f"line {i}, é ü" for i in range(300)))]


def docs_of(spark, rows):
    importable(spark)
    return spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, piece int, sequence_id string")


def test_pieces_equal_slices_of_the_ids(spark):
    plain, size = encoder(tokenizer_path()).tokenizer, 64
    want = Counter()
    for i, t in TEXTS:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    rows = pack_documents(docs_of(spark, TEXTS), tokenizer_path(), capacity=size).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_line_counts_equal_offsets(spark):
    plain = encoder(tokenizer_path()).tokenizer
    want = Counter()
    for i, t in TEXTS:
        t = t or ""
        starts = [0, *[m.end() for m in re.finditer("\n", t) if m.end() < len(t)]]
        made = plain.encode(t, add_special_tokens=False)
        owned = Counter(max(k for k, s in enumerate(starts) if s <= a) for a, _ in made.offsets)
        for k in range(len(starts)):
            want[i, k, owned[k], len(made.ids)] += 1
    rows = count_section_tokens(docs_of(spark, TEXTS), tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["section"], r["n_tokens"], r["doc_tokens"]) for r in rows) == want


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def test_base_spans_equal_patterns(spark):
    random = np.random.default_rng(8)
    parts = ["a.b@c.de", "x@y", "10.0.0.255", "1.2.3.256", "4111 1111 1111 1111", "4111111111111112", "+44 20 (7946) 0958", "+1 2", "é",
             "word", "\n", "5500-0000-0000-0004", "999", "..", "@", "u%v@host.co.uk."]
    texts = [(i, " ".join(random.choice(parts, 1 + i % 12)) if i % 3 else "".join(random.choice(parts, 1 + i % 9))) for i in range(400)]
    texts += [(None, "a.b@c.de"), (7, None), (8, ""), (9, "1 " * 20_000)]
    want = Counter()
    for i, t in texts:
        found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if ok(m.group())]
        told = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        counts = Counter(k for _, k, _ in found)
        want[i, counts[0], counts[1], counts[2], counts[3], hashlib.sha256(told.encode()).hexdigest()] += 1
    rows = find_personal_data(docs_of(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_and_empty_tables(spark, name):
    """Odd rows pass every stage that filters, with all their columns; packing seats every one of them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, " \n ", None, "s", 3), (-3, "word " * 4000, "en", None, 20_000)], docs.schema)
    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, odd, FOLDER)
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {None, -1, -2, -3}
    else:
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {None, -1, -2, -3}
    assert step(spark, odd.limit(0), FOLDER).count() == 0
