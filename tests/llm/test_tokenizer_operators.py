"""SentencePiece encoding, tokenizer alignment and fill-in-middle against plain Python forms."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm.bytepair import byte_alphabet, encoder
from cohortloom.llm.fill_in_middle import (
    PIECE_CHARS, digest_documents, restore_pieces, transform_documents, transform_pieces)
from cohortloom.llm.pair_alignment import (
    LISTED, align_documents, pair_counts, read_bitmaps, score_documents, write_bitmaps)
from cohortloom.llm.piece_encoder import piece_encoder
from cohortloom.llm.queries import QUERIES, importable, tokenizer_path
from cohortloom.llm.sentence_pieces import decode_documents, encode_documents

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
#: Names that clash with those an operator makes for itself.
CLASHING = "doc_id long, text string, id string, n long, position int, k1 string, container string, planes int, form string"


def docs_of(spark, texts, parts=3):
    importable(spark)
    return spark.createDataFrame([(i, t, "x", None, 1, "y", None, 0, "z") for i, t in texts], CLASHING).repartition(parts)


def odd_texts(n):
    draw, letters = random.Random(5), " ▁ab\n\té𝒳　.<>PSM"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(n)]


WORDS = "alpha Beta gämma δelta 12 345 don't <|endoftext|> <s> </s> [INST] 日本語 naïve 🙂 x_y http://a.b/c?d=e".split()


def prose(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice(WORDS) + draw.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


EDGE = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n\n\n"), (6, "a▁b"), (7, "one"), (7, "one"),
        (7, "another text of the id"), (8, "line\n" * 6), (9, "é" * 3000), (10, "x" + " " * 5000 + "y"), (11, "\0"), (12, "a\r\nb\n"),
        (13, "<P>" * 3), (14, "no line feed " * 3000), (15, "long line " * 400 + "\n" + "second\n" + "z" * 40_000)]
TEXTS = EDGE + [(100 + i, t) for i, t in enumerate(odd_texts(120))] + [(300 + i, prose(i, 3 + 7 * i)) for i in range(40)]


# --- SentencePiece -------------------------------------------------------------------
def plain_pieces(text):
    model = piece_encoder(PIECES).model
    ids = model.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_pieces_equal_the_library(spark):
    rows = encode_documents(docs_of(spark, TEXTS), PIECES).collect()
    got = Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(),
                   hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in rows)
    assert got == Counter((i, *plain_pieces(t)) for i, t in TEXTS)
    assert encode_documents(docs_of(spark, []), PIECES).count() == 0


def test_stored_ids_are_decoded(spark):
    encoded = encode_documents(docs_of(spark, TEXTS), PIECES, ends=False)
    texts = Counter((r["doc_id"], r["text"]) for r in decode_documents(encoded, PIECES).collect())
    assert texts == Counter((i, (t or "").replace("▁", " ")) for i, t in TEXTS)
    nothing = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert dict(map(tuple, decode_documents(nothing, PIECES).collect())) == {1: None, 2: ""}


def test_long_runs_are_segmented():
    coder = piece_encoder(PIECES)
    for text in (" " * 200_000, "a" * 50_000, "▁" * 999 + "b", "\t" * 100_000 + " x"):
        assert coder.encode([text, "next"])[0].tolist() == coder.model.encode(text) + coder.model.encode("next")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_pieces_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, QUERIES["op11_distinct_chunk_pieces"](spark, FOLDER).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert got == Counter((i, *plain_pieces(t)) for i, t in docs)


# --- alignment -------------------------------------------------------------------------
def plain_alignment(texts):
    """All columns by loops over tokens."""
    letters, model, byte_level = byte_alphabet(), piece_encoder(PIECES).model, encoder(BYTES).tokenizer
    documents, held = [], Counter()
    for identity, text in texts:
        a, b, groups = [], [], []
        if text:
            a = byte_level.encode(" " + text, add_special_tokens=False).ids
            b = model.encode(text)
            spelled_a = [bytes(letters[c] for c in byte_level.id_to_token(i)) for i in a]
            spelled_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                         else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            whole = (" " + text).encode()
            if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
                a, b = [], []
        if a:
            ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = i, j
                while i < len(a) and ends_a[i] <= end:
                    i += 1
                while j < len(b) and ends_b[j] <= end:
                    j += 1
                groups.append((a[x:i], b[y:j]))
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        documents.append((identity, len(a), len(b), groups, links))
    highest = Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    rows = []
    for identity, n_a, n_b, groups, links in documents:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((identity, n_a, n_b, len(groups), sum(links.values()),
                     sum(n for p, n in links.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in links.items()),
                     hashlib.sha256(said.encode()).hexdigest() if said else ""))
    all_links = Counter()
    for d in documents:
        all_links.update(d[4])
    return rows, held, all_links


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_loops(spark):
    rows, held, links = plain_alignment(TEXTS)
    aligned = align_documents(docs_of(spark, TEXTS), BYTES, PIECES)
    assert Counter(map(tuple, score_documents(aligned).select(*COLUMNS).collect())) == Counter(rows)
    pairs = pair_counts(aligned).collect()
    assert {(r["a"], r["b"]): (r["n_docs"], r["links"]) for r in pairs} == {p: (held[p], links[p]) for p in held}


def test_alignment_of_a_large_group(spark, monkeypatch):
    texts = [(1, "日本語" * 40), (2, "x" + " " * 5000 + "y"), (3, "ab" * 3000)]
    monkeypatch.setattr("cohortloom.llm.pair_alignment.LISTED", 1)
    from cohortloom.llm.pair_alignment import _Aligner

    few = _Aligner(BYTES, PIECES)([t for _, t in texts])
    monkeypatch.setattr("cohortloom.llm.pair_alignment.LISTED", LISTED)
    listed = _Aligner(BYTES, PIECES)([t for _, t in texts])
    assert all((x == y).all() for x, y in zip(few[5], listed[5])) and few[4] == listed[4]


def test_alignment_over_many_containers(spark, monkeypatch):
    monkeypatch.setattr("cohortloom.llm.pair_alignment.CONTAINER_POSTINGS", 1)
    rows, _, _ = plain_alignment(TEXTS)
    from cohortloom.llm import pair_alignment

    small = [r for r in TEXTS]
    got = score_documents(pair_alignment.align_documents(docs_of(spark, small, 1), BYTES, PIECES))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(rows)


def test_alignment_of_nothing(spark):
    assert score_documents(align_documents(docs_of(spark, []), BYTES, PIECES)).count() == 0
    only = score_documents(align_documents(docs_of(spark, [(1, None), (2, "")]), BYTES, PIECES)).select(*COLUMNS).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n_docs", [1, 7, 8, 1000, 65_536])
def test_bitmaps_read_back(n_docs):
    draw = np.random.default_rng(n_docs)
    pairs = sorted({(int(r), int(d)) for r, share in enumerate((0.001, 0.02, 0.5, 1.0))
                    for d in np.flatnonzero(draw.random(n_docs) < share)})
    row, doc = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    held, bitmaps = write_bitmaps(row, doc, n_docs)
    r, d = read_bitmaps(bitmaps)
    assert sorted(zip(held[r].tolist(), d.tolist())) == pairs
    if len(bitmaps) > 1:
        r, d = read_bitmaps(bitmaps.slice(1))
        assert sorted(zip(held[1:][r].tolist(), d.tolist())) == [p for p in pairs if p[0] != held[0]]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_alignment_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_inverted_pair_alignment"](spark, FOLDER).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(plain_alignment(docs)[0])


# --- fill in the middle ------------------------------------------------------------------
def plain_fill(identity, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if identity is None else identity}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return identity, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return identity, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return identity, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hashed(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_fill_in_middle_equals_slices(spark):
    pieces = transform_pieces(docs_of(spark, TEXTS))
    got = Counter(map(tuple, digest_documents(pieces).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()))
    assert got == Counter((*plain_fill(i, t)[:5], hashed(plain_fill(i, t)[5]), hashed(t)) for i, t in TEXTS)
    assert digest_documents(transform_pieces(docs_of(spark, []))).count() == 0


def test_whole_outputs(spark):
    rows = transform_documents(docs_of(spark, TEXTS), rate=70, spm=20).collect()
    want = [plain_fill(i, t, 70, 20) for i, t in TEXTS]
    assert Counter(map(tuple, rows)) == Counter((w[0], w[2], w[5]) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_pieces_are_bounded_and_shuffled_once(spark):
    pieces = transform_pieces(docs_of(spark, TEXTS))
    assert max(len(r["piece"].decode()) for r in pieces.collect()) <= PIECE_CHARS + 3
    plan = digest_documents(pieces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k1") <= 1 and plan.count("Exchange") <= 2
    assert restore_pieces(pieces).where("section = 3").count() == len(TEXTS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_fill_in_middle_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, QUERIES["op13_secondary_sort_fill_in_middle"](spark, FOLDER).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()))
    assert got == Counter((*plain_fill(i, t)[:5], hashed(plain_fill(i, t)[5]), hashed(t)) for i, t in docs)


# --- long white space in the byte-level encoder ---------------------------------------------
def test_long_white_space_is_encoded():
    coder = encoder(BYTES)
    texts = ["a" + " " * 3000, "a" + " " * 3000 + "b", "\n" * 3000 + "b c", "a " + "　" * 2000 + "!" + "\t" * 1100 + "1", " " * 1024 + " x",
             "x" + "\r\n" * 2000 + "'s", "\x1c" * 2000 + " y", "\x85" * 1500 + "z"]
    plain = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [e.ids for e in plain] == [x.tolist() for x in coder.encode(texts)]


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_two_million_blanks(blank):
    coder = encoder(BYTES)
    ids = coder.encode(["a" + blank * 2_000_000 + "b"])[0]
    assert coder.tokenizer.decode(ids.tolist()) == "a" + blank * 2_000_000 + "b"
