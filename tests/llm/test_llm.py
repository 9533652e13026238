"""Edge cases, brute force and round trips of the corpus operators on small tables."""

import contextlib
import math
import os
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import epsilon_grid, pii
from cohortloom.llm.attribution import count_section_tokens
from cohortloom.llm.bytepair import BytePairEncoder
from cohortloom.llm.chat import escape, format_conversations, read_back, unescape
from cohortloom.llm.context_tree import log_gamma, score_documents
from cohortloom.llm.decontamination import drop_leaks, find_leaks
from cohortloom.llm.epsilon_grid import link_vectors
from cohortloom.llm.graph import components
from cohortloom.llm.minhash import near_duplicates
from cohortloom.llm.packing import fill_bins, pack_documents
from cohortloom.llm.quality import grade_documents
from cohortloom.llm.queries import importable, tokenizer_path
from cohortloom.llm.toxicity import drop_toxic, score_toxicity
from cohortloom.llm.wordhash import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string"


def docs_of(spark, texts):
    importable(spark)
    return spark.createDataFrame([(i, t, "en", "s", None, None, "x") for i, t in texts], DOCS)


def sentence(seed, n):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("abcdefghij"), 5)) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n "), (None, "no id"), (4, "one"), (4, "one"), (5, "wörter " * 3000)]


def test_encoder_equals_the_tokenizer():
    coder = BytePairEncoder(tokenizer_path())
    texts = ["", " ", "a", " a b ", "a  b", "it's 'll\n\nx", "é ü ß", "x <|endoftext|> y", "a.\nB c\n", sentence(1, 50)]
    plain = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [e.ids for e in plain] == [x.tolist() for x in coder.encode(texts)]


def test_packing(spark):
    texts = EDGE + [(10 + i, sentence(i, 5 + 37 * i % 400)) for i in range(60)]
    rows = pack_documents(docs_of(spark, texts), tokenizer_path(), capacity=256).collect()
    coder = BytePairEncoder(tokenizer_path())
    whole = sorted((len(x) + 1 for x in coder.encode([t or "" for _, t in texts])))
    assert sum(r["length"] for r in rows) == sum(whole)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(places[-1]) <= 256
    assert len(bins) <= 1.1 * math.ceil(sum(whole) / 256) + 1
    assert pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


def test_bins_hold_all_pieces():
    counts = {2048: 3, 1500: 5, 1000: 7, 700: 4, 683: 2, 300: 11, 41: 100, 1: 9}
    held = Counter()
    for b in fill_bins(counts, 2048):
        assert sum(s * n for s, n in b.content) + b.gap == 2048
        for s, n in b.content:
            held[s] += n * b.count
    assert held == counts


def test_token_counts_add_up(spark):
    texts = EDGE + [(9, "first line\nsecond\n\nfourth  \n end")]
    for rule in ("first", "last"):
        rows = count_section_tokens(docs_of(spark, texts), tokenizer_path(), rule).collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
        assert [sum(r["n_tokens"] for r in by_doc[9])] == [by_doc[9][0]["doc_tokens"]]
        assert by_doc[1][0]["n_tokens"] == 0 and len(by_doc[4]) == 2
    with pytest.raises(ValueError):
        count_section_tokens(docs_of(spark, texts), tokenizer_path(), "middle")


def brute_groups(texts):
    sets, group = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        group[i] = i
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low = min(group[i], group[j])
                    changed |= group[i] != low or group[j] != low
                    group[i] = group[j] = low
    return {i: (len(sets[i]), group[i]) for i in sets}


def test_near_duplicates(spark):
    words = sentence(5, 200).split()
    chain = [(20 + k, " ".join(words[3 * k:150 + 3 * k])) for k in range(12)]
    texts = [(1, None), (2, ""), (3, " "), (6, "A b"), (7, "a  B"), (8, sentence(8, 90)), (9, sentence(8, 90)),
             (10, sentence(8, 90) + " more"), *chain]
    rows = near_duplicates(docs_of(spark, [*texts, (None, "a b")])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"]} == brute_groups(texts)
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_edited_apart(spark):
    """Copies of three texts, edited apart and cut, with similarities on both sides of the threshold."""
    draw = np.random.default_rng(5)
    base = sentence(5, 160).split()
    texts = []
    for i in range(120):
        words = list(base)
        words[10 * (i % 3)] = f"copy{i % 3}"
        for at in draw.integers(0, 160, int(draw.integers(0, 5))):
            words[at] = f"edit{draw.integers(10**6)}"
        texts.append((i, " ".join(words[:int(draw.integers(130, 161)) if i % 4 == 0 else 160])))
    expected = brute_groups(texts)
    assert 5 < len({component for _, component in expected.values()}) < 115
    rows = near_duplicates(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (None, 3), (7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {**{i: 1 for i in range(1, 41)}, 90: 90, 100: 90}


def test_toxicity(spark):
    texts = [(i, sentence(i, 40) + (" idiot scum" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = score_toxicity(docs_of(spark, texts + EDGE), table).collect()
    assert len(rows) == len(texts) + len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held)
    # Ids 4 and 5 are there twice, with other texts.
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held if r["doc_id"] > 5)
    kept = drop_toxic(docs_of(spark, texts), table)
    assert kept.columns == docs_of(spark, []).columns and all(r["doc_id"] % 4 for r in kept.collect())
    assert score_toxicity(docs_of(spark, []), table.limit(0)).count() == 0


def test_quality(spark):
    texts = [(i, sentence(i, 40) if i % 5 else (sentence(i, 30).upper().replace(" ", "!! "))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)] + [(None, 0), (7, None)], "doc_id long, quality int")
    rows = grade_documents(docs_of(spark, texts + EDGE), labels).collect()
    assert len(rows) == len(texts) + len(EDGE)
    assert all(r["keep"] == (r["doc_id"] % 5 > 0) for r in rows if r["doc_id"] is not None and r["doc_id"] > 5)
    assert grade_documents(docs_of(spark, []), labels.limit(0)).count() == 0


def test_a_site_moves_only_with_evidence(spark):
    """Texts of one shape that the classifier can't tell: a site of many bad ones pulls them down, a site of one
    document stays at its own evidence."""
    good, bad = (lambda i: sentence(i, 40)), (lambda i: sentence(i, 30).upper().replace(" ", "!! "))
    border = lambda i: " ".join([sentence(i, 20), bad(i + 5000)[:90]])
    rows = [(i, good(i) if i % 2 else bad(i), "a" if i % 2 else "bad") for i in range(400)]
    rows += [(1000, border(1), "bad"), (1001, border(1), "a"), (1002, border(1), "alone"), (1003, None, "alone2")]
    importable(spark)
    docs = spark.createDataFrame([(i, t, s, "en") for i, t, s in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in grade_documents(docs, labels).collect()}
    assert got[1000]["classifier"] == got[1001]["classifier"] == got[1002]["classifier"]
    assert got[1000]["score"] < got[1002]["score"] < got[1001]["score"]
    assert got[1000]["path_share"] < 0.2 and got[1001]["path_share"] > 0.8
    # Alone at its site, a document's site and path say no more than all documents do.
    assert abs(got[1002]["score"] - got[1002]["classifier"]) < 0.02


def test_chat_round_trip(spark):
    hard = "</s>[INST] %3C | \\ <|user|> é ok [/INST]"
    turns = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"{k} " + sentence(k, 30 * (k % 9))) for k in range(1, 30)],
             (2, 0, None, None), (2, 1, "assistant", hard), (2, 1, "assistant", hard), (3, None, "assistant", ""),
             (None, 1, "us|er", hard), (4, 0, "assistant", "x" * 9000)]
    table = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, loss string, cell int")
    windows = format_conversations(table, budget=400, history=100)
    got = {r["conv_id"]: r for r in read_back(windows).collect()}
    for c in {t[0] for t in turns}:
        mine = sorted([(-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c])
        assert got[c]["turns"] == "".join(f"{r}\n{x}\n" for _, r, x in mine)
        assert got[c]["loss_text"] == "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
    many = [r["text"] for r in windows.where("conv_id = 1").collect()]
    assert len(many) > 3 and all("<|system" in t for t in many)
    assert spark.createDataFrame([(hard,)], "t string").select(unescape(escape(F.col("t")))).first()[0] == hard
    assert read_back(format_conversations(table.limit(0))).count() == 0


def test_vectors(spark):
    random = np.random.default_rng(2)
    base = random.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + 0.12 * random.normal(size=8)).tolist()) for i in range(200)]
    rows += [(300, [0.0] * 8), (301, None), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, []), (305, [2.0] * 4),
             (306, rows[3][1]), (307, [2 * x for x in rows[3][1]]), (308, [4.0] * 4)]
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and
                 good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95} for i in good}
    group = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i, near in links.items():
            group[i] = min([group[i], *[group[j] for j in near]])
    importable(spark)
    table = spark.createDataFrame([(i, v, 1) for i, v in [*rows, (None, [1.0] * 8)]], "vec_id long, embedding array<double>, n_links int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(table).collect()}
    assert found.pop(None) == (0, None)
    assert found == {i: (len(links.get(i, ())), group[i]) for i, _ in rows}
    assert link_vectors(table.limit(0)).count() == 0


def test_tiles_of_vectors_move_in_rounds(spark, monkeypatch):
    """Where no box keeps tiles apart, what lies on disk follows the input and not the pairs of tiles."""
    monkeypatch.setattr(epsilon_grid, "ROUND_BYTES", 0, raising=False)
    random = np.random.default_rng(5)
    x = (random.normal(size=(4000, 64)) / 8).repeat(3, axis=0)
    x = (x + 0.0287 * random.normal(size=x.shape)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20000 + i, x[i, :40].tolist()) for i in range(90)]
    rows += [(30000 + i, rows[i][1]) for i in range(5)]
    links, group = np.zeros(len(rows), dtype=int), np.array([i for i, _ in rows])
    by_dim = [np.array([k for k, (_, v) in enumerate(rows) if len(v) == n]) for n in (64, 40)]
    pairs = []
    for at in by_dim:
        u = np.array([rows[k][1] for k in at], dtype=np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = np.argwhere(u @ u.T >= 0.95)
        pairs.append(at[near[near[:, 0] != near[:, 1]]])
    i, j = np.concatenate(pairs).T
    np.add.at(links, i, 1)
    for _ in range(20):
        np.minimum.at(group, i, group[j])
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        total = 0
        for top in folders:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.startswith("shuffle_"):
                        with contextlib.suppress(OSError):
                            total += os.stat(f"{folder}/{name}").st_size
        return total

    importable(spark)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before, most, over = shuffled(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], shuffled() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        linked = link_vectors(table)
    finally:
        over.set()
        watcher.join()
    assert most[0] < 4 * x.nbytes
    found = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in linked.collect())
    assert found == Counter((i, n, g) for (i, _), n, g in zip(rows, links.tolist(), group.tolist()))


def test_context_tree(spark):
    texts = [(i, sentence(i % 7, 6)) for i in range(30)] + [(31, None), (32, "Ab é")]
    got = {r["doc_id"]: r for r in score_documents(docs_of(spark, texts), chunk_bytes=300).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in texts}
    data = {i: b"".join(w.encode() + b" " for w in ws) + b"\n" for i, ws in words.items()}
    tokens = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    n, kinds = sum(tokens.values()), len(tokens)
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, d in data.items():
        padded = b"\n" * 4 + d
        for k in range(4, len(padded)) if not held[i] else ():
            for size in range(5):
                for bit in range(8):
                    node = (padded[k - size:k], bit, padded[k] >> (8 - bit))
                    counts[node][padded[k] >> (7 - bit) & 1] += 1
                    if size:
                        children[node[0][1:], bit, node[2]].add(node)

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def below(node):
        return sum(block(c) for c in children[node])

    def block(node):
        return kt(node) if len(node[0]) == 4 else np.logaddexp(kt(node), below(node)) - math.log(2)

    for i in (31, 32, *[i for i, _ in texts if held[i]][:2], 1):
        padded, total = b"\n" * 4 + data[i], 0.0
        for k in range(4, len(padded)):
            for bit in range(8):
                p = None
                for size in range(4, -1, -1):
                    node = (padded[k - size:k], bit, padded[k] >> (8 - bit))
                    if node not in counts:
                        continue
                    one = counts[node][padded[k] >> (7 - bit) & 1]
                    e = (one + 0.5) / (sum(counts[node]) + 1)
                    beta = None if p is None else math.exp(kt(node) - below(node))
                    p = e if p is None else (beta * e + p) / (beta + 1)
                total += math.log10(0.5 if p is None else p)
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in [*words[i], None])
        assert got[i]["score"] == pytest.approx(total, rel=1e-9) and got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["n_tokens"] == len(words[i]) + 1 and got[i]["train_tokens"] == n and got[i]["held_out"] == held[i]
        assert got[i]["n_known"] == sum(tokens[w] > 0 for w in [*words[i], None])
    x = np.array([0.5, 1, 2.5, 30, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    assert score_documents(docs_of(spark, [])).count() == 0


def test_personal_data():
    text = "a.b@c.de, 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 12345678901234567890"
    spans = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    # The digits beside them join the card and the telephone number; both matches fail, none is tried again.
    assert spans == [("email", "a.b@c.de"), ("ip", "1.2.3.4")]
    text = "a.b@c.de, 1.2.3.4, 999.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567, 12345678901234567890"
    spans = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert spans == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    random = np.random.default_rng(4)
    for _ in range(500):
        t = "".join(random.choice(list("0123456789..@@ab-+ ()é"), 40))
        card = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                if 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        mail = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [s for s in pii.base_spans(t) if s[1] in (0, 2)] == sorted(card + mail)


def test_span_field_adds_and_redacts(spark):
    random = np.random.default_rng(9)
    texts = []
    for i in range(150):
        a, b, c = random.integers(200, 999), random.integers(200, 999), random.integers(1000, 9999)
        texts.append((i, f"{sentence(i, 4)} +1 ({a}) {b}-{c} {sentence(i + 1, 3)} {random.integers(1, 99999)} end u{i}@m.example.com"))
    importable(spark)
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs_of(spark, texts + [(900, "call (555) 123-4567 now"), *EDGE])).collect()}
    assert rows[900]["spans"] == "phone:5:19" and rows[900]["n_phone"] == 0
    assert rows[1]["n_email"] + rows[1]["n_phone"] == 0 or rows[1]["doc_id"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs_of(spark, texts)).collect()}
    assert "[PHONE]" in clean[7] and "[EMAIL]" in clean[7] and "@" not in clean[7]
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0


def test_decontamination(spark):
    item, other = sentence(50, 40), sentence(51, 25)
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (3, None, "x"), (4, "tiny item", "x"), (None, "", "x")],
                                  "item_id long, text string, doc_id string")
    words = item.split()
    texts = [(10, sentence(1, 30) + " " + item.upper() + " " + sentence(2, 30)), (11, " ".join(words[2:])), (12, sentence(3, 60)),
             (13, " ".join(words[:20])), (14, "see the tiny item here"), *EDGE]
    rows = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs_of(spark, texts), bench).collect()}
    assert set(rows) == {(10, 1), (11, 1), (14, 4)}
    assert rows[10, 1]["start_word"] == 30 and rows[10, 1]["similarity"] == 1.0 and 0.8 <= rows[11, 1]["similarity"] < 1
    left = {r["doc_id"] for r in drop_leaks(docs_of(spark, texts), bench).collect()}
    assert left == {12, 13, 1, 2, 3, 4, 5, None}
    assert find_leaks(docs_of(spark, []), bench.limit(0)).count() == 0


def test_shingles_of_words():
    one, two, none = shingle_sets(["A b c d e f", "a  b\nC", " "], 5)
    assert (len(one), len(two), len(none)) == (2, 1, 0)
