"""Spelling variants, inferred credential formats and dual-tree codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import credentials, dualtree, spelling

ODD = "doc_id long, text string, word string, n string, _key string, _text string, home string, label string"


def typed_words(rows):
    """Word counts of (key, text) rows, one run at a time."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    out = {}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(near[w])]
    rows = set()
    for w, (form, n, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, count, words[form] if form else None))
    return rows


def spelled_texts():
    rng = random.Random(3)
    bases = ["haende", "straße", "colour", "mississippi", "naïveté", "ÀÉÎõü", "banana", "×÷×÷×", "q" * 40, "z" * 700 + "a"]
    texts = [None, "", " ", "12 34", "a bc def", "Banana BANANA bananaÀ"]
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(bases)
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("aesx") + w[at:], w[:at] + rng.choice("aeß") + w[at + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(" ".join(words))
    return [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def spelled():
    return spelled_texts()


def odd_rows(spark, rows):
    return spark.createDataFrame([(k, t, "w", "n", "k", "t", "h", "l") for k, t in rows], ODD).repartition(3)


@pytest.mark.parametrize("most", [spelling.SUBTREE, 15])
def test_variants_equal_all_pairs(spark, spelled, most):
    docs = odd_rows(spark, spelled)
    words = typed_words(spelled)
    assert {tuple(r) for r in spelling.word_counts(docs).collect()} == set(words.items())
    found = spelling.variant_groups(spelling.word_counts(docs), most=most)
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(words) and set(rows) == grouped(words)
    assert sum(r[1] is not None for r in rows) > 5 and any(r[1] not in (None, r[2]) for r in rows)


def test_variants_of_nothing(spark, spelled):
    docs = odd_rows(spark, spelled).where("doc_id < -5")
    assert spelling.spelling_variants(docs).count() == 0


def test_whole_subtree_beyond_one_block(spark):
    """Words of one frequency vector are cut into blocks, and no pair is lost."""
    letters = "bvwbvwbv"
    rng = random.Random(1)
    words = {"".join(rng.sample(letters, 8)) for _ in range(300)}
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    pairs = [tuple(r) for r in spelling.near_pairs(table, most=40).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_routing_budget():
    for depth in (1, 2, 4):
        for d in spelling.within_budget(depth):
            assert d > (0,) * depth and sum(v for v in d if v > 0) <= 1 and sum(-v for v in d if v < 0) <= 1
    assert len(spelling.within_budget(4)) == (2 * 4 + 4 * 3) // 2


def test_frontier_may_be_split(monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aeinbvw") for _ in range(rng.randint(5, 7))) for _ in range(400)})
    block = spelling.Block(words, [1] * len(words)).ordered()

    def pairs():
        trie = spelling.Trie(block)
        return {(block.words[q], trie.words.words[p]) for qs, ps in trie.search(block.counts) for q, p in zip(qs, ps)}

    whole = pairs()
    monkeypatch.setattr(spelling, "FRONTIER", 50)
    assert pairs() == whole
    near = {(a, b) for a in words for b in words if distance_one(a, b)}
    assert near <= whole


ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def secret_texts():
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda: "tk_" + "".join(rng.choice(letters) for _ in range(30))
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    access = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    word = lambda: "".join(rng.choice(["ness", "ion", "able", "er", "ing", "un", "re", "tion"]) for _ in range(6))
    texts = [
        None, "", "no secrets", "password: ab token=abcdefgh", "secret=token=abcdefgh", "password=token:abcdefg",
        "ſecret=abcdefgh toKen: abcdefgh", "AKIAAKIA" + "X" * 14, "AKIA" + "Z" * 15, digits(23), digits(24) + "g" + digits(40),
        "é" * 5 + f" Api_Key = '{token()}'", "x" + "=" * 40, "password  ==  abcdef", "a" * 50_000,
    ]
    bare = []
    for i in range(300):
        texts.append(f"{word()} TOKEN = \"{token()}\" {word()}{word()} {digits(40) if i % 3 == 0 else ''} {access() if i % 5 == 0 else ''}")
    for _ in range(20):
        bare.append(token())
        texts.append(f"é {word()} {bare[-1]} {word()}")
    return texts, bare


def test_secret_spans(spark):
    texts, bare = secret_texts()
    rows = [(None if i == 3 else 5 if i in (8, 9) else i, t) for i, t in enumerate(texts)]
    docs = odd_rows(spark, rows)
    found = credentials.digest(credentials.secret_spans(docs))
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found.collect())
    want = Counter()
    for key, text in rows:
        spans = plain_spans(text or "")
        named = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        want[(key, counts[0], counts[1], counts[2], hashlib.sha256(named.encode()).hexdigest())] += 1
    assert got == want
    by_key = {r["doc_id"]: r for r in found.collect()}
    caught = 0
    for key, text in rows[len(texts) - len(bare) :]:
        spans = [s.split(":") for s in by_key[key]["spans"].split(",") if s]
        caught += any(text[int(a) : int(b)] in bare for _, a, b in spans)
    assert caught >= 0.9 * len(bare)
    clean = [by_key[key] for key, text in rows if text and "TOKEN" not in text and key is not None and key > 14 and not any(b in text for b in bare)]
    assert all(r["n_added"] == 0 for r in clean)
    words_added = [r for r in found.collect() if r["n_added"] > 1]
    assert not words_added


def test_no_credentials_no_documents(spark):
    docs = odd_rows(spark, [(1, "nothing " * 5), (2, None), (3, "x" * 30)])
    assert [r["spans"] for r in credentials.secret_spans(docs).collect()] == [""] * 3
    assert credentials.secret_spans(docs.where("doc_id < 0")).count() == 0


def test_automaton_of_a_loop():
    """From values of (ab)*c the cycle is inferred, and shares are kept."""
    rng = random.Random(6)
    values = []
    for _ in range(2000):
        n = 0
        while rng.random() < 0.6:
            n += 1
        values.append("ab" * n + "c")
    rows = credentials.inferred(values)
    assert len({r[0] for r in rows}) <= 4
    form = credentials.Format(rows)
    assert math.isclose(form.likelihood("c"), math.log(0.4), abs_tol=0.2)
    assert math.isclose(form.likelihood("ababc"), math.log(0.36 * 0.4), abs_tol=0.3)
    assert form.likelihood("abab") < form.likelihood("ababababc") - 2
    for state in {r[0] for r in rows}:
        whole = sum(math.exp(p) for (s, _), (p, _) in form.steps.items() if s == state)
        assert whole <= 1 + 1e-9


def test_automaton_does_not_depend_on_order():
    texts, bare = secret_texts()
    values = bare * 3
    assert credentials.inferred(values) == credentials.inferred(values[::-1])


def lloyd(vectors, parts, entries, rounds):
    """Plain rounds with Python's integers."""
    width = len(vectors[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in vectors[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (dist(v[p * width : (p + 1) * width], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in vectors:
                members.setdefault(nearest(p, v), []).append(v[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    codes = [[nearest(p, v) for p in range(parts)] for v in vectors]
    errors = [sum(dist(v[p * width : (p + 1) * width], books[p][c[p]]) for p in range(parts)) for v, c in zip(vectors, codes)]
    return codes, errors, books


VECTORS = "vec_id long, embedding array<double>, label int, id string, q string, _label string, code string"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "i", "q", "l", "c") for r in rows], VECTORS).repartition(3, "vec_id")


@pytest.mark.parametrize("wide", [1.0, 1e13])
def test_codes_equal_plain_rounds(spark, wide):
    rng = random.Random(8)
    rows = [(i if i != 40 else None, [rng.gauss(rng.choice((-1, 1)), 0.2) * wide for _ in range(8)], rng.choice((1, 2, None))) for i in range(150)]
    rows += [(7, rows[7][1], 3), (7, rows[7][1], 3), (200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1)]
    found = dualtree.code_digest(vector_table(spark, rows), parts=4, entries=16, rounds=3)
    kept = sorted(
        ((k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    codes, errors, books = lloyd([v for _, v, _ in kept], 4, 16, 3)
    whole = ",".join(str(x) for b in books for e in b for x in e)
    top = (1 << 63) - 1
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    if wide == 1.0:
        want = Counter((k, bytes(c).hex(), e, by_label[label], hashlib.sha256(whole.encode()).hexdigest()) for (k, _, label), c, e in zip(kept, codes, errors))
        assert Counter(tuple(r) for r in found.collect()) == want
    else:
        coded, got = dualtree.vector_codes(vector_table(spark, rows), parts=4, entries=16, rounds=3)
        assert got == books
        assert Counter((r["id"], r["code"], r["error"]) for r in coded.collect()) == Counter(
            (k, bytes(c).hex(), min(e, top)) for (k, _, _), c, e in zip(kept, codes, errors)
        )


def test_codes_of_few_and_no_rows(spark):
    few = vector_table(spark, [(3, [0.5] * 5, 1), (1, [0.25] * 3, None), (2, [], None)])
    found = {r["vec_id"]: r for r in dualtree.code_digest(few, rounds=2).collect()}
    assert {k: r["code"] for k, r in found.items()} == {1: "00000000", 2: "01010000", 3: "02020200"}
    assert all(r["error"] == r["label_error"] == 0 for r in found.values())
    none = dualtree.code_digest(few.where("vec_id > 9"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_trees_prune_and_assign_whole_nodes():
    """Far clusters are assigned by their sums; equal entries leave the lower index."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-100_000, 100_000, (32, 4))
    points = np.concatenate([c + rng.integers(-50, 50, (64, 4)) for c in centres])
    points = points[dualtree.tree_order(points, dualtree.depth(len(points), dualtree.LEAF))]
    book = dualtree.Codebook([*centres.tolist(), centres[0].tolist()])
    tree = dualtree.Tree(points, dualtree.LEAF)
    done = book.assigned(tree)
    assert done.pruned > 0
    whole = sum(int((tree.at[level][nodes + 1] - tree.at[level][nodes]).sum()) for level, nodes, _ in done.whole)
    assert whole > 0.5 * len(points)
    want = np.argmin(((points[:, None] - book.entries[None]) ** 2).sum(2), 1)
    assert (done.codes(tree) == want).all()
    counts, sums = np.zeros(33, np.int64), np.zeros((33, 4), np.int64)
    done.add_to(tree, counts, sums)
    assert (counts == np.bincount(want, minlength=33)).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(33))


def test_uneven_trees():
    for n in (1, 2, 3, 17, 100, 255):
        points = np.random.default_rng(n).integers(-9, 9, (n, 3))
        order = dualtree.tree_order(points, dualtree.depth(n, 2))
        assert sorted(order.tolist()) == list(range(n))
        tree = dualtree.Tree(points[order], 2)
        for level, at in enumerate(tree.at):
            for i in np.flatnonzero(at[:-1] < at[1:]).tolist():
                own = tree.points[at[i] : at[i + 1]]
                assert (tree.low[level][i] == own.min(0)).all() and (tree.sums[level][i] == own.sum(0)).all()
        book = dualtree.Codebook(points[: min(n, 9)].tolist())
        want = np.argmin(((tree.points[:, None] - book.entries[None]) ** 2).sum(2), 1)
        assert (book.assigned(tree).codes(tree) == want).all()
