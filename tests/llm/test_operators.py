"""Operators of the training-data pipeline against brute force on small and odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import (
    bitslice, bpe, bwt, components, cotrain, crf, huffman, jaccard, media, rendezvous, shingles, vector_packing,
)
from tallyloom.llm.pretokens import classes, library_pretokens
from tallyloom.sources.workspace import new_table_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, ids string, "
    "_k string, _score string, _key string, label string, _crc string, bucket string"
)


def odd_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts = [
        None, "", " ", "a", "it's  'S 'll''s\t\n x", "é é İx Σας ½Ⅷ 12a", "<|endoftext|> q<|endoftext|>", "日本語 😀",
        "x" * 3000, passage, passage, passage + " end", "start " + passage, "no. 1", "\x1c\x1d a\x00b",
    ]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(25)]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [
        (None if i == 4 else 7 if i in (9, 10) else i * 3, t, None if i % 5 == 0 else "en", f"s{i % 2}" if i % 3 else None,
         None if t is None else len(t), 0.5, i, "x", "k", "s", "q", "l", "c", "b")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "shard")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("shard < 0")


def ids_of(path, text, end=None):
    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return np.array(ids + ([] if end is None else [end]), "<u4")


def test_classes_agree_with_the_library():
    cut = Tokenizer.from_file(BYTES).pre_tokenizer
    for point in [*range(0x3000), *range(0x10D40, 0x10D90), 0x1E5F1, 0x13460]:
        before = "a1!"[(classes()[point] - 1) % 3] if classes()[point] else None
        if before and point != 0x27:
            assert len(cut.pre_tokenize_str(before + chr(point))) == 1, hex(point)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pretokens_equal_the_library(path, texts):
    rng = random.Random(1)
    more = ["".join(rng.choice(list("abs'tdmlrve  \n\t1.9,!é ßÉ日")) for _ in range(rng.randrange(30))) for _ in range(800)]
    every = [*texts, *more]
    got = []
    for _, ids, counts in library_pretokens(path).encode(pa.array(every)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [ids_of(path, t).tolist() for t in every]


def test_limited_lengths_are_best():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 4), (2, 4), (13, 4), (200, 9), (200, 16)):
        counts = rng.integers(1, 5000, n) ** 2
        bits = huffman.limited_lengths(counts, limit)
        assert bits.max() <= limit
        assert n == 1 or sum(2.0 ** -bits) == 1
    with pytest.raises(ValueError):
        huffman.limited_lengths(np.ones(17), 4)


def test_code_round_trip():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    counts = np.array([0, 1, 511, 512, 513, 3463])
    seen = np.unique(ids, return_counts=True)
    code = huffman.Code(seen[0], huffman.limited_lengths(seen[1], 12), 12)
    data, marks = code.encode(ids, counts)
    sizes = [len(d) for d in data]
    places = np.cumsum(sizes) - sizes
    assert (code.decode(b"".join(data), places, counts, np.concatenate(marks).astype(np.int64)) == ids).all()


def test_token_files(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(huffman, "RANGE_IDS", 5000)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 1000)
    path = new_table_path(spark, "token-files")
    huffman.write_token_files(docs, path, WORDS, end=2)
    got = huffman.read_token_files(spark, path).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted((r["doc_id"] for r in rows), key=lambda k: (k is not None, k))
    want = Counter((r["doc_id"], ids_of(WORDS, r["text"], 2).tobytes()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def test_token_files_of_an_empty_table(spark, empty):
    path = new_table_path(spark, "token-files")
    huffman.write_token_files(empty, path, WORDS, end=2)
    assert huffman.read_token_files(spark, path).count() == 0


def test_shards(docs, texts, empty):
    got = rendezvous.sharded(docs, [1.0] * 8).collect()
    assert len(got) == len(texts)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == want
    assert rendezvous.sharded(empty, [1.0] * 8).count() == 0


def test_weighted_shards_move_few(spark):
    rows = spark.range(20_000).select(
        rendezvous.shard_of(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("a"),
        rendezvous.shard_of(F.col("id"), [1.0, 2.0, 0.0, 1.0, 4.0]).alias("b"),
    )
    moved = rows.where("a <> b").agg(F.count("*"), F.min("b"), F.max("b")).first()
    assert moved[1] == moved[2] == 4 and abs(moved[0] - 10_000) < 500
    sizes = dict(rows.groupBy("a").count().collect())
    assert set(sizes) == {0, 1, 3} and abs(sizes[1] - 10_000) < 500
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), [0.0])


@pytest.mark.parametrize("room", [(64, 8, 64), (64, 3, 64), (64, 8, 20), (64, 1, 5)])
def test_packing_limits(room):
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 200, 150)
    prompts = np.minimum(tokens, rng.integers(0, 60, 150))
    seen = [0] * 150
    pieces = sorted((i, s, n) for seq in vector_packing.pack(tokens, prompts, room) for i, s, n in seq)
    for i, start, size in pieces:
        assert size > 0 and start == seen[i]
        seen[i] += size
    assert seen == tokens.tolist()
    for seq in vector_packing.pack(tokens, prompts, room):
        assert sum(n for _, _, n in seq) <= room[0] and len(seq) <= room[1]
        assert sum(max(0, s + n - max(s, int(prompts[i]))) for i, s, n in seq) <= room[2]


def test_packed_texts(docs, texts, empty):
    got = vector_packing.packed_texts(docs, BYTES, 1, tokens=256, with_ids=True).collect()
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert max(filled.values()) <= 256
    assert all(n == 256 or n & (n - 1) == 0 for n in filled.values())
    assert sum(filled.values()) == sum(len(ids_of(BYTES, t, 1)) for t in texts)
    assert vector_packing.packed_texts(empty, BYTES, 1).count() == 0


def test_bpe(docs, texts, empty):
    got = {}
    for r in bpe.bpe_round_trip(docs, BYTES).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    whole = Tokenizer.from_file(BYTES)
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(BYTES, r["text"])
        text = whole.decode(ids.tolist(), skip_special_tokens=False)
        digest = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert digest in got[r["doc_id"]]
    assert bpe.bpe_round_trip(empty, BYTES).count() == 0
    parts = bpe.bpe_decode(bpe.bpe_encode(docs, BYTES), BYTES).select("text").collect()
    assert Counter(r["text"] for r in parts) == Counter(t or "" for t in texts)


def test_bpe_decodes_broken_bytes():
    table, whole = bpe.merge_table(BYTES), Tokenizer.from_file(BYTES)
    for ids in ([255, 140, 160], [1000, 200, 30_000, 220], []):
        assert bpe.decode(table, np.array(ids, np.int64), np.array([len(ids)])) == [whole.decode(ids, skip_special_tokens=False)]


def brute_links(rows):
    # A text without words is one element: itself.
    sets = [set(shingles.shingle_set(t).tolist()) or ({t} if t else set()) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, (key, _) in enumerate(rows):
        names.setdefault(find(i), []).append(key)
    return Counter(
        (key, min((k for k in names[find(i)] if k is not None), default=None), links[i]) for i, (key, _) in enumerate(rows)
    )


@pytest.mark.parametrize("small,block", [(32, 256), (2, 4)])
def test_jaccard(spark, docs, texts, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    near = []
    for _ in range(14):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        near.append(" ".join(words))
    rows = [(1000 + i, t) for i, t in enumerate(near)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(map(tuple, jaccard.jaccard_classes(every).select("doc_id", "class_id", "links").collect()))
    assert got == brute_links([tuple(r) for r in every.collect()])


def test_jaccard_of_rows_without_or_with_one_key(spark):
    """Null and repeated keys: rows meet their own sets only; texts without words meet equal ones."""
    bases = [" ".join(f"{n}{i}" for i in range(40)) for n in "abcdef"]
    made = [None, "", "", "?!", "?!", "?!", "-- --", *bases, *bases[:3], *(b + " end" for b in bases)]
    rows = [((None, 7, -1, 100 + i)[i % 4], t) for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard.jaccard_classes(df).select("doc_id", "class_id", "links").collect()))
    assert got == brute_links(rows)


def test_full_sets_of_a_hot_key_are_not_a_product(spark):
    rows = [(None if i % 2 else 5, f"one two three four five {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jaccard.signed_rows(df, 2, 2, 5, "doc_id", "text")
    wanted = signed.select("set_id", "key", "mark").distinct()
    found = jaccard.full_sets(df, wanted, 5, "doc_id", "text")
    assert found.count() == 400
    met = df.select(F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_mark")).join(
        wanted, (F.col("_mark") == F.col("mark")) & F.col("_key").eqNullSafe(F.col("key"))
    )
    assert met.count() == 400


def test_jaccard_keeps_one(docs, empty):
    kept = jaccard.one_of_each_class(docs)
    assert kept.columns == docs.columns
    classes_ = {r["class_id"] for r in jaccard.jaccard_classes(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == classes_ | {None}
    assert jaccard.one_of_each_class(empty).count() == 0


def test_band_plan():
    bands, rows = shingles.band_plan(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        shingles.band_plan(0.1, 0.9999, 8)


def test_components(spark):
    links = [(b"%04d" % i, b"%04d" % (i + 1)) for i in range(40) if i % 10] + [(b"0001", b"0031"), (b"0005", b"0005")]
    got = dict(components.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary")).collect())
    for i in range(2, 40):
        low = {0: 1, 1: 11, 2: 21, 3: 1}[(i - 1) // 10]
        assert i == low or got[b"%04d" % i] == b"%04d" % low


def brute_removal(values, length):
    count = Counter(v[i : i + length] for v in values for i in range(len(v) - length + 1))
    out = []
    for v in values:
        gone = np.zeros(len(v), bool)
        for i in range(len(v) - length + 1):
            if count[v[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("limit,length", [(4096, 400), (1, 400), (4096, 40)])
def test_repeats(spark, docs, texts, monkeypatch, limit, length):
    monkeypatch.setattr(bwt, "LIMIT", limit)
    monkeypatch.setattr(bwt, "UNIT", 4000)
    monkeypatch.setattr(bwt, "SHARD", 1500)
    loops = ["ab" * 500, "é" * 450 + "z" * 20, "z" * 399]
    rows = [(i, t) for i, t in enumerate([*[t for t in texts if len(t or "") < 9000], *loops])]
    got = {r["doc_id"]: r for r in bwt.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    values = [(t or "").encode() for _, t in rows]
    for (key, _), data, gone in zip(rows, values, brute_removal(values, length), strict=True):
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want = (len(data), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
        r = got[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_repeats_of_rows_without_or_with_one_key(spark):
    """Rows without a key, with key -1 and with one key for all, copies among them."""
    rng = random.Random(12)
    shared = "".join(rng.choice("klmnop ") for _ in range(450))
    made = [rng.choice(["", "x" * 5]) + "".join(rng.choice("abcdefgh ") for _ in range(300)) + (shared if i % 3 else "") for i in range(24)]
    rows = [((None, -1, 7)[i % 3], t, i) for i, t in enumerate([*made, *made[:6], None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k int")
    got = Counter(map(tuple, bwt.removal_digest(df, 400).collect()))
    values = [(t or "").encode() for _, t, _ in rows]
    want = Counter()
    for (key, _, _), data, gone in zip(rows, values, brute_removal(values, 400), strict=True):
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want[(key, len(data), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    spans = bwt.repeat_spans(df, 400)
    assert spans.columns == ["doc_id", "text", "_k", "_spans"]
    assert sorted(r["_k"] for r in spans.collect()) == [r[2] for r in rows]
    with pytest.raises(ValueError):
        bwt.repeat_spans(df.withColumn("_spans", F.lit(1)), 400)


def test_repeats_keep_rows(docs, empty):
    cut = bwt.without_repeats(docs, 200)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("text is not null and n_chars <> length(text)").count() == 0
    assert bwt.without_repeats(empty, 200).count() == 0 and bwt.removal_digest(empty).count() == 0
    with pytest.raises(ValueError):
        bwt.repeat_spans(docs, 401)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "ROWS", 40)
    monkeypatch.setattr(bitslice, "QUERIES", 3)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=12) / 3]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(15)]
    rows += [(400, None), (401, [1.0, None] * 6), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, rows[0][1]), (500, [0.0] * 12), (600, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score long".split(", rank")[0])
    got = Counter(map(tuple, bitslice.top_k(table, F.col("vec_id") % 50 == 0, 10).collect()))
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q and len(b) == len(a))[:10]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want
    assert bitslice.top_k(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_bit_sliced_sum():
    rng = np.random.default_rng(8)
    numbers = rng.integers(-600, 600, (130, 9))
    planes, shift, low = bitslice.sliced(numbers, int(numbers.min()))
    weights = np.array([5, -3, 0, 700, -1, 2, 9, -64, 1])
    slices = bitslice.weighted_sum(planes, weights)
    total = sum(bitslice.bits_of(s, 130).astype(int) << k for k, s in enumerate(slices) if s is not None)
    high, most = (numbers - low) >> shift, (1 << planes.shape[1]) - 1
    want = np.where(weights > 0, high, most - high) @ np.abs(weights)
    assert (total == want).all()
    alive = np.packbits(np.pad(np.ones(130, np.uint8), (0, 62)), bitorder="little").view(np.uint64)
    value = bitslice.kth_largest(slices, alive, 7)
    assert value == np.sort(want)[-7]
    assert (bitslice.bits_of(bitslice.at_least(slices, alive, value), 130) == (want >= value)).all()


def test_media_formats():
    rng = np.random.default_rng(9)
    for shape in ((3, 5), (7, 64), (3, 5, 3), (1, 1), (8, 9, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        for data in (media.encode_netpbm(pixels), media.encode_bmp(pixels)):
            assert (media.decode_media(data) == pixels).all()
    assert media.decode_media(b"P2\n# c\n2 2 3\n0 1 2 3").tolist() == [[0, 85], [170, 255]]
    assert media.decode_media(b"P1 2 2 1 0 0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode_media(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    for broken in (None, b"", b"P5\n9 9\n255\n1", b"BM", b"P9 1 1 1", b"P5 0 1 255 ", b"\x00" * 60):
        assert media.decode_media(broken) is None


def test_area_means():
    rng = np.random.default_rng(10)
    pixels = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    wide = np.kron(pixels, np.ones((4, 3))).reshape(4, 7, 3, 5).mean((1, 3))
    assert np.allclose(media.area_resize(pixels, 4, 3), wide)
    tile = media.npy_tile(pixels, 4)
    assert np.load(__import__("io").BytesIO(tile)).shape == (4, 4)


def test_stored_media(docs, texts, empty):
    got = media.stored_text_media(docs).collect()
    want = Counter()
    for t in texts:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        want[len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert media.stored_text_media(empty).count() == 0
    rows = media.media_columns(docs.limit(2).select("doc_id", F.lit(None).cast("binary").alias("media"))).collect()
    assert all(r["height"] is None and r["feature"] is None for r in rows)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, poor = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                body[rng.randrange(len(body))] = rng.choice(["vileword", "Scorned", "hatefully"])
        text = " ".join(body)
        rows.append((i, text.upper() + "!!! $$$" if poor else text, "en", f"s{i % 3}", len(text)))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(None, None, None, None, None), (900, "", "en", None, 0), (901, "vileword scorned hatefully", None, "s1", 26)]
    labels += [(None, 1, 1), (2, None, None)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_field_marginals_by_enumeration():
    field = crf.Field([])
    field.steps = np.array([[0.3, -0.5], [-0.2, 0.9]])
    score = np.array([0.4, -1.0, 2.0, 0.1, -0.3])
    starts = np.array([True, False, False, True, False])
    p, expected = field.marginals(score, starts, pairwise=True)
    want, steps = np.zeros(5), np.zeros((2, 2))
    for chain in ((0, 1, 2), (3, 4)):
        total, part, pair = 0.0, np.zeros(5), np.zeros((2, 2))
        for code in range(2 ** len(chain)):
            tags = [code >> k & 1 for k in range(len(chain))]
            moves = list(zip(tags, tags[1:]))
            weight = np.exp(sum(score[i] * y for i, y in zip(chain, tags)) + sum(field.steps[m] for m in moves))
            total += weight
            for i, y in zip(chain, tags):
                part[i] += weight * y
            for m in moves:
                pair[m] += weight
        want += part / total
        steps += pair / total
    assert np.allclose(p, want) and np.allclose(expected, steps)


def test_toxicity(judged, docs, empty):
    rows, labels = judged
    got = {r["doc_id"]: r for r in crf.toxicity(rows, labels).collect()}
    assert len(got) == rows.count()
    want = {r["doc_id"]: r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] % 4 == 0 for r in rows.collect()}
    want[901] = True
    wrong = [k for k, r in got.items() if bool(r["predicted"]) != want[k]]
    assert len(wrong) <= 5, wrong
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    spans = [text[0][s["begin"] : s["end"]].lower() for s in got[0]["spans"]]
    assert spans and all(any(w in s for w in ("vileword", "scorned", "hatefully")) for s in spans)
    kept = crf.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert crf.without_toxic(empty, labels).count() == 0
    assert {r["score"] for r in crf.toxicity(rows, labels.where("toxic = 0")).collect()} == {0.0}


def test_quality(judged, docs, empty):
    rows, labels = judged
    got = {r["doc_id"]: r for r in cotrain.quality(rows, labels).collect()}
    wrong = [k for k in range(500) if bool(got[k]["predicted"]) != (k % 5 != 1)]
    assert len(wrong) <= 5 and len(got) == rows.count()
    kept = cotrain.without_poor(docs, labels)
    assert kept.columns == docs.columns
    assert kept.join(docs, "shard", "left_anti").count() == 0
    assert cotrain.without_poor(empty, labels).count() == 0
    assert {r["score"] for r in cotrain.quality(rows, labels.where("quality > 5")).collect()} == {1.0}


def test_toxicity_counts_every_labelled_row(spark, monkeypatch):
    """Documents that share most of their words stay apart, in the counts and in the class share."""
    shared = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"{shared} own{i} {'vileword' if i % 4 == 0 else 'kindword'} end{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    marking = crf.marking_features

    def kept(counts, clean, toxic):
        row = counts.where("feature = 'common7'").first()
        seen.append((clean, toxic, row["clean"], row["toxic"]))
        return marking(counts, clean, toxic)

    monkeypatch.setattr(crf, "marking_features", kept)
    crf.trained(docs, labels)
    training = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    toxic = sum(i % 4 == 0 for i in training)
    assert seen == [(len(training) - toxic, toxic, len(training) - toxic, toxic)]


def test_co_training_learns_from_every_unlabelled_row(spark):
    """Each unlabelled row has a word of its own; all get a weight once the page view is sure."""
    def row(i, poor):
        body = "click here buy cheap now!!! " * 3 if poor else "A calm and careful sentence about rivers. " * 2
        return i, f"{body} own{i}x", "en", "spam" if poor else "book", 90

    rows = [row(i, i % 2) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)], "doc_id long, quality int")
    views = cotrain.trained(docs, labels)
    free = cotrain.slots([f"own{i}x" for i in range(300, 1800)], cotrain.WIDTH)
    assert (views.text[free] != 0).mean() > 0.95


def test_labels_of_absent_documents_train_nothing(spark):
    """Labels far beyond the documents leave the scores as they are."""
    docs = spark.createDataFrame(
        [(i, f"the calm words of text {i} " + ("vile grimmig rotten" if i % 5 == 0 else "fine kind day")) for i in range(300)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    absent = spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    alone = {r["doc_id"]: r["score"] for r in crf.toxicity(docs, labels).collect()}
    found = {r["doc_id"]: r["score"] for r in crf.toxicity(docs, labels.unionByName(absent)).collect()}
    assert found == alone and len(set(alone.values())) > 1
    assert all((score >= 0.5) == (key % 5 == 0) for key, score in alone.items())


def test_rare_toxic_words_are_found():
    """Where one row in a hundred is toxic, a word of one toxic row in ten still marks."""
    assert min(crf.PURE, crf.LIFT * 0.01) < 0.1 < crf.PURE


def test_short_documents_are_packed_without_padding(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(3000)] + [(5000, None), (5001, "b c d " * 3000)], "doc_id long, text string")
    pieces = vector_packing.packed_texts(rows.coalesce(1), BYTES, end=1).collect()
    used, offsets, covered = Counter(), {}, {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == offsets.get(r["sequence_id"], 0)
        offsets[r["sequence_id"]] = r["offset"] + r["length"]
        used[r["sequence_id"]] += r["length"]
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert max(used.values()) <= 2048 and padded <= sum(used.values()) / 15
    for parts in covered.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    assert len(covered) == 3002


def test_words_are_held_by_bytes(monkeypatch):
    from tallyloom.llm import pretokens

    coder = library_pretokens(WORDS)
    whole = [coder.one(f"word{i} thing{i}").tolist() for i in range(300)]
    monkeypatch.setattr(pretokens, "MEMORY_BYTES", 100)
    assert [coder.one(f"word{i} thing{i}").tolist() for i in range(300)] == whole
    assert len(coder.known) < 50
    pretokens.forget()
    assert library_pretokens.cache_info().currsize == 0


def test_repeats_are_marked_next_to_the_digest(spark, tmp_path):
    """Lengths do not tell which documents lose bytes; the mark does, at 400 bytes and not below."""
    from tallyloom.llm import queries

    rng = random.Random(11)
    passage, short = ("".join(rng.choices("abcdefgh ", k=n)) for n in (400, 399))
    own = ["".join(rng.choices("ijklmnop ", k=500)) for _ in range(5)]
    texts = [own[0] + passage, passage + own[1], short + own[2], own[3] + short, own[4], "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_bwt_repeats(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeat"]
    got = {r["doc_id"]: (r["n_removed"], r["has_repeat"]) for r in found.collect()}
    assert got == {0: (400, True), 1: (400, True)} | {i: (0, False) for i in range(2, 7)}
