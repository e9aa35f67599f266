"""Vocabulary training by chains and native encoding against the library."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import composed
from tallyloom.operators import vocab as V
from tallyloom.sources.workspace import pin
from tallyloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def library_merges(texts, ids):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    library = Tokenizer(models.BPE())
    library.normalizer = normalizers.NFC()
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.train_from_iterator(
        texts,
        trainers.BpeTrainer(
            vocab_size=ids, min_frequency=2, special_tokens=V.SPECIAL_TOKENS,
            initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False,
        ),
    )
    return [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").select("doc_id", "text")


def test_full_vocabulary_equals_the_library_trainer(spark, documents):
    texts = [r["text"] for r in documents.where("length(text) >= 16").collect()]
    counts = pin(V.piece_counts(documents.where("length(text) >= 16")))
    learned = V.learned_merges(counts, 16_000 - 256 - len(V.SPECIAL_TOKENS))
    assert [(a, b) for a, b, _ in V.spelled(learned)] == library_merges(texts, 16_000)
    assert len(learned) > 5_000


@pytest.mark.parametrize("chains", [1, 40, 2000])
def test_rounds_do_not_change_the_merges(spark, documents, chains):
    """However few chains a round may see, the order of the merges is the same."""
    counts = pin(V.piece_counts(documents.where("doc_id < 20")))
    most = 25 if chains == 1 else 150
    wanted = V.learned_merges(counts, most)
    assert V.learned_merges(counts, most, chains=chains) == wanted
    texts = [r["text"] for r in documents.where("doc_id < 20").collect()]
    assert [(a, b) for a, b, _ in V.spelled(wanted)] == library_merges(texts, 256 + 7 + most)


def test_runs_and_ties(spark):
    """Equal counts, runs of one symbol, single pieces, nothing to merge."""
    texts = ["ab ab ba ba", "cd cd dc dc", "eeeeee eeeee", "x", "q w e"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    learned = V.learned_merges(V.piece_counts(rows), 40)
    assert [(a, b) for a, b, _ in V.spelled(learned)] == library_merges(texts, 256 + 7 + 40)
    assert V.learned_merges(V.piece_counts(rows.where("text = 'x'")), 5) == []
    assert V.learned_merges(V.piece_counts(rows.where("text = ''")), 5) == []


def test_symbols_join_like_repeated_replacement():
    rng = random.Random(4)
    ranks, made = {}, list("abcd")
    for i in range(30):
        a, b = rng.choice(made), rng.choice(made)
        if a + b not in ranks:
            ranks[a + b] = (i, chr(0x400 + i))
            made.append(chr(0x400 + i))

    def plain(s):
        while True:
            known = [ranks[s[i : i + 2]] for i in range(len(s) - 1) if s[i : i + 2] in ranks]
            if not known:
                return s
            rank, new = min(known)
            pair = next(p for p, v in ranks.items() if v == (rank, new))
            i = next(i for i in range(len(s) - 1) if s[i : i + 2] == pair)
            s = s[:i] + new + s[i + 2 :]

    for _ in range(500):
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))
        assert V.joined_symbols(s, ranks) == plain(s)


def test_chains_are_cut_at_absent_pairs():
    assert list(V.chains_of("abcabd", {"ab", "bc"})) == ["abc", "ab"]
    assert list(V.chains_of("aaa", {"aa"})) == ["aaa"]
    assert list(V.chains_of("xyz", {"ab"})) == [] and list(V.chains_of("", set())) == []


@pytest.mark.parametrize("frequent", [V.FREQUENT, 10])
def test_token_counts_equal_the_library(spark, documents, monkeypatch, frequent):
    from tokenizers import Tokenizer

    monkeypatch.setattr(V, "FREQUENT", frequent)
    odd = [(10_000, ""), (10_001, "é é  12"), (10_002, "\n\n a"), (10_003, "z" * 5000), (10_004, None)]
    docs = documents.where("doc_id < 60").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    learned = V.learned_merges(V.piece_counts(docs), 300)
    pieces = pin(V.piece_lengths(pin(V.piece_counts(docs)), learned))
    found = {r["doc_id"]: r["n_tokens"] for r in V.token_counts(docs, pieces).collect()}
    coder = Tokenizer.from_str(V.tokenizer_json(learned))
    assert found == {r["doc_id"]: len(coder.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_streamed_ids_resume(spark, documents, tmp_path):
    """Two runs give the ids of the library and the shards of one run; changed settings are refused."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    learned = V.learned_merges(pin(V.piece_counts(docs.where("text <> ''"))), 200)
    schema = docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    landing, folder, once = (str(tmp_path / n) for n in ("in", "out", "once"))
    for part in ("doc_id < 30", "doc_id >= 30"):
        docs.where(part).write.mode("append").parquet(landing)
        jobs.tokenise_arrivals(jobs.arrivals(spark, landing, schema), folder, learned, 3000)
    jobs.tokenise_arrivals(jobs.arrivals(spark, landing, schema), once, learned, 3000)
    coder = Tokenizer.from_str(V.tokenizer_json(learned))
    found = {r["doc_id"]: r for r in jobs.tokenised_arrivals(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("text <> ''").collect()}
    assert {k: r["ids"] for k, r in found.items()} == {k: coder.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
    assert {k: r["shard_id"] for k, r in found.items()} == {r["doc_id"]: r["shard_id"] for r in jobs.tokenised_arrivals(spark, once).collect()}
    pieces = spark.read.parquet(f"{folder}/pieces")
    assert pieces.count() == pieces.select("piece").distinct().count()
    for changed in ({"merges": learned[:-1]}, {"shard_size": 2999}, {"mix": {"a": 1.0}}):
        settings = {"merges": learned, "shard_size": 3000, **changed}
        with pytest.raises(ValueError):
            jobs.tokenise_arrivals(jobs.arrivals(spark, landing, schema), folder, **settings)


def test_texts_are_composed_without_python(spark):
    texts = [None, "", "plain", "é", "ạ̀ ö\n\0", "각 Å ﬁ", "\U0001d15e ̈́ ẍ́", "ü" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = df.select("doc_id", composed(F.col("text")).alias("nfc"))
    assert [r["nfc"] for r in found.orderBy("doc_id").collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    for plan in (found, V.piece_counts(df), V.token_counts(df, V.piece_lengths(V.piece_counts(df), []))):
        assert "Python" not in plan._jdf.queryExecution().optimizedPlan().toString().replace("MapInArrow", "")


def test_chains_and_merges_of_many_texts_at_once(spark):
    """Batches are searched as one row of symbols; nothing goes on from one text into the next."""
    import pyarrow as pa

    rng = random.Random(3)
    letters = "abcd\U00010400"

    def plain(text, pairs):
        start = 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in pairs:
                if i - start > 1:
                    yield text[start:i]
                start = i

    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.choice((0, 1, 2, 9)))) for _ in range(rng.randrange(8))]
        pairs = {"".join(rng.choices(letters, k=2)) for _ in range(rng.randrange(8))}
        want = [(i, chain) for i, text in enumerate(texts) for chain in plain(text, pairs)]
        batch = pa.array(["ab", *texts], pa.string()).slice(1)
        assert list(V.chains_in(batch, V.PairSet(pairs))) == want
    ids = [300, 301, 302, 300, 301, 5]
    merges = [(300, 301, 400, 9), (400, 302, 401, 5)]
    rows = ["".join(map(V.symbol, ids)), V.symbol(301) + V.symbol(300), V.symbol(300), ""]
    words = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "n long, s string").coalesce(1)
    got = {r["n"]: [V.token_id(c) for c in r["s"]] for r in V.with_merges(words, merges).collect()}
    assert got == {0: [401, 400, 5], 1: [301, 300], 2: [300], 3: []}
