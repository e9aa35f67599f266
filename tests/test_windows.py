"""Stored shards, windows by offset and reweighting against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import windows as W
from tallyloom.sources.workspace import new_table_path

ROWS = "before long, n_tokens long, ids array<int>, mask array<int>, source string"


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(7)
    rows, at = [], 0
    for i in range(120):
        n = rng.choice((0, 1, 2, 5, 40, 300)) if i != 60 else 2500
        ids = [rng.randrange(1000) for _ in range(n)]
        rows.append((at, n, ids, [x % 2 for x in ids], f"s{rng.choice('aab')}"))
        at += n
    return rows


@pytest.fixture(scope="module")
def table(spark, stream):
    return spark.createDataFrame(stream, ROWS).repartition(5)


def cut(values, length):
    return {i: values[i * length : (i + 1) * length] for i in range(len(values) // length)}


@pytest.mark.parametrize(("shard", "run", "length"), [(700, 100, 64), (1000, 64, 64), (500, 30, 90), (10**6, 10**6, 7), (90, 200, 400)])
def test_windows_from_shards(spark, stream, table, shard, run, length):
    ids = [x for r in stream for x in r[2]]
    path = new_table_path(spark, "t")
    W.write_token_shards(table, path, shard, run, ("ids", "mask"))
    index = {r["shard_id"]: (r["first"], r["tokens"]) for r in W.shard_index(spark, path).collect()}
    assert index == {i: (i * shard, min(shard, len(ids) - i * shard)) for i in range(-(-len(ids) // shard))}
    runs = W.stored_runs(spark, path, ("ids", "mask"))
    assert runs.agg(F.max(F.size("ids"))).first()[0] <= run
    found = W.windows_of(runs, length, ("ids", "mask")).collect()
    want = cut(ids, length)
    assert len(found) == len(want) and {r["window_id"]: r["ids"] for r in found} == want
    assert all(r["mask"] == [x % 2 for x in r["ids"]] for r in found)
    some = [0, 3, len(want) // 2, len(want) - 1, len(want), len(want) + 50, 3]
    asked = spark.createDataFrame([(w,) for w in some], "window_id long")
    got = {r["window_id"]: r["ids"] for r in W.windows_at(spark, path, asked, length).collect()}
    assert got == {w: want[w] for w in some if w in want}
    low, high = len(want) // 3, len(want) // 2 + 1
    got = {r["window_id"]: r["ids"] for r in W.windows_between(spark, path, low, high, length).collect()}
    assert got == {w: want[w] for w in range(low, high)}
    assert W.windows_between(spark, path, 10**7, 10**7 + 1, length).count() == 0


def test_only_needed_shards_are_read(spark, table):
    path = new_table_path(spark, "t")
    W.write_token_shards(table, path, 500, 50)
    found = W.windows_between(spark, path, 20, 22, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan and "LessThan(first," in plan
    files = {r[0] for r in W.stored_runs(spark, path).filter("shard_id BETWEEN 2 AND 2").select(F.input_file_name()).collect()}
    assert files and all("shard_id=2" in f for f in files)


def test_nothing_to_store(spark, table):
    path = new_table_path(spark, "t")
    W.write_token_shards(table.where("n_tokens < 0").select("before", "n_tokens", "ids"), path, 500, 50)
    assert W.shard_index(spark, path).count() == 0
    assert W.windows_of(W.stored_runs(spark, path), 5).count() == 0
    assert W.windows_between(spark, path, 0, 3, 5).count() == 0
    assert W.windows_at(spark, path, spark.createDataFrame([(0,)], "window_id long"), 5).count() == 0


def test_reweighting(spark, stream, table):
    length = 50
    held = W.window_sources(table, length)
    want = {}
    for before, n, _, _, source in stream:
        for at in range(before, before + n):
            want[at // length, source] = want.get((at // length, source), 0) + 1
    assert {(r["window_id"], r["source"]): r["tokens"] for r in held.collect()} == want
    targets = spark.createDataFrame([("sa", 1), ("sb", 3)], "source string, target long")
    weights = W.window_weights(held, targets)
    now = {s: sum(v for (_, t), v in want.items() if t == s) for s in ("sa", "sb")}
    total = sum(now.values())
    factor = {s: t * total * 1_000_000 // (4 * now[s]) for s, t in (("sa", 1), ("sb", 3))}
    plain = {}
    for (w, s), v in want.items():
        plain[w] = plain.get(w, 0) + v * factor[s]
    assert {r["window_id"]: int(r["weight"]) for r in weights.collect()} == plain
    for draws, offset in ((1, 0.0), (37, 0.5), (1000, 0.999)):
        copies = {r["window_id"]: r["copies"] for r in W.resampled(weights, draws, offset).collect()}
        assert sum(copies.values()) == draws
        for w, weight in plain.items():
            expected = weight * draws / sum(plain.values())
            assert abs(copies.get(w, 0) - expected) < 1 + 1e-9
    drawn = W.resampled(weights, 2000)
    tokens = {r["source"]: r["t"] for r in held.join(drawn, "window_id").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert tokens["sb"] / sum(tokens.values()) > now["sb"] / total
    repeated = W.repeated_windows(held.select("window_id").distinct(), drawn)
    assert repeated.count() == 2000 and repeated.distinct().count() == 2000


def test_sources_without_target_or_weight(spark, table):
    held = W.window_sources(table, 50)
    none = spark.createDataFrame([("other", 1)], "source string, target long")
    weights = W.window_weights(held, none)
    assert weights.filter("weight <> 0").count() == 0
    with pytest.raises(ValueError):
        W.resampled(weights, 5)


@pytest.mark.parametrize("most", [1, 4, 512])
def test_many_shards_share_few_folders(spark, stream, table, most):
    ids = [x for r in stream for x in r[2]]
    path = new_table_path(spark, "t")
    W.write_token_shards(table, path, 90, 40, most=most)
    runs = W.stored_runs(spark, path)
    folders = {r[0].rsplit("/", 2)[1] for r in runs.select(F.input_file_name()).collect()}
    shards = -(-len(ids) // 90)
    assert len(folders) == (shards if most == 512 else most)
    got = {r["shard_id"]: r["n"] for r in runs.groupBy("shard_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {i: min(90, len(ids) - 90 * i) for i in range(shards)}
    want = cut(ids, 64)
    assert {r["window_id"]: r["ids"] for r in W.windows_of(runs, 64).collect()} == want
    asked = spark.createDataFrame([(w,) for w in (0, 7, len(want))], "window_id long")
    assert {r["window_id"]: r["ids"] for r in W.windows_at(spark, path, asked, 64).collect()} == {w: want[w] for w in (0, 7)}
    found = W.windows_between(spark, path, 9, 11, 64)
    assert {r["window_id"]: r["ids"] for r in found.collect()} == {w: want[w] for w in (9, 10)}


def test_ids_of_texts_by_batch(spark):
    from tallyloom.functions import tokens as K

    texts = ["a", "naïve 字😀", None, "x" * 700, "", "a\x00b"] * 90
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r["i"]: r["ids"] for r in rows.select("i", K.batch_char_ids(F.col("t")).alias("ids")).collect()}
    assert got == {i: None if t is None else [ord(c) % 30 + 2 for c in t] + [1] for i, t in enumerate(texts)}


def test_long_rows_are_not_boxed_or_repeated(spark, table):
    from tallyloom.operators.packing import split_by_size

    cut = split_by_size(table, 64, "w", ("ids", "mask"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in cut
    path = new_table_path(spark, "t")
    W.write_token_shards(table, path, 1000, 640)
    asked = spark.range(200).withColumnRenamed("id", "window_id")
    found = W.windows_at(spark, path, asked, 8)
    assert found.count() == 200
    # The ids of a run pass the join once, whatever number of its windows is asked for.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    joins = [i for i, line in enumerate(lines) if line.startswith("Join") and "run_id" in line]
    assert "explode(_asked" in " ".join(lines[: joins[0]])
