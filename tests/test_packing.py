import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import packing as P
from tallyloom.operators.ordered import totals_by_key
from tallyloom.sources import shards
from tallyloom.plans.incremental import DOCUMENTS, streamed_token_counts
from tallyloom.streaming import jobs


def brute_shards(sizes, limit):
    shard, filled, out = 0, 0, []
    for n in sizes:
        if filled and filled + n > limit:
            shard, filled = shard + 1, 0
        filled += n
        out.append(shard)
        if filled >= limit:
            shard, filled = shard + 1, 0
    return out


def placed(spark, sizes):
    df = spark.createDataFrame(
        [(i, "s%d" % (i % 3), n) for i, n in enumerate(sizes)], "doc_id long, source string, n_tokens long"
    )
    return totals_by_key(df, {"before": F.col("n_tokens"), "position": F.lit(1)}, "doc_id")


@pytest.mark.parametrize("seed", range(4))
def test_aligned_shards(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 5, 8, 30]) for _ in range(90)]
    limit = rng.choice([6, 13, 40])
    got = P.aligned_shards(placed(spark, sizes), limit, rows_per_chunk=7).orderBy("doc_id").collect()
    assert [r["shard_id"] for r in got] == brute_shards(sizes, limit)
    fill = {}
    for r in got:
        fill.setdefault(r["shard_id"], []).append(r["n_tokens"])
    assert all(sum(v) <= limit or len(v) == 1 for v in fill.values())


def test_equal_documents_never_merge_chains(spark):
    sizes = [7] * 60
    got = P.aligned_shards(placed(spark, sizes), 20, rows_per_chunk=7).orderBy("doc_id").collect()
    assert [r["shard_id"] for r in got] == brute_shards(sizes, 20)


@pytest.mark.parametrize("sizes,limit,chunk", [([7] * 60, 20, 7), ([1, 2, 9, 1, 1, 4] * 12, 30, 4)])
def test_tables_of_chunks_join(spark, monkeypatch, sizes, limit, chunk):
    """Several levels, and chunks shorter than a shard, which packing may pass over."""
    monkeypatch.setattr(P, "FAN", 3)
    got = P.aligned_shards(placed(spark, sizes), limit, rows_per_chunk=chunk).orderBy("doc_id").collect()
    assert [r["shard_id"] for r in got] == brute_shards(sizes, limit)


def test_joined_tables_by_hand():
    """A joined table says the same as its parts one after the other."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 9, 24)
        begins = np.cumsum(sizes) - sizes
        limit = int(rng.integers(3, 40))
        parts = [
            P._chunk_exits(pd.DataFrame({"before": begins[i : i + 4], "n_tokens": sizes[i : i + 4], "block": i // 4}), limit)
            for i in range(0, 24, 4)
        ]
        whole = P._joined_exits(pd.concat(parts).assign(parent=0))
        for entry in range(limit):
            at = entry
            for part in parts:
                at = P._left_at(part, at)
            assert P._left_at(whole, entry) == at


def test_appending_equals_packing_at_once(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 9) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    state, got = P.OpenShard(), []
    for low, high in ((0, 13), (13, 14), (14, 50)):
        part = df.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        packed, state = P.append_aligned(part, "doc_id", 15, state, rows_per_chunk=6)
        got += packed.collect()
    got.sort(key=lambda r: r["doc_id"])
    assert [r["shard_id"] for r in got] == brute_shards(sizes, 15)
    assert state.tokens == sum(sizes) and state.rows == 50


def test_windows_give_back_the_stream(spark):
    rng = random.Random(3)
    docs = [[rng.randint(2, 31) for _ in range(rng.choice([0, 1, 4, 50]))] + [1] for _ in range(40)]
    rows, before = [], 0
    for i, ids in enumerate(docs):
        rows.append((i, before, len(ids), ids))
        before += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, before long, n_tokens long, ids array<int>")
    got = P.fixed_windows(df, 16).orderBy("window_id").collect()
    stream = [x for ids in docs for x in ids]
    assert len(got) == len(stream) // 16
    assert [x for r in got for x in r["ids"]] == stream[: len(got) * 16]
    train, held = P.tail_split(P.fixed_windows(df, 16), len(got), 3)
    assert train.select("window_id").intersect(held.select("window_id")).count() == 0
    assert train.count() + held.count() == len(got)
    for bad in (0, len(got)):
        with pytest.raises(ValueError):
            P.tail_split(df, len(got), bad)


def test_stored_shards(spark, tmp_path):
    sizes = [3, 4, 5, 6, 7, 8]
    packed = P.aligned_shards(placed(spark, sizes), 10)
    path, listing = str(tmp_path / "s"), str(tmp_path / "m")
    shards.write_shards(packed, path)
    stored = shards.read_shards(spark, path)
    shards.write_manifest(stored, listing)
    listed = shards.read_manifest(spark, listing)
    assert P.validate_shards(stored, listed).count() == 0
    assert stored.count() == len(sizes)
    assert P.first_shards(stored, listed, 2).select("shard_id").distinct().count() == 2
    with pytest.raises(ValueError):
        P.first_shards(stored, listed, 99)
    one = P.manifest(packed).filter("shard_id = 0").first()
    assert one["tokens"] == sum(one["source_counts"].values()) == 7
    assert one["example_counts"] == {"s0": 1, "s1": 1}


def test_a_changed_stream_is_refused(spark, tmp_path):
    jobs.check_settings(spark, str(tmp_path / "job"), {"shard_size": 5})
    jobs.check_settings(spark, str(tmp_path / "job"), {"shard_size": 5})
    with pytest.raises(ValueError):
        jobs.check_settings(spark, str(tmp_path / "job"), {"shard_size": 6})


def test_a_table_arrives_from_one_file_or_from_part_files(spark, tmp_path):
    rows = [(i, "one two three"[: 3 + 4 * (i % 3)] if i else "", "en", f"s{i % 2}", 9) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "single" / "documents.parquet")
    want = {"s0": 5, "s1": 6}
    for folder in ("parts", "single"):
        got = {r["source"]: r for r in streamed_token_counts(spark, str(tmp_path / folder)).collect()}
        assert {k: r["examples"] for k, r in got.items()} == want
        assert sum(r["tokens"] for r in got.values()) == sum(len(r[1].split()) + 1 for r in rows if r[1])
    none = tmp_path / "none"
    docs.where("doc_id < 1").write.parquet(str(none / "documents.parquet"))
    assert streamed_token_counts(spark, str(none)).count() == 0


def test_many_shards_share_few_folders(spark, tmp_path):
    packed = P.aligned_shards(placed(spark, [3] * 50 + [7, 9]), 10)
    path = str(tmp_path / "s")
    shards.write_shards(packed, path, most=5)
    assert 1 < len(list((tmp_path / "s").glob("shard_id=*"))) <= 5
    stored = shards.read_shards(spark, path)
    assert sorted(stored.columns) == sorted(packed.columns)
    assert sorted(map(tuple, stored.select(*packed.columns).collect())) == sorted(map(tuple, packed.collect()))
