import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import mixing as M


def greedy(docs, targets, total):
    queues = {s: [d for d in docs if d[1] == s] for s, _ in targets}
    emitted = {s: 0 for s, _ in targets}
    done, order = 0, []
    while done < total:
        live = [
            (emitted[s] / t, i, s)
            for i, (s, t) in enumerate(targets)
            if t > 0 and queues[s] and emitted[s] / t < 1
        ]
        if not live:
            break
        source = min(live)[2]
        doc = queues[source].pop(0)
        order.append(doc[0])
        emitted[source] += doc[2]
        done += doc[2]
    return order


@pytest.mark.parametrize("seed", range(4))
def test_quota_mix_is_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    docs = [(i, rng.choice(names), rng.randint(1, 9)) for i in range(80)]
    targets = [(n, rng.choice([10.0, 25.0, 60.0, 0.0])) for n in names]
    total = rng.choice([40.0, 90.0, 1000.0])
    frame = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    wanted = spark.createDataFrame(
        [(n, i, t, total) for i, (n, t) in enumerate(targets)],
        "source string, source_pos int, target double, target_total double",
    )
    got = M.quota_mix(frame, wanted, slices=5).orderBy("position").collect()
    assert [r["doc_id"] for r in got] == greedy(docs, targets, total)
    assert [r["position"] for r in got] == list(range(len(got)))


def test_interleave_covers_every_source_and_replays(spark):
    rows = spark.range(60).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 50, "big").otherwise("small").alias("source")
    )
    shares = [M.SourceShare("big", 0.75), M.SourceShare("small", 0.25)]
    got = M.interleave_with_replay(rows, shares, seed=42).orderBy("draw").collect()
    assert [r["draw"] for r in got] == list(range(len(got)))
    assert {r["doc_id"] for r in got} == set(range(60))
    per_source = {}
    for r in got:
        per_source.setdefault(r["source"], []).append(r)
    sizes = {"big": 50, "small": 10}
    for name, part in per_source.items():
        lowest = 0 if name == "big" else 50
        for k, r in enumerate(part):
            assert (r["doc_id"] - lowest, r["replay"]) == (k % sizes[name], k // sizes[name])
    last = got[-1]
    assert last["doc_id"] in (49, 59) and last["replay"] == 0
    assert len(per_source["big"]) / len(got) > 0.6


def test_interleave_needs_rows(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        M.interleave_with_replay(rows, [M.SourceShare("a", 1), M.SourceShare("b", 1)], 1)


def test_weighted_mix_shares(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.element_at(F.array(*[F.lit(x) for x in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("source"),
    )
    shares = M.share_table(spark, [M.SourceShare("a", 5), M.SourceShare("b", 3), M.SourceShare("c", 2)])
    head = M.weighted_mix(rows, shares, seed=7).filter("position < 1500")
    got = {r["source"]: r["n"] / 1500 for r in head.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 0.5) < 0.05 and abs(got["b"] - 0.3) < 0.05 and abs(got["c"] - 0.2) < 0.05


def test_weights():
    assert M.normalised(None, 4) == [0.25] * 4
    assert M.normalised([1, 3], 2) == [0.25, 0.75]
    for bad in ([1], [-1, 2], [0, 0]):
        with pytest.raises(ValueError):
            M.normalised(bad, 2)


def test_only_sources(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    assert [r["doc_id"] for r in M.only_sources(rows, ["b"], ["a", "b"]).collect()] == [2]
    with pytest.raises(ValueError):
        M.only_sources(rows, ["x"], ["a", "b"])


def test_workers_share_all_rows(spark):
    rows = spark.range(23).withColumnRenamed("id", "k")
    got = M.epoch_assignment(rows, world=4, seed=1, epoch=0, key="k").collect()
    other = M.epoch_assignment(rows, world=4, seed=1, epoch=1, key="k").collect()
    assert sorted(r["position"] for r in got) == list(range(20))
    assert {r["worker"] for r in got} == {0, 1, 2, 3}
    assert {(r["k"], r["position"]) for r in got} != {(r["k"], r["position"]) for r in other}
    parts = [M.worker_rows(rows, "k", 3, w).count() for w in range(3)]
    assert sum(parts) == 23
    with pytest.raises(ValueError):
        M.worker_rows(rows, "k", 3, 3)
