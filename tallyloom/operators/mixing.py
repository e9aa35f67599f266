"""Mixing sources by token quota, by weight, and with replay."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.draws import exponential, uniform
from tallyloom.operators.ordered import running_totals, totals_by_key, totals_by_sort
from tallyloom.sources.workspace import pin


@dataclass(frozen=True)
class SourceShare:
    name: str
    weight: float


def normalised(weights: Sequence[float] | None, count: int) -> list[float]:
    """Weights that sum to one; ``None`` means equal shares."""
    if weights is None:
        return [1.0 / count for _ in range(count)]
    if len(weights) != count:
        raise ValueError(f"{len(weights)} weights given for {count} sources")
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return [w / total for w in weights]


def share_table(spark: SparkSession, shares: Sequence[SourceShare]) -> DataFrame:
    """One row per configured source, in list order."""
    rows = [(s.name, i, float(s.weight)) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "source string, source_pos int, weight double")


def only_sources(df: DataFrame, wanted: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Keep the named sources; it is an error when none of them is known."""
    kept = [k for k in known if k in set(wanted)]
    if not kept:
        raise ValueError(f"no source matches {list(wanted)}")
    return df.filter(F.col("source").isin(kept))


def quota_mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", slices: int = 8192
) -> DataFrame:
    """Documents in the order in which the least-served source is always taken next.

    ``docs`` holds source, ``key`` (unique integer, the source order) and n_tokens;
    ``targets`` holds source, source_pos, target and target_total. The share of its
    target a source had received before a document decides when that document is
    taken, so the loop is a sort on that share. The share also cuts the sort into
    slices of about equal token counts. The rated rows are pinned, because the slices
    are summed and then sorted.
    """
    served = totals_by_key(
        docs, {"source_before": F.col("n_tokens")}, key, groups=["source"]
    )
    rated = pin(
        served.join(targets.filter(F.col("target") > 0), "source")
        .withColumn("served_share", F.col("source_before") / F.col("target"))
        .filter(F.col("served_share") < 1)
    )
    placed = running_totals(
        rated,
        {"before": F.col("n_tokens"), "position": F.lit(1)},
        F.floor(F.col("served_share") * slices).cast("long"),
        [F.col("served_share"), F.col("source_pos"), F.col(key)],
    )
    return placed.filter(F.col("before") < F.col("target_total"))


def weighted_order(
    rows: DataFrame, shares: DataFrame, seed: int, key: str = "doc_id"
) -> DataFrame:
    """Arrival time of each row when sources are drawn at random by weight.

    Rows of a source arrive as a Poisson stream with the weight as its rate. The
    merged streams pick sources by weight, and once one has ended the others keep
    their relative weights. Waits are whole numbers of 2^-20, so that sums do not depend
    on how rows are grouped.
    """
    wait = exponential(seed, F.col("source"), F.col(key)) / F.col("weight")
    gaps = rows.join(shares.filter(F.col("weight") > 0), "source").withColumn(
        "_gap", F.floor(wait * F.lit(float(1 << 20))).cast("long")
    )
    timed = totals_by_key(gaps, {"_waited": F.col("_gap")}, key, groups=["source"])
    return timed.withColumn("arrival", F.col("_waited") + F.col("_gap")).drop(
        "_waited", "_gap"
    )


def weighted_mix(
    rows: DataFrame,
    shares: DataFrame,
    seed: int,
    key: str = "doc_id",
    target_tokens: int | None = None,
) -> DataFrame:
    """Rows with their 0-based draw position; stops at ``target_tokens`` when given."""
    timed = weighted_order(rows, shares, seed, key)
    values = {"position": F.lit(1)}
    if target_tokens is not None:
        values["before"] = F.col("n_tokens")
    ordered = totals_by_sort(timed, values, [F.col("arrival"), F.col("source"), F.col(key)])
    if target_tokens is None:
        return ordered
    return ordered.filter(F.col("before") < target_tokens)


def interleave_with_replay(
    rows: DataFrame, shares: Sequence[SourceShare], seed: int, key: str = "doc_id"
) -> DataFrame:
    """Draw sources by weight, replaying ended ones, until each has ended once.

    Returns one row per draw: draw number, source, replay round and the source row.
    """
    spark = rows.sparkSession
    probabilities = normalised([s.weight for s in shares], len(shares))
    sizes = {
        r["source"]: r["n"]
        for r in rows.filter(F.col("source").isin([s.name for s in shares]))
        .groupBy("source")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    empty = [s.name for s in shares if not sizes.get(s.name)]
    if empty:
        raise ValueError(f"sources without rows: {empty}")
    if min(probabilities) <= 0:
        raise ValueError("every interleaved source needs a positive weight")

    edges, reached = [], 0.0
    for p in probabilities:
        reached += p
        edges.append(reached)
    pick = F.lit(shares[-1].name)
    for share, edge in reversed(list(zip(shares[:-1], edges[:-1]))):
        pick = F.when(F.col("_u") < F.lit(edge), F.lit(share.name)).otherwise(pick)

    longest = max(sizes[s.name] / p for s, p in zip(shares, probabilities))
    draws_made = int(longest + 8 * math.sqrt(longest) + 64)
    while True:
        draws = (
            spark.range(draws_made)
            .withColumnRenamed("id", "draw")
            .withColumn("_u", uniform(seed, F.col("draw")))
            .select("draw", pick.alias("source"))
        )
        counted = totals_by_key(draws, {"taken": F.lit(1)}, "draw", groups=["source"])
        size_of = F.create_map(*[F.lit(v) for s in shares for v in (s.name, sizes[s.name])])
        ends = {
            r["source"]: r["draw"]
            for r in counted.filter(F.col("taken") == size_of[F.col("source")] - 1)
            .select("source", "draw")
            .collect()
        }
        if len(ends) == len(shares):
            break
        draws_made *= 2

    indexed = totals_by_key(
        rows.filter(F.col("source").isin(list(sizes))),
        {"_row": F.lit(1)},
        key,
        groups=["source"],
    )
    kept = counted.filter(F.col("draw") <= max(ends.values())).select(
        "draw",
        "source",
        F.call_function("div", F.col("taken"), size_of[F.col("source")].cast("long")).alias("replay"),
        (F.col("taken") % size_of[F.col("source")]).alias("_row"),
    )
    return kept.join(indexed, ["source", "_row"]).drop("_row")


def epoch_assignment(
    rows: DataFrame, world: int, seed: int, epoch: int, key: str
) -> DataFrame:
    """Shuffled position and worker of each row; the uneven tail is dropped."""
    total = rows.count()
    keyed = rows.withColumn("_order", uniform(seed, F.lit(epoch), F.col(key)))
    slices = max(1, total // 65536)
    placed = running_totals(
        keyed,
        {"position": F.lit(1)},
        F.floor(F.col("_order") * slices).cast("long"),
        [F.col("_order"), F.col(key)],
    ).drop("_order")
    even = total // world * world
    return placed.filter(F.col("position") < even).withColumn(
        "worker", F.col("position") % world
    )


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """All rows in a seeded order."""
    return rows.orderBy(uniform(seed, F.col(key)), F.col(key))


def with_worker(rows: DataFrame, index: str, workers: int) -> DataFrame:
    """Round-robin worker number of every row of an indexed stream."""
    if workers < 1:
        raise ValueError("at least one worker is needed")
    return rows.withColumn("worker", F.pmod(F.col(index), F.lit(workers)))


def worker_rows(rows: DataFrame, index: str, workers: int, worker: int) -> DataFrame:
    """The rows one worker reads."""
    if not 0 <= worker < workers:
        raise ValueError(f"worker {worker} is outside 0..{workers - 1}")
    return with_worker(rows, index, workers).filter(F.col("worker") == worker).drop("worker")
