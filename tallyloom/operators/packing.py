"""Packing token sequences into shards and fixed windows.

Inputs hold ``before`` (tokens ahead of the row in the stream) and ``n_tokens``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.ordered import totals_by_key, whole
from tallyloom.sources.workspace import pin


FAN = 16
SAME = -1


def _chunk_starts(rows: pd.DataFrame, shard_size: int) -> pd.DataFrame:
    """Follow the shards through one chunk from the point where it is entered."""
    ordered = rows.sort_values("before")
    begins = ordered["before"].to_numpy()
    ends = begins + ordered["n_tokens"].to_numpy()
    reach, starts = int(ordered["entry"].iloc[0]), []
    while reach < ends[-1]:
        at = int(np.searchsorted(ends, reach, side="right"))
        starts.append(int(begins[at]))
        reach = int(max(begins[at] + shard_size, ends[at]))
    return pd.DataFrame({"before": np.array(starts, dtype="int64")})


def _chunk_exits(rows: pd.DataFrame, shard_size: int) -> pd.DataFrame:
    """Where packing leaves a chunk, for every point where it can enter it.

    From ``low`` on (up to the next ``low``) the chunk is left at ``leaves``, or passed over
    (``SAME``). No shard that began before the chunk reaches further than one shard into it.
    """
    ordered = rows.sort_values("before")
    begins = ordered["before"].to_numpy()
    ends = begins + ordered["n_tokens"].to_numpy()
    reach = np.maximum(begins + shard_size, ends)
    follows = np.searchsorted(ends, reach, side="right")
    own = np.arange(len(ends))
    last = np.where(follows == len(ends), own, np.minimum(follows, len(ends) - 1))
    while not np.array_equal(last, last[last]):
        last = last[last]
    low = np.append(np.concatenate([begins[:1], ends[:-1]]), ends[-1])
    leaves = np.append(reach[last], SAME)
    return _steps(low, leaves, int(ordered["block"].iloc[0]), begins[0] + shard_size)


def _steps(low: np.ndarray, leaves: np.ndarray, block: int, furthest: int | None = None) -> pd.DataFrame:
    """Steps that change something, up to ``furthest``."""
    kept = np.concatenate([[True], leaves[1:] != leaves[:-1]])
    if furthest is not None:
        kept &= low <= furthest
    return pd.DataFrame({"block": block, "low": low[kept], "leaves": leaves[kept]})


def _left_at(steps: pd.DataFrame, entry: int) -> int:
    at = max(0, int(np.searchsorted(steps["low"].to_numpy(), entry, side="right")) - 1)
    found = int(steps["leaves"].iloc[at])
    return entry if found == SAME else found


def _joined_exits(rows: pd.DataFrame) -> pd.DataFrame:
    """The steps of neighbouring blocks as those of one block."""
    low = leaves = None
    for _, steps in rows.sort_values(["block", "low"]).groupby("block", sort=True):
        then_low, then_leaves = steps["low"].to_numpy(), steps["leaves"].to_numpy()
        if low is None:
            low, leaves = then_low, then_leaves
            continue
        new_low, new_leaves = [], []
        passed = np.flatnonzero(leaves == SAME)
        fixed = leaves != SAME
        at = np.maximum(0, np.searchsorted(then_low, leaves[fixed], side="right") - 1)
        found = then_leaves[at]
        new_low.append(low[fixed])
        new_leaves.append(np.where(found == SAME, leaves[fixed], found))
        for i in passed:
            end = low[i + 1] if i + 1 < len(low) else np.iinfo(np.int64).max
            first = max(0, int(np.searchsorted(then_low, low[i], side="right")) - 1)
            stop = max(first + 1, int(np.searchsorted(then_low, end, side="left")))
            new_low.append(np.maximum(then_low[first:stop], low[i]))
            new_leaves.append(then_leaves[first:stop])
        low, leaves = np.concatenate(new_low), np.concatenate(new_leaves)
        order = np.argsort(low, kind="stable")
        low, leaves = low[order], leaves[order]
    return _steps(low, leaves, int(rows["parent"].iloc[0]))


def _passed_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit of each block below one that is entered at ``entry``."""
    entry, out = int(rows["entry"].iloc[0]), []
    for block, steps in rows.sort_values(["block", "low"]).groupby("block", sort=True):
        leaves = _left_at(steps, entry)
        out.append((int(block), entry, leaves))
        entry = leaves
    return pd.DataFrame(out, columns=["block", "entry", "leaves"])


@dataclass(frozen=True)
class OpenShard:
    """Where packing stopped: rows and tokens so far, shards begun, end of the open one."""

    rows: int = 0
    tokens: int = 0
    shards: int = 0
    reach: int = 0


def aligned_shards(
    docs: DataFrame,
    shard_size: int,
    rows_per_chunk: int = 1 << 20,
    after: OpenShard = OpenShard(),
) -> DataFrame:
    """Add ``shard_id``: the longest run of whole documents that fits, at least one.

    ``docs`` also holds ``position``. Where a shard starts depends on the one before
    it. The stream is cut into chunks of ``rows_per_chunk`` rows; each finds, for every
    point where it may be entered, where it is left. The tables of ``FAN`` chunks are
    joined into one, and so on up; the true entries are then passed down, and each chunk is
    walked once. The number of passes follows the logarithm of the number of chunks,
    whatever the lengths of the rows. A table has at most the rows of one shard.
    """
    return _aligned(docs, shard_size, rows_per_chunk, after)[0]


def _aligned(
    docs: DataFrame, shard_size: int, rows_per_chunk: int, after: OpenShard
) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    filled = docs.filter(F.col("n_tokens") > 0)
    spans = pin(
        filled.select(
            "before",
            "n_tokens",
            whole(F.col("position"), rows_per_chunk).alias("chunk"),
        )
    )

    chunks = sorted(r["chunk"] for r in spans.select("chunk").distinct().collect())
    if not chunks:
        return filled.withColumn("shard_id", F.lit(0).cast("long")), after.reach
    numbers = spark.createDataFrame(list(enumerate(chunks)), "block long, chunk long")
    blocks = spans.join(numbers, "chunk").select("block", "before", "n_tokens")
    steps = "block long, low long, leaves long"
    levels = [pin(blocks.groupBy("block").applyInPandas(lambda rows: _chunk_exits(rows, shard_size), steps))]
    width = len(chunks)
    parent = F.floor(F.col("block") / FAN).cast("long").alias("parent")
    while width > FAN:
        width = -(-width // FAN)
        under = levels[-1].select("*", parent)
        levels.append(pin(under.groupBy("parent").applyInPandas(_joined_exits, steps)))
    entries = spark.createDataFrame([(0, after.reach)], "parent long, entry long")
    for level in reversed(levels):
        under = level.select("*", parent).join(entries, "parent")
        found = pin(under.groupBy("parent").applyInPandas(_passed_down, "block long, entry long, leaves long"))
        entries = found.select(F.col("block").alias("parent"), "entry")
    reach = max(after.reach, found.agg(F.max("leaves")).first()[0])
    starts = (
        blocks.join(found.select("block", "entry"), "block")
        .groupBy("block")
        .applyInPandas(lambda rows: _chunk_starts(rows, shard_size), "before long")
        .withColumn("_starts", F.lit(1))
    )
    opened = filled.join(starts, "before", "left").withColumn(
        "_starts", F.coalesce("_starts", F.lit(0))
    )
    numbered = totals_by_key(opened, {"_opened": F.col("_starts")}, "position")
    shard_id = F.lit(after.shards - 1) + F.col("_opened") + F.col("_starts")
    return numbered.select(*docs.columns, shard_id.cast("long").alias("shard_id")), reach


def append_aligned(
    docs: DataFrame, key: str, shard_size: int, after: OpenShard, rows_per_chunk: int = 1 << 20
) -> tuple[DataFrame, OpenShard]:
    """Pack further documents in ``key`` order behind what is packed already."""
    placed = pin(
        totals_by_key(
            docs.filter(F.col("n_tokens") > 0),
            {"before": F.col("n_tokens"), "position": F.lit(1)},
            key,
        ).withColumns(
            {
                "before": F.col("before") + F.lit(after.tokens),
                "position": F.col("position") + F.lit(after.rows),
            }
        )
    )
    packed, reach = _aligned(placed, shard_size, rows_per_chunk, after)
    packed = pin(packed)
    total = packed.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("shard_id") + 1, F.lit(after.shards)).alias("shards"),
    ).first()
    return packed, OpenShard(
        after.rows + total["rows"], after.tokens + total["tokens"], total["shards"], reach
    )


def split_by_size(docs: DataFrame, size: int, id_name: str, arrays=("ids",)) -> DataFrame:
    """Cut rows at multiples of ``size`` in the stream: one output row per piece.

    Arrays named in ``arrays`` are cut along; ``piece_start`` orders pieces.
    """
    end = F.col("before") + F.col("n_tokens")
    numbers = F.sequence(
        whole(F.col("before"), size), whole(end - 1, size)
    )
    others = [c for c in docs.columns if c not in (*arrays, "before", "n_tokens")]

    pieces = docs.filter(F.col("n_tokens") > 0).select(*docs.columns, F.explode(numbers).alias("_piece"))
    # Cut after the explode: a slice inside a lambda would box all ids of the row for each piece.
    start = F.greatest(F.col("before"), F.col("_piece") * size)
    tokens = F.least(end, (F.col("_piece") + 1) * size) - start
    skip = (start - F.col("before")).cast("int")
    return pieces.select(
        *others, F.col("_piece").alias(id_name), start.alias("piece_start"), tokens.alias("piece_tokens"),
        *[F.slice(a, skip + 1, tokens.cast("int")).alias(a) for a in arrays],
    )


def fixed_windows(docs: DataFrame, length: int) -> DataFrame:
    """Back-to-back windows of ``length`` ids across all rows; the tail is dropped.

    Only pieces are shuffled, and one group never holds more than ``length`` ids.
    """
    pieces = split_by_size(
        docs.select("before", "n_tokens", "ids"), length, "window_id"
    )
    joined = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("piece_start", "ids"))),
            lambda p: p["ids"],
        )
    )
    return (
        pieces.groupBy("window_id")
        .agg(joined.alias("ids"), F.sum("piece_tokens").alias("_n"))
        .filter(F.col("_n") == length)
        .drop("_n")
    )


def tail_split(windows: DataFrame, total: int, eval_windows: int) -> tuple[DataFrame, DataFrame]:
    """The last ``eval_windows`` windows are held out; both sides must be non-empty."""
    if not 0 < eval_windows < total:
        raise ValueError(f"cannot hold out {eval_windows} of {total} windows")
    edge = total - eval_windows
    return (
        windows.filter(F.col("window_id") < edge),
        windows.filter(F.col("window_id") >= edge),
    )


def shard_source_counts(packed: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return packed.groupBy("shard_id", "source").agg(
        F.sum(tokens).alias("tokens"), F.count("*").alias("examples")
    )


def manifest(packed: DataFrame) -> DataFrame:
    """One row per shard: tokens, examples, and both again by source."""
    return (
        shard_source_counts(packed)
        .groupBy("shard_id")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum("examples").alias("examples"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("source", "tokens")))
            ).alias("source_counts"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("source", "examples")))
            ).alias("example_counts"),
        )
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Emitted against wanted tokens by source, sources without rows included."""
    emitted = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("emitted"), F.count("*").alias("examples")
    )
    filled = targets.join(emitted, "source", "left").fillna(0, ["emitted", "examples"])
    everything = W.partitionBy(F.lit(0))
    return filled.select(
        "source",
        "target",
        "emitted",
        "examples",
        (F.col("emitted") / F.sum("emitted").over(everything)).alias("emitted_share"),
        (F.col("target") / F.sum("target").over(everything)).alias("target_share"),
        (F.col("emitted") < F.col("target")).alias("exhausted"),
    )


def validate_shards(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Shards whose recount differs from the manifest, or that only one side knows."""
    recount = stored.groupBy("shard_id").agg(F.sum("n_tokens").alias("found_tokens"))
    both = recount.join(
        listed.select("shard_id", F.col("tokens").alias("listed_tokens")),
        "shard_id",
        "full_outer",
    )
    problem = (
        F.when(F.col("found_tokens").isNull(), "missing")
        .when(F.col("listed_tokens").isNull(), "unlisted")
        .when(F.col("found_tokens") != F.col("listed_tokens"), "token count differs")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def unlisted_shards(stored: DataFrame, listed: DataFrame) -> DataFrame:
    return stored.select("shard_id").distinct().join(listed, "shard_id", "left_anti")


def first_shards(packed: DataFrame, listed: DataFrame, count: int) -> DataFrame:
    """The first ``count`` shards by number; fewer than that is an error."""
    chosen = listed.select("shard_id").orderBy("shard_id").limit(count)
    if chosen.count() < count:
        raise ValueError(f"fewer than {count} shards exist")
    return packed.join(chosen, "shard_id", "left_semi")
