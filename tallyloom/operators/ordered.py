"""Ordered computations without a one-task window.

A plain ``sum() over (order by ...)`` sorts the whole table in one task. Here rows
are first put into ordered chunks, each chunk is summed, the chunk sums are
accumulated (one row per chunk), and the running value is finished inside each
chunk. Rows are shuffled once, on (group, chunk), whatever the group sizes are; the
chunk sums are added up before their shuffle. The input is read twice, so an expensive
one should be pinned or stored first, with the few columns the order needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin

CHUNK = 1 << 16
NARROWEST_CHUNK = 1 << 8
# Chunk sums of one group are accumulated in one task; this many are no burden.
MOST_CHUNKS = 1 << 20


def whole(number: Column, width: int) -> Column:
    """Integer quotient, exact for every long."""
    return F.call_function("div", number.cast("long"), F.lit(width).cast("long"))


def key_chunk(key: str, width: int = CHUNK) -> Column:
    """Chunk number of a unique integer key: at most ``2 * width`` rows share one."""
    return whole(F.col(key), width)


def running_totals(
    df: DataFrame,
    values: Mapping[str, Column],
    chunk: Column,
    order: Sequence[Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add, per name in ``values``, the exclusive running sum of its expression.

    ``chunk`` must not decrease along ``order`` inside a group.
    """
    keys = [*groups, "_chunk"]
    staged = df.withColumn("_chunk", chunk)
    for name, value in values.items():
        staged = staged.withColumn(f"_v_{name}", value)

    chunk_sums = staged.groupBy(*keys).agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values]
    )
    earlier = (
        W.partitionBy(*[F.col(g) for g in groups] or [F.lit(0)])
        .orderBy("_chunk")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = chunk_sums.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name in values
        ],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = staged.join(offsets, keys)
    kept = df.columns
    return joined.select(
        *kept,
        *[
            (
                F.col(f"_o_{name}")
                + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0))
            ).alias(name)
            for name in values
        ],
    )


def totals_by_key(
    df: DataFrame,
    values: Mapping[str, Column],
    key: str,
    groups: Sequence[str] = (),
    width: int | None = None,
    per_core: int = 4,
) -> DataFrame:
    """``running_totals`` in the order of a unique integer key.

    Chunks are equal key ranges, by default narrow enough to give every core ``per_core`` of them; rows
    that carry texts need more, so that a chunk is sorted in memory and tasks get equal shares. Keys
    with so wide gaps that the chunk sums would not fit one task are sorted into ranges
    instead.
    """
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    reach = 0 if ends["low"] is None else ends["high"] - ends["low"]
    if width is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        width = min(CHUNK, max(NARROWEST_CHUNK, reach // (per_core * cores)))
    if reach // width > MOST_CHUNKS:
        return totals_by_sort(df, values, [F.col(key)], groups)
    return running_totals(df, values, key_chunk(key, width), [F.col(key)], groups)


def totals_by_sort(
    df: DataFrame,
    values: Mapping[str, Column],
    order: Sequence[Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """``running_totals`` in any order; ``order`` must end in a unique column.

    Range partitions are the chunks. They are pinned, because sampling the ranges
    again could place a row differently.
    """
    whole_order = [*[F.col(g) for g in groups], *order]
    ranged = df.repartitionByRange(*whole_order).withColumn("_range", F.spark_partition_id())
    return running_totals(pin(ranged), values, F.col("_range"), order, groups).drop("_range")


def carry_forward(
    df: DataFrame,
    value: str,
    key: str,
    groups: Sequence[str],
    out: str,
    width: int = CHUNK,
) -> DataFrame:
    """Last non-null ``value`` at or before each row, in key order inside a group."""
    keys = [*groups, "_chunk"]
    staged = df.withColumn("_chunk", key_chunk(key, width))
    last_seen = staged.groupBy(*keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key))).alias("_last")
    )
    earlier = (
        W.partitionBy(*groups).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    entering = last_seen.select(
        *keys, F.last("_last", ignorenulls=True).over(earlier).alias("_entering")
    )
    inside = W.partitionBy(*keys).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return staged.join(entering, keys).select(
        *df.columns,
        F.coalesce(
            F.last(value, ignorenulls=True).over(inside), F.col("_entering")
        ).alias(out),
    )


def trailing_mean(
    df: DataFrame,
    value: str,
    position: str,
    groups: Sequence[str],
    window: int,
    out: str,
    width: int = CHUNK,
) -> DataFrame:
    """Mean of the last ``window`` values by dense position; the first ones stay raw.

    Each chunk also receives the ``window - 1`` rows before it, so no group has to
    sit in one task.
    """
    if not 1 <= window <= width:
        raise ValueError(f"window must be between 1 and {width}")
    home = whole(F.col(position), width)
    feeds_next = F.col(position) % width >= width - (window - 1)
    spread = df.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.when(feeds_next, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
                F.array(F.col("_home"))
            )
        ),
    )
    recent = (
        W.partitionBy(*groups, "_chunk").orderBy(position).rowsBetween(-(window - 1), 0)
    )
    return (
        spread.withColumn("_mean", F.avg(value).over(recent))
        .filter(F.col("_chunk") == F.col("_home"))
        .select(
            *df.columns,
            F.when(F.col(position) >= window - 1, F.col("_mean"))
            .otherwise(F.col(value))
            .alias(out),
        )
    )


def first_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], limit: int
) -> DataFrame:
    """First ``limit`` rows of each group; Spark cuts each partition before the shuffle."""
    numbered = df.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    )
    return numbered.filter(F.col("_rank") <= limit).drop("_rank")
