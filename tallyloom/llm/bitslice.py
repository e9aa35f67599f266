"""Exact top-k inner products with a bit-sliced index.

Components become whole numbers. The index keeps blocks of vectors as bit slices: for each
dimension and each high bit of the number (shifted to be at least 0), one bitmap over the
block's rows. A query adds the slices its weights select, with carry-save adders on whole
bitmaps, into a bit-sliced sum: each row's score but for a known error, since the low bits are left
out. Going down from the most significant slice of the sum finds the k-th largest; every row
that lies less than the error below it is looked up and scored exactly.
So the result is exact, ties included (smaller id first).

Vectors that are null or hold a null or non-finite component take no part, nor do rows
without id; vectors are compared with those of the same length only. A row never meets rows
of its own id. Queries meet the index in blocks: every block of queries with every block of
rows; each pair gives back at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin

ROWS = 8192
QUERIES = 64
HIGH_BITS = 8
MOST = 1 << 30


def usable(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id``, ``dim`` and ``q`` (array of long): floor(scale * x) of the rows that take part."""
    x = F.col(vector)
    wide = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(key).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
        .select(F.col(key).cast("long").alias("id"), F.size(x).alias("dim"), wide.alias("q"))
    )


def sliced(rows: np.ndarray, low: int) -> tuple[np.ndarray, int, int]:
    """Bitmaps [dimension, slice, word] of the high bits, the shift and the offset.

    A row's number is ``offset + (high << shift) + rest`` with ``0 <= rest < 1 << shift``.
    """
    top = int(rows.max(initial=low)) - low
    bits = max(1, top.bit_length())
    shift = max(0, bits - HIGH_BITS)
    high = ((rows - low) >> shift).T
    words = -(-rows.shape[0] // 64)
    padded = np.zeros((rows.shape[1], words * 64), np.int64)
    padded[:, : rows.shape[0]] = high
    planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits - shift)]
    return np.stack(planes, 1).view(np.uint64), shift, low


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum bitmaps given by weight: three of a weight become one and a carry, all at once."""
    out: list[np.ndarray] = []
    weight = 0
    carry: list[np.ndarray] = []
    while weight < len(columns) or carry:
        own = carry + (columns[weight] if weight < len(columns) else [])
        carry = []
        stack = np.concatenate([x if x.ndim == 2 else x[None] for x in own]) if own else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carry.append((a & b) | (c & half))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            else:
                carry.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if stack is not None else None)
        weight += 1
    return out


def bits_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), count=n, bitorder="little").astype(bool)


def weighted_sum(planes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of sum(|w| * t), ``t`` the high bits where ``w`` > 0 and their complement else."""
    size = np.abs(weights)
    highest = int(size.max(initial=0)).bit_length()
    columns: list[list[np.ndarray]] = [[] for _ in range(highest + planes.shape[1])]
    up, down = weights > 0, weights < 0
    for b in range(highest):
        has = (size >> b & 1).astype(bool)
        plus, minus = np.flatnonzero(has & up), np.flatnonzero(has & down)
        for s in range(planes.shape[1]):
            if len(plus):
                columns[b + s].append(planes[plus, s])
            if len(minus):
                columns[b + s].append(~planes[minus, s])
    return added(columns)


def kth_largest(slices: list[np.ndarray], alive: np.ndarray, k: int) -> int:
    """The k-th largest sum among the ``alive`` rows, from the most significant slice down."""
    sure, tied, value = np.zeros_like(alive), alive, 0
    for s in reversed(slices):
        high = tied if s is None else tied & s
        if s is None:
            high = np.zeros_like(alive)
        count = int(np.bitwise_count(sure | high).sum())
        value <<= 1
        if count >= k:
            tied, value = high, value | 1
        else:
            sure, tied = sure | high, tied & ~high
    return value


def at_least(slices: list[np.ndarray], alive: np.ndarray, least: int) -> np.ndarray:
    """Rows whose sum is ``least`` or more."""
    if least <= 0:
        return alive
    if least >> len(slices):
        return np.zeros_like(alive)
    more, tied = np.zeros_like(alive), alive
    for bit in range(len(slices) - 1, -1, -1):
        s = slices[bit] if slices[bit] is not None else np.zeros_like(alive)
        if least >> bit & 1:
            tied = tied & s
        else:
            more, tied = more | (tied & s), tied & ~s
    return more | tied


def top_rows(ids: np.ndarray, rows: np.ndarray, planes: np.ndarray, shift: int, low: int, query: int, weights: np.ndarray, k: int):
    """Positions and scores of the block's best ``k`` rows for one query, best first."""
    alive_rows = ids != query
    n = int(alive_rows.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > k and weights.any():
        words = np.packbits(np.pad(alive_rows, (0, planes.shape[2] * 64 - len(ids))), bitorder="little").view(np.uint64)
        slices = weighted_sum(planes, weights)
        bound = kth_largest(slices, words, k)
        # The rests move two scores apart by at most (2^shift - 1) * sum(|w|).
        slack = -(-((1 << shift) - 1) * int(np.abs(weights).sum()) // (1 << shift)) if shift else 0
        at = np.flatnonzero(bits_of(at_least(slices, words, bound - slack), len(ids)))
    else:
        at = np.flatnonzero(alive_rows)
    scores = rows[at] @ weights
    best = np.lexsort((ids[at], -scores))[:k]
    return at[best], scores[best]


def built_index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids, raw numbers and bit slices."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        dim = int(group["dim"].iloc[0])
        numbers = np.array(group["q"].tolist(), np.int64).reshape(len(group), dim)
        planes, shift, low = sliced(numbers, int(numbers.min(initial=0)))
        return pd.DataFrame(
            {
                "dim": [dim], "block": [int(group["block"].iloc[0])], "rows": [len(group)], "shift": [shift], "low": [low], "slices": [planes.shape[1]],
                "ids": [group["id"].to_numpy().tobytes()], "numbers": [numbers.astype("<i4").tobytes()],
                "planes": [planes.tobytes()],
            }
        )

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return rows.select("id", "dim", "q", block).groupBy("dim", "block").applyInPandas(
        run, "dim int, block long, rows int, shift int, low long, slices int, ids binary, numbers binary, planes binary"
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows where ``is_query`` holds."""
    numbers = pin(usable(vectors, key, vector, scale))
    shape = numbers.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(F.array_max(F.transform("q", lambda v: F.abs(v))), F.lit(0))).alias("top"),
        F.max("dim").alias("dim"),
    ).first()
    if (shape["top"] or 0) >= MOST or (shape["top"] or 0) ** 2 * (shape["dim"] or 1) >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    blocks = max(1, -(-shape["n"] // ROWS))
    index = pin(built_index(numbers, blocks))
    asked = numbers.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    parts = max(1, -(-asked.count() // QUERIES))
    groups = asked.groupBy(F.col("dim").alias("qdim"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(
        F.collect_list(F.struct("id", "q")).alias("asked")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                raw = np.frombuffer(row["numbers"], "<i4").astype(np.int64).reshape(len(ids), row["dim"])
                planes = np.frombuffer(row["planes"], np.uint64).reshape(row["dim"], row["slices"], -1)
                cols: list[list] = [[], [], []]
                for one in row["asked"]:
                    at, scores = top_rows(ids, raw, planes, row["shift"], row["low"], one["id"], np.array(one["q"], np.int64), k)
                    cols[0].extend([one["id"]] * len(at))
                    cols[1].extend(ids[at].tolist())
                    cols[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    # Each block of the index is a key of its own with a partition that is not merged with others, so
    # the queries of one length do not all meet all rows in one task.
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    place = [F.col("dim"), F.col("block")]
    asked_there = everywhere.withColumnRenamed("qdim", "dim").repartition(blocks, *place)
    pairs = index.repartition(blocks, *place).join(asked_there, ["dim", "block"]).drop("block", "part", "rows")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
