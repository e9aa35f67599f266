"""Rendezvous hashing of record keys over weighted shards, and gapless places in them.

Each (key, shard) pair has a hash of its own, from the first 48 bits of an MD5 digest of
``key:shard``; the score is ``weight / -ln(u)`` with ``u`` the hash in (0, 1), and the shard of
highest score takes the key (the lower number on a tie). A further shard can only win keys
for itself. All of it is column expressions; there is no shuffle but for the places.

A null key is the key ``null``; rows with equal keys share a shard and lie side by side in
it, in order of size, checksum. Null texts have no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 16_384
MIN_RANGES = 64


def hashed(key: Column, suffix: str) -> Column:
    """48 bits of a digest that any engine can repeat."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(suffix))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long")


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    number = hashed(key, f":{shard}").cast("double")
    return F.lit(float(weight)) / -F.log((number + F.lit(0.5)) / F.lit(float(1 << 48)))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key; a weight that is not positive takes no keys."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    scores = [F.struct(shard_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in live]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within ``shard``.

    Rows are ranked within hash ranges of a shard, sized by the number of rows, and the
    ranges' counts are added up; no task holds a shard. Equal keys share a range.
    """
    n = rows.count()
    ranges = max(MIN_RANGES, n // RANGE_ROWS)
    placed = rows.withColumn("_range", (hashed(F.col(order[0]), "") % ranges).cast("int"))
    within = Window.partitionBy("shard", "_range").orderBy(*order)
    before = Window.partitionBy("shard").orderBy("_range")
    sums = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    bases = sums.select("shard", "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(bases, ["shard", "_range"])
        .withColumn("slot", (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_range", "_rank", "_base")
    )


def sharded(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum, shard and place of every row, and its shard with one more of weight 1."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    return with_places(rows, ["doc_id", "size", "text_crc32"])
