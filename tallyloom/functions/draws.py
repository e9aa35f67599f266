"""Seeded draws that depend on a row's key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def key_hash(seed: int | str, *keys: Column) -> Column:
    """52-bit integer from a seed and the row's keys."""
    label = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(label.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column) -> Column:
    """Number in (0, 1): the hash is moved off zero so that its logarithm exists."""
    return (key_hash(seed, *keys) + F.lit(0.5)) / F.lit(_SCALE)


def exponential(seed: int | str, *keys: Column) -> Column:
    return -F.ln(uniform(seed, *keys))
