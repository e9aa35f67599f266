"""Word shingles of texts as sets of 64-bit hashes, and MinHash bands of the sets.

Words are runs of letters and digits of the lower-cased text; a shingle is five words in a
row, a text of fewer words has one shingle of all of them, a text without words none. Set
operations are done on the hashes: equal shingles have equal hashes, and two shingles of
10^6 differ in hash but for a chance of about 10^-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

from tallyloom.llm.pretokens import LETTER, NUMBER, classes, code_points

WORDS = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base)]))[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, from prefix sums of its characters."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    _, points = code_points(data)
    kind = classes()[points]
    inside = np.concatenate([[False], (kind == LETTER) | (kind == NUMBER), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(STEP, len(points)), powers(BACK, len(points))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up)])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = word_hashes(text or "")
    if not len(found):
        return found
    n = max(1, len(found) - words + 1)
    with np.errstate(over="ignore"):
        value = np.full(n, np.uint64(len(found) if len(found) < words else words))
        for k in range(min(words, len(found))):
            value = mixed(value * STEP + found[k : k + n])
    return np.unique(value)


def set_id(values: np.ndarray) -> bytes:
    """16 bytes that name the set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def text_id(text: str | None) -> bytes | None:
    """16 bytes that name a text without words, none for an empty one."""
    return hashlib.blake2b(text.encode(), digest_size=16, person=b"text").digest() if text else None


def band_plan(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands still find ``recall`` of the pairs at the
    threshold with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no plan reaches this recall with so few hashes")
    return best


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the MinHash signature of a set that is not empty."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * STEP)
    low = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    factors = seeds | np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            part = values[None, at : at + 4096] * factors[:, None]
            part ^= part >> np.uint64(32)
            part *= STEP
            np.minimum(low, part.min(1), out=low)
        key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for k in range(rows):
            key = mixed(key * STEP + low.reshape(bands, rows)[:, k])
    return key


