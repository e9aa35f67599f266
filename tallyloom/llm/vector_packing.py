"""Vector bin packing of examples into sequences, by the dot product of needs and room.

A sequence has three limits: tokens, segments (pieces of examples) and loss-bearing tokens.
The next example of an open sequence is the one that fits and whose needs, each as a share of
its limit, have the largest dot product with the room left; when none fits whole, the best
one is cut to the room. Examples longer than a sequence first give whole sequences. The last
sequence of a window, and any that another limit closes with more than ``SLACK`` of its room left, is
cut into powers of two, which need no padding.

Packing runs in windows of ``WINDOW`` examples (fewer, once they hold ``WINDOW_IDS`` ids) within a partition, next
to the ids, so nothing is shuffled and a task holds one window. ``sequence_id`` is made of the partition and
a number in it. The same partitions give the same rows again, so a lost task can be redone.

Null texts count as empty: their one id is the end. A null or repeated key keeps its rows. A
null or negative prompt length is 0; the first ``prompt`` ids of an example bear no loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.pretokens import library_pretokens, with_end

WINDOW = 4096
WINDOW_IDS = 1 << 23
#: A sequence that closes with more room than this share of it is cut into powers of two.
SLACK = 1 / 16


def pack(tokens: np.ndarray, prompts: np.ndarray, room: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length); every id of every example lies in one piece."""
    capacity, segments, loss_cap = room
    if min(room) < 1:
        raise ValueError("limits must be positive")

    def loss(i: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, int(prompts[i])))

    def cut(i: int, start: int, space: int, bearing: int) -> int:
        """The most ids from ``start`` that fit ``space`` with ``bearing`` loss tokens."""
        free = max(0, int(prompts[i]) - start)
        return min(space, int(tokens[i]) - start, free + bearing)

    out: list[list[tuple[int, int, int]]] = []
    begin = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero(tokens > min(capacity, loss_cap)):
        while tokens[i] - begin[i] >= capacity and (size := cut(i, int(begin[i]), capacity, loss_cap)) == capacity:
            out.append([(int(i), int(begin[i]), size)])
            begin[i] += size
    left = tokens - begin
    bearing = np.maximum(0, tokens - np.maximum(begin, prompts))
    alive = np.flatnonzero(left > 0)
    scale = np.array([1 / capacity, 1 / segments, 1 / loss_cap])
    while len(alive):
        have = np.array([capacity, segments, loss_cap], np.int64)
        bin_: list[tuple[int, int, int]] = []
        while have[0] and have[1] and len(alive):
            need = np.stack([left[alive], np.ones(len(alive), np.int64), bearing[alive]], 1)
            score = (need * scale) @ (have * scale)
            fits = (need[:, 0] <= have[0]) & (need[:, 2] <= have[2])
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
                i = int(alive[at])
                size = int(left[i])
            else:
                at = int(np.argmax(score))
                i = int(alive[at])
                size = cut(i, int(begin[i]), int(have[0]), int(have[2]))
                if not size:
                    break
            bin_.append((i, int(begin[i]), size))
            have -= (size, 1, loss(i, int(begin[i]), size))
            begin[i] += size
            left[i] -= size
            bearing[i] = max(0, int(tokens[i]) - max(int(begin[i]), int(prompts[i])))
            if not left[i]:
                alive = np.delete(alive, at)
        out.append(bin_)
    last = len(out) - 1
    close = lambda i, b: i < last and sum(size for _, _, size in b) >= (1 - SLACK) * capacity
    return [part for i, b in enumerate(out) for part in ([b] if close(i, b) else powers(b, capacity))]


def powers(bin_: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """One sequence cut into sequences of falling powers of two, unless it is full."""
    rest = sum(size for _, _, size in bin_)
    if rest == capacity:
        return [bin_]
    out = []
    pieces = bin_[::-1]
    while rest:
        space = 1 << (rest.bit_length() - 1)
        rest -= space
        now = []
        while space:
            i, start, size = pieces.pop()
            take = min(size, space)
            now.append((i, start, take))
            space -= take
            if take < size:
                pieces.append((i, start + take, size - take))
        out.append(now)
    return out


def packed_texts(
    docs: DataFrame, tokenizer: str, end: int, tokens: int = 2048, segments: int = 64,
    loss_tokens: int = 2048, key: str = "doc_id", text: str = "text", prompt: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows; ``prompt`` names a column with the number of ids without loss."""
    room = (tokens, segments, loss_tokens)
    fields = [("doc_id", docs.schema[key].dataType.simpleString(), None), ("start", "long", pa.int64()),
              ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("doc_tokens", "long", pa.int64()),
              ("sequence_id", "long", pa.int64()), ("offset", "long", pa.int64()), ("loss_tokens", "long", pa.int64())]
    if with_ids:
        fields.append(("ids", "array<int>", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_pretokens(tokenizer)
        base = TaskContext.get().partitionId() << 40
        number = 0
        keys: list = []
        parts: list[np.ndarray] = []
        prompts: list[int] = []
        held_ids = 0

        def close(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number, held_ids
            held_ids = 0
            sizes = np.array([len(p) for p in parts], np.int64)
            free = np.clip(np.array(prompts, np.int64), 0, sizes)
            cols: list[list] = [[] for _ in fields]
            for sequence in pack(sizes, free, room):
                offset = 0
                for i, start, size in sequence:
                    ids = parts[i][start : start + size]
                    row = [keys[i], start, size, zlib.crc32(ids.tobytes()), int(sizes[i]), base + number, offset,
                           max(0, start + size - max(start, int(free[i])))]
                    for col, value in zip(cols, [*row, ids.astype(np.int32)] if with_ids else row, strict=True):
                        col.append(value)
                    offset += size
                number += 1
            for held in (keys, parts, prompts):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f[2] or kind) for c, f in zip(cols, fields, strict=True)], names=[f[0] for f in fields]
            )

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at, ids, counts in coder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end)
                stops = np.cumsum(counts)
                keys.extend(batch.column(0).slice(at, len(counts)).to_pylist())
                prompts.extend(batch.column(2).slice(at, len(counts)).to_pylist())
                parts.extend(np.split(ids.astype("<u4"), stops[:-1]))
                held_ids += len(ids)
                if len(keys) >= WINDOW or held_ids >= WINDOW_IDS:
                    yield close(kind)
        if keys:
            yield close(kind)

    free = F.lit(0) if prompt is None else F.coalesce(F.col(prompt), F.lit(0))
    rows = docs.select(F.col(key), F.col(text), free.cast("long").alias("_prompt"))
    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind, _ in fields))
