"""Token id files: canonical length-limited Huffman code from global counts.

Writing: texts are tokenised once (a pinned table), ids are counted over all rows, the code
is made from the counts, and each document is coded on its own. Documents are then dealt
into ranges of the key, sorted there, and joined into blocks; a file row is one block::

    bucket, block     ranges in key order; blocks within a range
    before            ids of the range in earlier blocks
    keys, counts      per document
    places            byte where each document's bits start
    marks             per 512 ids, the bit offset within the document
    code              the bits, high bit first

The code itself is a table of (id, bits); codes follow from the lengths. Blocks decode
alone, and each mark starts a lane of its own, so that one table look-up per step advances
all lanes of a block.

Null texts count as empty; a null key comes first. Rows with equal keys stay apart, ordered
by their code. A table without rows gives a code without ids and no blocks.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.pretokens import forget, library_pretokens, with_end
from tallyloom.sources.workspace import pin

LANE = 512
BLOCK_IDS = 1 << 18
RANGE_IDS = 1 << 23
MAX_RANGES = 1 << 14


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths up to ``limit`` for positive counts, by merging packages of coins."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    row, owners = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        mixed = np.concatenate([leaves, pairs])
        sort = np.argsort(mixed, kind="stable")
        row = mixed[sort]
        owners.append(sort < n)
    lengths = np.zeros(n, np.int64)
    taken = 2 * n - 2
    for own in reversed(owners):
        single = int(own[:taken].sum())
        lengths[:single] += 1
        taken = 2 * (taken - single)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: by length, then id; the first of each length follows the last one."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, limit: int):
        order = np.lexsort((ids, bits))
        ids, bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.limit = limit
        size = int(ids.max()) + 1 if len(ids) else 1
        span = np.int64(1) << (limit - bits)
        start = np.cumsum(span) - span
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.bits[ids], self.codes[ids] = bits, (start >> (limit - bits)).astype(np.uint64)
        self.table = np.zeros(1 << limit, np.int64)
        self.table[: int(span.sum())] = np.repeat(ids << 5 | bits, span)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """The bits of each document from a whole byte on, and its marks."""
        bits = self.bits[ids]
        ends, stops = np.cumsum(bits), np.cumsum(counts)
        begin = stops - counts
        total = np.concatenate([[0], ends])
        used = total[stops] - total[begin]
        room = (used + 7) >> 3
        first = (np.cumsum(room) - room) << 3
        at = ends - bits + np.repeat(first - total[begin], counts)
        value = self.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        n = int(room.sum() // 4 + 3)
        # The parts of a word have no bit in common, so sums in doubles are exact.
        filled = np.bincount(word, (value >> np.uint64(32)).astype(float), n)
        filled += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n)
        data = filled.astype(">u4").tobytes()
        offset = (first >> 3).tolist()
        lanes = (counts + LANE - 1) // LANE
        step = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        marks = at[np.repeat(begin, lanes) + step * LANE] - np.repeat(first, lanes)
        cut = np.split(marks.astype("<u4"), np.cumsum(lanes)[:-1])
        return [data[a : a + size] for a, size in zip(offset, room.tolist(), strict=True)], cut

    def decode(self, data: bytes, places: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of a block; every mark is followed at once."""
        raw = np.frombuffer(data + bytes(LANE * 4 + 8), np.uint8).astype(np.int64)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        lanes = (counts + LANE - 1) // LANE
        step = np.arange(len(marks)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        sizes = np.minimum(LANE, np.repeat(counts, lanes) - step * LANE)
        order = np.argsort(-sizes, kind="stable")
        at = (np.repeat(places * 8, lanes) + marks)[order]
        sizes, to = sizes[order], (np.cumsum(sizes) - sizes)[order]
        out = np.empty(int(counts.sum()), np.uint32)
        shift, mask = 32 - self.limit, (1 << self.limit) - 1
        running = np.searchsorted(-sizes, -np.arange(LANE), "left")
        for k in range(LANE):
            n = running[k]
            if not n:
                break
            now = at[:n]
            found = self.table[(window[now >> 3] >> (shift - (now & 7))) & mask]
            out[to[:n] + k] = found >> 5
            now += found & 31
        return out


def _tokenise(path: str, end: int, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_pretokens(path)
        for batch in batches:
            for at, ids, counts in coder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end)
                data = ids.astype(width).tobytes()
                size = np.dtype(width).itemsize
                stops = np.concatenate([[0], np.cumsum(counts) * size]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(counts)), pa.array([data[a:b] for a, b in zip(stops, stops[1:])], pa.binary())],
                    names=["key", "ids"],
                )

    return run


def _count(width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                got = np.bincount(np.frombuffer(b"".join(batch.column(0)[at : at + 256].to_pylist()), width))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return run


def _code(ids: np.ndarray, bits: np.ndarray, limit: int, bounds: list, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        code = Code(ids, bits, limit)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = part.column(1).to_pylist()
                flat = np.frombuffer(b"".join(raw), width)
                counts = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(width).itemsize
                data, marks = code.encode(flat, counts)
                keys = part.column(0).to_pylist()
                bucket = [0 if k is None else bisect.bisect_right(bounds, k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), part.column(0), pa.array(counts, pa.int64()),
                     pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(data, pa.binary())],
                    names=["bucket", "key", "n", "marks", "code"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the sorted documents of each bucket into blocks."""
    schema = pa.schema([
        ("bucket", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int64())), ("marks", pa.binary()), ("code", pa.binary()),
    ])
    now: list = []
    state = {"bucket": None, "block": 0, "before": 0, "ids": 0}

    def close() -> pa.RecordBatch:
        sizes = [len(x[3]) for x in now]
        places = (np.cumsum(sizes) - sizes).tolist()
        row = [[state["bucket"]], [state["block"]], [state["before"]], [state["ids"]],
               [[x[0] for x in now]], [[x[1] for x in now]], [places],
               [b"".join(x[2] for x in now)], [b"".join(x[3] for x in now)]]
        state.update(block=state["block"] + 1, before=state["before"] + state["ids"], ids=0)
        now.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for bucket, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != state["bucket"]:
                if now:
                    yield close()
                state.update(bucket=bucket, block=0, before=0, ids=0)
            now.append(doc)
            state["ids"] += doc[1]
            if state["ids"] >= BLOCK_IDS:
                yield close()
    if now:
        yield close()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end: int, limit: int = 16,
    key: str = "doc_id", text: str = "text", vocabulary: int = 1 << 16,
) -> None:
    """Tokenise ``text``, append ``end``, and write the ids in order of the integer ``key``.

    ``vocabulary`` bounds the ids, and with them what the driver holds: a count for each.
    """
    spark = docs.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = pin(
        docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(_tokenise(tokenizer, end, width), "key long, ids binary")
    )
    counts = tokens.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = np.array([r["id"] for r in counts], np.int64)
    n = np.array([r["n"] for r in counts], np.int64)
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    bits = limited_lengths(n, limit)
    ranges = int(min(MAX_RANGES, max(1, n.sum() // RANGE_IDS)))
    shares = [i / ranges for i in range(1, ranges)]
    found = tokens.agg(F.percentile_approx("key", shares, 10 * ranges).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(found or []))
    spark.createDataFrame(list(zip(ids.tolist(), bits.tolist(), strict=True)), "id long, bits long").write.parquet(f"{path}/code")
    coded = tokens.mapInArrow(
        _code(ids, bits, limit, bounds, width), "bucket int, key long, n long, marks binary, code binary"
    )
    blocks = coded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "key", "code").mapInArrow(
        _blocks,
        "bucket int, block long, before long, n_ids long, keys array<long>, counts array<long>, places array<long>, marks binary, code binary",
    )
    blocks.write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, limit: int = 16) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids`` (binary,
    little-endian unsigned 32 bits). The driver holds one sum for each range."""
    code = spark.read.schema("id long, bits long").parquet(f"{path}/code").collect()
    ids, bits = [r["id"] for r in code], [r["bits"] for r in code]
    blocks = spark.read.schema(
        "bucket int, block long, before long, n_ids long, keys array<long>, counts array<long>, places array<long>, marks binary, code binary"
    ).parquet(f"{path}/blocks")
    sums = dict(blocks.groupBy("bucket").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for bucket in sorted(sums):
        base[bucket] = total
        total += sums[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        book = Code(np.array(ids, np.int64), np.array(bits, np.int64), limit)
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, _, before, _, keys, counts, places, marks, data = (c[row] for c in batch.columns)
                counts, places = (np.array(x.as_py(), np.int64) for x in (counts, places))
                got = book.decode(data.as_py(), places, counts, np.frombuffer(marks.as_py(), "<u4").astype(np.int64))
                stops = np.cumsum(counts)
                raw, at = got.astype("<u4").tobytes(), np.concatenate([[0], stops * 4]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(stops - counts + before.as_py() + base[bucket.as_py()]), pa.array(counts),
                     pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
