"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of ``length`` bytes has an anchor: the gram (``GRAM`` bytes, or a third of
a short window) of smallest hash in it. Windows in a row with the same anchor form a run; equal windows have equal anchors, so
they meet in the runs of one anchor, wherever they stand. Runs whose anchor occurs once hold
no repeat. Equal runs fall together into one with a weight.

What is left is indexed. The text of a run is read in steps: a symbol is a piece of
``length / STEPS`` bytes, the suffix of a place is the symbol there and those of each further
step, so a window is ``STEPS`` symbols. Shards (some runs each) sort their own suffixes and
form their transforms, the symbol before each suffix. Two shards are then merged: the
interleave of one's suffixes with the other's starts as unknown and is refined one symbol at
a time, by counting symbols in the other's transform, without sorting suffixes again. The
bounds of the counts after ``STEPS`` rounds are the suffixes with a common prefix of a whole
window; merged shards are merged on, and groups of weight two or more are the repeats.

Runs are dealt by anchor; tasks stream over anchors and index about ``UNIT`` symbols at a
time. An anchor with more than ``LIMIT`` different runs is not put into one task: its windows
are counted by their hash, with partial sums before the shuffle.

Symbols and runs are compared by 64-bit hashes. Nulls count as empty texts; texts shorter
than a window have no repeats. Rows that repeat whole (key and text) get the same spans; a
key with several texts keeps them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.pretokens import forget
from tallyloom.llm.rows import set_aside
from tallyloom.llm.shingles import BACK, STEP, mixed, powers
from tallyloom.sources.workspace import pin

GRAM = 128
STEPS = 4
UNIT = 300_000
SHARD = 100_000
LIMIT = 4096
PART = 1 << 20


def gram_of(length: int) -> int:
    return min(GRAM, length // 3)


class Prefix:
    """Hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = powers(BACK, n + 1)
        up = powers(STEP, n + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])
        self.total = np.concatenate([[np.uint64(0)], sums])

    def all(self, width: int) -> np.ndarray:
        """The hash of every substring of ``width`` bytes."""
        with np.errstate(over="ignore"):
            n = len(self.total) - width
            return mixed((self.total[width:] - self.total[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.total[end] - self.total[start]) * self.down[start]
            return mixed(value + mixed((end - start).astype(np.uint64)))


def window_runs(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, number of windows, anchor hash and content hash of each run of a text."""
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(whole) - length + 1, PART):
        sums = Prefix(whole[begin : begin + PART + length - 1])
        grams = sums.all(gram)
        place = np.uint64((1 << 24) - 1)
        low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        wide, span = length - gram + 1, 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if wide > span:
            low = np.minimum(low[: span - wide], low[wide - span :])
        anchor = (low & place).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(start[1:], len(anchor))
        content = sums.of(start, end - 1 + length)
        yield start + begin, end - start, grams[anchor[start]], content


class Index:
    """Suffixes of runs in order: their places, the symbols before them, and which of them
    have a common prefix of a whole window with the suffix before.

    Places number the symbols of all runs of the unit and the end of every chain of steps;
    ``symbol`` is 0 at an end, ``after`` the place one step on.
    """

    def __init__(self, places: np.ndarray, before: np.ndarray, joined: np.ndarray):
        self.places, self.before, self.joined = places, before, joined


def shard_index(places: np.ndarray, symbol: np.ndarray, before: np.ndarray, after: np.ndarray, deepest: int) -> Index:
    """Sort the suffixes of some places (all of their chains) by doubling ranks."""
    local = np.empty(int(places.max()) + 1, np.int64)
    local[places] = np.arange(len(places))
    nxt = local[after[places]]
    rank = symbol[places].astype(np.int64)
    # An end differs from every other end, in the order of places.
    ends = rank == 0
    rank = rank + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    depth, top, at_window = 1, int(rank.max()) + 1, None
    while depth < deepest:
        key = np.where(ends, rank * top, rank * top + rank[nxt])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(len(key), np.int64)
        rank[order] = fresh
        ends, nxt = ends | ends[nxt], np.where(ends, nxt, nxt[nxt])
        top, depth = int(fresh[-1]) + 1, depth * 2
        if depth == STEPS:
            at_window = rank
    order = np.argsort(rank, kind="stable")
    window = at_window[order]
    joined = np.concatenate([[False], window[1:] == window[:-1]])
    return Index(places[order], before[places[order]], joined)


def merged(a: Index, b: Index, symbol: np.ndarray, after: np.ndarray, size: int) -> Index:
    """Merge two indexes by refining the interleave of ``a``'s suffixes with ``b``'s."""
    n = len(b.places)
    counts = np.sort(b.before.astype(np.int64) * (n + 1) + np.arange(n))
    row = np.empty(size, np.int64)
    row[a.places] = np.arange(len(a.places))
    own = symbol[a.places].astype(np.int64) * (n + 1)
    ends = symbol[a.places] == 0
    nxt = row[after[a.places]]
    low, high = np.zeros(len(own), np.int64), np.full(len(own), n, np.int64)
    low_at_window, high_at_window = low, high
    rounds = 0
    while True:
        was = low
        low = np.where(ends, 0, np.searchsorted(counts, own + low[nxt]))
        rounds += 1
        if rounds <= STEPS:
            high = np.where(ends, 0, np.searchsorted(counts, own + high[nxt]))
            low_at_window, high_at_window = low, high
        elif (low == was).all():
            break
    place_a = np.arange(len(own)) + low
    total = len(own) + n
    from_a = np.zeros(total, bool)
    from_a[place_a] = True
    place_b = np.flatnonzero(~from_a)
    places = np.empty(total, np.int64)
    places[place_a], places[place_b] = a.places, b.places
    before = np.empty(total, a.before.dtype)
    before[place_a], before[place_b] = a.before, b.before
    joined = np.zeros(total, bool)
    rank = np.empty(total, np.int64)
    rank[place_a], rank[place_b] = np.arange(len(own)), np.arange(n)
    same = from_a[1:] == from_a[:-1]
    inner = np.where(from_a[1:], a.joined[np.where(from_a[1:], rank[1:], 0)], b.joined[np.where(from_a[1:], 0, rank[1:])])
    x = np.where(from_a[:-1], rank[:-1], rank[1:])
    y = np.where(from_a[:-1], rank[1:], rank[:-1])
    x, y = np.where(same, 0, x), np.where(same, 0, y)
    cross = (y >= low_at_window[x]) & (y < high_at_window[x])
    joined[1:] = np.where(same, inner, cross)
    return Index(places, before, joined)


def repeated_windows(runs: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each run, whether each of its windows has total weight two or more."""
    step = length // STEPS
    sizes = np.array([len(r) - step + 1 for r in runs], np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    hashes = np.concatenate([Prefix(np.frombuffer(r, np.uint8)).all(step) for r in runs])
    _, dense = np.unique(hashes, return_inverse=True)
    # The chains of a run end at one place each, after its symbols.
    symbol = np.zeros(total + step * len(runs), np.int64)
    symbol[:total] = dense + 1
    owner = np.repeat(np.arange(len(runs)), sizes)
    within = np.arange(total) - starts[owner]
    after = np.zeros(len(symbol), np.int64)
    last = within + step >= sizes[owner]
    after[:total] = np.where(last, total + owner * step + within % step, np.arange(total) + step)
    after[total:] = np.arange(total, len(symbol))
    before = np.zeros(len(symbol), np.int64)
    before[after[:total]] = symbol[:total]
    deepest = int(sizes.max()) // step + 2
    cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(SHARD, total + SHARD, SHARD)))
    bounds = [0, *[int(c) for c in cuts if 0 < c < len(runs)], len(runs)]
    parts = []
    for a, b in zip(bounds, bounds[1:]):
        stop = starts[b] if b < len(runs) else total
        places = np.concatenate([np.arange(starts[a], stop), np.arange(total + a * step, total + b * step)])
        parts.append(shard_index(places, symbol, before, after, max(deepest, STEPS)))
    while len(parts) > 1:
        parts = [
            merged(parts[i], parts[i + 1], symbol, after, len(symbol)) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    index = parts[0]
    group = np.cumsum(~index.joined)
    weight = np.zeros(len(symbol), np.int64)
    weight[:total] = np.array(weights, np.int64)[owner]
    sums = np.bincount(group, weight[index.places])
    heavy = np.empty(len(symbol), bool)
    heavy[index.places] = sums[group] >= 2
    return [heavy[s : s + len(r) - length + 1] for s, r in zip(starts.tolist(), runs, strict=True)]


def spans_of(flags: np.ndarray, length: int) -> list[int]:
    """Start and end of the bytes that flagged windows cover, in a flat list."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [int(v) for a, b in zip(edge[::2], edge[1::2]) for v in (a, b - 1 + length)]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Names of rows: the key and a hash of the text; a null key is replaced by another hash of it.

    So different texts under one key, or without a key, stay apart and don't make a hot key.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(
        "_k", F.coalesce(F.col(key).cast("long"), F.xxhash64(F.lit("no key"), body))
    ).withColumn("_c", F.xxhash64(body))


def all_runs(docs: DataFrame, length: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, found = [], []
                for i, value in enumerate(part.column(2)):
                    data = (value.as_py() or "").encode()
                    for got in window_runs(data, length, gram_of(length)):
                        rows.append(np.full(len(got[0]), i))
                        found.append(got)
                if not rows:
                    continue
                index = pa.array(np.concatenate(rows))
                start, n, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(1).take(index), pa.array(start), pa.array(n, pa.int32()),
                     pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["_k", "_c", "start", "n", "anchor", "content"],
                )

    return docs.select("_k", "_c", text).mapInArrow(run, "_k long, _c long, start long, n int, anchor long, content long")


def run_texts(docs: DataFrame, distinct: DataFrame, length: int, text: str) -> DataFrame:
    """The bytes of each different run, from one of the texts that hold it."""
    wanted = distinct.groupBy("rep._k", "rep._c").agg(
        F.collect_list(F.struct("anchor", "content", "weight", "hot", F.col("rep.start").alias("start"), F.col("rep.n").alias("n"))).alias("runs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], []]
                for value, runs in zip(part.column(0), part.column(1), strict=True):
                    data = (value.as_py() or "").encode()
                    for r in runs.as_py():
                        row = (r["anchor"], r["content"], r["weight"], r["hot"], data[r["start"] : r["start"] + r["n"] - 1 + length])
                        for col, item in zip(cols, row, strict=True):
                            col.append(item)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "content", "weight", "hot", "run"]
                )

    return docs.join(wanted, ["_k", "_c"]).select(text, "runs").mapInArrow(
        run, "anchor long, content long, weight long, hot boolean, run binary"
    )


def indexed(runs: DataFrame, length: int) -> DataFrame:
    """Repeats within the runs of each anchor: ``anchor``, ``content`` and ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            flags = repeated_windows([h[3] for h in held], [h[2] for h in held], length)
            spans = [spans_of(f, length) for f in flags]
            keep = [i for i, s in enumerate(spans) if s]
            out = [pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int64()),
                   pa.array([spans[i] for i in keep], pa.list_(pa.int32()))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["anchor", "content", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                anchor, content, weight, data = (x.as_py() for x in row)
                if (anchor, content) == last:
                    continue
                if size >= UNIT and (last is None or last[0] != anchor):
                    yield close()
                    size = 0
                last = (anchor, content)
                held.append((anchor, content, weight, data))
                size += len(data)
        if held:
            yield close()

    dealt = runs.select("anchor", "content", "weight", "run").repartition("anchor").sortWithinPartitions("anchor", "content")
    return dealt.mapInArrow(run, "anchor long, content long, spans array<int>")


def counted_windows(runs: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different runs: windows are counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                anchor, content, weight, data = (x.as_py() for x in row)
                names = Prefix(np.frombuffer(data, np.uint8)).all(length).view(np.int64)
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array([weight] * n, pa.int64()),
                     pa.array(np.arange(n), pa.int32()), pa.array(names)],
                    names=["anchor", "content", "weight", "at", "window"],
                )

    rows = runs.select("anchor", "content", "weight", "run").distinct().mapInArrow(
        run, "anchor long, content long, weight long, at int, window long"
    )
    heavy = rows.groupBy("anchor", "window").agg(F.sum("weight").alias("w")).where("w > 1").drop("w")
    found = rows.join(heavy, ["anchor", "window"])
    return found.groupBy("anchor", "content").agg(
        F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + length))).alias("spans")
    )


def repeat_spans(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_spans`` (which none of them may be called): byte ranges (start, end in turn, unordered, may
    overlap) that repeated strings of ``length`` bytes cover; null where there is none."""
    if "_spans" in docs.columns:
        raise ValueError("the documents have a column _spans already")
    if length % STEPS or length < 4 * STEPS:
        raise ValueError(f"the length must be a multiple of {STEPS} and {4 * STEPS} at least")
    inner, back = set_aside(docs, list(dict.fromkeys([key, text])))
    keyed = _keyed(inner, key, text)
    runs = pin(all_runs(keyed, length, text))
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    kept = pin(runs.join(often, "anchor"))
    grouped = kept.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("_k", "_c", "start", "n")).alias("rep")
    )
    distinct = pin(grouped)
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIMIT)
    marked = distinct.join(crowded.select("anchor", F.lit(True).alias("hot")), "anchor", "left")
    texts = pin(run_texts(keyed, marked.withColumn("hot", F.coalesce("hot", F.lit(False))), length, text))
    found = pin(
        indexed(texts.where("not hot"), length).unionByName(counted_windows(texts.where("hot"), length))
    )
    placed = kept.join(found, ["anchor", "content"]).select(
        "_k", "_c", F.transform("spans", lambda s: s.cast("long") + F.col("start")).alias("s")
    )
    by_doc = placed.groupBy("_k", "_c").agg(F.flatten(F.collect_set("s")).alias("_spans"))
    return back(keyed.join(by_doc, ["_k", "_c"], "left"), "_spans")


def joined_spans(spans: list[int] | None) -> list[tuple[int, int]]:
    """Ranges in order; ranges that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    spans = spans or []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(v for span in spans for v in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))


def removal_digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: bytes, removed bytes, removed ranges and a digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], []]
                for value, spans in zip(part.column(1), part.column(2), strict=True):
                    data = (value.as_py() or "").encode()
                    cut = joined_spans(spans.as_py())
                    row = (len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(data, cut)).hexdigest())
                    for col, item in zip(cols, row, strict=True):
                        col.append(item)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeat_spans(docs.select("doc_id", "text"), length)
    return found.select("doc_id", "text", "_spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The same rows with repeated bytes cut from ``text`` and ``n_chars`` counted anew.

    A character cut in part goes whole. Texts may become empty; null texts stay null.
    """
    inner, back = set_aside(docs, ["doc_id", "text", "n_chars"])
    found = repeat_spans(inner, length)
    names = found.columns
    text, spans = names.index("text"), names.index("_spans")
    chars = names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, counts = [], []
                for value, cut, n in zip(part.column(text), part.column(spans), part.column(chars), strict=True):
                    value, cut, n = value.as_py(), cut.as_py(), n.as_py()
                    if cut:
                        value = without(value.encode(), joined_spans(cut)).decode("utf-8", "ignore")
                        n = len(value)
                    texts.append(value)
                    counts.append(n)
                columns = list(part.columns)
                columns[text] = pa.array(texts, part.column(text).type)
                columns[chars] = pa.array(counts, part.column(chars).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return back(found.mapInArrow(run, found.schema))
