"""Codes of vectors by product quantisation, with Lloyd's rounds over two trees.

Components become whole numbers, vectors are cut into equal parts, and each part has a codebook
of entries. A round assigns every part to its nearest entry and moves each entry to the
mean of its parts, rounded down. The vectors lie in blocks; each part of a block is kept in the
order of a balanced box tree, so a node is a range of points with a box and a cached sum. The
entries of a codebook form a second tree. Both are descended together: a pair of nodes is dropped
when the nearest points of its boxes are further apart than the farthest of another
pair of the same points. A node of points with one entry left is assigned whole, by its
cached sum. Points in the leaves with several entries left are compared with those entries one by one.
All bounds, sums and distances are exact whole numbers, so are ties (the lower index wins).

A block has at most ``ROWS`` vectors, is built once and stored; a round reads all blocks, adds up
sums by entry in each task, then over tasks. The driver holds the codebooks: entries times
components, whatever the number of vectors.

Defined results: rows whose vector is null or holds null or non-finite components go. A missing id
sorts after all others, rows of one id by their numbers; repeated rows are rows. Vectors are
filled up with zeros to the longest one's length, and that to a multiple of the parts. Numbers beyond
2^62 stay there, an error beyond 2^63 - 1 too. With fewer rows than entries there are as many entries as rows; an empty
table gives no rows. Other columns than the three that are read may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.sources.corpora import spread
from tallyloom.sources.workspace import pin

ROWS = 4096
LEAF = 16
MOST = 1 << 62
PAIRS = 1 << 16


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """``id``, ``label`` and ``q`` (array of long) of the rows that take part."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long"))
    return vectors.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.when(F.coalesce(fine, F.lit(False)), held).alias("q")
    ).where(F.col("q").isNotNull())


def exact(numbers: np.ndarray) -> np.ndarray:
    """The numbers in a type that holds their squared distances: 64 bits, else Python's integers."""
    top = max(abs(int(numbers.max(initial=0))), abs(int(numbers.min(initial=0))))
    return numbers if 4 * top * top * max(1, numbers.shape[-1]) < 1 << 62 else numbers.astype(object)


def edges(count: int, level: int) -> np.ndarray:
    """Where the ranges of a level's nodes begin and end."""
    return (count * np.arange((1 << level) + 1)) >> level


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """Order of the points in a balanced tree that halves each node across its widest side."""
    order = np.arange(len(points))
    for level in range(levels):
        at, middles = edges(len(points), level), edges(len(points), level + 1)[1::2]
        for low, high, middle in zip(at[:-1].tolist(), at[1:].tolist(), middles.tolist(), strict=True):
            if high - low > 1 and middle > low:
                own = points[order[low:high]]
                side = own[:, int(np.argmax(own.max(0) - own.min(0)))]
                order[low:high] = order[low:high][np.argpartition(side, middle - low)]
    return order


class Tree:
    """Boxes and sums of the nodes over points in tree order, by level."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.levels = depth(len(points), leaf)
        self.at = [edges(len(points), level) for level in range(self.levels + 1)]
        self.low, self.high, self.sums = [], [], []
        for at in self.at:
            # An empty node repeats its neighbour; it is never asked for.
            begin = np.minimum(at[:-1], len(points) - 1)
            self.low.append(np.minimum.reduceat(points, begin))
            self.high.append(np.maximum.reduceat(points, begin))
            self.sums.append(np.add.reduceat(points, begin))


def depth(count: int, leaf: int) -> int:
    return max(0, (-(-count // leaf) - 1).bit_length())


def bounds(points: Tree, p_level: int, p: np.ndarray, entries: Tree, e_level: int, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between the boxes of pairs of nodes."""
    up = entries.low[e_level][e] - points.high[p_level][p]
    down = points.low[p_level][p] - entries.high[e_level][e]
    gap = np.maximum(np.maximum(up, down), 0)
    span = np.maximum(entries.high[e_level][e] - points.low[p_level][p], points.high[p_level][p] - entries.low[e_level][e])
    return (gap * gap).sum(1), (span * span).sum(1)


def children(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each node where the level has any below, and the place of their parent; empty ones go."""
    place = np.arange(len(nodes))
    if level == tree.levels:
        return nodes, place
    both, place = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([place, place])
    filled = tree.at[level + 1][both] < tree.at[level + 1][both + 1]
    return both[filled], place[filled]


def square_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Every point's squared distance from every entry, as exact whole numbers."""
    if points.dtype == object or entries.dtype == object:
        gap = points.astype(object)[:, None, :] - entries.astype(object)[None, :, :]
        return (gap * gap).sum(2)
    top = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, points.shape[1]) < 1 << 52:
        # Below 2^53 doubles hold whole numbers exactly.
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    own, other = (points * points).sum(1), (entries * entries).sum(1)
    return own[:, None] + other[None, :] - 2 * (points @ entries.T)


class Assignment:
    """Nearest entries of a tree's points: ``whole`` nodes as (level, node, entry), and the
    points ``one`` by one with their entry; ``pruned`` counts the pairs of nodes dropped."""

    def __init__(self, points: Tree, entries: Tree, names: np.ndarray):
        """``names``: the index of each entry in tree order."""
        self.whole: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.one: list[tuple[np.ndarray, np.ndarray]] = []
        self.pruned = 0
        p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for step in range(max(points.levels, entries.levels) + 1):
            p_level, e_level = min(step, points.levels), min(step, entries.levels)
            near, far = bounds(points, p_level, p, entries, e_level, e)
            order = np.argsort(p, kind="stable")
            p, e, near, far = p[order], e[order], near[order], far[order]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
            if not len(first):
                return
            least = np.repeat(np.minimum.reduceat(far, first), np.diff(np.append(first, len(p))))
            left = (near <= least).astype(bool)
            self.pruned += int((~left).sum())
            p, e = p[left], e[left]
            if e_level == entries.levels:
                begin = np.concatenate([[True], p[1:] != p[:-1]])
                alone = begin & np.append(begin[1:], True)
                self.whole.append((p_level, p[alone], names[entries.at[e_level][e[alone]]]))
                p, e = p[~alone], e[~alone]
            if step < max(points.levels, entries.levels):
                p, parent = children(points, p_level, p)
                e, place = children(entries, e_level, e[parent])
                p = p[place]
        if len(p):
            self._compare(points, entries, names, p, e)

    def _compare(self, points: Tree, entries: Tree, names: np.ndarray, p: np.ndarray, e: np.ndarray) -> None:
        """Points of the leaves with the entries left to them, sorted by leaf."""
        at, place = points.at[-1], entries.at[-1][e]
        cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = place[low:high][np.argsort(names[place[low:high]])]
            inside = np.arange(at[p[low]], at[p[low] + 1])
            distance = square_distances(points.points[inside], entries.points[own])
            self.one.append((inside, names[own][np.argmin(distance, 1)]))

    def add_to(self, points: Tree, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add each entry's points to its count and sum: whole nodes by their cached sums."""
        for level, nodes, entry in self.whole:
            np.add.at(counts, entry, points.at[level][nodes + 1] - points.at[level][nodes])
            np.add.at(sums, entry, points.sums[level][nodes])
        for inside, entry in self.one:
            np.add.at(counts, entry, 1)
            np.add.at(sums, entry, points.points[inside])

    def codes(self, points: Tree) -> np.ndarray:
        """The entry of each point, in tree order."""
        found = np.zeros(len(points.points), np.int64)
        for level, nodes, entry in self.whole:
            for node, one in zip(nodes.tolist(), entry.tolist(), strict=True):
                found[points.at[level][node] : points.at[level][node + 1]] = one
        for inside, entry in self.one:
            found[inside] = entry
        return found


class Codebook:
    """The entries of one part, and their tree."""

    def __init__(self, entries: list[list[int]]):
        self.entries = exact(np.array(entries, np.int64).reshape(len(entries), -1))
        self.order = tree_order(self.entries, depth(len(entries), 1))
        self.tree = Tree(self.entries[self.order], 1)

    def assigned(self, points: Tree) -> Assignment:
        return Assignment(points, self.tree, self.order)


def _blocks(parts: int, width: int, id_type: pa.DataType, label_type: pa.DataType) -> Callable:
    """Blocks of vectors: ids, labels, and the points and order of each part's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                n = rows.num_rows
                cells = rows.column("q")
                size = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + n + 1])
                numbers = np.zeros((n, parts * width), np.int64)
                inside = np.arange(parts * width)[None, :] < size[:, None]
                numbers[inside] = cells.flatten().to_numpy()
                orders, points = [], []
                for part in range(parts):
                    own = numbers[:, part * width : (part + 1) * width]
                    order = tree_order(exact(own), depth(n, LEAF))
                    orders.append(order.astype("<i4").tobytes())
                    points.append(own[order].astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("id").to_pylist()], pa.list_(id_type)),
                     pa.array([rows.column("label").to_pylist()], pa.list_(label_type)),
                     pa.array([orders], pa.list_(pa.binary())), pa.array([points], pa.list_(pa.binary()))],
                    names=["ids", "labels", "orders", "points"],
                )

    return run


def _trees(cells: list[bytes], width: int) -> Iterator[Tree]:
    for raw in cells:
        yield Tree(exact(np.frombuffer(raw, "<i8").reshape(-1, width)), LEAF)


def _round(books: list[list[list[int]]], width: int) -> Callable:
    """Counts and sums of every entry over all blocks of a task; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Codebook] = []
        counts = [np.zeros(len(book), np.int64) for book in books]
        sums = [np.zeros((len(book), width), object) for book in books]
        for batch in batches:
            made = made or [Codebook(book) for book in books]
            for cells in batch.column("points"):
                for part, tree in enumerate(_trees(cells.as_py(), width)):
                    block = np.zeros(sums[part].shape, tree.points.dtype)
                    made[part].assigned(tree).add_to(tree, counts[part], block)
                    sums[part] += block
        for part, count in enumerate(counts):
            used = np.flatnonzero(count)
            entry = np.repeat(used, width + 1)
            place = np.tile(np.arange(-1, width), len(used))
            total = np.concatenate([count[used].astype(object)[:, None], sums[part][used]], 1).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), part), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                 pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))],
                names=["part", "entry", "place", "total"],
            )

    return run


def _code(books: list[list[list[int]]], width: int) -> Callable:
    """Code and error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Codebook] = []
        for batch in batches:
            made = made or [Codebook(book) for book in books]
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                codes, errors = np.zeros((len(ids), len(made)), np.uint8), np.zeros(len(ids), object)
                orders = batch.column("orders")[i].as_py()
                for part, tree in enumerate(_trees(batch.column("points")[i].as_py(), width)):
                    order = np.frombuffer(orders[part], "<i4")
                    code = made[part].assigned(tree).codes(tree)
                    gap = tree.points - made[part].entries[code]
                    codes[order, part] = code
                    errors[order] += (gap * gap).sum(1).astype(object)
                text, size = codes.tobytes().hex(), 2 * len(made)
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[at : at + size] for at in range(0, len(text), size)], pa.string()),
                     pa.array([min(int(v), (1 << 63) - 1) for v in errors], pa.int64())],
                    names=["id", "label", "code", "error"],
                )

    return run


def moved(book: list[list[int]], totals: dict[tuple[int, int], int], width: int) -> list[list[int]]:
    """Entries at the mean of their parts, rounded down; those without parts stay."""
    return [
        [totals[entry, i] // totals[entry, -1] for i in range(width)] if (entry, -1) in totals else old
        for entry, old in enumerate(book)
    ]


def learned_codebooks(blocks: DataFrame, books: list[list[list[int]]], width: int, rounds: int) -> list[list[list[int]]]:
    """Codebooks after some of Lloyd's rounds over all blocks."""
    for _ in range(rounds):
        sums = blocks.select("points").mapInArrow(_round(books, width), "part int, entry int, place int, total decimal(38,0)")
        rows = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        totals: list[dict] = [{} for _ in books]
        for r in rows:
            totals[r["part"]][r["entry"], r["place"]] = int(r["total"])
        books = [moved(book, total, width) for book, total in zip(books, totals, strict=True)]
    return books


def vector_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``id``, ``label``, ``code`` (two hexadecimal digits a part) and ``error`` of every vector, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    numbers = pin(spread(whole_numbers(vectors, key, vector, label, scale), "id"))
    longest = numbers.agg(F.max(F.size("q")).alias("n")).first()["n"] or 0
    width = max(1, -(-longest // parts))
    first = numbers.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    filled = [list(r["q"]) + [0] * (parts * width - len(r["q"])) for r in first]
    books = [[row[part * width : (part + 1) * width] for row in filled] for part in range(parts)]
    id_type, label_type = (numbers.schema[c].dataType for c in ("id", "label"))
    shape = f"ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>, orders array<binary>, points array<binary>"
    blocks = pin(numbers.mapInArrow(_blocks(parts, width, to_arrow_type(id_type), to_arrow_type(label_type)), shape))
    books = learned_codebooks(blocks, books, width, rounds)
    coded = blocks.mapInArrow(
        _code(books, width), f"id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long"
    )
    return coded, books


def code_digest(vectors: DataFrame, key: str = "vec_id", label: str = "label", **settings) -> DataFrame:
    """Codes with the error of each label (rows without one count together) and the hash of the codebooks."""
    coded, books = vector_codes(vectors, key, label=label, **settings)
    coded = pin(coded)
    flat = ",".join(str(v) for book in books for entry in book for v in entry)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(key), "code", "error", "label_error",
        F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256"),
    )
