"""Groups spelling variants of words with a trie over letter-group counts.

A word's *frequency vector* holds how often the letters of each group occur in it; the last
entry counts all other characters. One inserted, deleted or replaced character raises at most
one entry by one and lowers at most one by one. So the words are arranged in a trie by their
successive counts, and a depth-first search from a word goes down with a budget of one surplus
and one deficit. The words of the leaves it reaches are verified character by character.

The top levels of the trie deal the words to tasks: a word lives in the subtree of its first
counts and visits the subtrees within the budget that sort after its own, so a pair is found
once. As many levels are used as it takes to have at most ``SUBTREE`` words in a subtree; a
subtree that is still larger is cut into blocks, and visitors go to each of them. A task holds
the words of one block; visitors stream past it.

Defined results: null and empty texts have no words; a null key is written ``null`` where it is
hashed; repeated rows and equal texts count as often as they occur; words longer than a page are
words like others; an empty table gives no rows. Only the key and text columns are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin

LETTER = "[A-Za-zÀ-ÿ]"
#: Levels of the trie, frequent letters first; characters of no group count on the last level.
GROUPS = ("e", "a", "i", "n", "r", "o", "s", "t", "l", "u", "d", "c", "m", "h", "g", "p", "bvw", "fjkqxyz")
SUBTREE = 20_000
DEEPEST = 8
FRONTIER = 1 << 16
VISITORS = 4096
WIDE = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(run, UPPER, LOWER)


def typed(key: Column, run: Column, every: int) -> Column:
    """The run with one code point missing where ``every`` divides the checksum of key and run."""
    checksum = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), run))
    at = (checksum % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(checksum % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, length: int = 5, least: int = 3) -> DataFrame:
    """``word``, ``n``: words of at least ``length`` code points that occur ``least`` times.

    A run never gets longer, so shorter runs are left out from the start.
    """
    whole_run = F.lit(f"{LETTER}{{{length},}}")
    runs = docs.select(
        F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), whole_run, F.lit(0))).alias("run")
    )
    words = runs.select(typed(F.col("key"), lowered(F.col("run")), every).alias("word"))
    return (
        words.where(F.char_length("word") >= length).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )


def top_counts(word: Column) -> Column:
    """The counts of the first ``DEEPEST`` levels."""
    size = F.char_length(word)
    return F.array(*[size - F.char_length(F.translate(word, g, "")) for g in GROUPS[:DEEPEST]])


class Block:
    """Some words with their frequency vectors and, but for very long ones, a matrix of their
    code points (zeros at the end)."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        group = np.full(256, len(GROUPS), np.int64)
        for level, letters in enumerate(GROUPS):
            group[[ord(c) for c in letters]] = level
        levels = len(GROUPS) + 1
        level = np.where(points < 256, group[np.minimum(points, 255)], len(GROUPS))
        row = np.repeat(np.arange(len(words)), self.sizes)
        self.counts = np.bincount(row * levels + level, minlength=len(words) * levels).reshape(len(words), levels)
        column = np.arange(len(points)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        near = column < WIDE
        self.points = np.zeros((len(words), WIDE + 1), np.uint32)
        self.points[row[near], column[near]] = points[near]

    def part(self, at: slice) -> Block:
        out = object.__new__(Block)
        out.words, out.n, out.sizes = self.words[at], self.n[at], self.sizes[at]
        out.counts, out.points = self.counts[at], self.points[at]
        return out

    def ordered(self) -> Block:
        """The same words sorted by their counts."""
        order = np.lexsort(self.counts.T[::-1])
        return Block([self.words[i] for i in order], [self.n[i] for i in order])


def within_budget(depth: int) -> list[tuple[int, ...]]:
    """Changes of ``depth`` counts with at most one surplus and one deficit that sort after none."""
    unit = np.eye(depth, dtype=int)
    found = {tuple(int(v) for v in up - down) for up in (*unit, unit[0] * 0) for down in (*unit, unit[0] * 0)}
    return sorted(d for d in found if d > (0,) * depth)


def routing_depth(words: DataFrame, most: int = SUBTREE) -> int:
    """Levels to deal by, so that a subtree holds at most ``most`` words where that is possible."""
    prefixes = [F.struct(F.lit(d).alias("depth"), F.slice("counts", 1, d).alias("prefix")) for d in range(1, DEEPEST + 1)]
    sizes = words.select(F.explode(F.array(*prefixes)).alias("p")).groupBy("p").count()
    largest = sizes.groupBy("p.depth").agg(F.max("count").alias("n")).collect()
    return min((r["depth"] for r in largest if r["n"] <= most), default=DEEPEST)


def routed(words: DataFrame, depth: int, most: int = SUBTREE) -> DataFrame:
    """Every word at home (``visit`` 0) and in each block it must visit (``visit`` 1).

    At home a word visits the blocks after its own, elsewhere all blocks of the subtree.
    """
    homes = words.select("word", "n", F.slice("counts", 1, depth).alias("home"))
    sizes = homes.groupBy(F.col("home").alias("prefix")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("blocks")
    )
    changes = F.array(*[F.array(*[F.lit(v) for v in d]) for d in ((0,) * depth, *within_budget(depth))])
    reached = F.transform(changes, lambda d: F.zip_with("home", d, lambda a, b: a + b))
    possible = F.filter(reached, lambda p: F.forall(p, lambda v: v >= 0))
    placed = homes.select("word", "n", "home", F.explode(possible).alias("prefix")).join(sizes, "prefix")
    own = F.when(F.col("prefix") == F.col("home"), F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    blocks = F.sequence(F.coalesce(F.col("own"), F.lit(0)), F.col("blocks") - 1)
    return placed.withColumn("own", own).select("prefix", "own", "word", "n", F.explode(blocks).alias("block")).select(
        "prefix", "block", F.when(F.col("own") == F.col("block"), 0).otherwise(1).alias("visit"), "word", "n"
    )


class Trie:
    """Sorted words by their counts, level by level.

    ``edges[level]`` holds the sorted (parent node, count) pairs; a node's number is its place
    there. The nodes of the last level are the leaves, with a range of words each.
    """

    def __init__(self, words: Block):
        self.words = words
        self.width = int(words.counts.max(initial=0)) + 3
        self.edges: list[np.ndarray] = []
        node = np.zeros(len(words.n), np.int64)
        for level in range(words.counts.shape[1]):
            edge, node = np.unique(node * self.width + words.counts[:, level], return_inverse=True)
            self.edges.append(edge)
        self.leaves = np.searchsorted(node, np.arange(len(self.edges[-1]) + 1))

    def search(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and word places whose counts lie within the budget.

        Depth first: a path carries its query, its node and what it has spent; paths that
        outgrow ``FRONTIER`` are halved, and one half waits on the stack.
        """
        none = np.zeros(len(counts), np.int64)
        stack = [(0, np.arange(len(counts)), none, none)]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack.append((level, query[:half], node[:half], spent[:half]))
                stack.append((level, query[half:], node[half:], spent[half:]))
                continue
            if not len(query):
                continue
            if level == len(self.edges):
                first, size = self.leaves[node], self.leaves[node + 1] - self.leaves[node]
                start = np.repeat(first - (np.cumsum(size) - size), size)
                yield np.repeat(query, size), start + np.arange(int(size.sum()))
                continue
            parts = []
            for change, cost in ((0, 0), (1, 1), (-1, 2)):
                able = (spent & cost) == 0
                q, at = query[able], node[able]
                count = counts[q, level] + change
                edge = at * self.width + count
                place = np.searchsorted(self.edges[level], edge)
                place[place == len(self.edges[level])] = 0
                there = (self.edges[level][place] == edge) & (count >= 0) & (count < self.width)
                parts.append((q[there], place[there], spent[able][there] | cost))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns one word into the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at, end = 0, len(a)
    while at < end and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def verified(a: Block, b: Block, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of places in ``a`` and ``b`` are one code point apart."""
    gap = b.sizes[right] - a.sizes[left]
    good = np.zeros(len(left), bool)
    long = (a.sizes[left] > WIDE) | (b.sizes[right] > WIDE)
    for i in np.flatnonzero(long):
        good[i] = one_apart(a.words[left[i]], b.words[right[i]])
    for step in (0, 1, -1):
        rows = np.flatnonzero((gap == step) & ~long)
        less, more = a.points[left[rows]], b.points[right[rows]]
        if step < 0:
            less, more = more, less
        apart = less != more
        if step == 0:
            good[rows] = apart.sum(1) == 1
        else:
            first = apart.argmax(1)
            late = np.arange(WIDE) >= first[:, None]
            good[rows] = ~((less[:, :-1] != more[:, 1:]) & late).any(1)
    return good


def _found(trie: Trie, visitors: Block, after: int | None) -> Iterator[pa.RecordBatch]:
    """Both directions of the verified pairs; ``after``: the visitors are the trie's own words from there on."""
    home = trie.words
    for query, place in trie.search(visitors.counts):
        if after is not None:
            later = place > query + after
            query, place = query[later], place[later]
        for at in range(0, len(query), FRONTIER):
            left, right = query[at : at + FRONTIER], place[at : at + FRONTIER]
            good = verified(visitors, home, left, right)
            left, right = left[good].tolist(), right[good].tolist()
            if left:
                a, b = [visitors.words[q] for q in left], [home.words[p] for p in right]
                of_a, of_b = [visitors.n[q] for q in left], [home.n[p] for p in right]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(of_b + of_a, pa.int64())],
                    names=["word", "near", "near_n"],
                )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs from rows sorted by subtree and block, with the words at home first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    home, trie = None, None
    for (prefix, block, visit), group in groupby(rows, key=lambda r: r[:3]):
        if not visit:
            _, _, _, words, n = zip(*group, strict=True)
            home, trie = (prefix, block), Trie(Block(list(words), list(n)).ordered())
            for at in range(0, len(words), VISITORS):
                yield from _found(trie, trie.words.part(slice(at, at + VISITORS)), at)
        elif home == (prefix, block):
            while chunk := list(islice(group, VISITORS)):
                yield from _found(trie, Block([r[3] for r in chunk], [r[4] for r in chunk]), None)


def near_pairs(words: DataFrame, most: int = SUBTREE) -> DataFrame:
    """``word``, ``near``, ``near_n``: the distinct words that are one code point apart, both ways."""
    counted = words.select("word", "n", top_counts(F.col("word")).alias("counts"))
    routes = routed(counted, routing_depth(counted, most), most)
    sorted_rows = routes.repartition("prefix", "block").sortWithinPartitions("prefix", "block", "visit")
    return sorted_rows.mapInArrow(_searched, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root``: where the forms of ``links`` (``word``, ``form``) end.

    Every round follows twice as many forms as the one before.
    """
    reached = pin(links.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = pin(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"))
        if moved.where(F.col("beyond").isNotNull()).isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def variant_groups(words: DataFrame, times: int = 2, most: int = SUBTREE) -> DataFrame:
    """For distinct words and how often each occurs: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is its near word that occurs most (ties: the smallest in code-point order),
    if that occurs at least ``times`` as often. ``root`` follows the forms to the last.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = pin(near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best))
    far_enough = -F.col("best.minus") >= times * F.col("n")
    told = pin(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far_enough, F.col("best.near")).alias("form"), F.when(far_enough, -F.col("best.minus")).alias("form_n"),
        )
    )
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, length: int = 5, least: int = 3) -> DataFrame:
    """Variant groups of all words of the texts."""
    return variant_groups(pin(word_counts(docs, key, text, every, length, least)))
