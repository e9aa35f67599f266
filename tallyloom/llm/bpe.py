"""Byte pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree are the ranks of its adjacent pairs, joined with their places;
an inner node is the smaller of its two children, so the root is the leftmost pair of lowest
rank. A merge changes three leaves: the merged pair's, its right neighbour's (which goes)
and its left neighbour's, each with a logarithmic climb; it ends when the root is empty.
Words of the same size class are worked on together, one array step for all; a word of more
than ``WIDE`` bytes has a tree of its own.

Nulls count as empty texts; empty texts have no ids. Equal texts get equal ids. Rows are
never dropped: a repeated or null key comes out as often as it went in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.pretokens import Pretokens, byte_letters

WIDE = 64
NONE = np.int64(1) << 62


class Merges:
    """Ranks and results of the merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        vocab = plan["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in plan["added_tokens"]}
        letters = byte_letters()
        back = {ord(letter): byte for byte, letter in letters.items()}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.rank: dict[int, int] = {}
        result = []
        for n, pair in enumerate(plan["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] * self.size + vocab[right], n)
            result.append(vocab[left + right])
        self.result = np.array([*result, 0], np.int64)
        pairs = np.array([*self.rank, -1], np.int64)
        ranks = np.array([*self.rank.values(), 0], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], ranks[order]
        self.pieces = [b""] * self.size
        for token, n in vocab.items():
            self.pieces[n] = bytes(token.translate(back).encode("latin-1"))
        for token, n in self.special.items():
            self.pieces[n] = token.encode()
        self.widths = np.array(list(map(len, self.pieces)), np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, leaves: int):
        """Leaf values of pairs: rank and place, or NONE where no merge is known."""
        wanted = left * self.size + right
        at = np.searchsorted(self.pairs, wanted)
        at = np.minimum(at, len(self.pairs) - 1)
        known = (self.pairs[at] == wanted) & (right >= 0) & (left >= 0)
        return np.where(known, self.ranks[at] * leaves + place, NONE)


def merge_together(merges: Merges, symbols: np.ndarray, leaves: int) -> np.ndarray:
    """Merge rows of symbols (-1: none) to the end; a row keeps -1 where a symbol went."""
    words, width = symbols.shape
    tree = np.full((words, 2 * leaves), NONE, np.int64)
    place = np.arange(width - 1)[None, :]
    tree[:, leaves : leaves + width - 1] = merges.keys(symbols[:, :-1], symbols[:, 1:], place, leaves)
    level = leaves
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    after = np.tile(np.arange(1, width + 1), (words, 1))
    before = np.tile(np.arange(-1, width - 1), (words, 1))
    rows = np.flatnonzero(tree[:, 1] < NONE)

    def put(at: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[at, node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])

    def symbol(at: np.ndarray, where: np.ndarray) -> np.ndarray:
        inside = (where >= 0) & (where < width)
        return np.where(inside, symbols[at, np.clip(where, 0, width - 1)], -1)

    while len(rows):
        root = tree[rows, 1]
        left = root % leaves
        made = merges.result[root // leaves]
        right = after[rows, left]
        far = after[rows, right]
        symbols[rows, left] = made
        symbols[rows, right] = -1
        after[rows, left] = far
        inside = np.flatnonzero(far < width)
        before[rows[inside], far[inside]] = left[inside]
        put(rows, right % leaves, np.full(len(rows), NONE))
        put(rows, left, merges.keys(made, symbol(rows, far), left, leaves))
        near = before[rows, left]
        some = np.flatnonzero(near >= 0)
        if len(some):
            at, where = rows[some], near[some]
            put(at, where, merges.keys(symbols[at, where], made[some], where, leaves))
        rows = rows[tree[rows, 1] < NONE]
    return symbols


def merge_alone(merges: Merges, symbols: list[int]) -> list[int]:
    """One long word with one tree."""
    n, size, none = len(symbols), merges.size, int(NONE)
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * leaves)

    def key(i: int, j: int) -> int:
        rank = merges.rank.get(symbols[i] * size + symbols[j]) if j < n else None
        return none if rank is None else rank * leaves + i

    for i in range(n - 1):
        tree[leaves + i] = key(i, i + 1)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, value: int) -> None:
        node = leaf + leaves
        tree[node] = value
        while node > 1:
            node >>= 1
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                return
            tree[node] = best

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < none:
        rank, left = divmod(tree[1], leaves)
        right = after[left]
        far = after[right]
        symbols[left], symbols[right], after[left] = int(merges.result[rank]), -1, far
        put(right, none)
        put(left, key(left, far))
        if far < n:
            before[far] = left
        if before[left] >= 0:
            put(before[left], key(before[left], left))
    return [x for x in symbols if x >= 0]


def encode_words(merges: Merges, words: list[str]) -> list[list[int]]:
    raw = [word.encode() for word in words]
    out: list[list[int]] = [[]] * len(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for i in np.flatnonzero(sizes > WIDE):
        out[i] = merge_alone(merges, merges.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist())
    low, high = 0, 4
    while low < WIDE:
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(own):
            lengths = sizes[own]
            filled = np.arange(high)[None, :] < lengths[:, None]
            symbols = np.full((len(own), high), -1, np.int64)
            symbols[filled] = merges.byte_ids[np.frombuffer(b"".join(raw[i] for i in own), np.uint8)]
            merge_together(merges, symbols, high)
            kept = symbols >= 0
            flat, ends = symbols[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
            start = 0
            for i, end in zip(own.tolist(), ends, strict=True):
                out[i] = flat[start:end]
                start = end
        low, high = high, high * 2
    return out


@lru_cache(maxsize=2)
def merge_table(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def tree_pretokens(path: str) -> Pretokens:
    """Pretokens of a byte-level vocabulary file, encoded by segment trees."""
    merges = merge_table(path)

    def words(new: list[str]) -> list:
        return encode_words(merges, new)

    def text(value: str) -> list[int]:
        """A text with special tokens in it: the parts between them are encoded apart."""
        ids: list[int] = []
        while value:
            found = min(
                ((value.find(s), -len(s), s) for s in merges.special if s in value), default=None
            )
            head, token = (value, "") if found is None else (value[: found[0]], found[2])
            ids.extend(coder.one(head).tolist())
            if token:
                ids.append(merges.special[token])
            value = value[len(head) + len(token) :]
        return ids

    coder = Pretokens(True, words, text, lambda value: any(s in value for s in merges.special))
    return coder


def bpe_encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_pretokens(vocabulary)
        for batch in batches:
            for at, ids, counts in coder.encode(batch.column(1)):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(merges: Merges, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of consecutive runs of ids."""
    data = b"".join(map(merges.pieces.__getitem__, ids.tolist()))
    widths = np.concatenate([[0], np.cumsum(merges.widths[ids])])
    at = widths[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def bpe_decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Adds the decoded ``text`` to ``key`` and ``ids``; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merge_table(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                counts = np.diff(lists.offsets.to_numpy())
                texts = decode(merges, lists.flatten().to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[key, "ids", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, merges = tree_pretokens(vocabulary), merge_table(vocabulary)
        for batch in batches:
            for start, ids, counts in coder.encode(batch.column(1)):
                flat, ends = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]).tolist()
                texts = decode(merges, flat, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]),
                        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in texts]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
