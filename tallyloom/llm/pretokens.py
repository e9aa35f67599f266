"""Cuts blocks of texts into pretokens with whole-array steps, and looks words up once.

Both public byte pair vocabularies first cut a text by character class. Here the classes of
all characters of a block are taken from one table, the cut points follow by comparing
neighbours, and the pretokens become an Arrow string array over the same bytes. Arrow's
dictionary encoding leaves the distinct pretokens of the block; only those a worker has not
met before are encoded. The memory of a worker holds at most twice ``MEMORY`` pretokens or ``MEMORY_BYTES``,
the older half is dropped when full; that changes the speed only. Steps that don't tokenise give it back.
"""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
MEMORY = 150_000
MEMORY_BYTES = 16 << 20
BLOCK = 2 << 20

# Letters and numbers that Unicode 16.0 added, beyond this Python's tables.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3),
    (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    first = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], np.uint8)
    table[first == ord("L")] = LETTER
    table[first == ord("N")] = NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    blank = [i for i in range(0x110000) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    table[blank] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        head, at = points[wide], lead[wide]
        value = np.where(head >= 0xF0, head & 0x07, np.where(head >= 0xE0, head & 0x0F, head & 0x1F))
        for step, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            more = np.flatnonzero(head >= least)
            value[more] = (value[more] << 6) | (data[at[more] + step] & 0x3F)
        points[wide] = value
    return lead, points


def cut_points(data: np.ndarray, text_starts: np.ndarray, spaced: bool) -> np.ndarray:
    """Byte positions where pretokens start; white space belongs to some pretoken too.

    ``spaced``: one blank joins the run after it and numbers stay whole, as in the byte-level
    vocabulary. Otherwise digits stand alone, white space forms pretokens of its own and
    contractions are known in either case, as in the word-end vocabulary.
    """
    lead, points = code_points(data)
    kind = classes()[points]
    n = len(lead)
    first = np.zeros(n + 4, bool)
    first[np.searchsorted(lead, text_starts)] = True
    first[n:] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if spaced:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    else:
        start[:n] |= kind == NUMBER
    mark = np.flatnonzero((points == 0x27) & start[:n])
    if len(mark):
        padded = np.concatenate([points, np.zeros(3, np.int32)])
        if not spaced:
            padded = np.where((padded >= 65) & (padded <= 90), padded + 32, padded)
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "sdmt"]) & ~first[mark + 1]
        pair = one * 256 + two
        long = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("ll", "ve", "re")])
        long &= ~first[mark + 1] & ~first[mark + 2]
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return lead[np.flatnonzero(start[:n])]


class Pretokens:
    """Ids of texts, pretoken by pretoken.

    ``encode_words`` gives the ids of each of some pretokens, ``encode_text`` those of a text
    that must be taken whole, ``whole`` tells which texts those are.
    """

    def __init__(
        self,
        spaced: bool,
        encode_words: Callable[[list[str]], list],
        encode_text: Callable[[str], list[int]],
        whole: Callable[[str], bool],
    ):
        self.spaced, self.encode_words = spaced, encode_words
        self.encode_text, self.whole = encode_text, whole
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY or self.held > MEMORY_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        got = list(map(self.known.get, words))
        if None in got:
            rest = [i for i, ids in enumerate(got) if ids is None]
            new = []
            for i in rest:
                ids = self.older.get(words[i])
                if ids is None:
                    new.append(i)
                else:
                    got[i] = self.known[words[i]] = ids
            fresh = [words[i] for i in new]
            for i, word, ids in zip(new, fresh, self.encode_words(fresh), strict=True):
                got[i] = self.known[word] = array("I", ids).tobytes()
                self.held += len(word) + len(got[i])
        return got

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each text has."""
        count = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(count, np.int64)
        filled = np.flatnonzero(np.diff(offsets))
        cuts = cut_points(data, offsets[filled], self.spaced)
        bounds = np.append(cuts, len(data)).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(data))
        packed = tokens.dictionary_encode()
        index = packed.indices.to_numpy()
        got = self._words(packed.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        pool = np.frombuffer(b"".join(got), "<u4")
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        shift = (np.cumsum(sizes) - sizes)[index] - (ends - lengths)
        ids = pool[np.repeat(shift, lengths) + np.arange(total)]
        running = np.concatenate([[0], ends])
        at = running[np.searchsorted(cuts, offsets)]
        return ids, np.diff(at)

    def one(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self._block(data, np.array([0, len(data)]))[0]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Position of the first text, the ids and the id counts of each block of texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(raw, raw[at] + BLOCK, "right")) - 1)
            end = min(end, len(texts))
            own = [at + i for i, x in enumerate(texts[at:end].to_pylist()) if self.whole(x)]
            if own and own[0] == at:
                ids = np.array(self.encode_text(texts[at].as_py()), np.uint32)
                yield at, ids, np.array([len(ids)], np.int64)
                at += 1
                continue
            end = own[0] if own else end
            yield (at, *self._block(data[raw[at] : raw[end]], raw[at : end + 1] - raw[at]))
            at = end


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library_pretokens(path: str) -> Pretokens:
    """For a vocabulary file of the tokenizers library, whose model encodes new pretokens.

    Texts with a special token in them are given to the library whole; so are texts of a
    normalising vocabulary that are not in composed form, or hold a letter whose lower case
    depends on its place or has two characters: there a pretoken alone could get other ids
    than within its text.
    """
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        plan = json.load(file)
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    special = [x["content"] for x in plan["added_tokens"]]
    spaced = plan["normalizer"] is None
    model, letters, kinds = library.model, byte_letters(), classes()

    def words(new: list[str]) -> list:
        if not spaced:
            new = ["" if kinds[ord(word[0])] == SPACE else word.lower() for word in new]
        new = [word.encode().decode("latin-1").translate(letters) for word in new]
        return [[x.id for x in model.tokenize(word)] for word in new]

    def text(value: str) -> list[int]:
        return library.encode(value, add_special_tokens=False).ids

    def whole(value: str) -> bool:
        if any(x in value for x in special):
            return True
        if spaced or value.isascii():
            return False
        return "İ" in value or "Σ" in value or not unicodedata.is_normalized("NFC", value)

    return Pretokens(spaced, words, text, whole)


def forget() -> None:
    """Give back a worker's memory of pretokens, for steps that don't tokenise."""
    if library_pretokens.cache_info().currsize:
        library_pretokens.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more at the end of each text."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end), counts + 1
