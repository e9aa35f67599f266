"""Words of a block of texts as arrays: distinct words, places, documents, sentence ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyloom.llm.pretokens import LETTER, NUMBER, classes, code_points, forget

BLOCK = 1 << 20
ENDS = [ord(c) for c in ".!?\n"]


class Words:
    """``names``: the distinct strings; ``word``: for each word its number in ``names``;
    ``start`` and ``end``: characters within its text; ``doc``: its text; ``first``: whether
    a sentence starts there; ``gap``: the number of the string before the word, in ``names``.
    """

    def __init__(self, texts: list[str]):
        data = np.frombuffer("\n".join(["", *texts, ""]).encode(), np.uint8)
        lead, points = code_points(data)
        lead = np.append(lead, len(data))
        kind = classes()[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes
        inside = (kind == LETTER) | (kind == NUMBER)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.texts = len(texts)
        self.kind, self.points, self.begin, self.sizes = kind, points, begin, sizes
        start, end = edge[::2], edge[1::2]
        bounds = lead[np.concatenate([[0], edge])].astype(np.int32)
        cells = pa.StringArray.from_buffers(len(edge), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        index = cells.indices.to_numpy()
        self.names = cells.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.gap, self.word = index[::2], index[1::2]
        self.doc = np.searchsorted(begin, start, "right") - 1
        stops = np.concatenate([[0], np.cumsum(np.isin(points, ENDS))])
        before = np.concatenate([[0], end[:-1]])
        self.first = stops[start] != stops[before]
        self.first[:1] = True
        self.start, self.end = start - begin[self.doc], end - begin[self.doc]


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Position of the first text and the words of blocks of about ``BLOCK`` bytes."""
    forget()
    values = ["" if v is None else v for v in texts.to_pylist()]
    at = 0
    while at < len(values):
        end, size = at, 0
        while end < len(values) and (end == at or size + len(values[end]) <= BLOCK):
            size += len(values[end])
            end += 1
        yield at, Words(values[at:end])
        at = end
