"""Finds secrets by fixed formats, and by formats inferred from those it found.

The fixed patterns give spans of three kinds: assigned values, access keys, hexadecimal strings.
Their values are the labelled credentials. For each kind a probabilistic automaton is
inferred from them: a prefix tree counts how often each state is reached, left by each
symbol and ended in; then states, nearest the root first, are merged with an earlier state
wherever Hoeffding's bound finds no difference in these shares, down through all their
successors. One more automaton is inferred from the other long strings. Every candidate, each
maximal run of ``LEAST`` or more symbols that meets no fixed span, is then scored by all
automata; it is added as ``<kind>_like`` where the best kind's likelihood, times the kind's share
in all texts, exceeds that of other strings by ``MARGIN``, and where its likelihood a symbol is
one that a credential of that kind has.

The texts are read twice, to collect values and to score, and are never shuffled. Values are
counted over all texts. An automaton is inferred in a task of its own from at most ``SAMPLE``
different values of up to ``LONGEST`` symbols, chosen by hash; that is the only bound,
candidates of any length are scored.

Defined results: null and empty texts have no spans, and the hash of nothing; every row gives a
row, repeated keys and null keys too; a kind that never occurs adds nothing; an empty table
gives no rows. Only the key and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin

# Fixed patterns and least lengths of the three kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KINDS = ("assign", "access", "hex")
OTHER = "other"
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
SYMBOLS = 67
END = ""

SAMPLE = 1000
LONGEST = 256
ALPHA = 0.05
MARGIN = math.log(100)
FLOOR = 0.02
REMEMBERED = 50_000


def fixed_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind number, end, start of the value)``, sorted.

    A run of hexadecimal digits is matched whole, so asking for its length in the pattern
    drops the same matches as asking afterwards; for assigned values it would not.
    """
    found = [
        (m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST
    ]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def free_candidates(text: str, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Long runs of symbols that no span touches."""
    edges = iter(sorted((s[0], s[2]) for s in spans))
    edge = next(edges, None)
    reach = -1
    for m in CANDIDATE.finditer(text):
        while edge is not None and edge[0] < m.end():
            reach = max(reach, edge[1])
            edge = next(edges, None)
        if reach <= m.start():
            yield m.span()


class Automaton:
    """States with their arrivals, ends, and successors by symbol, inferred from values."""

    def __init__(self) -> None:
        self.arrived, self.ended = [0], [0]
        self.taken: list[dict[str, int]] = [{}]
        self.after: list[dict[str, int]] = [{}]

    def add(self, value: str) -> None:
        """One more value in the prefix tree."""
        at = 0
        self.arrived[0] += 1
        for symbol in value:
            if symbol not in self.after[at]:
                self.after[at][symbol] = len(self.arrived)
                self.taken[at][symbol] = 0
                self.arrived.append(0)
                self.ended.append(0)
                self.taken.append({})
                self.after.append({})
            self.taken[at][symbol] += 1
            at = self.after[at][symbol]
            self.arrived[at] += 1
        self.ended[at] += 1

    def alike(self, one: int, two: int, alpha: float) -> bool:
        """Whether two states, and all that follows them both, differ by less than the bound."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        waiting, seen = [(one, two)], set()
        while waiting:
            a, b = waiting.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.arrived[a], self.arrived[b]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) >= bound:
                return False
            for symbol in self.taken[a].keys() | self.taken[b].keys():
                if abs(self.taken[a].get(symbol, 0) / n - self.taken[b].get(symbol, 0) / m) >= bound:
                    return False
                if symbol in self.after[a] and symbol in self.after[b]:
                    waiting.append((self.after[a][symbol], self.after[b][symbol]))
        return True

    def fold(self, kept: int, gone: int) -> None:
        """Add a tree's counts to a state and its successors."""
        waiting = [(kept, gone)]
        while waiting:
            a, b = waiting.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for symbol, n in self.taken[b].items():
                self.taken[a][symbol] = self.taken[a].get(symbol, 0) + n
                if symbol in self.after[a]:
                    waiting.append((self.after[a][symbol], self.after[b][symbol]))
                else:
                    self.after[a][symbol] = self.after[b][symbol]

    def merged(self, alpha: float) -> list[int]:
        """Merge compatible states; the states that stay.

        The successor of a kept state that most values reach is tried next, against the kept
        states in the order they were kept.
        """
        kept = [0]
        while True:
            open_ends = [
                (-self.arrived[child], state, symbol)
                for state in kept for symbol, child in self.after[state].items() if child not in kept
            ]
            if not open_ends:
                return kept
            _, state, symbol = min(open_ends)
            child = self.after[state][symbol]
            like = next((k for k in kept if self.alike(k, child, alpha)), None)
            if like is None:
                kept.append(child)
            else:
                self.after[state][symbol] = like
                self.fold(like, child)


def inferred(values: Iterable[str], alpha: float = ALPHA) -> list[tuple[int, str, int, int]]:
    """``(state, symbol, next state, count)``; the empty symbol ends a value. State 0 is the first."""
    automaton = Automaton()
    for value in sorted(values):
        automaton.add(value)
    kept = automaton.merged(alpha)
    number = {state: i for i, state in enumerate(kept)}
    rows = []
    for state in kept:
        rows += [(number[state], s, number[automaton.after[state][s]], n) for s, n in sorted(automaton.taken[state].items())]
        if automaton.ended[state]:
            rows.append((number[state], END, 0, automaton.ended[state]))
    return rows


class Format:
    """Likelihoods under an inferred automaton.

    A state's counts are smoothed by the shares of symbols in all states, and these by equal shares. A symbol
    that a state was never left by leads out of the automaton: from there on the shares of all states count.
    """

    def __init__(self, rows: Iterable[tuple[int, str, int, int]]):
        shares: dict[str, int] = {}
        arrived: dict[int, int] = {}
        self.steps: dict[tuple[int, str], tuple[float, int]] = {}
        rows = list(rows)
        for state, symbol, _, n in rows:
            shares[symbol] = shares.get(symbol, 0) + n
            arrived[state] = arrived.get(state, 0) + n
        total = sum(shares.values())
        self.share = {s: (n + 1 / (SYMBOLS + 1)) / (total + 1) for s, n in shares.items()}
        self.rare = 1 / (SYMBOLS + 1) / (total + 1)
        for state, symbol, following, n in rows:
            self.steps[state, symbol] = (math.log((n + self.share[symbol]) / (arrived[state] + 1)), following)
        self.lost = {state: 1 / (n + 1) for state, n in arrived.items()}
        self.lost[-1] = 1.0

    def likelihood(self, value: str) -> float:
        """Logarithm of the value's probability."""
        at, total = 0, 0.0
        for symbol in (*value, END):
            step = self.steps.get((at, symbol))
            if step is None:
                total += math.log(self.lost[at] * self.share.get(symbol, self.rare))
                at = -1
            else:
                total += step[0]
                at = step[1]
        return total


class Judge:
    """Which kind of credential a candidate is, if any."""

    def __init__(self, formats: dict[str, list], counts: dict[str, int], floors: dict[str, float], margin: float = MARGIN):
        self.formats = {kind: Format(rows) for kind, rows in formats.items()}
        total = sum(counts.values())
        self.share = {kind: math.log(n / total) for kind, n in counts.items()}
        self.floors, self.margin = floors, margin

    def kind(self, value: str) -> str | None:
        scores = {k: f.likelihood(value) for k, f in self.formats.items()}
        known = [k for k in KINDS if k in scores and scores[k] / (len(value) + 1) >= self.floors[k]]
        if not known:
            return None
        best = max(known, key=lambda k: scores[k] + self.share[k])
        if OTHER not in scores:
            return best
        return best if scores[best] + self.share[best] - scores[OTHER] - self.share[OTHER] > self.margin else None


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind and value of every fixed span, and every other candidate."""
    for batch in batches:
        kinds, values = [], []
        for text in batch.column(0).to_pylist():
            if text:
                spans = fixed_spans(text)
                kinds += [KINDS[s[1]] for s in spans]
                values += [text[s[3] : s[2]] for s in spans]
                others = [text[a:b] for a, b in free_candidates(text, spans)]
                kinds += [OTHER] * len(others)
                values += others
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


def _infer(alpha: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = sorted(group["value"])
        rows = inferred(values, alpha)
        form = Format(rows)
        each = sorted(form.likelihood(v) / (len(v) + 1) for v in values)
        floor = each[int(len(each) * FLOOR)]
        out = pd.DataFrame(rows, columns=["state", "symbol", "following", "n"])
        return out.assign(kind=group["kind"].iloc[0], floor=floor)

    return run


def learned_formats(docs: DataFrame, text: str = "text", sample: int = SAMPLE, alpha: float = ALPHA) -> tuple[dict, dict, dict]:
    """Automata, numbers of different values and floors by kind.

    The driver receives the automata, whose size the sample bounds, and four counts.
    """
    seen = pin(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_values, "kind string, value string").distinct())
    counts = {r["kind"]: r["count"] for r in seen.groupBy("kind").count().collect()}
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    short = seen.where(F.char_length("value") <= LONGEST)
    chosen = short.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample).select("kind", "value")
    found = chosen.groupBy("kind").applyInPandas(_infer(alpha), "state long, symbol string, following long, n long, kind string, floor double")
    formats: dict[str, list] = {}
    floors: dict[str, float] = {}
    for r in found.collect():
        formats.setdefault(r["kind"], []).append((r["state"], r["symbol"], r["following"], r["n"]))
        floors[r["kind"]] = r["floor"]
    return formats, counts, floors


def joined(spans: Iterable[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` by start, then kind."""
    return ",".join(f"{name}:{start}:{end}" for start, _, name, end in sorted(spans))


def _scan(judge: Judge) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                fixed = fixed_spans(text)
                base = [(s[0], s[1], KINDS[s[1]], s[2]) for s in fixed]
                added = []
                for a, b in free_candidates(text, fixed):
                    value = text[a:b]
                    if value not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[value] = judge.kind(value)
                    if known[value] is not None:
                        added.append((a, len(KINDS) + KINDS.index(known[value]), f"{known[value]}_like", b))
                numbers = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((*numbers, joined(base), joined(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base", "spans", "n_added"]
            )

    return run


def secret_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, alpha: float = ALPHA, margin: float = MARGIN
) -> DataFrame:
    """Per row: the key, ``n_assign``, ``n_access``, ``n_hex``, the fixed spans (``base``), all ``spans`` as text and ``n_added``."""
    judge = Judge(*learned_formats(docs, text, sample, alpha), margin)
    inner = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = inner.schema["_key"].dataType.simpleString()
    found = inner.mapInArrow(
        _scan(judge), f"_key {kind}, n_assign long, n_access long, n_hex long, base string, spans string, n_added long"
    )
    return found.withColumnRenamed("_key", key)


def digest(spans: DataFrame) -> DataFrame:
    """The spans with the hash of the fixed ones in place of their text."""
    return spans.withColumn("base", F.sha2("base", 256)).withColumnRenamed("base", "base_sha256")
