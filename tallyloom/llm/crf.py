"""Toxic spans by a linear-chain conditional random field, and document scores from it.

The chain is a sentence (at most ``CHAIN`` words); each word is outside or toxic. Features are
the word and its prefixes of 4 to 6 letters, for the word itself and for its neighbours, and
the transitions. Only features that mark toxic documents are kept: their counts over all
labelled training rows must be further from chance than the number of features explains
(likelihood ratio above ``DOUBT`` times its logarithm), with a share of toxic rows of ``LIFT`` times
that of all rows at least, or ``PURE`` if that is less. Words of toxic rows with such a feature are the labelled tokens. The weights
maximise the likelihood of tagged sentences of a bounded sample (``SAMPLE`` rows a class);
forward and backward passes run over all sentences of a block at once. A row's score is a
logistic function of the largest marginal, the expected number of toxic words and the number
of all words, fitted on the same sample and shifted to the share of toxic rows.

Labels of rows whose checksum of the key leaves 0 on division by 5 are held out. Rows with a
null or conflicting label (mean one half) train nothing; neither do labels of keys without a document. Null and empty texts have no words:
their score is that of no toxic word. Without labelled rows of both classes, with texts, every score
is the known share (0 if there is none). Repeated rows get equal scores.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tallyloom.llm.rows import set_aside
from tallyloom.llm.wordblocks import Words, word_blocks
from tallyloom.sources.workspace import pin

log = logging.getLogger(__name__)

CHAIN = 256
SAMPLE = 800
FEATURES = 20_000
HELD = 200_000
DOUBT = 2.0
PURE = 0.3
LIFT = 3.0
BROADCAST_ROWS = 200_000
ROUNDS = 60


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(name: str) -> list[str]:
    """The word and its prefixes, in lower case."""
    word = name.lower()
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


def feature_counts(rows: DataFrame) -> DataFrame:
    """Training rows with each feature, by class; ``rows`` has ``text`` and ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, block in word_blocks(batch.column(0)):
                pairs = np.unique(block.doc.astype(np.int64) * len(block.names) + block.word)
                feats = {u: features_of(block.names[u]) for u in set((pairs % len(block.names)).tolist())}
                cut = np.split(pairs % len(block.names), np.searchsorted(pairs // len(block.names), np.arange(1, block.texts)))
                for doc, own in enumerate(cut):
                    counts[int(labels[at + doc])].update({f for u in own.tolist() for f in feats[u]})
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield out()
        yield out()

    found = rows.select("text", "label").mapInArrow(run, "feature string, clean long, toxic long")
    return found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def marking_features(counts: DataFrame, clean: int, toxic: int) -> list[str]:
    """Features of toxic rows beyond chance; those go to the driver. Should more than ``FEATURES`` be found,
    the strongest are kept and a warning names how many there were."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n, share = t + c, F.lit(toxic / (toxic + clean))
    part = lambda x, want: F.when(x > 0, x * F.log(x / want)).otherwise(F.lit(0.0))
    ratio = 2 * (part(t, n * share) + part(c, n * (1 - share)))
    total = counts.count()
    pure = min(PURE, LIFT * toxic / (toxic + clean))
    strong = counts.withColumn("g", ratio).where((t > n * share) & (t >= pure * n))
    rows = strong.where(F.col("g") > DOUBT * np.log(max(2, total)))
    found = [r["feature"] for r in rows.orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").collect()]
    if len(found) == FEATURES:
        log.warning("%d of %d features beyond chance are kept", FEATURES, rows.count())
    return found


class Field:
    """Weights of a two-state field: per feature for the word, the one before and after it."""

    def __init__(self, features: list[str]):
        self.place = {f: i + 1 for i, f in enumerate(features)}
        self.weights = np.zeros((3, len(features) + 1))
        self.bias = -3.0
        self.steps = np.array([[0.0, 0.0], [0.0, 0.0]])
        self.final = np.zeros(4)
        self.fallback: float | None = None

    def known(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (distinct string, feature) of a block."""
        strings, feats = [], []
        for u in np.unique(block.word).tolist():
            for f in features_of(block.names[u]):
                i = self.place.get(f)
                if i:
                    strings.append(u)
                    feats.append(i)
        return np.array(strings, np.int64), np.array(feats, np.int64)

    def emissions(self, block: Words, pairs: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> np.ndarray:
        sums = [np.bincount(pairs[0], w[pairs[1]], len(block.names)) for w in self.weights]
        own, before, after = (s[block.word] for s in sums)
        score = self.bias + own
        score[1:] += np.where(starts[1:], 0, before[:-1])
        score[:-1] += np.where(starts[1:], 0, after[1:])
        return score

    def marginals(self, score: np.ndarray, starts: np.ndarray, pairwise: bool = False):
        """Probability of each word to be toxic; ``starts`` marks the first words of chains.

        With ``pairwise`` also the expected number of each transition.
        """
        begin = np.flatnonzero(starts)
        sizes = np.diff(np.append(begin, len(score)))
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        e = np.exp(np.clip(score, -30, 30))
        step = np.exp(self.steps)
        f0, f1 = np.empty(len(score)), np.empty(len(score))
        for t in range(longest):
            at = begin[: active[t]] + t
            if t:
                p0, p1 = f0[at - 1], f1[at - 1]
                a, b = p0 * step[0, 0] + p1 * step[1, 0], (p0 * step[0, 1] + p1 * step[1, 1]) * e[at]
            else:
                a, b = np.ones(len(at)), e[at]
            total = a + b
            f0[at], f1[at] = a / total, b / total
        b0, b1 = np.ones(len(score)), np.ones(len(score))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            n0, n1 = b0[at + 1], e[at + 1] * b1[at + 1]
            if pairwise:
                x = [f0[at] * step[0, 0] * n0, f0[at] * step[0, 1] * n1, f1[at] * step[1, 0] * n0, f1[at] * step[1, 1] * n1]
                total = x[0] + x[1] + x[2] + x[3]
                expected += np.array([(v / total).sum() for v in x]).reshape(2, 2)
            a, b = step[0, 0] * n0 + step[0, 1] * n1, step[1, 0] * n0 + step[1, 1] * n1
            total = a + b
            b0[at], b1[at] = a / total, b / total
        p = f1 * b1 / (f0 * b0 + f1 * b1)
        return (p, expected) if pairwise else p

    def fit(self, block: Words, tags: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        """Ascend the penalised likelihood of the tags with per-weight step sizes."""
        starts = chain_starts(block)
        seen = np.zeros((2, 2))
        inside = ~starts[1:]
        np.add.at(seen, (tags[:-1][inside], tags[1:][inside]), 1)
        square = [np.full_like(self.weights, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
        for _ in range(ROUNDS):
            p, expected = self.marginals(self.emissions(block, pairs, starts), starts, pairwise=True)
            miss = tags - p
            shifted = [miss, np.where(starts[1:], 0, miss[1:]), np.where(starts[1:], 0, miss[:-1])]
            words = [block.word, block.word[:-1], block.word[1:]]
            grad = np.stack([
                np.bincount(pairs[1], np.bincount(w, m, len(block.names))[pairs[0]], self.weights.shape[1])
                for w, m in zip(words, shifted, strict=True)
            ]).astype(float)
            grad -= 0.1 * self.weights
            for i, (name, g) in enumerate((("weights", grad), ("bias", miss.sum()), ("steps", seen - expected - 0.1 * self.steps))):
                square[i] = square[i] + g * g
                setattr(self, name, getattr(self, name) + 0.5 * g / np.sqrt(square[i]))

    def document_views(self, block: Words, p: np.ndarray) -> np.ndarray:
        """Per text: log-odds of the largest marginal, log(1 + expected toxic words) and
        log(1 + words)."""
        top = np.full(block.texts, 1e-6)
        np.maximum.at(top, block.doc, p)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        expected = np.bincount(block.doc, np.where(p > 0.05, p, 0.0), block.texts)
        words = np.bincount(block.doc, minlength=block.texts)
        return np.stack([np.log(top / (1 - top)), np.log1p(expected), np.log1p(words)], 1)

    def scores(self, views: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(views), self.fallback)
        return 1 / (1 + np.exp(-(self.final[0] + views @ self.final[1:])))


def chain_starts(block: Words) -> np.ndarray:
    """First words of sentences and of each further ``CHAIN`` words of a long one."""
    if not len(block.word):
        return np.zeros(0, bool)
    starts = block.first.copy()
    starts[1:] |= block.doc[1:] != block.doc[:-1]
    at = np.arange(len(starts))
    return starts | ((at - np.maximum.accumulate(np.where(starts, at, 0))) % CHAIN == 0)


def logistic(views: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method; intercept first."""
    x = np.column_stack([np.ones(len(views)), views])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * len(x) * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (labels - p) - penalty * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def clean_labels(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """One row per key: 0 or 1 by the mean of its labels; undecided keys are left out."""
    mean = labels.where(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(column).alias("m"))
    return mean.where("m <> 0.5").select("_key", (F.col("m") > 0.5).cast("int").alias("label"))


def bounded_sample(docs: DataFrame, picked: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """Texts of at most ``rows`` keys; so few keys are safe to broadcast."""
    few = picked.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    return docs.join(F.broadcast(few), F.col(key) == F.col("_key")).dropDuplicates(["_key"])


def trained(docs: DataFrame, labels: DataFrame, column: str = "toxic", key: str = "doc_id", text: str = "text") -> Field:
    """A field from the training labels. The driver holds the features kept and the sample."""
    plain = docs.select(F.col(key), F.col(text).alias("text"))
    marked_keys = clean_labels(labels, column, key).where(~held_out(F.col("_key")))
    known = pin(marked_keys.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        field = Field([])
        field.fallback = toxic / max(1, toxic + clean)
        return field
    # Keys and labels of 16 bytes a row: few are sent to all, many are joined by shuffling.
    side = F.broadcast(known) if clean + toxic <= BROADCAST_ROWS else known
    rows = plain.join(side, F.col(key) == F.col("_key")).select("text", "label")
    field = Field(marking_features(pin(feature_counts(rows)), clean, toxic))
    parts = [
        bounded_sample(plain, known.where(F.col("label") == v), SAMPLE, key).select("_key", "text", "label").toPandas()
        for v in (0, 1)
    ]
    if not all(map(len, parts)):
        field.fallback = toxic / (toxic + clean)
        return field
    sample = pd.concat(parts).sort_values("_key")
    block = Words([t or "" for t in sample["text"]])
    label = sample["label"].to_numpy()
    pairs = field.known(block)
    marked = np.zeros(len(block.names), bool)
    marked[pairs[0]] = True
    tags = (marked[block.word] & (label[block.doc] == 1)).astype(np.int64)
    if len(block.word):
        field.fit(block, tags, pairs)
    starts = chain_starts(block)
    views = field.document_views(block, field.marginals(field.emissions(block, pairs, starts), starts))
    field.final = logistic(views, label)
    field.final[0] += np.log(toxic / clean) - np.log(max(1, label.sum()) / max(1, (1 - label).sum()))
    return field


def scored_rows(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """All columns, with ``_score`` and ``_spans`` (begin and end characters of toxic runs of
    words); rows are not moved."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in word_blocks(batch.column(where)):
                starts = chain_starts(block)
                p = field.marginals(field.emissions(block, field.known(block), starts), starts)
                spans: list[list] = [[] for _ in range(block.texts)]
                last = -2
                for i in np.flatnonzero(p >= 0.5).tolist():
                    own = spans[block.doc[i]]
                    if last == i - 1 and own and not starts[i]:
                        own[-1] = {"begin": own[-1]["begin"], "end": int(block.end[i])}
                    else:
                        own.append({"begin": int(block.start[i]), "end": int(block.end[i])})
                    last = i
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                part = batch.slice(at, block.texts)
                scores = pa.array(field.scores(field.document_views(block, p)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, scores, pa.array(spans, kind)], names=[*part.schema.names, "_score", "_spans"]
                )

    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    added = [StructField("_score", DoubleType()), StructField("_spans", ArrayType(span))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its fold, score, decision and spans."""
    found = scored_rows(docs.select("doc_id", "text"), trained(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_spans").alias("spans"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic."""
    inner, back = set_aside(docs, ["doc_id", "text"])
    return back(scored_rows(inner, trained(docs, labels)).where("_score < 0.5"))
