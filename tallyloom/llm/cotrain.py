"""Page quality by co-training a text view and a page view, and scores for all documents.

The text view has the words and the marks between them, in hashed counts relative to the
text's length. The page view has metadata (language, source, length) and layout: lines,
word lengths, shares of upper case, digits, marks and blanks, shares of different words and
lines. Each view has a logistic model. In each round each names the unlabelled rows it is sure
of (all beyond ``SURE``, calibrated on labelled rows kept apart; none that both are sure of in
opposite ways); they train the *other* view with that label, and both are fitted again. Afterwards both views are calibrated on labelled
rows kept apart, and a logistic model over both calibrated log-odds scores documents.

Labelled rows are a bounded sample (``LABELLED`` a class, by a hash of the key), which the
driver holds. Unlabelled rows are all others, null keys too, equal rows once: their features
are pinned, each pass names their labels from the models of the round before where the rows are, and only sums of gradients and curvature, whose size does not depend on the input,
come to the driver. A refit takes ``PASSES`` such passes: Newton steps for the page view,
limited-memory quasi-Newton steps for the text view. Weights are rounded after each round, so
that the order of the sums leaves no trace.

Held-out labels (checksum of the key leaves 0 on division by 5) train nothing. Null labels
are left out. Nulls in any column of a document count as empty or as a value of their own.
Without training rows of both classes every document gets the known share (1 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tallyloom.llm.crf import BROADCAST_ROWS, clean_labels, held_out, logistic
from tallyloom.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, classes
from tallyloom.llm.rows import set_aside
from tallyloom.llm.wordblocks import Words, word_blocks
from tallyloom.sources.workspace import pin

LABELLED = 1500
TURNS = 4
PASSES = 4
SURE = 0.95
WIDTH = 1 << 15
NAMES = 32
PAGE = 12 + 2 * NAMES
TOTAL = 10
SHRINK = 0.002
ROWS = 1024
NEEDED = ["doc_id", "text", "lang", "source", "n_chars"]


@lru_cache(maxsize=1)
def upper_case() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isupper()]] = True
    return table


def slots(names: list[str], width: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(n.encode()) % width for n in names), np.int64, len(names))


def text_cells(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each word and each string between words."""
    slot = slots(block.names, WIDTH)
    return np.concatenate([block.doc, block.doc]), np.concatenate([slot[block.word], slot[block.gap]])


def page_view(block: Words, texts: list[str], lang: list, source: list, chars: list) -> np.ndarray:
    """Metadata and layout of each text."""
    n = block.texts
    owner = np.repeat(np.arange(n), block.sizes)
    at = np.repeat(block.begin, block.sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(block.sizes) - block.sizes, block.sizes)
    points = block.points[at]
    kind = classes()[points]
    total = np.maximum(1, block.sizes)
    share = lambda mask: np.bincount(owner[mask], minlength=n) / total
    letters = np.maximum(1e-9, share(kind == LETTER))
    words = np.bincount(block.doc, minlength=n)
    pairs = np.unique(block.doc * len(block.names) + block.word)
    different = np.bincount(pairs // max(1, len(block.names)), minlength=n)
    size = np.bincount(block.doc, block.end - block.start, n)
    lines = [t.split("\n") for t in texts]
    out = [
        np.log1p([float(c) if c is not None else 0.0 for c in chars]), np.log1p(block.sizes), np.log1p(words),
        np.log1p([len(x) for x in lines]), size / np.maximum(1, words), share(upper_case()[points]) / letters,
        share(kind == NUMBER), share(kind == OTHER), share(kind == SPACE), different / np.maximum(1, words),
        np.array([len(set(x)) / len(x) for x in lines]), (words == 0).astype(float),
    ]
    named = np.zeros((n, 2 * NAMES))
    for half, values in enumerate((lang, source)):
        named[np.arange(n), half * NAMES + slots([f"{v}" for v in values], NAMES)] = 1
    return np.column_stack([*out, named])


class SparseRows:
    """Rows of (slot, value) pairs, from the number of pairs of each row, slots and counts.

    Values of a row add up to ``TOTAL``.
    """

    def __init__(self, sizes: np.ndarray, slot: np.ndarray, count: np.ndarray):
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.slot = slot.astype(np.int64)
        self.value = TOTAL * count / np.bincount(self.row, count, self.n)[self.row]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.slot], self.n) + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.slot, self.value * g[self.row], WIDTH), g.sum())


def unpacked(dense: pa.Array, slot: pa.Array, count: pa.Array) -> tuple[np.ndarray, SparseRows]:
    """Page features and text cells of rows of ``viewed``."""
    cells = [x.to_pylist() for x in (dense, slot, count)]
    sizes = np.fromiter((len(c) // 2 for c in cells[1]), np.int64, len(cells[1]))
    page, slots_, counts = (np.frombuffer(b"".join(c), t) for c, t in zip(cells, (np.float64, np.uint16, np.uint32), strict=True))
    return page.reshape(len(sizes), PAGE), SparseRows(sizes, slots_, counts)


def sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_text(rows: SparseRows, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Penalised logistic weights by adaptive steps; the last one is the intercept."""
    w = np.zeros(WIDTH + 1)
    square = np.full(WIDTH + 1, 1e-8)
    for _ in range(60):
        g = rows.back((labels - sigmoid(rows.times(w))) * weights) - SHRINK * w
        square += g * g
        w += 0.5 * g / np.sqrt(square)
    return w


class Views:
    """Both fitted views, their calibration and their combination."""

    def __init__(self) -> None:
        self.fallback: float | None = None
        self.text = np.zeros(WIDTH + 1)
        self.middle, self.scale, self.page = np.zeros(0), np.zeros(0), np.zeros(0)
        self.calibration = [np.array([0.0, 1.0])] * 2
        self.both = np.array([0.0, 0.5, 0.5])

    def page_odds(self, dense: np.ndarray) -> np.ndarray:
        return self.page[0] + (dense - self.middle) / self.scale @ self.page[1:]

    def combined(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        odds = [c[0] + c[1] * v for c, v in zip(self.calibration, (text, page), strict=True)]
        return self.both[0] + self.both[1] * odds[0] + self.both[2] * odds[1]


def weighted_logistic(dense: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(dense)), dense])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) * weights)[:, None]).T @ x + 1.0 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ ((labels - p) * weights) - 1.0 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def view_sums(dense: np.ndarray, rows: SparseRows, labels: np.ndarray, text: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Sums over labelled rows, each by class: rows a view, loss, gradient and curvature bound
    of the text view, gradient and curvature of the page view. ``labels``: one line a view
    (-1: none). ``dense`` is scaled, with a leading one."""
    p, q = sigmoid(rows.times(text)), sigmoid(dense @ page)
    out = []
    for y in (0, 1):
        own, other = labels == y
        x, part = dense[other], q[other]
        out += [
            [own.sum(), other.sum(), *(-np.log(np.where(u, v if y else 1 - v, 1)).sum() for u, v in ((own, p), (other, q)))], rows.back(np.where(own, y - p, 0)),
            # No curvature exceeds the sum over a row's values, TOTAL and the intercept's one.
            (TOTAL + 1) * rows.back(np.where(own, p * (1 - p) + 0.02, 0)), x.T @ (y - part), ((x * (part * (1 - part))[:, None]).T @ x).ravel(),
        ]
    return np.concatenate(out)


def split_sums(sums: np.ndarray) -> list[list[np.ndarray]]:
    """By class: the five parts of ``view_sums``."""
    sizes = [4, WIDTH + 1, WIDTH + 1, PAGE + 1, (PAGE + 1) ** 2]
    return [np.split(half, np.cumsum(sizes)[:-1]) for half in np.split(sums, 2)]


def named_rows(text: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Labels that train each view, given by the other one's odds (-1: none). Rows that the
    views are sure of in opposite ways get none."""
    edge = np.log(SURE / (1 - SURE))
    labels = np.array([np.where(np.abs(v) >= edge, v > 0, -1) for v in (page, text)]).astype(np.int64)
    labels[:, (labels >= 0).all(0) & (labels[0] != labels[1])] = -1
    return labels


def summed(free: DataFrame, size: int, of) -> np.ndarray:
    """Sum of the vectors that ``of`` makes of the unlabelled rows' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += of(*unpacked(*batch.slice(at, ROWS).columns))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "v"])

    found = free.select("dense", "slots", "counts").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out


def direction(g: np.ndarray, bound: np.ndarray, steps: list) -> np.ndarray:
    """Limited-memory quasi-Newton step down ``g``; ``steps``: moves and changes of ``g``."""
    d, sizes = g.copy(), []
    for s, y in reversed(steps):
        sizes.append(s @ d / (s @ y))
        d -= sizes[-1] * y
    d /= bound
    if steps:
        s, y = steps[-1]
        d *= s @ y / (y @ (y / bound))
    for (s, y), a in zip(steps, reversed(sizes), strict=True):
        d += (a - y @ d / (s @ y)) * s
    return -d


def refitted(total, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views after ``PASSES`` passes; ``total`` gives ``view_sums`` over all rows."""
    best, top, steps, bound = None, None, [], None
    for _ in range(PASSES):
        halves = split_sums(total(text, page))
        count = np.array([h[0] for h in halves])[:, :2]
        weight = np.maximum(1, count.sum(0)) / (2 * np.maximum(1, count))
        add = lambda part, view: sum(h[part] * w for h, w in zip(halves, weight[:, view], strict=True))
        loss, other = (add(0, view)[2 + view] for view in (0, 1))
        loss, other = loss + SHRINK / 2 * text @ text, other + page @ page / 2
        g = SHRINK * text - add(1, 0)
        if best is None or loss <= best[0]:
            if best is not None and (text - best[1]) @ (g - best[2]) > 0:
                steps.append((text - best[1], g - best[2]))
            bound = add(2, 0) + SHRINK if bound is None else bound
            best = (loss, text, g)
            text = text + direction(g, bound, steps)
        else:
            text = (best[1] + text) / 2
        if top is None or other <= top[0]:
            top = (other, page)
            hess = add(4, 1).reshape(PAGE + 1, PAGE + 1) + np.eye(PAGE + 1)
            page = page + np.clip(np.linalg.solve(hess, add(3, 1) - page), -5, 5)
        else:
            page = (top[1] + page) / 2
    return np.round(best[1], 9), np.round(top[1], 9)


def balance(y: np.ndarray) -> np.ndarray:
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - ones)
    return np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * zeros))


def co_trained(sample: pa.Table, free: DataFrame, share: float) -> Views:
    """``sample``: labelled rows of ``viewed`` in a fixed order; ``free``: the unlabelled ones."""
    views = Views()
    cells = ("dense", "slots", "counts")
    label = sample.column("label").to_numpy()
    apart = np.arange(len(label)) % 4 == 0

    def part(mask: np.ndarray) -> tuple[np.ndarray, SparseRows]:
        rows = sample.filter(pa.array(mask))
        return unpacked(*(rows.column(c).combine_chunks() for c in cells))

    (own, own_rows), (held, held_rows), y = part(~apart), part(apart), label[apart]
    known = label[~apart]
    moments = lambda dense, rows: np.concatenate([[rows.n], dense.sum(0), (dense * dense).sum(0)])
    apart_own = moments(np.concatenate([own, held]), SparseRows(np.zeros(len(label), np.int64), np.zeros(0), np.zeros(0)))
    pool = summed(free, 1 + 2 * PAGE, moments)
    n, first, second = np.split(pool + apart_own, [1, 1 + PAGE])
    middle = np.round(first / n, 9)
    scale = np.round(np.sqrt(np.maximum(0, second / n - middle**2)), 6) + 1e-3
    views.middle, views.scale = middle, scale
    scaled = lambda dense: np.column_stack([np.ones(len(dense)), (dense - middle) / scale])
    views.text = np.round(fit_text(own_rows, known, balance(known)), 9)
    views.page = np.round(weighted_logistic(scaled(own)[:, 1:], known, balance(known)), 9)
    own = scaled(own)
    size = 2 * (4 + 2 * (WIDTH + 1) + (PAGE + 1) * (PAGE + 2))
    seen = min(max(y.mean(), 1e-3), 1 - 1e-3)
    shift = np.array([np.log(share / (1 - share)) - np.log(seen / (1 - seen)), 0.0])

    def calibrated() -> list[np.ndarray]:
        """Intercept and slope of each view's odds, on the labelled rows kept apart."""
        return [np.round(logistic(v[:, None], y, 1e-4), 9) for v in (held_rows.times(views.text), views.page_odds(held))]

    for _ in range(TURNS if pool[0] else 0):
        # Fitted with balanced classes, so what is sure is judged at the share of the labels.
        before, (c, d) = (views.text, views.page), [x + shift for x in calibrated()]

        def total(text: np.ndarray, page: np.ndarray) -> np.ndarray:
            def of(dense: np.ndarray, rows: SparseRows) -> np.ndarray:
                dense = scaled(dense)
                named = named_rows(c[0] + c[1] * rows.times(before[0]), d[0] + d[1] * (dense @ before[1]))
                return view_sums(dense, rows, named, text, page)

            return summed(free, size, of) + view_sums(own, own_rows, np.stack([known, known]), text, page)

        views.text, views.page = refitted(total, views.text, views.page)
    odds = (held_rows.times(views.text), views.page_odds(held))
    views.calibration = calibrated()
    both = np.column_stack([c[0] + c[1] * v for c, v in zip(views.calibration, odds, strict=True)])
    views.both = logistic(both, y, 1e-4)
    views.both[0] += shift[0]
    return views


def viewed(rows: DataFrame) -> DataFrame:
    """Features of rows (``text``, ``lang``, ``source``, ``n_chars``); other columns are kept."""
    kept = [f for f in rows.schema.fields if f.name not in NEEDED[1:]]
    columns = ["text", "lang", "source", "n_chars", *(f.name for f in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:4]]
            for at, block in word_blocks(batch.column(0)):
                end = at + block.texts
                dense = page_view(block, [t or "" for t in cols[0][at:end]], *(c[at:end] for c in cols[1:4]))
                doc, slot = text_cells(block)
                pair, count = np.unique(doc * WIDTH + slot, return_counts=True)
                doc, slot = pair // WIDTH, pair % WIDTH
                cuts = np.searchsorted(doc, np.arange(1, block.texts))
                packed = (list(dense), np.split(slot.astype(np.uint16), cuts), np.split(count.astype(np.uint32), cuts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, block.texts).columns[4:], *(pa.array([x.tobytes() for x in c], pa.binary()) for c in packed)],
                    names=[*columns[4:], "dense", "slots", "counts"],
                )

    added = [StructField(n, BinaryType()) for n in ("dense", "slots", "counts")]
    return rows.select(*columns).mapInArrow(run, StructType([*kept, *added]))


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Features of the rows without a label, equal rows once (by a hash of 128 bits)."""
    side = known.select("_key")
    if known.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = docs.select(*NEEDED).join(side, F.col("doc_id") == F.col("_key"), "left_anti").select(*NEEDED[1:])
    whole = [*NEEDED[1:], *(F.isnull(c) for c in NEEDED[1:])]
    rows = rows.withColumn("_one", F.xxhash64(*whole)).withColumn("_two", F.xxhash64(F.lit("again"), *whole))
    return pin(viewed(rows).dropDuplicates(["_one", "_two"]).drop("_one", "_two"))


def trained(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Views:
    known = pin(clean_labels(labels, column))
    training = known.where(~held_out(F.col("_key")))
    sizes = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        views = Views()
        views.fallback = good / (good + bad) if good + bad else 1.0
        return views
    order = (F.xxhash64("_key"), "_key")
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_key")).distinct()
    parts = [training.join(ids, "_key", "left_semi").where(F.col("label") == v).orderBy(*order).limit(LABELLED) for v in (0, 1)]
    picked = pin(parts[0].unionByName(parts[1]))
    # At most 2 * LABELLED keys: the bound of this broadcast.
    rows = docs.select(*NEEDED).join(F.broadcast(picked), F.col("doc_id") == F.col("_key")).drop("doc_id")
    sample = viewed(rows.dropDuplicates(["_key"])).toArrow().sort_by("_key")
    if set(sample.column("label").to_pylist()) & {0, 1} != {0, 1}:
        views = Views()
        views.fallback = good / (good + bad)
        return views
    return co_trained(sample, unlabelled(docs, known), good / (good + bad))


def scored_rows(docs: DataFrame, views: Views) -> DataFrame:
    """All columns, with the calibrated scores ``_text``, ``_page`` and the combined ``_score``."""
    names = docs.columns
    where = [names.index(n) for n in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        for batch in batches:
            text_, *rest = (batch.column(i) for i in where)
            cols = [c.to_pylist() for c in rest]
            for at, block in word_blocks(text_):
                part = batch.slice(at, block.texts)
                scores = [np.full(block.texts, views.fallback)] * 3
                if views.fallback is None:
                    texts = ["" if t is None else t for t in part.column(where[0]).to_pylist()]
                    dense = page_view(block, texts, *(c[at : at + block.texts] for c in cols))
                    doc, slot = text_cells(block)
                    sums = np.bincount(doc, views.text[slot], block.texts)
                    text = TOTAL * sums / np.maximum(1, np.bincount(doc, minlength=block.texts)) + views.text[-1]
                    page = views.page_odds(dense)
                    scores = [chance(c[0] + c[1] * v) for c, v in zip(views.calibration, (text, page), strict=True)]
                    scores.append(chance(views.combined(text, page)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(s, pa.float64()) for s in scores)], names=[*names, "_text", "_page", "_score"]
                )

    added = [StructField(n, DoubleType()) for n in ("_text", "_page", "_score")]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document: fold, both views' calibrated scores, the combined score, and whether it
    is kept (score of one half or more)."""
    found = scored_rows(docs.select(*NEEDED), trained(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_text").alias("text_score"),
        F.col("_page").alias("page_score"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose combined score is one half or more."""
    inner, back = set_aside(docs, NEEDED)
    return back(scored_rows(inner, trained(docs, labels)).where("_score >= 0.5"))
