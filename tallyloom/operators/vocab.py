"""Byte-pair vocabulary training and encoding as counting jobs over distinct pieces.

Training goes in rounds. A round counts all adjacent pairs on the cluster and takes those above
some count, the *floor*. Where neither an old nor a later pair of a text can exceed the floor,
that text is cut; what is left are *chains*, whose weights are added up over all pieces. A
pair that merges make is at most as frequent as the old pair at its junction, so every
occurrence of every pair above the floor, old or new, lies inside a chain: the chains
alone tell the order of all merges down to the floor. Their number is checked; the floor is raised
until there are at most ``CHAINS``, and the driver follows the merges on them. Then all
pieces take these merges in one pass and are written, which cuts the lineage. A vocabulary of
16,000 ids takes some tens of rounds instead of one for each merge.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import composed
from tallyloom.sources.workspace import pin

# Reserved tokens, in id order.
SPECIAL_TOKENS = [
    "<|endoftext|>",
    "<|pad|>",
    "<|im_start|>",
    "<|im_end|>",
    "<|user|>",
    "<|assistant|>",
    "<|system|>",
]
# Fixed pattern: how text is cut into pieces that merges never cross.
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: itself when printable, else a shifted letter."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


def first_ids() -> dict[int, int]:
    """Id of each byte: behind the reserved tokens, ordered by stand-in."""
    letters = byte_alphabet()
    ranked = sorted(range(256), key=lambda b: letters[b])
    return {b: len(SPECIAL_TOKENS) + i for i, b in enumerate(ranked)}


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PIECE), F.lit(0))


def piece_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """How often each piece occurs; counts are added up before the shuffle."""
    return (
        texts.select(composed(F.col(text)).alias("_t"))
        .select(F.explode(_pieces(F.col("_t"))).alias("piece"))
        .groupBy("piece")
        .agg(F.count("*").alias("n"))
    )


def symbol(token_id: int) -> str:
    """One character per token id, so that joining a pair is a text replacement."""
    code = 0x100 + token_id
    return chr(code if code < 0xD800 else code + 0x800)


def token_id(char: str) -> int:
    code = ord(char)
    return (code if code < 0xD800 else code - 0x800) - 0x100


def _byte_symbols(piece: Column) -> Column:
    """The UTF-8 bytes of a piece as symbols."""
    as_chars = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    ids = first_ids()
    return F.translate(
        as_chars,
        "".join(chr(b) for b in range(256)),
        "".join(symbol(ids[b]) for b in range(256)),
    )


def _pairs(symbols: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.char_length(symbols) - 1),
        lambda i: F.substr(symbols, i, F.lit(2)),
    )


#: Most pairs and chains the driver looks at in a round.
TOP = 1 << 14
CHAINS = 1 << 16
#: Chains a task counts before it hands them on.
HELD = 1 << 16


def joined_symbols(symbols: str, ranks: dict[str, tuple[int, str]]) -> str:
    """Merge the pair of lowest rank, leftmost first, until no pair has one."""
    waiting = [(*ranks[symbols[i : i + 2]], i) for i in range(len(symbols) - 1) if symbols[i : i + 2] in ranks]
    if not waiting:
        return symbols
    heapq.heapify(waiting)
    at = list(symbols)
    after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
    while waiting:
        _, new, i = heapq.heappop(waiting)
        j = after[i] if at[i] else len(at)
        if j == len(at) or ranks.get(at[i] + at[j], (0, ""))[1] != new:
            continue
        at[i], at[j] = new, ""
        after[i] = after[j]
        if after[i] < len(at):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(at):
                found = ranks.get(at[k] + at[after[k]])
                if found:
                    heapq.heappush(waiting, (*found, k))
    return "".join(at)


class PairSet:
    """Pairs of symbols that are looked for in whole batches of texts at once.

    Most pairs of a text fail by their left or right symbol alone; only the others are searched for.
    """

    def __init__(self, pairs: Iterable[str]) -> None:
        codes = _codes("".join(pairs)).reshape(-1, 2)
        self.known = np.unique(_pair_codes(codes[:, 0], codes[:, 1]))
        self.left, self.right = (np.zeros(int(codes.max(initial=0)) + 2, dtype=bool) for _ in "ab")
        self.left[codes[:, 0]] = self.right[codes[:, 1]] = True

    def found(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions of symbols that make a pair of the set with the next one of their text."""
        beyond = len(self.left) - 1
        held = np.minimum(codes, beyond)
        maybe = self.left[held[:-1]] & self.right[held[1:]]
        maybe[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(codes))] - 1] = False
        at = np.flatnonzero(maybe)
        if not len(at):
            return at
        wanted = _pair_codes(codes[at], codes[at + 1])
        place = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        return at[self.known[place] == wanted]


def _codes(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode("utf-32-le") or bytearray(), dtype=np.uint32)


def _pair_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)


def _laid_out(texts: pa.StringArray) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in a row, their symbols' codes, and where each text ends; no text is taken out by itself."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(texts)], texts), "")[0].as_py()
    return joined, _codes(joined), np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)


def with_merges(words: DataFrame, learned: list[tuple[int, int, int, int]]) -> DataFrame:
    """The symbols ``s`` of all pieces after some merges; pieces are not moved."""
    ranks = {symbol(a) + symbol(b): (i, symbol(new)) for i, (a, b, new, _) in enumerate(learned)}
    place = words.columns.index("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = PairSet(ranks)
        for batch in batches:
            texts = batch.column(place)
            _, codes, ends = _laid_out(texts)
            touched = np.unique(np.searchsorted(ends, pairs.found(codes, ends), side="right"))
            joined = [joined_symbols(x, ranks) for x in texts.take(pa.array(touched)).to_pylist()]
            there = np.zeros(len(texts), dtype=bool)
            there[touched] = True
            columns = list(batch.columns)
            columns[place] = pc.replace_with_mask(texts, pa.array(there), pa.array(joined, texts.type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return words.mapInArrow(run, words.schema)


def chains_of(symbols: str, pairs: set[str]) -> Iterator[str]:
    """Longest runs of symbols whose adjacent pairs are all among ``pairs``."""
    return (chain for _, chain in chains_in(pa.array([symbols]), PairSet(pairs)))


def chains_in(texts: pa.StringArray, pairs: PairSet) -> Iterator[tuple[int, str]]:
    """The chains of many texts, each with the place of its text."""
    joined, codes, ends = _laid_out(texts)
    at = pairs.found(codes, ends)
    if not len(at):
        return
    # The last symbol of a text begins no pair, so runs of positions never go on into the next text.
    gaps = np.flatnonzero(np.diff(at) != 1)
    first = at[np.concatenate([[0], gaps + 1])]
    last = at[np.concatenate([gaps, [len(at) - 1]])]
    owner = np.searchsorted(ends, first, side="right")
    for i, start, stop in zip(owner.tolist(), first.tolist(), (last + 2).tolist(), strict=True):
        yield i, joined[start:stop]


def _counted_chains(pairs: set[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_for = PairSet(pairs)
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["chain", "n"])

        for batch in batches:
            weights = batch.column(1).to_numpy().tolist()
            for i, chain in chains_in(batch.column(0), looked_for):
                counts[chain] += weights[i]
            if len(counts) > HELD:
                yield out()
        yield out()

    return run


def pair_counts(words: DataFrame, min_count: int = 1) -> DataFrame:
    """How often each adjacent pair of symbols occurs in all pieces."""
    return (
        words.select("n", F.explode(_pairs(F.col("s"))).alias("pair"))
        .groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    )


def followed_merges(chains: Iterable[tuple[str, int]], floor: int, most: int, next_id: int) -> list[tuple[int, int, int, int]]:
    """Merges by falling count over weighted chains, as long as the best count exceeds ``floor``.

    A merge changes the counts of its chains only; equal counts go to the smaller ids.
    """
    words, weights = map(list, zip(*chains, strict=True))
    counts: dict[str, int] = defaultdict(int)
    where: dict[str, set[int]] = defaultdict(set)
    for i, word in enumerate(words):
        for k in range(len(word) - 1):
            counts[word[k : k + 2]] += weights[i]
            where[word[k : k + 2]].add(i)
    waiting = [(-n, pair) for pair, n in counts.items() if n > floor]
    heapq.heapify(waiting)
    learned: list[tuple[int, int, int, int]] = []
    while waiting and len(learned) < most:
        minus, pair = heapq.heappop(waiting)
        if counts.get(pair) != -minus:
            continue
        new = symbol(next_id)
        learned.append((token_id(pair[0]), token_id(pair[1]), next_id, -minus))
        next_id += 1
        changed: dict[str, int] = defaultdict(int)
        for i in where.pop(pair):
            old, weight = words[i], weights[i]
            words[i] = now = old.replace(pair, new)
            for k in range(len(old) - 1):
                changed[old[k : k + 2]] -= weight
            for k in range(len(now) - 1):
                changed[now[k : k + 2]] += weight
                if new in now[k : k + 2]:
                    where[now[k : k + 2]].add(i)
        for touched, by in changed.items():
            if by:
                counts[touched] += by
                if counts[touched] > floor:
                    heapq.heappush(waiting, (-counts[touched], touched))
    return learned


def learned_merges(
    counts: DataFrame, merges: int, min_count: int = 2, chains: int = CHAINS
) -> list[tuple[int, int, int, int]]:
    """Merges as (left id, right id, new id, count), most frequent pair first.

    Only distinct pieces are kept between rounds, pinned so that a lost executor never
    replays earlier rounds. Equal counts go to the smaller ids. Where one pair alone has more than
    ``chains`` chains, or the best pairs are all equally frequent, a round learns one merge.
    """
    spread = counts.sparkSession.sparkContext.defaultParallelism
    words = pin(
        counts.select("piece", _byte_symbols(F.col("piece")).alias("s"), "n")
        .filter(F.char_length("s") > 1)
        .repartition(spread, "piece")
        .select("s", "n")
    )
    next_id = len(SPECIAL_TOKENS) + 256
    learned: list[tuple[int, int, int, int]] = []
    width = TOP
    while len(learned) < merges:
        top = [(r["pair"], r["n"]) for r in pair_counts(words, min_count).orderBy(F.desc("n"), "pair").limit(TOP).collect()]
        if not top:
            break
        new: list[tuple[int, int, int, int]] = []
        width = min(2 * width, TOP)
        while not new:
            # Pairs beyond those looked at are at most as frequent as the floor.
            floor = top[width][1] if width < len(top) else top[-1][1] if len(top) == TOP else min_count - 1
            above = {pair for pair, n in top if n > floor}
            if not above:
                (pair, n) = top[0]
                new = [(token_id(pair[0]), token_id(pair[1]), next_id, n)]
                break
            found = words.select("s", "n").mapInArrow(_counted_chains(above), "chain string, n long")
            rows = found.groupBy("chain").agg(F.sum("n").alias("n")).limit(chains + 1).collect()
            if len(rows) <= chains:
                new = followed_merges([(r["chain"], r["n"]) for r in rows], floor, merges - len(learned), next_id)
            else:
                width //= 4
        learned += new
        next_id += len(new)
        if len(learned) < merges:
            words = pin(with_merges(words, new).filter(F.char_length("s") > 1))
    return learned


def piece_lengths(counts: DataFrame, learned: list[tuple[int, int, int, int]]) -> DataFrame:
    """``piece``, ``n``, ``s`` (one symbol a token) and ``n_tokens`` of every distinct piece."""
    symbols = counts.select("piece", "n", _byte_symbols(F.col("piece")).alias("s"))
    return with_merges(symbols, learned).withColumn("n_tokens", F.char_length("s"))


#: Frequent pieces that are sent to all tasks, so that no join meets a hot piece.
FREQUENT = 20_000


def token_counts(texts: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of every text, by adding up its pieces; keys are taken as unique.

    Occurrences of the ``FREQUENT`` most frequent pieces are added where they are. The others are counted by text
    first, then joined.
    """
    frequent = F.broadcast(
        pieces.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece", F.col("n_tokens").alias("known"))
    )
    occurring = texts.select(F.col(key), F.explode_outer(_pieces(composed(F.col(text)))).alias("piece"))
    rare = F.when(F.col("known").isNull(), F.col("piece")).alias("rare")
    summed = pin(
        occurring.join(frequent, "piece", "left").groupBy(F.col(key), rare)
        .agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("times"))
    )
    joined = summed.filter("rare IS NOT NULL").join(pieces.select(F.col("piece").alias("rare"), F.col("n_tokens").alias("each")), "rare")
    parts = summed.filter("rare IS NULL").select(key, "n_tokens").unionByName(
        joined.select(key, (F.col("times") * F.col("each")).alias("n_tokens"))
    )
    return parts.groupBy(key).agg(F.sum("n_tokens").cast("int").alias("n_tokens"))


def symbol_ids(symbols: Column) -> Column:
    """The token ids behind a piece's symbols."""
    code = lambda c: F.ascii(c)
    ids = F.transform(F.split(symbols, ""), lambda c: F.when(code(c) < 0xD800, code(c)).otherwise(code(c) - 0x800) - 0x100)
    return F.when(symbols == "", F.array().cast("array<int>")).otherwise(ids.cast("array<int>"))


def token_ids(
    texts: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text", eos: int | None = None
) -> DataFrame:
    """``key``, ``ids`` and ``n_tokens`` of every text, in order, with ``eos`` at the end; keys are taken as unique.

    Frequent pieces get their ids where they occur, the others by a join. A group holds the pieces of one
    text.
    """
    known = pieces.select("piece", "n", symbol_ids(F.col("s")).alias("found"))
    frequent = F.broadcast(known.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece", F.col("found").alias("near")))
    occurring = texts.select(F.col(key), F.posexplode_outer(_pieces(composed(F.col(text)))).alias("place", "piece"))
    met = occurring.join(frequent, "piece", "left")
    here = met.filter(F.col("near").isNotNull() | F.col("piece").isNull()).select(key, "place", F.col("near").alias("found"))
    rare = met.filter(F.col("near").isNull() & F.col("piece").isNotNull()).join(known.drop("n"), "piece").select(key, "place", "found")
    parts = F.array_sort(F.collect_list(F.struct("place", "found")))
    ids = F.flatten(F.filter(F.transform(parts, lambda p: p["found"]), lambda f: f.isNotNull()))
    if eos is not None:
        ids = F.concat(ids, F.array(F.lit(eos)))
    return here.unionByName(rare).groupBy(key).agg(ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


def spelled(learned: list[tuple[int, int, int, int]]) -> list[tuple[str, str, int]]:
    """Merges with both sides spelled in byte stand-ins, and their counts."""
    letters = byte_alphabet()
    text = {i: letters[b] for b, i in first_ids().items()}
    out = []
    for a, b, new, n in learned:
        text[new] = text[a] + text[b]
        out.append((text[a], text[b], n))
    return out


def tokenizer_json(learned: list[tuple[int, int, int, int]]) -> str:
    """Tokenizer definition of the learned merges, for ``subword_ids``."""
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

    letters = byte_alphabet()
    vocab = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
    vocab |= {letters[b]: i for b, i in first_ids().items()}
    pairs = [(a, b) for a, b, _ in spelled(learned)]
    for (a, b), (_, _, new, _) in zip(pairs, learned):
        vocab[a + b] = new
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=pairs))
    tokenizer.normalizer = normalizers.NFC()
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = decoders.ByteLevel()
    tokenizer.add_special_tokens(SPECIAL_TOKENS)
    return json.dumps(json.loads(tokenizer.to_str()))


def merge_table(counts: DataFrame, learned: list[tuple[int, int, int, int]]) -> DataFrame:
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(spelled(learned))]
    return counts.sparkSession.createDataFrame(
        rows, "merge_rank int, left_text string, right_text string, n long"
    )
