"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets decide.

Texts with the same shingle set fall together first, whatever their number. Each distinct
set sends its band keys; keys that two or more sets share are buckets. Pairs of a bucket of
at most ``SMALL`` sets are listed, once for all bands, and verified by joining both sets.
Larger buckets are cut into blocks by hash; each pair of blocks is a unit of work that
compares its sets as bit rows and gives back sums per set and one link per set to the root of
its group, never pairs. A pair that several large buckets share counts in the first.

Links between texts of different sets count every copy. ``class_id`` is the smallest key of
the connected class. Band and row counts follow from the wanted recall; every verified link is
exact. Nulls and texts without words have no shingles: no links, a class each. Rows with a
null key link like others; repeated keys with different texts stay apart but for their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.pretokens import forget
from tallyloom.llm.rows import set_aside
from tallyloom.llm.shingles import band_keys, band_plan, set_id, shingle_set, text_id
from tallyloom.sources.workspace import pin

SMALL = 32
BLOCK = 256


def signed_rows(docs: DataFrame, bands: int, rows: int, words: int, key: str, text: str) -> DataFrame:
    """Per row: key, a hash of the text, set id, number of shingles and band keys.

    The set of a text without words is named by the text itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                names, sizes, keys = [], [], []
                for value in part.column(2):
                    found = shingle_set(value.as_py(), words)
                    names.append(set_id(found) if len(found) else text_id(value.as_py()))
                    sizes.append(len(found))
                    keys.append(band_keys(found, bands, rows).view(np.int64) if len(found) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["key", "mark", "set_id", "size", "bands"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.xxhash64(text), F.col(text)).mapInArrow(
        run, f"key {kind}, mark long, set_id binary, size long, bands array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """The shingles of the wanted sets (``set_id``, ``key`` and ``mark`` of a row that has it).

    Rows and sets meet by the hash of the text too, so rows that share a key or have none
    don't meet each other's sets.
    """
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text")).join(
        wanted.select("set_id", F.col("key").alias("_wanted"), "mark"),
        (F.col("_mark") == F.col("mark")) & F.col("_key").eqNullSafe(F.col("_wanted")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [shingle_set(v.as_py(), words) for v in part.column(1)]
                own = [i for i, (f, n) in enumerate(zip(found, part.column(0), strict=True)) if set_id(f) == n.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())), pa.array([found[i].tobytes() for i in own], pa.binary())],
                    names=["set_id", "shingles"],
                )

    found = rows.select("set_id", "_text").mapInArrow(run, "set_id binary, shingles binary")
    return found.groupBy("set_id").agg(F.min("shingles").alias("shingles"))


def enough(common, size_a, size_b, threshold: float):
    """Whether Jaccard reaches the threshold; scaled to whole numbers for decimal thresholds."""
    parts = round(threshold * 10_000)
    return common * (10_000 + parts) >= parts * (size_a + size_b)


def verified_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of set ids whose sets are similar enough."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"), F.col("large").alias("la"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"), F.col("large").alias("lb"))
    joined = pairs.join(left, "a").join(right, "b").where(~F.coalesce(F.arrays_overlap("la", "lb"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_py(), "<u8")
                y = np.frombuffer(batch.column(3)[i].as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if enough(common, len(x), len(y), threshold):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"]
            )

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def similar_in_unit(shingles: list[np.ndarray], threshold: float, split: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later members (of the other block, from ``split`` on, if there is
    one) that are similar enough; shingles of one member alone cannot be common."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    values, index, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    width = (int(shared.sum()) + 63) // 64
    bits = np.zeros((len(shingles), max(1, width)), np.uint64)
    owner = np.repeat(np.arange(len(shingles)), sizes)
    keep = shared[index]
    at, owner = place[index[keep]], owner[keep]
    np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    last = split if split < len(shingles) else len(shingles)
    for i in range(last):
        begin = split if split < len(shingles) else i + 1
        common = np.bitwise_count(bits[begin:] & bits[i]).sum(1, dtype=np.int64)
        yield i, begin + np.flatnonzero(enough(common, sizes[i], sizes[begin:], threshold))


def compared_units(units: DataFrame, threshold: float) -> DataFrame:
    """Per set of a unit with links in it: their number with copies, and the root of its group.

    A unit has ``bucket``, two block numbers ``u`` and ``v``, and for each member its block,
    set id, copies, the bands' keys that are large buckets (else null) and shingles.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        u, bucket = group["u"].iloc[0], group["bucket"].iloc[0]
        group = group.sort_values(["side", "set_id"]).reset_index(drop=True)
        split = int((group["side"] == u).sum())
        sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
        n = len(group)
        own = np.array(group["flags"].tolist(), np.int64).reshape(n, -1)
        own = np.where(own == 0, -1 - np.arange(n)[:, None], own)
        first = np.argmax(own == bucket, axis=1)
        copies = group["copies"].to_numpy()
        links, root = np.zeros(n, np.int64), np.arange(n)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, near in similar_in_unit(sets, threshold, split if group["v"].iloc[0] != u else n):
            if len(near):
                same = own[near] == own[i]
                near = near[np.argmax(same, axis=1) == first[i]]
            for j in near:
                links[i] += copies[j]
                links[j] += copies[i]
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
        some = np.flatnonzero(links)
        ids = group["set_id"]
        return pd.DataFrame(
            {"a": [ids[i] for i in some], "b": [ids[find(i)] for i in some], "links": links[some]}
        )

    return units.groupBy("bucket", "u", "v").applyInPandas(run, "a binary, b binary, links long")


def jaccard_classes(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` and ``links``, the number of other rows similar to it.

    Texts without words are similar to equal texts only; an empty or null text to none.
    """
    bands, rows = band_plan(threshold, recall)
    signed = pin(signed_rows(docs, bands, rows, words, key, text))
    sets = pin(
        signed.where("size > 0").groupBy("set_id").agg(
            F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
            F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("row"),
        ).select("set_id", "key", "copies", "bands", "row.mark")
    )
    keys = sets.select("set_id", F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = pin(keys.join(buckets, "bucket"))
    large = members.where(F.col("n") > SMALL)
    flags = large.groupBy("set_id").agg(F.collect_set("bucket").alias("large"))
    listed = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("set_id")).alias("s"))
    ahead = F.expr("transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> named_struct('a', x, 'b', y)))")
    pairs = pin(listed.select(F.explode(F.flatten(ahead)).alias("p")).select("p.a", "p.b").distinct())
    wanted = (
        pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(large.select("set_id")).distinct()
    )
    known = sets.join(wanted, "set_id")
    full = pin(
        full_sets(docs, known.select("set_id", "key", "mark"), words, key, text)
        .join(known.select("set_id", "copies", "bands"), "set_id")
        .join(flags, "set_id", "left")
    )
    found = pin(verified_pairs(pairs, full, threshold))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    units = (
        large.withColumn("blocks", blocks)
        .withColumn("side", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("set_id", "bucket", "side", F.least("side", "other").alias("u"), F.greatest("side", "other").alias("v"))
        .join(
            full.where("large is not null").select(
                "set_id", "copies", "shingles",
                F.expr("transform(bands, x -> if(array_contains(large, x), x, 0L))").alias("flags"),
            ),
            "set_id",
        )
    )
    summed = pin(compared_units(units, threshold))

    copies = sets.select("set_id", "copies")
    one = found.join(copies.withColumnRenamed("set_id", "b"), "b").select(F.col("a").alias("set_id"), F.col("copies").alias("links"))
    two = found.join(copies.withColumnRenamed("set_id", "a"), "a").select(F.col("b").alias("set_id"), F.col("copies").alias("links"))
    three = summed.select(F.col("a").alias("set_id"), "links")
    counted = one.unionByName(two).unionByName(three).groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(found.unionByName(summed.select("a", "b")))
    rooted = pin(
        sets.select("set_id", "key", "copies")
        .join(joined.select(F.col("a").alias("set_id"), F.col("b").alias("root")), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
        .join(counted, "set_id", "left")
    )
    named = rooted.groupBy("root").agg(F.min("key").alias("class_id"))
    result = rooted.join(named, "root").select(
        "set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links")
    )
    with_words = signed.where("size > 0").select("key", "set_id").join(result, "set_id")
    wordless = signed.where("size = 0")
    equal = wordless.where("set_id is not null").groupBy("set_id").agg(
        F.min("key").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links")
    )
    without = (
        wordless.where("set_id is not null").select("key", "set_id").join(equal, "set_id").select("key", "class_id", "links")
    )
    empty = wordless.where("set_id is null").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("links"))
    named_rows = with_words.select("key", "class_id", "links").unionByName(without).unionByName(empty)
    return named_rows.withColumnRenamed("key", "doc_id")


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """Of each class the rows with its smallest key; rows that repeat whole stay once.

    A row without a key can't be named by a decision and stays.
    """
    inner, back = set_aside(docs, ["doc_id", "text"])
    classes = jaccard_classes(docs, threshold, words)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    marked = inner.withColumn("_crc", F.crc32(F.col("text").cast("binary"))).withColumn("_hash", F.xxhash64("text"))
    named = marked.join(kept, F.col("doc_id") == F.col("_kept")).dropDuplicates(["doc_id", "_crc", "_hash"])
    unnamed = marked.where("doc_id is null")
    return back(named.drop("_kept").unionByName(unnamed))
