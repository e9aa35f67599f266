"""Stored token shards with ids, and windows read from them by offset.

A stream of ids is stored in shards. Inside its shard it is one row for each *run*, a
stretch of ``run`` ids on a grid over the whole stream, so the place of any id follows
from its offset. A window that lies inside a run is a slice of it and is never shuffled; only the pieces of
windows that cross the edge of a run or shard are brought together. Further arrays (loss masks) are
cut along with the ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ordered import totals_by_key, whole
from tallyloom.operators.packing import split_by_size
from tallyloom.sources.shards import FOLDERS, first_of_folder

RUN = 1 << 16
EXACT = "decimal(38,0)"


def _joined(arrays: Sequence[str]) -> list[Column]:
    """The arrays of a group's pieces, put together in stream order."""
    ordered = F.array_sort(F.collect_list(F.struct("piece_start", *arrays)))
    return [F.flatten(F.transform(ordered, lambda p: p[a])).alias(a) for a in arrays]


def write_token_shards(
    rows: DataFrame, path: str, shard_tokens: int, run: int = RUN, arrays: Sequence[str] = ("ids",), most: int = FOLDERS
) -> None:
    """Store rows with ``before``, ``n_tokens`` and arrays as shards of ``shard_tokens`` ids.

    Rows are cut at the edges of shards and runs and shuffled once, by folder. Neighbouring shards share a
    folder, of which there are at most ``most``; its name is its first shard. The job commit makes
    all shards visible together; the index (shard, folder, first offset, ids, run) is written after them.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_shards = split_by_size(rows.select("before", "n_tokens", *arrays), shard_tokens, "shard_id", arrays)
    in_runs = split_by_size(
        in_shards.withColumnsRenamed({"piece_start": "before", "piece_tokens": "n_tokens"}), run, "run_id", arrays
    )
    reach = rows.filter(F.col("n_tokens") > 0).agg(F.max(F.col("before") + F.col("n_tokens"))).first()[0] or 1
    folder = first_of_folder(F.col("shard"), (reach - 1) // shard_tokens, most)
    placed = in_runs.withColumnRenamed("shard_id", "shard").withColumn("shard_id", folder)
    runs = (
        placed.repartition(tasks, "shard_id").groupBy("shard_id", "shard", "run_id")
        .agg(F.min("piece_start").alias("first"), F.sum("piece_tokens").alias("n"), *_joined(arrays))
    )
    runs.sortWithinPartitions("shard_id", "first").write.partitionBy("shard_id").orc(f"{path}/shards")
    spark = rows.sparkSession
    stored = _stored(spark, path, ())
    index = stored.groupBy("shard", F.col("shard_id").alias("folder")).agg(F.min("first").alias("first"), F.sum("n").alias("tokens"))
    index.select(F.col("shard").alias("shard_id"), "folder", "first", "tokens", F.lit(run).alias("run")).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str, arrays: Sequence[str]) -> DataFrame:
    """The rows as they are stored: ``shard_id`` names the folder, ``shard`` the shard."""
    columns = "".join(f"{a} array<int>, " for a in arrays)
    return spark.read.schema(f"run_id long, first long, n long, {columns}shard long, shard_id long").orc(f"{path}/shards")


def stored_runs(spark: SparkSession, path: str, arrays: Sequence[str] = ("ids",)) -> DataFrame:
    """``run_id``, ``first``, ``n`` and the named arrays of every run, with its ``shard_id``."""
    return _by_shard(_stored(spark, path, arrays), arrays)


def _by_shard(stored: DataFrame, arrays: Sequence[str]) -> DataFrame:
    return stored.select("run_id", "first", "n", *arrays, F.col("shard").alias("shard_id"))


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard_id``, ``folder``, ``first``, ``tokens``, ``run`` of every shard."""
    return spark.read.schema("shard_id long, folder long, first long, tokens long, run int").parquet(f"{path}/index")


def windows_of(runs: DataFrame, length: int, arrays: Sequence[str] = ("ids",)) -> DataFrame:
    """All full windows of ``length`` ids in runs; the tail of the stream is dropped.

    The runs are read twice: windows inside a run are cut where it lies, and only the pieces at
    its two ends are shuffled.
    """
    end = F.col("first") + F.col("n")
    low = whole(F.col("first") + (length - 1), length)
    high = whole(end, length)
    inside = F.when(low < high, F.sequence(low, high - 1))
    cut = lambda a, start, size: F.slice(a, (start - F.col("first") + 1).cast("int"), size.cast("int"))
    complete = runs.select("first", *arrays, F.explode(inside).alias("window_id")).select(
        "window_id", *[cut(a, F.col("window_id") * length, F.lit(length)).alias(a) for a in arrays]
    )
    # Before the first full window and after the last; a run inside one window is one piece.
    head = F.struct(F.col("first").alias("piece_start"), F.least(low * length, end).alias("piece_end"))
    tail = F.struct((high * length).alias("piece_start"), end.alias("piece_end"))
    ends = F.when(low <= high, F.array(head, tail)).otherwise(F.array(F.struct(F.col("first").alias("piece_start"), end.alias("piece_end"))))
    pieces = (
        runs.select("first", *arrays, F.explode(ends).alias("_e")).filter("_e.piece_start < _e.piece_end")
        .select(
            whole(F.col("_e.piece_start"), length).alias("window_id"), F.col("_e.piece_start").alias("piece_start"),
            *[cut(a, F.col("_e.piece_start"), F.col("_e.piece_end") - F.col("_e.piece_start")).alias(a) for a in arrays],
        )
    )
    crossing = pieces.groupBy("window_id").agg(*_joined(arrays)).filter(F.size(arrays[0]) == length)
    return complete.unionByName(crossing)


def windows_between(
    spark: SparkSession, path: str, low: int, high: int, length: int, arrays: Sequence[str] = ("ids",)
) -> DataFrame:
    """Windows ``low`` to ``high`` (exclusive), reading only the folders and runs that hold them.

    The index gives the range of folders; the offsets of the runs are tested in the scan.
    """
    begin, end = low * length, high * length
    index = shard_index(spark, path)
    held = index.filter((F.col("first") < end) & (F.col("first") + F.col("tokens") > begin)).agg(
        F.min("folder").alias("low"), F.max("folder").alias("high"), F.max("run").alias("run")
    ).first()
    stored = _stored(spark, path, arrays)
    if held["low"] is None:
        return windows_of(_by_shard(stored.filter(F.lit(False)), arrays), length, arrays)
    touched = stored.filter(
        F.col("shard_id").between(held["low"], held["high"])
        & (F.col("first") < end) & (F.col("first") > begin - held["run"])
    )
    return windows_of(_by_shard(touched, arrays), length, arrays).filter((F.col("window_id") >= low) & (F.col("window_id") < high))


def windows_at(
    spark: SparkSession, path: str, wanted: DataFrame, length: int, arrays: Sequence[str] = ("ids",)
) -> DataFrame:
    """The windows listed in ``wanted`` (``window_id``), each looked up by its offset.

    A window meets the shards whose range it overlaps in cells of the longest shard's width, then
    the runs it needs, one or two of them where runs are longer than windows.
    """
    index = shard_index(spark, path)
    width = int(index.agg(F.max("tokens")).first()[0] or 1)
    run = int(index.agg(F.max("run")).first()[0] or 1)
    begin, end = F.col("window_id") * length, (F.col("window_id") + 1) * length
    asked = wanted.select("window_id").distinct().select(
        "window_id", F.explode(F.sequence(whole(begin, width), whole(end - 1, width))).alias("cell")
    )
    last = F.col("first") + F.col("tokens") - 1
    cells = index.select("shard_id", "first", "tokens", F.explode(F.sequence(whole(F.col("first"), width), whole(last, width))).alias("cell"))
    start, stop = F.greatest(begin, F.col("first")), F.least(end, last + 1)
    spans = asked.join(cells, "cell").filter(
        (start < stop) & (F.col("cell") == whole(start, width))
    )
    needed = spans.select(
        "window_id", "shard_id", F.explode(F.sequence(whole(start, run), whole(stop - 1, run))).alias("run_id")
    )
    runs = stored_runs(spark, path, arrays).withColumnRenamed("first", "run_first")
    # One row for each run, so that its ids pass the join once and not for every window.
    listed = needed.groupBy("shard_id", "run_id").agg(F.collect_list("window_id").alias("_asked"))
    met = listed.join(runs, ["shard_id", "run_id"]).select("run_first", "n", *arrays, F.explode("_asked").alias("window_id"))
    at, until = F.greatest(begin, F.col("run_first")), F.least(end, F.col("run_first") + F.col("n"))
    pieces = met.select(
        "window_id", at.alias("piece_start"),
        *[F.slice(a, (at - F.col("run_first") + 1).cast("int"), (until - at).cast("int")).alias(a) for a in arrays],
    )
    return pieces.groupBy("window_id").agg(*_joined(arrays)).filter(F.size(arrays[0]) == length)


def window_sources(rows: DataFrame, length: int) -> DataFrame:
    """``window_id``, ``source``, ``tokens``: what each window holds of each source.

    ``rows`` has ``before``, ``n_tokens`` and ``source``; no ids are read.
    """
    pieces = split_by_size(rows.select("before", "n_tokens", "source"), length, "window_id", ())
    return pieces.groupBy("window_id", "source").agg(F.sum("piece_tokens").alias("tokens"))


def window_weights(held: DataFrame, targets: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Whole-number weight of each window, so that sources come in the shares of ``targets``.

    A token counts its source's wanted share over its share now; ``targets`` has ``source`` and ``target``.
    Sources without a target count nothing. Sums are exact decimals.
    """
    now = held.groupBy("source").agg(F.sum("tokens").cast(EXACT).alias("tokens"))
    both = now.join(targets.select("source", F.col("target").cast(EXACT).alias("target")), "source", "left").fillna(0, ["target"])
    total = both.agg(F.sum("tokens").alias("tokens"), F.sum("target").alias("target")).first()
    tokens, target = (F.lit(str(total[c] or 1)).cast(EXACT) for c in ("tokens", "target"))
    factor = F.call_function("div", F.col("target") * tokens * F.lit(scale).cast(EXACT), target * F.col("tokens"))
    factors = both.select("source", factor.cast(EXACT).alias("factor"))
    return held.join(factors, "source").groupBy("window_id").agg(
        F.sum(F.col("tokens").cast(EXACT) * F.col("factor")).cast(EXACT).alias("weight")
    )


def resampled(weights: DataFrame, draws: int, offset: float = 0.0) -> DataFrame:
    """``window_id`` and ``copies``: systematic resampling with ``draws`` copies in all.

    The running weight is laid against ``draws`` equally spaced marks, shifted by ``offset`` (0 to 1 marks).
    A window gets its expected number of copies, rounded up or down; no random number is drawn for a row.
    """
    total = weights.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no window has any weight")
    whole_weight, n = F.lit(str(total)).cast(EXACT), F.lit(draws).cast(EXACT)
    shift = F.lit(str(int(total * int(offset * 1_000_000)) // 1_000_000)).cast(EXACT)
    ran = totals_by_key(weights, {"_before": F.col("weight")}, "window_id")
    marks = lambda reached: F.call_function("div", (reached * n + shift).cast(EXACT), whole_weight)
    before = F.col("_before").cast(EXACT)
    copies = marks((before + F.col("weight")).cast(EXACT)) - marks(before)
    return ran.select("window_id", copies.cast("long").alias("copies")).filter("copies > 0")


def repeated_windows(windows: DataFrame, copies: DataFrame) -> DataFrame:
    """Windows as often as they were drawn, numbered ``copy`` from 0."""
    return windows.join(copies, "window_id").select(
        *windows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    )
