"""Streaming jobs that take what has arrived and stop.

Each job keeps its progress in a checkpoint folder, so a later run goes on where the
last one stopped, and its settings next to it, so that a changed run is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyloom.functions.tokens import word_count
from tallyloom.operators import vocab
from tallyloom.operators.packing import OpenShard, append_aligned
from tallyloom.operators.rollup import latest_results
from tallyloom.sources.records import METRIC_SCHEMA


def check_settings(spark: SparkSession, folder: str, settings: Mapping[str, object]) -> None:
    """Store a job's settings on its first run and refuse other ones later."""
    wanted = json.dumps(settings, sort_keys=True)
    path = f"{folder}/settings"
    try:
        stored = spark.read.text(path).first()["value"]
    except AnalysisException:
        rows = spark.createDataFrame([(wanted,)], "value string")
        rows.write.mode("errorifexists").text(path)
        return
    if stored != wanted:
        raise ValueError(f"this output was begun with {stored}, not with {wanted}")


def arrivals(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    )


def table_arrivals(spark: SparkSession, folder: str, schema: str, name: str) -> DataFrame:
    """Arrivals of one table of a folder, be it a single file or a folder of part files.

    A stream takes a single file only by a pattern, so the name's last letter is one.
    """
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name[:-1]}[{name[-1]}]")


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


COUNTS = "doc_id long, source string, n_tokens long"


def count_tokens(stream: DataFrame, folder: str) -> None:
    """Token counts of arriving documents, appended exactly once."""
    counted = stream.filter(F.col("text") != "").select(
        "doc_id", "source", (word_count(F.col("text")) + 1).cast("long").alias("n_tokens")
    )
    writer = counted.writeStream.format("parquet").outputMode("append").option(
        "path", f"{folder}/rows"
    )
    _run(writer, f"{folder}/progress")


def _open_shard_before(spark: SparkSession, folder: str, batch_id: int) -> OpenShard:
    try:
        done = spark.read.schema(
            "batch long, rows long, tokens long, shards long, reach long"
        ).json(f"{folder}/state")
        last = done.filter(F.col("batch") < batch_id).orderBy(F.desc("batch")).first()
    except AnalysisException:
        last = None
    if last is None:
        return OpenShard()
    return OpenShard(last["rows"], last["tokens"], last["shards"], last["reach"])


def pack_arrivals(stream: DataFrame, folder: str, shard_size: int) -> None:
    """Pack arriving documents behind those packed before, shards staying open.

    A batch writes its rows and then where it stopped, both under its own number. A
    repeated batch starts from the state before it and overwrites its own output.
    """
    spark = stream.sparkSession
    check_settings(spark, folder, {"shard_size": shard_size, "tokens": "words"})
    counted = stream.filter(F.col("text") != "").select(
        "doc_id", "source", (word_count(F.col("text")) + 1).cast("long").alias("n_tokens")
    )

    def pack(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _open_shard_before(session, folder, batch_id)
        packed, after = append_aligned(batch, "doc_id", shard_size, before)
        packed.write.mode("overwrite").parquet(f"{folder}/shards/batch={batch_id}")
        state = session.createDataFrame(
            [(batch_id, after.rows, after.tokens, after.shards, after.reach)],
            "batch long, rows long, tokens long, shards long, reach long",
        )
        state.write.mode("overwrite").json(f"{folder}/state/number={batch_id}")

    _run(counted.writeStream.foreachBatch(pack), f"{folder}/progress")


PIECES = "piece string, n long, s string, n_tokens int"


def _known_pieces(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Pieces that the batches before this one encoded."""
    try:
        return spark.read.schema(f"{PIECES}, batch long").parquet(f"{folder}/pieces").filter(F.col("batch") < batch_id).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], PIECES)


def tokenise_arrivals(
    stream: DataFrame,
    folder: str,
    merges: Sequence[tuple[int, int, int, int]],
    shard_size: int,
    mix: Mapping[str, float] | None = None,
    eos: int = 0,
) -> None:
    """Turn arriving texts into subword ids and pack them behind those packed before.

    Every distinct piece is encoded once: a batch takes the pieces it has not met from the table of known ones,
    encodes the rest and adds them under its own number. Another tokenizer, mix, id type or shard
    size than the folder was begun with is refused. ``mix`` names the sources that are taken; null takes all.
    """
    spark = stream.sparkSession
    fingerprint = hashlib.sha256(json.dumps([list(m) for m in merges]).encode()).hexdigest()
    check_settings(
        spark, folder,
        {"shard_size": shard_size, "tokenizer": fingerprint, "mix": dict(mix) if mix else None, "ids": "int", "eos": eos},
    )
    taken = stream.filter(F.col("text") != "")
    if mix:
        taken = taken.filter(F.col("source").isin([s for s, share in mix.items() if share > 0]))

    def tokenise(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        met = vocab.piece_counts(batch)
        known = _known_pieces(session, folder, batch_id)
        new = vocab.piece_lengths(met.join(known.select("piece"), "piece", "left_anti"), list(merges))
        new.write.mode("overwrite").parquet(f"{folder}/pieces/batch={batch_id}")
        fresh = session.read.schema(PIECES).parquet(f"{folder}/pieces/batch={batch_id}")
        ids = vocab.token_ids(batch, known.unionByName(fresh), eos=eos)
        ids.write.mode("overwrite").parquet(f"{folder}/ids/batch={batch_id}")
        stored = session.read.schema("doc_id long, ids array<int>, n_tokens long").parquet(f"{folder}/ids/batch={batch_id}")
        rows = stored.select("doc_id", "n_tokens").join(batch.select("doc_id", "source"), "doc_id")
        packed, after = append_aligned(rows, "doc_id", shard_size, _open_shard_before(session, folder, batch_id))
        packed.write.mode("overwrite").parquet(f"{folder}/shards/batch={batch_id}")
        state = session.createDataFrame(
            [(batch_id, after.rows, after.tokens, after.shards, after.reach)],
            "batch long, rows long, tokens long, shards long, reach long",
        )
        state.write.mode("overwrite").json(f"{folder}/state/number={batch_id}")

    _run(taken.writeStream.foreachBatch(tokenise), f"{folder}/progress")


def tokenised_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows of all finished batches with their ids."""
    ids = spark.read.schema("doc_id long, ids array<int>, batch long").parquet(f"{folder}/ids")
    return packed_arrivals(spark, folder).join(ids, ["batch", "doc_id"])


def packed_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows of all finished batches."""
    finished = spark.read.schema("batch long").json(f"{folder}/state")
    return spark.read.parquet(f"{folder}/shards").join(finished, "batch", "left_semi")


def follow_metrics(spark: SparkSession, folder: str, out: str) -> None:
    """Latest loss of each phase while records keep being appended."""
    stream = spark.readStream.schema(METRIC_SCHEMA).json(folder)
    latest = stream.groupBy("phase").agg(
        F.max("step").alias("step"),
        F.max_by("loss", "step").alias("loss"),
        F.count("*").alias("records"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/rows/number={batch_id}"
        )

    _run(latest.writeStream.outputMode("update").foreachBatch(keep), f"{out}/progress")


def followed_metrics(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/rows").drop("number")
    return latest_results(rows, ["phase"], "version").drop("version")
