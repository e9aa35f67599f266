"""Metric records, checkpoint tables, log files and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "phase string, step long, loss double, perplexity double, lr double"
CHECKPOINT_SCHEMA = (
    "run_name string, checkpoint string, global_step long, val_loss double, val_perplexity double"
)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric records; infinite and missing numbers are read as such."""
    return (
        spark.read.schema(METRIC_SCHEMA).option("allowNonNumericNumbers", True).json(path)
    )


def write_checkpoint_metrics(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def read_checkpoint_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT_SCHEMA).option("header", True).csv(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files of any size: ``file``, ``block``, ``place``, ``line``.

    Large files are read in blocks by many tasks. ``block`` is where a line's block starts in its file, ``place``
    rises with the lines of a block (and means nothing across blocks). Line feeds and carriage
    returns both end a line, also next to the edge of a block.
    """
    return (
        spark.read.option("recursiveFileLookup", True).text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
        )
    )


def write_shared_logs(lines: DataFrame, path: str) -> None:
    """Log files that several logs share, one for each task: a file for every small log costs more to open than to fill.

    ``lines`` has ``log``, ``line_no`` and ``value`` (a line with its end). A line starts with the name of its log and a
    tab; a log without a name has an empty one. The lines of a log stand in one file, in order.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(tasks, "log").sortWithinPartitions("log", "line_no")
    named = F.concat(F.coalesce(F.col("log").cast("string"), F.lit("")), F.lit("\t"), "value")
    rows.select(named.alias("value")).write.option("lineSep", "\r").option("maxRecordsPerFile", 0).text(path)


def read_shared_logs(spark: SparkSession, path: str) -> DataFrame:
    """``read_log_lines`` of shared files, with the ``log`` each line belongs to; lines without a tab belong to none."""
    lines = read_log_lines(spark, path).filter(F.contains("line", F.lit("\t")))
    log = F.substring_index("line", "\t", 1)
    return lines.select("file", "block", "place", log.alias("log"), F.substr("line", F.char_length(log) + 2).alias("line"))


def read_summary_files(
    spark: SparkSession, path: str, name: str = "eval_all_summary.json"
) -> DataFrame:
    """Summary files anywhere under a folder, as whole texts."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .text(path, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    )


def write_table_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
