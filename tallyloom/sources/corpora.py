"""Text sources: scans, specs, caps and health."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import decoded

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Spec:
    name: str
    cap: int | None = None


def parse_spec(spec: str) -> Spec:
    """``name`` or ``name:rows``; a suffix that is no integer belongs to the name."""
    name, mark, tail = spec.rpartition(":")
    if mark and name and tail.strip().lstrip("+-").isdigit():
        return Spec(name, int(tail))
    return Spec(spec)


def resolve_config(name: str, known: Mapping[str, str]) -> tuple[str, str | None]:
    """``name::config`` or ``name:config``, else the registered config if any."""
    head, mark, tail = name.partition("::")
    if mark:
        return head, tail or None
    head, _, tail = name.rpartition(":")
    if head and tail:
        return head, tail
    return name, known.get(name)


def config_of(spec: Column, known: Mapping[str, str]) -> Column:
    """``resolve_config`` as a column: a struct of ``name`` and ``config``."""
    double, single = F.instr(spec, "::"), F.instr(F.reverse(spec), ":")
    head, tail = F.substring(spec, F.lit(1), double - 1), F.substring(spec, double + 2, F.char_length(spec))
    cut = F.char_length(spec) - single
    name, config = F.substring(spec, F.lit(1), cut), F.substring(spec, cut + 2, F.char_length(spec))
    registered = F.lit(None).cast("string")
    for key, value in known.items():
        registered = F.when(spec == key, value).otherwise(registered)
    pair = lambda n, c: F.struct(n.alias("name"), c.alias("config"))
    return (
        F.when(double > 0, pair(head, F.nullif(tail, F.lit(""))))
        .when((single > 1) & (cut > 0), pair(name, config))
        .otherwise(pair(spec, registered))
    )


def resolve_split(
    name: str, split: str, aliases: Mapping[str, Mapping[str, str]]
) -> str:
    """Split name as the set itself calls it; set names ignore case."""
    return aliases.get(name.lower(), {}).get(split, split)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small scan over all cores before heavy work on each row.

    Fewer scan splits than cores means little data in few files, which one shuffle on
    ``key`` evens out. A scan with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def text_rows(df: DataFrame, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """One text field (string or bytes) as ``text``, without null and empty rows."""
    require_columns(df, [field, *keep])
    binary = dict(df.dtypes)[field] == "binary"
    text = decoded(F.col(field)) if binary else F.col(field)
    return df.select(*keep, text.alias("text")).filter(F.col("text") != "")


def capped(df: DataFrame, cap: int | None, order: str) -> DataFrame:
    """The first ``cap`` rows by ``order``, nulls first.

    Only the order column is sorted, for the last key that counts; rows are then filtered by
    it where they are. Rows that share that key fill what room is left.
    """
    if cap is None:
        return df
    if cap < 1:
        return df.limit(0)
    firsts = df.select(F.col(order).alias("_o")).orderBy("_o").limit(cap)
    last = firsts.agg(F.max("_o")).first()[0]
    if last is None:
        return df.filter(F.col(order).isNull()).limit(cap)
    room = firsts.filter(F.col("_o") == F.lit(last)).count()
    below = df.filter(F.col(order).isNull() | (F.col(order) < F.lit(last)))
    return below.unionByName(df.filter(F.col(order) == F.lit(last)).limit(room))


def capped_by_catalogue(
    df: DataFrame, caps: Mapping[str, int], group: str, order: Column
) -> DataFrame:
    """First rows of each group, as many as the catalogue allows for it."""
    cap_of = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])
    listed = df.filter(F.col(group).isin(list(caps)))
    ranked = listed.withColumn(
        "_rank", F.row_number().over(W.partitionBy(group).orderBy(order))
    ).filter(F.col("_rank") <= max(caps.values()))
    return ranked.filter(F.col("_rank") <= cap_of[F.col(group)]).drop("_rank")


def source_health(docs: DataFrame, wanted: Mapping[str, bool]) -> DataFrame:
    """Row count, first text and status of each wanted source; value True is critical."""
    spark = docs.sparkSession
    listed = spark.createDataFrame(list(wanted.items()), "source string, critical boolean")
    seen = (
        docs.filter((F.col("text") != "") & F.col("source").isin(list(wanted)))
        .groupBy("source")
        .agg(
            F.count("*").alias("n_rows"),
            F.min_by(F.substring("text", 1, 100), "doc_id").alias("sample"),
        )
    )
    failed = F.max(F.col("critical") & F.col("n_rows").isNull()).over(
        W.partitionBy(F.lit(0))
    )
    return listed.join(seen, "source", "left").select(
        "source",
        "critical",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "sample",
        F.when(F.col("n_rows").isNull(), "no rows").otherwise("ok").alias("status"),
        (~failed).alias("all_critical_ok"),
    )


def concatenated(parts: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """All readable parts with their name; an unreadable one is skipped with a warning."""
    joined: DataFrame | None = None
    for name, load in parts.items():
        try:
            part = load()
        except AnalysisException as error:
            log.warning("skipping %s: %s", name, str(error).splitlines()[0])
            continue
        part = part.withColumn("origin", F.lit(name))
        joined = part if joined is None else joined.unionByName(part, allowMissingColumns=True)
    if joined is None:
        raise ValueError("no part could be read")
    return joined


def read_readable(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Rows of all files under a folder with their ``file``; files that break while they are read give what came before."""
    return (
        spark.read.format(kind).schema(schema).option("ignoreCorruptFiles", True)
        .option("recursiveFileLookup", True).load(path).withColumn("file", F.col("_metadata.file_path"))
    )


def file_census(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """``file``, ``bytes``, ``n_rows`` and ``status`` of every file under a folder.

    A file that gives no row, because it is broken or holds none, has ``no rows``: ``read_readable`` passes over it
    and it is named here. Files without a byte are not listed. Only names and sizes are listed, contents are
    read once, to count rows.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    )
    counted = read_readable(spark, path, schema, kind).groupBy("file").agg(F.count("*").alias("n_rows"))
    rows = F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    status = F.when(F.col("n_rows").isNull(), "no rows").otherwise("ok")
    return listed.join(counted, "file", "left").select("file", "bytes", rows, status.alias("status"))


def all_splits_or_test(splits: Mapping[str, DataFrame]) -> DataFrame:
    """The test split when there is one, else all splits together."""
    if "test" in splits:
        return splits["test"]
    return concatenated({name: (lambda df=df: df) for name, df in splits.items()}).drop("origin")


def statistics(counted: DataFrame) -> DataFrame:
    return counted.groupBy("source").agg(
        F.count("*").alias("samples"),
        F.avg("n_tokens").alias("avg_tokens"),
        F.sum("n_tokens").alias("total_tokens"),
    )


def use_counters(df: DataFrame, used: Column, size: Column) -> DataFrame:
    return df.agg(
        F.count_if(used).alias("used"),
        F.count_if(~used).alias("skipped"),
        F.sum(F.when(used, size)).alias("used_chars"),
    )


def manifest_paths(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a text file, one per line; blank lines are dropped."""
    lines = spark.read.text(path).select(F.btrim("value").alias("value"))
    found = [r["value"] for r in lines.filter(F.col("value") != "").collect()]
    if not found:
        raise ValueError(f"{path} lists no files")
    return found


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(manifest_paths(spark, path))
