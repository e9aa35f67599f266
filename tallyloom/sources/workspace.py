"""Where lineage is cut and intermediate tables are written.

A cluster names its shared folder in ``spark.checkpoint.dir``. A private folder is made
only for a local master that has none, as in the tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallyloom-")
    return _local_dirs[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there.

    They are computed once, survive a lost executor, and later steps read only the
    columns they need; the optimizer sees the real size of the table.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "pinned")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Files one task writes one after the other, where every key gets its own.
FILES_PER_TASK = 128


def dealt_by_file(rows: DataFrame, key: str, files: int) -> DataFrame:
    """Rows dealt by ``key``, with more tasks than usual where there are many files to write."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-files // FILES_PER_TASK)), key)
