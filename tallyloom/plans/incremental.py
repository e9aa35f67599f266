"""Streaming jobs over the driver tables; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import vocab as V
from tallyloom.plans.corpus import COUNTED_SQL
from tallyloom.plans.packing import SHARD_TOKENS, aligned_sql
from tallyloom.plans.registry import query, table
from tallyloom.sources.records import append_metrics
from tallyloom.sources.workspace import new_table_path, pin
from tallyloom.streaming import jobs

STREAM_MERGES = 2000
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@query(
    "streamed_token_counts",
    f"WITH {COUNTED_SQL} SELECT source, count(*) AS examples, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY source",
)
def streamed_token_counts(spark, sf_dir):
    folder = new_table_path(spark, "counts")
    jobs.count_tokens(jobs.table_arrivals(spark, sf_dir, DOCUMENTS, "documents.parquet"), folder)
    rows = spark.read.schema(jobs.COUNTS).parquet(f"{folder}/rows")
    return rows.groupBy("source").agg(
        F.count("*").alias("examples"), F.sum("n_tokens").alias("tokens")
    )


@query(
    "streamed_shards",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT doc_id, source, n_tokens, shard_id FROM packed""",
)
def streamed_shards(spark, sf_dir):
    """Documents arrive in two halves; the second run resumes in an open shard."""
    landing, folder = new_table_path(spark, "landing"), new_table_path(spark, "packed")
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.floor(F.avg("doc_id"))).first()[0]
    for half in (F.col("doc_id") <= middle, F.col("doc_id") > middle):
        docs.filter(half).write.mode("append").parquet(landing)
        jobs.pack_arrivals(jobs.arrivals(spark, landing, DOCUMENTS), folder, SHARD_TOKENS)
    return jobs.packed_arrivals(spark, folder).select("doc_id", "source", "n_tokens", "shard_id")


@query("streamed_token_ids")
def streamed_token_ids(spark, sf_dir):
    """Documents arrive in two halves and become subword ids in shards that stay open."""
    landing, folder = new_table_path(spark, "landing"), new_table_path(spark, "tokenised")
    docs = table(spark, sf_dir, "documents")
    merges = V.learned_merges(pin(V.piece_counts(docs.filter(F.char_length("text") >= 16))), STREAM_MERGES)
    middle = docs.agg(F.floor(F.avg("doc_id"))).first()[0]
    for half in (F.col("doc_id") <= middle, F.col("doc_id") > middle):
        docs.filter(half).write.mode("append").parquet(landing)
        jobs.tokenise_arrivals(jobs.arrivals(spark, landing, DOCUMENTS), folder, merges, SHARD_TOKENS)
    found = jobs.tokenised_arrivals(spark, folder)
    return found.select(
        "doc_id", "source", "n_tokens", "shard_id", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5")
    )


@query(
    "followed_metrics",
    "SELECT event_type AS phase, max(event_id) AS step, arg_max(value, event_id) AS loss, count(*) AS records FROM events GROUP BY 1",
)
def followed_metrics(spark, sf_dir):
    landing, out = new_table_path(spark, "records"), new_table_path(spark, "latest")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("phase"), F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
    )
    middle = events.agg(F.floor(F.avg("step"))).first()[0]
    for half in (F.col("step") <= middle, F.col("step") > middle):
        append_metrics(events.filter(half), landing)
        jobs.follow_metrics(spark, landing, out)
    return jobs.followed_metrics(spark, out)
