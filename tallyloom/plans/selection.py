"""Queries on candidates, models and overlap with the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import selection as S
from tallyloom.plans.registry import query, table, texts


@query(
    "anneal_documents",
    "SELECT doc_id, source, 1 + 4 * quality AS score FROM documents JOIN labels USING (doc_id) WHERE 1 + 4 * quality >= 4",
)
def anneal_documents(spark, sf_dir):
    """Documents good enough for the last phase of training."""
    score = (F.lit(1) + F.lit(4) * F.col("quality")).alias("score")
    graded = table(spark, sf_dir, "labels").select("doc_id", score)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.scored_at_least(docs.join(graded, "doc_id"), "score", 4)


def candidates(spark, sf_dir):
    """The lines of an order as sampled answers to one question."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("answer"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") != "N").alias("correct"),
    )


@query(
    "self_consistency",
    """WITH v AS (SELECT l_orderkey AS question_id, l_returnflag AS answer, count(*) AS votes, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)
    SELECT question_id, answer, votes FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, f, answer) = 1""",
)
def self_consistency(spark, sf_dir):
    return S.majority_answers(candidates(spark, sf_dir), ["question_id"])


@query(
    "rejection_sampling",
    """SELECT l_orderkey AS question_id, l_linenumber AS position, l_extendedprice AS score FROM lineitem WHERE l_returnflag <> 'N'
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1""",
)
def rejection_sampling(spark, sf_dir):
    return S.best_correct(candidates(spark, sf_dir), ["question_id"])


@query(
    "domain_perplexity",
    "SELECT l_returnflag || l_linestatus AS domain, sum(l_quantity) AS n_tokens, round(exp(sum(l_quantity * l_discount) / sum(l_quantity)), 9) AS perplexity FROM lineitem GROUP BY 1",
)
def domain_perplexity(spark, sf_dir):
    losses = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("domain"),
        F.col("l_quantity").alias("n_tokens"),
        (F.col("l_quantity") * F.col("l_discount")).alias("loss_sum"),
    )
    return S.domain_perplexity(losses).withColumn("perplexity", F.round("perplexity", 9))


@query(
    "task_wins",
    """WITH s AS (SELECT l_suppkey AS model, l_linenumber AS task, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
    b AS (SELECT l_linenumber AS task, avg(l_extendedprice) * 1.8 AS base FROM lineitem GROUP BY 1)
    SELECT model, count(*) AS tasks, count(*) FILTER (score > base) AS wins, count(*) FILTER (score > base) >= 5 AS better FROM s JOIN b USING (task) GROUP BY 1""",
)
def task_wins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.groupBy(F.col("l_suppkey").alias("model"), F.col("l_linenumber").alias("task")).agg(
        F.max("l_extendedprice").alias("score")
    )
    base = lines.groupBy(F.col("l_linenumber").alias("task")).agg((F.avg("l_extendedprice") * 1.8).alias("score"))
    return S.task_wins(scores, base, needed=5)


GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(len(ws) - 11, 1)), lambda i: array_to_string(ws[i:i + 12], ' ')))"
WORDS_SQL = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws"


@query(
    "contamination_audit",
    f"""WITH b AS (SELECT item_id, unnest({GRAMS_SQL}) AS gram FROM (SELECT item_id, {WORDS_SQL} FROM benchmark)),
    d AS (SELECT doc_id, unnest({GRAMS_SQL}) AS gram FROM (SELECT doc_id, {WORDS_SQL} FROM documents)),
    p AS (SELECT item_id, doc_id, count(*) AS grams FROM b JOIN d USING (gram) GROUP BY ALL)
    SELECT item_id, count(*) AS documents, max(grams) AS most_grams, sum(grams)::BIGINT AS hits FROM p GROUP BY 1""",
)
def contamination_audit(spark, sf_dir):
    """Benchmark items whose 13-word runs stand in documents."""
    return S.shared_grams(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), 13)
