"""Choosing among candidates, comparing models, and auditing overlap with a benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin


def scored_at_least(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows whose score reaches ``least``; a row without a score does not."""
    return rows.filter(F.col(score) >= F.lit(least))


def majority_answers(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent ``answer`` of each key; of equally frequent ones the first given,
    and the smaller one if they share a place.

    ``candidates`` holds ``answer`` and its place ``position``. Null answers do not vote.
    Votes are summed before the shuffle, so a key may have any number of candidates.
    """
    votes = (
        candidates.filter(F.col("answer").isNotNull())
        .groupBy(*keys, "answer")
        .agg(F.count("*").alias("votes"), F.min("position").alias("_first"))
    )
    best = F.min_by(F.struct("answer", "votes"), F.struct(-F.col("votes"), "_first", "answer"))
    return votes.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.answer", "_best.votes")


def best_correct(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rejection sampling: per key the ``correct`` candidate of highest ``score``.

    The first place wins a tie; keys without a correct candidate have no row.
    """
    best = F.max_by(
        F.struct("position", "score"), F.struct(F.col("score"), -F.col("position"))
    )
    right = candidates.filter(F.col("correct") & F.col("score").isNotNull())
    return right.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.position", "_best.score")


def domain_perplexity(losses: DataFrame, domain: str = "domain") -> DataFrame:
    """Token-weighted perplexity of each domain from sums of loss and tokens."""
    return losses.groupBy(domain).agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.exp(F.sum("loss_sum") / F.sum("n_tokens")).alias("perplexity"),
    )


def task_wins(scores: DataFrame, baseline: DataFrame, needed: int) -> DataFrame:
    """Per model the tasks it shares with the baseline and wins, and whether they suffice.

    Equal scores are no win.
    """
    pairs = scores.join(baseline.withColumnRenamed("score", "_base"), "task")
    return pairs.groupBy("model").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("score") > F.col("_base")).alias("wins")
    ).withColumn("better", F.col("wins") >= needed)


#: Distinct benchmark grams that are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT_GRAMS = 2_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def hashed_grams(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``key``, the words, and hash and place of every run of ``size`` lower-case words.

    A run is hashed from its words' hashes, so no run is put together as text here.
    """
    worded = rows.select(key, _words(F.col("text")).alias("_words"))
    hashed = worded.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    places = F.when(F.size("_words") >= size, F.sequence(F.lit(1), F.size("_words") - (size - 1)))
    grams = F.transform(places, lambda i: F.struct(F.xxhash64(F.slice("_hashes", i, size)).alias("h"), i.alias("at")))
    return hashed.select(key, "_words", F.explode(grams).alias("_g")).select(key, "_words", "_g.h", "_g.at")


def _as_text(grams: DataFrame, key: str, size: int) -> DataFrame:
    # Never null, so that no test for null puts a run together before the hashes are compared.
    text = F.coalesce(F.array_join(F.slice("_words", F.col("at"), F.lit(size)), " "), F.lit(""))
    return grams.select(key, "h", text.alias("gram")).distinct()


def shared_grams(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """Per benchmark item: its grams found in documents, and the documents that have them.

    The hashes of the benchmark's grams are sent to the documents when they are few enough, so only
    grams that match become rows to shuffle; those are compared as text. An item's grams are distinct, and
    so are a document's; counts are summed before they are shuffled.
    """
    asked = pin(_as_text(hashed_grams(benchmark, "item_id", size), "item_id", size))
    wanted = asked.select("h").distinct()
    few = wanted.count() <= SENT_GRAMS
    met = hashed_grams(docs, "doc_id", size).join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    hits = _as_text(met, "doc_id", size).drop("h").join(asked, "gram")
    per_doc = hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("grams"))
    return per_doc.groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("grams").alias("most_grams"), F.sum("grams").alias("hits")
    )
