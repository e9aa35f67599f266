"""Perplexities, log probabilities and training metrics over loss tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stems import stems
from tallyloom.functions.text import strip
from tallyloom.functions.tokens import word_count
from tallyloom.sources.corpora import capped

INFINITE, NOT_A_NUMBER = float("inf"), float("nan")
# Where each form of perplexity stops.
LARGEST_TRAINER_LOSS, LARGEST_STAGE_LOSS = 20, 100
FEWEST_TOKENS = 2
# Bits of a group in the recurrence of common subsequences: sums of two groups stay a long.
BITS = 62
FULL = (1 << BITS) - 1


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(INFINITE))


def loss_perplexity(loss: Column) -> Column:
    """exp(loss) below the cap, else infinite; also for a missing or broken loss."""
    usable = finite(loss) & (loss < LARGEST_TRAINER_LOSS)
    return F.when(usable, F.exp(loss)).otherwise(F.lit(INFINITE))


def trainer_perplexity(losses: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean of the finite batch losses; a group without any has loss NaN."""
    mean = F.avg(F.when(finite(F.col("loss")), F.col("loss")))
    skipped = F.count_if(~F.coalesce(finite(F.col("loss")), F.lit(False)))
    return (
        losses.groupBy(*groups)
        .agg(F.coalesce(mean, F.lit(NOT_A_NUMBER)).alias("loss"), skipped.alias("skipped"))
        .withColumn("perplexity", loss_perplexity(F.col("loss")))
    )


def stage_perplexity(losses: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Like the trainer's, with the mean loss cut off before exp instead."""
    mean = F.avg(F.when(finite(F.col("loss")), F.col("loss")))
    found = losses.groupBy(*groups).agg(F.coalesce(mean, F.lit(INFINITE)).alias("loss"))
    return found.withColumn(
        "perplexity",
        F.when(F.col("loss") == INFINITE, F.col("loss")).otherwise(
            F.exp(F.least("loss", F.lit(float(LARGEST_STAGE_LOSS))))
        ),
    )


def plain_perplexity(losses: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    found = losses.groupBy(*groups).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
    return found.withColumn("perplexity", F.exp("loss"))


def token_weighted_perplexity(
    texts: DataFrame, groups: Sequence[str] = (), first: int | None = None, order: str = "doc_id"
) -> DataFrame:
    """exp of summed loss over summed predicted tokens.

    The cap on texts counts all of them; blank and one-token texts are left out after it.
    """
    usable = capped(texts, first, order).filter(
        (strip(F.col("text")) != "") & (word_count(F.col("text")) >= FEWEST_TOKENS)
    )
    sums = usable.groupBy(*groups).agg(
        F.sum("loss").alias("_loss"), F.sum("predicted_tokens").alias("_tokens")
    )
    return sums.select(
        *groups,
        F.col("_tokens").alias("tokens"),
        F.coalesce(F.exp(F.try_divide("_loss", "_tokens")), F.lit(INFINITE)).alias("perplexity"),
    )


def sequence_log_prob(log_probs: Column, mask: Column) -> Column:
    """Sum of next-token log probabilities; entry t predicts token t + 1 of the mask."""
    ahead = F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
    kept = F.zip_with(log_probs, ahead, lambda lp, m: F.when(m == 1, lp).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)


def preference_loss(margin: Column) -> Column:
    """-log(sigmoid(margin)) without overflow."""
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def preference_metrics(pairs: DataFrame, beta: float, groups: Sequence[str] = ()) -> DataFrame:
    """Mean preference loss and share of pairs whose chosen side scores higher.

    Batches weigh in by their size, so the mean over pairs is the reported value.
    """
    chosen, rejected = F.col("chosen_log_prob"), F.col("rejected_log_prob")
    return pairs.groupBy(*groups).agg(
        F.avg(preference_loss(F.lit(beta) * (chosen - rejected))).alias("loss"),
        F.avg((chosen > rejected).cast("int")).alias("accuracy"),
        F.count("*").alias("pairs"),
    )


def verifier_metrics(examples: DataFrame) -> DataFrame:
    """Accuracy over examples; loss as the mean of the batch means."""
    batches = examples.groupBy("batch").agg(
        F.count_if(F.col("predicted") == F.col("label")).alias("_right"),
        F.count("*").alias("_n"),
        F.avg("loss").alias("_loss"),
    )
    return batches.agg(
        F.coalesce(F.try_divide(F.sum("_right"), F.sum("_n")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg("_loss"), F.lit(0.0)).alias("loss"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("examples"),
    )


def attention_summary(rows: DataFrame, near: int = 3) -> DataFrame:
    """How attention is spread: on itself, nearby, on the first token, and its entropy.

    ``rows`` holds one attention row per (example, q) as the array ``weights``.
    """
    w, q = F.col("weights"), F.col("q")
    start = F.greatest(q - near, F.lit(0)).cast("int")
    close = F.slice(w, start + 1, (q + near + 1 - start).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    per_row = rows.select(
        "example",
        F.try_element_at(w, (q + 1).cast("int")).alias("_self"),
        total(close).alias("_near"),
        F.size(close).alias("_near_n"),
        F.try_element_at(w, F.lit(1)).alias("_first"),
        total(F.transform(w, lambda x: -x * F.ln(x + 1e-10))).alias("_entropy"),
    )
    return per_row.groupBy("example").agg(
        F.avg("_self").alias("self_attention"),
        (F.sum("_near") / F.sum("_near_n")).alias("local_attention"),
        F.avg("_first").alias("first_token_attention"),
        F.avg("_entropy").alias("entropy"),
    )


def summary_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _grams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<string>"))


def gram_overlap(
    pairs: DataFrame, keys: Sequence[str], n: int, out: str, stemmed: bool = False
) -> DataFrame:
    """F1 of shared n-grams, repeats counted, of words or of their stems."""
    words = (lambda text: stems(summary_tokens(text))) if stemmed else summary_tokens
    tokens = pairs.select(
        *keys, words(F.col("predicted")).alias("_p"), words(F.col("gold")).alias("_g")
    )
    sides = F.concat(
        F.transform(_grams(F.col("_p"), n), lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"))),
        F.transform(_grams(F.col("_g"), n), lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"))),
    )
    by_gram = (
        tokens.select(*keys, F.explode_outer(sides).alias("_t"))
        .groupBy(*keys, F.col("_t.t").alias("_gram"))
        .agg(
            F.count_if(F.col("_t.p") == 1).alias("_np"),
            F.count_if(F.col("_t.p") == 0).alias("_ng"),
        )
    )
    return by_gram.groupBy(*keys).agg(
        F.coalesce(
            F.try_divide(2 * F.sum(F.least("_np", "_ng")), F.sum("_np") + F.sum("_ng")),
            F.lit(0.0),
        ).alias(out)
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bits_of(word: Column, spread: Column, group: Column) -> Column:
    """The places of a word in one group of a spread array, as bits."""
    return F.aggregate(
        F.slice(spread, group * BITS + 1, F.lit(BITS)),
        F.lit(0).cast("bigint"),
        lambda bits, x: F.when(
            x["t"] == word,
            bits + F.call_function("shiftleft", F.lit(1).cast("bigint"), x["i"] % BITS),
        ).otherwise(bits),
    )


def _added(row: Column, hit: Column) -> Column:
    """One step of the recurrence: the row with a word's places added, group by group."""

    def group(state: Column, j: Column) -> Column:
        old = F.get(row, j)
        met = old.bitwiseAND(F.get(hit, j))
        total = old + met + state["carry"]
        new = total.bitwiseOR(old - met).bitwiseAND(F.lit(FULL))
        return F.struct(
            F.shiftright(total, BITS).alias("carry"),
            F.concat(state["row"], F.array(new)).alias("row"),
        )

    none = F.struct(
        F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("row")
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), none, group, lambda s: s["row"])


def longest_common_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays; 0 where one is empty or null.

    The places of the shorter array are bits, all set at first, in groups of ``BITS``. Each token
    of the longer one adds its own places, with carries between groups; the bits that end as 0
    count the subsequence. Work grows with the product of the lengths.
    """
    def common(s: Column) -> Column:
        places = F.transform(s["a"], lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        groups = F.sequence(F.lit(0), F.floor((F.size(s["a"]) - 1) / BITS).cast("int"))
        return _let(F.struct(places.alias("places"), groups.alias("groups"), s["b"].alias("b")), met)

    def met(s: Column) -> Column:
        words = F.array_distinct(s["places"]["t"])
        hits = F.map_from_arrays(
            words,
            F.transform(words, lambda w: F.transform(s["groups"], lambda g: _bits_of(w, s["places"], g))),
        )
        full = F.transform(s["groups"], lambda g: F.lit(FULL))
        return _let(F.struct(hits.alias("hits"), full.alias("full"), s["b"].alias("b")), walked)

    def walked(s: Column) -> Column:
        found = F.filter(
            F.transform(s["b"], lambda t: F.try_element_at(s["hits"], t)), lambda h: h.isNotNull()
        )
        left = F.aggregate(found, s["full"], _added)
        return F.aggregate(left, F.lit(0), lambda n, bits: n + BITS - F.bit_count(bits))

    def score(s: Column) -> Column:
        p, g = s["p"], s["g"]
        sides = F.when(F.size(p) <= F.size(g), F.struct(p.alias("a"), g.alias("b"))).otherwise(
            F.struct(g.alias("a"), p.alias("b"))
        )
        some = (F.size(p) > 0) & (F.size(g) > 0)
        f1 = 2.0 * _let(sides, common) / (F.size(p) + F.size(g))
        return F.when(some, f1).otherwise(F.lit(0.0))

    return _let(F.struct(predicted.alias("p"), gold.alias("g")), score)


def subsequence_overlap(
    pairs: DataFrame, keys: Sequence[str], out: str, stemmed: bool = False
) -> DataFrame:
    """F1 of the longest common subsequence of words, or of their stems; no shuffle."""
    words = (lambda text: stems(summary_tokens(text))) if stemmed else summary_tokens
    found = longest_common_f1(words(F.col("predicted")), words(F.col("gold")))
    return pairs.select(*keys, found.alias(out))
