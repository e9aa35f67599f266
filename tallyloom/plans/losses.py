"""Perplexities and training metrics over events, line items and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import losses as L
from tallyloom.plans.registry import query, table
from tallyloom.plans.scoring import rounded
from tallyloom.plans.stem_sql import stem_tables
from tallyloom.sources.corpora import spread

# Event values as batch losses; some are made infinite or not a number.
LOSS_SQL = """losses AS (SELECT event_type, user_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE
  ELSE CASE WHEN event_type = 'error' THEN value ELSE value / 100 END END AS loss FROM events)"""


def batch_losses(spark, sf_dir):
    scaled = F.when(F.col("event_type") == "error", F.col("value")).otherwise(F.col("value") / 100)
    loss = (
        F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
        .otherwise(scaled)
    )
    return table(spark, sf_dir, "events").select("event_type", "user_id", loss.alias("loss"))


@query(
    "trainer_perplexity",
    f"""WITH {LOSS_SQL} SELECT event_type, round(avg(loss) FILTER (isfinite(loss)), 6) AS loss, count(*) FILTER (NOT isfinite(loss)) AS skipped,
    CASE WHEN avg(loss) FILTER (isfinite(loss)) < 20 THEN round(exp(avg(loss) FILTER (isfinite(loss))), 6) ELSE 'inf'::DOUBLE END AS perplexity FROM losses GROUP BY 1""",
)
def trainer_perplexity(spark, sf_dir):
    found = L.trainer_perplexity(batch_losses(spark, sf_dir), ["event_type"])
    return rounded(found, "loss", "perplexity", digits=6)


@query(
    "stage_perplexity",
    f"""WITH {LOSS_SQL} SELECT event_type, round(avg(loss), 6) AS loss, round(ln(exp(least(avg(loss), 100))), 6) AS log_perplexity FROM losses WHERE isfinite(loss) GROUP BY 1""",
)
def stage_perplexity(spark, sf_dir):
    found = L.stage_perplexity(batch_losses(spark, sf_dir), ["event_type"])
    return found.select(
        "event_type",
        F.round("loss", 6).alias("loss"),
        F.round(F.ln("perplexity"), 6).alias("log_perplexity"),
    )


@query(
    "plain_perplexity",
    "SELECT user_id, round(avg(value / 100), 6) AS loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1",
)
def plain_perplexity(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("loss"))
    return rounded(L.plain_perplexity(losses, ["user_id"]), "loss", "perplexity", digits=6)


@query(
    "token_weighted_perplexity",
    """SELECT sum(n - 1)::BIGINT AS tokens, round(exp(sum(loss) / sum(n - 1)), 6) AS perplexity FROM
    (SELECT len(regexp_extract_all(text, '\\S+')) AS n, n_chars / 10.0 AS loss FROM documents) WHERE n >= 2""",
)
def token_weighted_perplexity(spark, sf_dir):
    from tallyloom.functions.tokens import word_count

    texts = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (F.col("n_chars") / 10.0).alias("loss"),
        (word_count(F.col("text")) - 1).alias("predicted_tokens"),
    )
    return rounded(L.token_weighted_perplexity(texts), "perplexity", digits=6)


@query(
    "sequence_log_prob",
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations),
    l AS (SELECT conv_id, turn, list_transform(ws[1:len(ws)-1], lambda x: -length(x) / 8.0::DOUBLE) AS lp, list_transform(ws[2:len(ws)], lambda x: length(x) % 3 > 0) AS m FROM w)
    SELECT conv_id, turn, round(coalesce(list_sum(list_transform(lp, lambda x, i: CASE WHEN m[i] THEN x ELSE 0 END)), 0), 6) AS log_prob FROM l""",
)
def sequence_log_prob(spark, sf_dir):
    words = F.split("text", " ")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("ws"))
    shown = F.slice("ws", F.lit(1), F.size("ws") - 1)
    log_probs = F.transform(shown, lambda x: -F.char_length(x) / F.lit(8.0))
    mask = F.transform("ws", lambda x: (F.char_length(x) % 3 > 0).cast("int"))
    return turns.select(
        "conv_id", "turn", F.round(L.sequence_log_prob(log_probs, mask), 6).alias("log_prob")
    )


@query(
    "preference_metrics",
    """WITH p AS (SELECT l_returnflag, -l_extendedprice / 1000 AS c, -l_quantity AS r FROM lineitem), m AS (SELECT *, 0.1 * (c - r) AS m FROM p)
    SELECT l_returnflag, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss, round(avg((c > r)::INT), 9) AS accuracy, count(*) AS pairs FROM m GROUP BY 1""",
)
def preference_metrics(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        (-F.col("l_extendedprice") / 1000).alias("chosen_log_prob"),
        (-F.col("l_quantity")).alias("rejected_log_prob"),
    )
    found = L.preference_metrics(pairs, 0.1, ["l_returnflag"])
    return rounded(rounded(found, "loss", digits=6), "accuracy")


@query(
    "verifier_metrics",
    """WITH b AS (SELECT event_id // 32 AS batch, count(*) FILTER (user_id % 2 = event_id % 2) AS ok, count(*) AS n, avg(value) AS l FROM events GROUP BY 1)
    SELECT round(sum(ok) / sum(n), 9) AS accuracy, round(avg(l), 6) AS loss, sum(n)::BIGINT AS examples FROM b""",
)
def verifier_metrics(spark, sf_dir):
    examples = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 32).alias("batch"),
        (F.col("user_id") % 2).alias("predicted"),
        (F.col("event_id") % 2).alias("label"),
        F.col("value").alias("loss"),
    )
    return rounded(rounded(L.verifier_metrics(examples), "loss", digits=6), "accuracy")


@query(
    "attention_summary",
    """WITH e AS (SELECT vec_id // 64 AS example, vec_id % 64 AS q, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
    w AS (SELECT example, q, k, exp(x) / sum(exp(x)) OVER (PARTITION BY example, q) AS w FROM e),
    n AS (SELECT example, q, sum(-w * ln(w + 1e-10)) AS h FROM w GROUP BY 1, 2)
    SELECT example, round(avg(w) FILTER (k = q), 9) AS self_attention, round(avg(w) FILTER (abs(k - q) <= 3), 9) AS local_attention,
      round(avg(w) FILTER (k = 0), 9) AS first_token_attention, round(max(mh), 9) AS entropy FROM w JOIN (SELECT example, avg(h) AS mh FROM n GROUP BY 1) USING (example) GROUP BY 1""",
)
def attention_summary(spark, sf_dir):
    """Embeddings as attention rows: 64 of them make one square example."""
    powers = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("example"),
        (F.col("vec_id") % 64).alias("q"),
        powers.alias("_e"),
    )
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    weighted = rows.withColumn("_t", total).select(
        "example", "q", F.transform("_e", lambda x: x / F.col("_t")).alias("weights")
    )
    names = ["self_attention", "local_attention", "first_token_attention", "entropy"]
    return rounded(L.attention_summary(weighted), *names)


def _summaries(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold")
    )
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("predicted"), "gold"
    )


TOKENS_SQL = "toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations)"
STEMS_SQL = f"""listed AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations),
    placed AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM listed),
    {stem_tables("placed")},
    stemmed AS (SELECT conv_id, turn, list(stem ORDER BY k) AS t FROM placed JOIN stems USING (token) GROUP BY 1, 2),
    toks AS (SELECT conv_id, turn, coalesce(stemmed.t, []) AS t FROM listed LEFT JOIN stemmed USING (conv_id, turn))"""


def _gram_sql(n, out, tokens=TOKENS_SQL):
    grams = "t" if n == 1 else f"list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i+{n - 1}], ' '))"
    return f"""WITH {tokens},
    grams AS (SELECT conv_id, turn, {grams} AS g FROM toks),
    pairs AS (SELECT a.conv_id, a.turn, a.g AS p, b.g AS q FROM grams a JOIN grams b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)
    SELECT conv_id, turn, round(CASE WHEN len(p) + len(q) = 0 THEN 0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(p),
      lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(q, lambda x: x = t))))), 0) / (len(p) + len(q)) END::DOUBLE, 9) AS {out} FROM pairs"""


def _sequence_sql(out, tokens=TOKENS_SQL):
    """The usual table of prefixes, one row of it an iteration."""
    return f"""WITH RECURSIVE {tokens},
    pairs AS (SELECT a.conv_id, a.turn, a.t AS p, b.t AS q FROM toks a JOIN toks b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
    walk AS (SELECT conv_id, turn, 0 AS i, list_transform(range(len(p) + 1), lambda x: 0) AS cells FROM pairs
      UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j]))
      FROM (SELECT conv_id, turn, i, list_transform(range(1, len(p) + 2), lambda j: CASE WHEN j = 1 THEN 0
        ELSE greatest(cells[j], cells[j - 1] + CASE WHEN p[j - 1] = q[i + 1] THEN 1 ELSE 0 END) END) AS cand
        FROM walk JOIN pairs USING (conv_id, turn) WHERE i < len(q)))
    SELECT conv_id, turn, round(CASE WHEN len(p) * len(q) = 0 THEN 0 ELSE 2.0 * cells[-1] / (len(p) + len(q)) END::DOUBLE, 9) AS {out}
    FROM walk JOIN pairs USING (conv_id, turn) WHERE i = len(q)"""


@query("unigram_overlap", _gram_sql(1, "unigram_f1"))
def unigram_overlap(spark, sf_dir):
    found = L.gram_overlap(_summaries(spark, sf_dir), ["conv_id", "turn"], 1, "unigram_f1")
    return rounded(found, "unigram_f1")


@query("bigram_overlap", _gram_sql(2, "bigram_f1"))
def bigram_overlap(spark, sf_dir):
    found = L.gram_overlap(_summaries(spark, sf_dir), ["conv_id", "turn"], 2, "bigram_f1")
    return rounded(found, "bigram_f1")


@query("longest_common_f1", _sequence_sql("sequence_f1"))
def longest_common_f1(spark, sf_dir):
    pairs = _summaries(spark, sf_dir)
    return rounded(L.subsequence_overlap(pairs, ["conv_id", "turn"], "sequence_f1"), "sequence_f1")


@query("stemmed_unigram_overlap", _gram_sql(1, "unigram_f1", STEMS_SQL))
def stemmed_unigram_overlap(spark, sf_dir):
    pairs = _summaries(spark, sf_dir)
    found = L.gram_overlap(pairs, ["conv_id", "turn"], 1, "unigram_f1", stemmed=True)
    return rounded(found, "unigram_f1")


@query("stemmed_bigram_overlap", _gram_sql(2, "bigram_f1", STEMS_SQL))
def stemmed_bigram_overlap(spark, sf_dir):
    pairs = _summaries(spark, sf_dir)
    found = L.gram_overlap(pairs, ["conv_id", "turn"], 2, "bigram_f1", stemmed=True)
    return rounded(found, "bigram_f1")


@query("stemmed_longest_common_f1", _sequence_sql("sequence_f1", STEMS_SQL))
def stemmed_longest_common_f1(spark, sf_dir):
    pairs = _summaries(spark, sf_dir)
    found = L.subsequence_overlap(pairs, ["conv_id", "turn"], "sequence_f1", stemmed=True)
    return rounded(found, "sequence_f1")
