"""Metrics over labels, line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import scoring as S
from tallyloom.operators.ordered import first_per_group
from tallyloom.plans.registry import query, table


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query(
    "accuracy",
    "SELECT round(avg((toxic = quality)::INT), 9) AS accuracy, count(*) AS total FROM labels",
)
def accuracy(spark, sf_dir):
    return rounded(S.accuracy(table(spark, sf_dir, "labels"), "toxic", "quality"), "accuracy")


EXACT_SQL = """SELECT round(avg((trim(o_orderpriority) = CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END)::INT), 9) AS exact_match,
 count(*) AS total FROM orders"""


@query("exact_match", EXACT_SQL)
def exact_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" \n"), "o_orderpriority", F.lit("\t")).alias("predicted"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("1-URGENT").alias("gold"),
    )
    return rounded(S.exact_match(orders, "predicted", "gold"), "exact_match")


@query(
    "binary_scores",
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn,
      count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn FROM labels)
    SELECT tp, tn, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE, 9) AS f1,
      round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))::DOUBLE) END, 9) AS matthews FROM c""",
)
def binary_scores(spark, sf_dir):
    return rounded(
        S.binary_scores(table(spark, sf_dir, "labels"), "toxic", "quality"), "f1", "matthews"
    )


@query(
    "class_scores",
    """WITH r AS (SELECT l_linenumber % 4 AS p, l_suppkey % 5 AS g FROM lineitem),
    c AS (SELECT k AS class, count(*) FILTER (p = k AND g = k) AS tp, count(*) FILTER (p = k AND g <> k) AS fp, count(*) FILTER (g = k AND p <> k) AS fn
      FROM r, (SELECT unnest(range(6)) AS k) GROUP BY k),
    f AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM c)
    SELECT class, round(avg(f1), 9) AS f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM f GROUP BY ROLLUP (class)""",
)
def class_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 4).alias("p"), (F.col("l_suppkey") % 5).alias("g")
    )
    return rounded(S.class_scores(rows, "p", "g", 6), "f1")


@query(
    "pearson",
    """SELECT round(corr(l_extendedprice, l_quantity), 9) AS pearson FROM lineitem""",
)
def pearson(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return rounded(S.pearson(items, "l_quantity", "l_extendedprice"), "pearson")


@query(
    "spearman",
    """WITH r AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rx,
      row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ry FROM orders)
    SELECT round(corr(rx, ry), 9) AS spearman FROM r""",
)
def spearman(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(S.spearman(orders, "o_custkey", "o_totalprice", "o_orderkey"), "spearman")


@query(
    "expected_bucket",
    """WITH b AS (SELECT o_orderkey, o_totalprice, unnest(range(6)) AS i FROM orders),
    lp AS (SELECT o_orderkey, i, -((o_orderkey * (i + 3) + o_custkey) % 17)::DOUBLE / 4 AS lp FROM b JOIN orders USING (o_orderkey)),
    m AS (SELECT *, max(lp) OVER (PARTITION BY o_orderkey) AS top FROM lp)
    SELECT o_orderkey, round(sum(i * exp(lp - top)) / sum(exp(lp - top)), 6) AS expected FROM m GROUP BY o_orderkey""",
)
def expected_bucket(spark, sf_dir):
    lps = [
        -((F.col("o_orderkey") * (i + 3) + F.col("o_custkey")) % 17).cast("double") / 4
        for i in range(6)
    ]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(S.expected_bucket(F.array(*lps)), 6).alias("expected")
    )


GROUPED_SQL = "round(avg((l_linenumber % 2 = l_suppkey % 2)::INT), 9) AS accuracy, count(*) FILTER (l_linenumber % 2 = l_suppkey % 2) AS correct, count(*) AS total FROM lineitem"


def _judged_items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "right", F.col("l_linenumber") % 2 == F.col("l_suppkey") % 2
    )


@query("grouped_accuracy", f"SELECT l_returnflag, {GROUPED_SQL} GROUP BY ROLLUP (l_returnflag)")
def grouped_accuracy(spark, sf_dir):
    items = _judged_items(spark, sf_dir)
    return rounded(S.grouped_accuracy(items, F.col("right"), ["l_returnflag"]), "accuracy")


@query(
    "accuracy_by_condition",
    f"SELECT l_returnflag, l_linestatus, {GROUPED_SQL} GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())",
)
def accuracy_by_condition(spark, sf_dir):
    items = _judged_items(spark, sf_dir)
    sets = [["l_returnflag"], ["l_returnflag", "l_linestatus"], []]
    found = S.accuracy_by_sets(items, F.col("right"), sets, ["l_returnflag", "l_linestatus"])
    return rounded(found, "accuracy")


@query(
    "checked_pairs",
    "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
)
def checked_pairs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.checked_pairs(docs.join(labels, "doc_id", "left_semi"), labels, "doc_id")


@query(
    "unmatched_pairs",
    """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'predictions' ELSE 'references' END AS only_in
    FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
)
def unmatched_pairs(spark, sf_dir):
    """Documents without a label and labels whose document gave no prediction."""
    predicted = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0")
    return S.unmatched(predicted, table(spark, sf_dir, "labels"), "doc_id")


# Choice scores: an order is an item, its lines are the choices.
PICK_SQL = """picked AS (SELECT l_orderkey, arg_min(l_linenumber, rn) AS picked FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {score} DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1 GROUP BY l_orderkey)"""


@query(
    "best_choice",
    f"""WITH {PICK_SQL.format(score='round(l_extendedprice / 10000)')} SELECT o_orderstatus, round(avg((picked = o_custkey % 7 + 1)::INT), 9) AS accuracy,
    count(*) FILTER (picked = o_custkey % 7 + 1) AS correct, count(*) AS total FROM picked JOIN orders ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_orderstatus)""",
)
def best_choice(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    picked = S.best_choice(
        items, ["l_orderkey"], "l_linenumber", F.round(F.col("l_extendedprice") / 10000)
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    right = F.col("picked") == F.col("o_custkey") % 7 + 1
    return rounded(
        S.grouped_accuracy(picked.join(orders, "l_orderkey"), right, ["o_orderstatus"]), "accuracy"
    )


@query(
    "best_choice_by_length",
    f"WITH {PICK_SQL.format(score='l_extendedprice / greatest(1, l_quantity)')} SELECT l_orderkey, picked FROM picked",
)
def best_choice_by_length(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    per_token = F.col("l_extendedprice") / F.greatest(F.lit(1), F.col("l_quantity"))
    return S.best_choice(items, ["l_orderkey"], "l_linenumber", per_token)


@query(
    "completion_scores",
    """WITH c AS (SELECT p_partkey AS item, unnest(range(4)) AS choice FROM part),
    t AS (SELECT l_partkey AS item, l_linenumber % 5 AS choice, sum(-l_extendedprice * 1.4142135623730951::DOUBLE / 10000) AS s, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT item, choice, round(coalesce(s, 0), 9) AS score, round(coalesce(s, 0) / greatest(coalesce(n, 1), 1), 9) AS score_per_token
    FROM c LEFT JOIN t USING (item, choice)""",
)
def completion_scores(spark, sf_dir):
    choices = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("choice"),
    )
    tokens = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"),
        (F.col("l_linenumber") % 5).cast("long").alias("choice"),
        (-F.col("l_extendedprice") * 1.4142135623730951 / 10000).alias("log_prob"),
    )
    plain = S.completion_scores(tokens, choices, ["item", "choice"])
    scaled = S.completion_scores(tokens, plain, ["item", "choice"], normalise=True)
    return scaled.toDF("item", "choice", "score", "score_per_token").transform(
        lambda d: rounded(d, "score", "score_per_token")
    )


RERANK_SQL = """cand AS (SELECT l_orderkey AS question, l_linenumber AS candidate, floor(l_quantity / 5)::BIGINT AS answer, round(l_extendedprice / 20000) AS score, l_suppkey, l_partkey FROM lineitem),
base AS (SELECT question, arg_min(answer, rn) AS base_answer FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY candidate, answer) AS rn FROM cand) WHERE rn = 1 GROUP BY 1),
best AS (SELECT question, arg_min(answer, rn) AS best_answer FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, candidate, answer) AS rn FROM cand) WHERE rn = 1 GROUP BY 1),
judged AS (SELECT o_orderkey AS question, o_orderpriority AS model, o_custkey % 10 AS gold, base_answer, best_answer, base_answer = o_custkey % 10 AS base_right, best_answer = o_custkey % 10 AS best_right
  FROM orders JOIN base ON base.question = o_orderkey JOIN best ON best.question = o_orderkey)"""


def _outcomes(spark, sf_dir):
    candidates = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("candidate")
    ).agg(
        F.min_by(
            F.struct(
                F.floor(F.col("l_quantity") / 5).alias("answer"),
                F.round(F.col("l_extendedprice") / 20000).alias("score"),
            ),
            F.struct(-F.round(F.col("l_extendedprice") / 20000), F.col("l_quantity")),
        ).alias("_c")
    )
    golds = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question"),
        F.col("o_orderpriority").alias("model"),
        (F.col("o_custkey") % 10).alias("gold"),
    )
    return S.rerank_outcomes(candidates.select("question", "candidate", "_c.*"), golds)


# A line number can come twice in an order; the better-scored line is the candidate.
RERANK_SQL = RERANK_SQL.replace("FROM lineitem)", "FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round(l_extendedprice / 20000) DESC, l_quantity) = 1)")


@query(
    "rerank_gain",
    f"""WITH {RERANK_SQL} SELECT model, round(avg(base_right::INT), 9) AS accuracy, round(avg(best_right::INT), 9) AS accuracy_reranked,
    round(avg(best_right::INT) - avg(base_right::INT), 9) AS gain, count(*) AS total FROM judged GROUP BY model""",
)
def rerank_gain(spark, sf_dir):
    return rounded(
        S.rerank_gain(_outcomes(spark, sf_dir), "model"), "accuracy", "accuracy_reranked", "gain"
    )


@query(
    "rerank_examples",
    f"""WITH {RERANK_SQL} SELECT outcome, question, gold, base_answer, best_answer FROM (
      SELECT *, CASE WHEN best_right AND NOT base_right THEN 'rescued' ELSE 'wrongly rejected' END AS outcome FROM judged WHERE best_right <> base_right)
    QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY question) <= 3""",
)
def rerank_examples(spark, sf_dir):
    changed = _outcomes(spark, sf_dir).filter(F.col("outcome").isin("rescued", "wrongly rejected"))
    return first_per_group(changed, ["outcome"], [F.col("question")], 3).select(
        "outcome", "question", "gold", "base_answer", "best_answer"
    )


@query(
    "two_label_decision",
    """SELECT l_returnflag, round(avg((l_discount > l_tax)::INT), 9) AS positive_share,
    round(avg(((l_discount > l_tax)::INT = l_linenumber % 2)::INT), 9) AS accuracy FROM lineitem GROUP BY l_returnflag""",
)
def two_label_decision(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn(
        "label", F.when(F.col("l_discount") > F.col("l_tax"), 1).otherwise(0)
    )
    found = items.groupBy("l_returnflag").agg(
        F.avg("label").alias("positive_share"),
        S.share_of(F.col("label") == F.col("l_linenumber") % 2).alias("accuracy"),
    )
    return rounded(found, "positive_share", "accuracy")


@query(
    "first_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 5""",
)
def first_rows_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return first_per_group(
        items.distinct(), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 5
    )


@query(
    "glue_style_score",
    """WITH m AS (SELECT user_id AS model, ['cola','mrpc','qqp','mnli','stsb'][(event_id % 5 + 1)::INT] AS task, avg(value * 1.4142135623730951::DOUBLE) AS a, avg(value * 0.5) AS b FROM events GROUP BY ALL),
    p AS (SELECT model, task, CASE task WHEN 'cola' THEN a ELSE (a + b) / 2 END AS v FROM m)
    SELECT model, round(avg(v), 6) AS score, count(*) AS tasks FROM p GROUP BY model""",
)
def glue_style_score(spark, sf_dir):
    from tallyloom.operators.rollup import glue_score

    tasks = F.array(*[F.lit(t) for t in ("cola", "mrpc", "qqp", "mnli", "stsb")])
    means = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("model"),
            F.element_at(tasks, (F.col("event_id") % 5 + 1).cast("int")).alias("task"),
        )
        .agg(F.avg(F.col("value") * 1.4142135623730951).alias("a"), F.avg(F.col("value") * 0.5).alias("b"))
    )
    first = {"cola": "matthews_corrcoef", "mrpc": "accuracy", "qqp": "accuracy",
             "mnli": "accuracy_matched", "stsb": "pearson"}
    second = {"cola": "accuracy", "mrpc": "f1", "qqp": "f1",
              "mnli": "accuracy_mismatched", "stsb": "spearman"}

    def named(names):
        return F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[F.col("task")]

    metrics = means.select(
        "model",
        "task",
        F.explode(
            F.array(
                F.struct(named(first).alias("metric"), F.col("a").alias("value")),
                F.struct(named(second).alias("metric"), F.col("b").alias("value")),
            )
        ).alias("_m"),
    ).select("model", "task", "_m.*")
    return rounded(glue_score(metrics), "score", digits=6)
