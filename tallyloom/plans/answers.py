"""Prompts, choices, question answering and number answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import prompts as P
from tallyloom.functions import text as T
from tallyloom.functions import tokens as K
from tallyloom.operators import scoring as S
from tallyloom.operators.ordered import first_per_group
from tallyloom.plans.chat import TRIM
from tallyloom.plans.registry import query, table, texts
from tallyloom.plans.scoring import rounded


def _template_sql(template, a, b):
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append("'" + head.replace("'", "''") + "'")
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append({"a": a, "b": b}[name])
    return " || ".join(parts)


PROMPT_SQL = (
    "WITH p AS (SELECT x.conv_id, x.turn, x.text AS a, y.text AS b FROM conversations x JOIN conversations y"
    " ON y.conv_id = x.conv_id AND y.turn = x.turn + 1) "
    + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{task}' AS task, md5("
        + _template_sql(t, f"trim(a, {TRIM})" if task == "sst2" else "a", "b")
        + ") AS prompt_md5 FROM p"
        for task, t in P.TEMPLATES.items()
    )
)


@query("task_prompts", PROMPT_SQL)
def task_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")
    )
    pairs = turns.select("conv_id", "turn", F.col("text").alias("a")).join(
        following, ["conv_id", "turn"]
    )
    tasks = F.explode(F.array(*[F.lit(t) for t in P.TEMPLATES]))
    prompts = pairs.withColumn("task", tasks).withColumn(
        "prompt", P.prompt_by_task(F.col("task"), a=F.col("a"), b=F.col("b"))
    )
    return prompts.select(
        "conv_id", "turn", "task", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")
    )


PARTS_SQL = """items AS (SELECT p_partkey, p_type AS subject, ' ' || p_name || ' ' AS question, [p_brand, p_type, p_size::VARCHAR, p_name] AS choices, p_partkey % 4 AS gold FROM part)"""
CHOICE_LINES = "array_to_string(list_transform({0}, lambda c, i: chr(10) || chr((64 + i)::INT) || '. ' || c), '')"


def part_items(spark, sf_dir):
    """Parts as four-way multiple-choice items."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("subject"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("question"),
        F.array("p_brand", "p_type", F.col("p_size").cast("string"), "p_name").alias("choices"),
        (F.col("p_partkey") % 4).alias("gold"),
    )


@query(
    "choice_prompts",
    f"WITH {PARTS_SQL} SELECT p_partkey, 'Question: ' || trim(question) || {CHOICE_LINES.format('choices')} || chr(10) || 'Answer:' AS prompt FROM items",
)
def choice_prompts(spark, sf_dir):
    items = part_items(spark, sf_dir)
    return items.select(
        "p_partkey", P.choice_prompt(T.strip(F.col("question")), F.col("choices")).alias("prompt")
    )


@query(
    "few_shot_prompts",
    f"""WITH {PARTS_SQL}, solved AS (SELECT subject, p_partkey, trim(question) || {CHOICE_LINES.format('choices')} || chr(10) || 'Answer: ' || chr((65 + gold)::INT) || chr(10) || chr(10) AS shot,
      row_number() OVER (PARTITION BY subject ORDER BY p_partkey) AS r FROM items WHERE p_partkey % 10 = 0 AND subject <> 'ECONOMY'),
    pool AS (SELECT subject, string_agg(shot, '' ORDER BY p_partkey) AS shots FROM solved WHERE r <= 5 GROUP BY subject)
    SELECT p_partkey, md5('The following are multiple choice questions (with answers) about ' || replace(subject, '_', ' ') || '.' || chr(10) || chr(10) || coalesce(shots, '')
      || trim(question) || {CHOICE_LINES.format('choices')} || chr(10) || 'Answer:') AS prompt_md5 FROM items LEFT JOIN pool USING (subject) WHERE p_partkey % 10 <> 0""",
)
def few_shot_prompts(spark, sf_dir):
    """Every tenth part belongs to the example pool, the others are asked."""
    items = part_items(spark, sf_dir)
    in_pool = F.col("p_partkey") % 10 == 0
    pool = first_per_group(
        items.filter(in_pool & (F.col("subject") != "ECONOMY")), ["subject"], [F.col("p_partkey")], 5
    )
    solved = P.solved_choice(F.col("question"), F.col("choices"), F.col("gold"))
    shots = pool.groupBy("subject").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("p_partkey", solved.alias("shot")))),
                lambda s: s["shot"],
            ),
            "",
        ).alias("shots")
    )
    prompts = items.filter(~in_pool).join(shots, "subject", "left").withColumn(
        "prompt",
        P.few_shot_prompt(F.col("subject"), F.col("shots"), F.col("question"), F.col("choices")),
    )
    return prompts.select("p_partkey", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "seeded_choices",
    f"""WITH {PARTS_SQL}, keyed AS (SELECT p_partkey, list_sort(list_transform(choices, lambda c, i: struct_pack(k := md5((i - 1) || ':' || question), i := i - 1, c := c))) AS s FROM items)
    SELECT p_partkey, array_to_string(list_transform(s, lambda x: x.c), '|') AS choices, list_position(list_transform(s, lambda x: x.i), 0) - 1 AS gold FROM keyed""",
)
def seeded_choices(spark, sf_dir):
    items = part_items(spark, sf_dir).withColumn(
        "_s", P.seeded_choices(F.col("question"), F.col("choices"))
    )
    return items.select(
        "p_partkey", F.array_join("_s.choices", "|").alias("choices"), F.col("_s.gold").alias("gold")
    )


GOLD_SQL = """golds AS (SELECT p_partkey, choices, CASE p_partkey % 3 WHEN 0 THEN ' b ' WHEN 1 THEN '' ELSE 'zz' END AS letter,
  CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE ' ' || subject || ' ' END AS answer FROM items),
resolved AS (SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(letter)), '^[A-Z]$') THEN ascii(upper(trim(letter))) - 65
  ELSE coalesce(list_position(choices, trim(answer)), 0) - 1 END AS gold FROM golds)"""


@query("gold_index", f"WITH {PARTS_SQL}, {GOLD_SQL} SELECT p_partkey, gold FROM resolved WHERE gold >= 0")
def gold_index(spark, sf_dir):
    letter = (
        F.when(F.col("p_partkey") % 3 == 0, " b ").when(F.col("p_partkey") % 3 == 1, "").otherwise("zz")
    )
    answer = F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(
        F.concat(F.lit(" "), "subject", F.lit(" "))
    )
    items = part_items(spark, sf_dir).select(
        "p_partkey", P.gold_index(letter, F.col("choices"), answer).alias("gold")
    )
    return items.filter(F.col("gold") >= 0)


@query(
    "easy_or_all",
    """WITH m AS (SELECT c_custkey, c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 = 0 AS easy FROM customer),
    a AS (SELECT c_mktsegment, bool_or(easy) AS any_easy FROM m GROUP BY 1)
    SELECT c_custkey, c_mktsegment FROM m JOIN a USING (c_mktsegment) WHERE easy OR NOT any_easy""",
)
def easy_or_all(spark, sf_dir):
    level = F.when(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_custkey") % 3 == 0), "Easy-1"
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", level.alias("level")
    )
    easy = F.contains(F.lower("level"), F.lit("easy"))
    return S.most_easy(customers, "c_mktsegment", easy).select("c_custkey", "c_mktsegment")


@query(
    "field_aliases",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS pulled,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS filled FROM orders""",
)
def field_aliases(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    blank = F.lit("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.first_present(first, blank, F.col("o_orderpriority")).alias("pulled"),
        T.first_filled(first, blank, F.col("o_orderpriority")).alias("filled"),
    )


@query(
    "classification_rows",
    """WITH t AS (SELECT c_custkey, c_name || chr(10) || coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'None') AS body, c_nationkey AS label FROM customer),
    i AS (SELECT *, list_transform(string_split(body, ''), lambda c: 2 + unicode(c) % 30) AS ids, least(length(body), 32) AS used FROM t)
    SELECT c_custkey, label, array_to_string(list_concat(ids[1:used], list_transform(range(32 - used), lambda x: 0)), ',') AS input_ids, used AS attended FROM i""",
)
def classification_rows(spark, sf_dir):
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    ids = K.char_ids(P.with_none(F.col("c_name"), segment))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("label"), ids.alias("_ids")
    )
    row = K.fixed_length_row(F.col("_ids"), 32)
    return rows.select("c_custkey", "label", row.alias("_r")).select(
        "c_custkey",
        "label",
        F.array_join(F.transform("_r.input_ids", lambda x: x.cast("string")), ",").alias("input_ids"),
        F.aggregate("_r.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"),
    )


# SQL form of the answer normaliser: every character that is no part of a word gets a
# mark on both sides, so that a marked article is a whole word.
def norm_sql(s):
    marked = f"chr(1) || regexp_replace(lower({s}), '([^\\p{{L}}\\p{{N}}\\p{{M}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1)"
    spaced = f"replace(regexp_replace({marked}, chr(1) || '(a|an|the)' || chr(1), chr(1) || ' ' || chr(1), 'g'), chr(1), '')"
    return f"trim(regexp_replace(regexp_replace({spaced}, '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'), {TRIM})"


@query(
    "qa_normalised",
    f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents",
)
def qa_normalised(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", T.qa_normalised(F.col("text")).alias("normal"))


@query(
    "exam_normalised",
    f"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(lower(text), {TRIM}), '\\s+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'), {TRIM}) AS normal FROM documents",
)
def exam_normalised(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", T.exam_normalised(F.col("text")).alias("normal"))


QA_SQL = f"""qa AS (SELECT x.conv_id, x.turn, CASE WHEN x.conv_id % 10 = 0 THEN ' No Answer ' ELSE x.text END AS raw,
  CASE WHEN x.turn % 4 = 3 THEN []::VARCHAR[] ELSE [y.text, y.text || ' ' || x.text] END AS golds
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn - 1 WHERE x.role = 'assistant'),
cleaned AS (SELECT conv_id, turn, golds, CASE WHEN lower(trim(raw, {TRIM})) IN ('unanswerable', 'no answer', 'none') OR contains(lower(raw), 'unanswerable') THEN '' ELSE trim(raw, {TRIM}) END AS predicted FROM qa),
spread AS (SELECT conv_id, turn, len(golds) > 0 AS has_answer, predicted, unnest(CASE WHEN len(golds) = 0 THEN [''] ELSE golds END) AS gold FROM cleaned),
toks AS (SELECT *, {norm_sql('predicted')} AS np, {norm_sql('gold')} AS ng FROM spread),
lists AS (SELECT *, CASE WHEN np = '' THEN []::VARCHAR[] ELSE string_split(np, ' ') END AS p, CASE WHEN ng = '' THEN []::VARCHAR[] ELSE string_split(ng, ' ') END AS g FROM toks),
counted AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0)::DOUBLE AS hits FROM lists)"""
RAW_F1 = "CASE WHEN predicted = '' AND gold = '' THEN 1.0 WHEN predicted = '' OR gold = '' OR hits = 0 THEN 0.0 ELSE 2 * hits / (len(p) + len(g)) END::DOUBLE"
TOKEN_F1 = "CASE WHEN np = '' AND ng = '' THEN 1.0 WHEN np = '' OR ng = '' OR hits = 0 THEN 0.0 ELSE 2 * hits / (len(p) + len(g)) END::DOUBLE"


def question_answers(spark, sf_dir):
    """Assistant turns as predictions, the turn before as gold; some have no gold."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold")
    )
    rows = turns.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"])
    raw = F.when(F.col("conv_id") % 10 == 0, " No Answer ").otherwise(F.col("text"))
    golds = F.when(F.col("turn") % 4 == 3, F.array().cast("array<string>")).otherwise(
        F.array("gold", F.concat_ws(" ", "gold", "text"))
    )
    return rows.select(
        "conv_id", "turn", T.without_unanswerable(raw).alias("predicted"), golds.alias("golds")
    )


@query(
    "best_over_golds",
    f"""WITH {QA_SQL} SELECT conv_id, turn, max((np = ng)::INT) AS em, round(max({RAW_F1}), 9) AS f1 FROM counted GROUP BY conv_id, turn""",
)
def best_over_golds(spark, sf_dir):
    scored = S.best_over_golds(question_answers(spark, sf_dir), ["conv_id", "turn"], False)
    return rounded(scored, "f1")


@query(
    "token_overlap",
    f"""WITH {QA_SQL} SELECT conv_id, turn, (np = ng)::INT AS em, round({TOKEN_F1}, 9) AS f1 FROM counted WHERE len(p) >= 0
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(gold)) = 1""",
)
def token_overlap(spark, sf_dir):
    pairs = question_answers(spark, sf_dir).select(
        "conv_id",
        "turn",
        "predicted",
        F.coalesce(F.try_element_at("golds", F.lit(1)), F.lit("")).alias("gold"),
    )
    return rounded(S.token_overlap(pairs, ["conv_id", "turn"], empty_by_tokens=True), "f1")


@query(
    "passage_turn_scores",
    f"""WITH {QA_SQL}, firsts AS (SELECT (np = ng)::INT AS em, {TOKEN_F1} AS f1 FROM counted
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(gold)) = 1)
    SELECT round(avg(f1), 9) AS f1, round(avg(em), 9) AS exact_match, count(*) AS total_turns FROM firsts""",
)
def passage_turn_scores(spark, sf_dir):
    scored = token_overlap(spark, sf_dir)
    return rounded(
        scored.agg(
            F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
            F.coalesce(F.avg("em"), F.lit(0.0)).alias("exact_match"),
            F.count("*").alias("total_turns"),
        ),
        "f1", "exact_match",
    )


@query(
    "answerable_report",
    f"""WITH {QA_SQL}, best AS (SELECT has_answer, max((np = ng)::INT) AS em, max({RAW_F1}) AS f1 FROM counted GROUP BY conv_id, turn, has_answer)
    SELECT round(100 * avg(em), 6) AS exact_match, round(100 * avg(f1), 6) AS f1, round(100 * avg(em) FILTER (has_answer), 6) AS has_exact, round(100 * avg(f1) FILTER (has_answer), 6) AS has_f1,
      round(coalesce(100 * avg(em) FILTER (NOT has_answer), 0), 6) AS no_exact, round(coalesce(100 * avg(f1) FILTER (NOT has_answer), 0), 6) AS no_f1,
      count(*) AS total, count(*) FILTER (has_answer) AS has_total, count(*) FILTER (NOT has_answer) AS no_total FROM best""",
)
def answerable_report(spark, sf_dir):
    rows = question_answers(spark, sf_dir)
    filled = F.exists("golds", lambda g: T.strip(g) != "")
    flagged = rows.withColumn("has_answer", F.coalesce(filled, F.lit(False)))
    scored = S.best_over_golds(flagged, ["conv_id", "turn", "has_answer"], False)
    names = ["exact_match", "f1", "has_exact", "has_f1", "no_exact", "no_f1"]
    return rounded(S.answerable_report(scored), *names, digits=6)


@query(
    "exam_scores",
    f"""WITH {PARTS_SQL}, {GOLD_SQL}, mc AS (SELECT gold = p_partkey % 4 AS ok FROM resolved WHERE gold >= 0 AND p_partkey % 2 = 0),
    short AS (SELECT p_name AS pred, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END AS gold FROM part WHERE p_partkey % 2 = 1)
    SELECT (SELECT round(avg(ok::INT), 9) FROM mc) AS mc_accuracy, (SELECT count(*) FROM mc) AS mc_total,
      (SELECT round(avg(contains(pred, gold)::INT), 9) FROM short WHERE gold <> '') AS exact_match, (SELECT count(*) FROM short WHERE gold <> '') AS short_total""",
)
def exam_scores(spark, sf_dir):
    """Even parts have options, odd ones a short answer; rows without a gold drop out."""
    even = F.col("p_partkey") % 2 == 0
    letter = (
        F.when(F.col("p_partkey") % 3 == 0, " b ").when(F.col("p_partkey") % 3 == 1, "").otherwise("zz")
    )
    answer = F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(
        F.concat(F.lit(" "), "subject", F.lit(" "))
    )
    name = F.try_element_at("choices", F.lit(4))
    short_gold = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    rows = part_items(spark, sf_dir).select(
        even.alias("has_options"),
        (F.col("p_partkey") % 4).alias("picked"),
        P.gold_index(letter, F.col("choices"), answer).alias("gold"),
        T.exam_normalised(name).alias("said"),
        T.exam_normalised(short_gold).alias("wanted"),
    )
    counted = F.when(
        F.col("has_options") & (F.col("gold") >= 0), (F.col("picked") == F.col("gold")).cast("int")
    )
    short = F.when(
        ~F.col("has_options") & (F.col("wanted") != ""),
        F.contains("said", F.col("wanted")).cast("int"),
    )
    return rounded(
        rows.agg(
            F.avg(counted).alias("mc_accuracy"),
            F.count(counted).alias("mc_total"),
            F.avg(short).alias("exact_match"),
            F.count(short).alias("short_total"),
        ),
        "mc_accuracy", "exact_match",
    )


MATH_SQL = """outputs AS (SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN 'Sum it. #### ' || floor(o_totalprice)::BIGINT || '.' WHEN 1 THEN 'So the Answer is ' || (floor(o_totalprice)::BIGINT // 1000) || ',' || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0')
  WHEN 2 THEN 'We get 12 and -7 = ' || (floor(o_totalprice)::BIGINT - o_custkey) || '  ' WHEN 3 THEN 'No idea at all'
  WHEN 4 THEN 'About 3, then ' || o_custkey || ' and -5.25 in ' || floor(o_totalprice)::BIGINT || ' steps, so ' || o_custkey ELSE '####-' || o_custkey || ' done' END AS output,
  floor(o_totalprice)::BIGINT::VARCHAR AS gold FROM orders)"""


def math_outputs(spark, sf_dir):
    price = F.floor("o_totalprice").cast("string")
    thousands = F.floor(F.floor("o_totalprice") / 1000).cast("string")
    rest = F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0")
    key, cust = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    less = (F.floor("o_totalprice") - F.col("o_custkey")).cast("string")
    output = (
        F.when(key == 0, F.concat(F.lit("Sum it. #### "), price, F.lit(".")))
        .when(key == 1, F.concat(F.lit("So the Answer is "), thousands, F.lit(","), rest))
        .when(key == 2, F.concat(F.lit("We get 12 and -7 = "), less, F.lit("  ")))
        .when(key == 3, F.lit("No idea at all"))
        .when(key == 4, F.concat(F.lit("About 3, then "), cust, F.lit(" and -5.25 in "), price, F.lit(" steps, so "), cust))
        .otherwise(F.concat(F.lit("####-"), cust, F.lit(" done")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", output.alias("output"), price.alias("gold")
    )


LOOSE_SQL = """CASE WHEN regexp_matches(output, '####\\s*([\\d,.-]+)') THEN replace(regexp_extract(output, '####\\s*([\\d,.-]+)', 1), ',', '')
  WHEN regexp_matches(output, '(?i)answer is\\s*([\\d,.-]+)') THEN replace(regexp_extract(output, '(?i)answer is\\s*([\\d,.-]+)', 1), ',', '')
  ELSE replace(list_extract(regexp_extract_all(output, '[\\d,]+\\.?\\d*'), -1), ',', '') END"""
NUM = "-?\\d+(?:,\\d{3})*(?:\\.\\d+)?"
STRICT_SQL = f"""replace(CASE WHEN regexp_matches(output, '####\\s*({NUM})') THEN regexp_extract(output, '####\\s*({NUM})', 1)
  WHEN regexp_matches(output, '(?i)answer\\s+is\\s+({NUM})') THEN regexp_extract(output, '(?i)answer\\s+is\\s+({NUM})', 1)
  WHEN regexp_matches(output, '=\\s*({NUM})\\s*$') THEN regexp_extract(output, '=\\s*({NUM})\\s*$', 1)
  ELSE coalesce(list_extract(regexp_extract_all(output, '{NUM}'), -1), '') END, ',', '')"""


@query(
    "number_answers",
    f"WITH {MATH_SQL} SELECT o_orderkey, {LOOSE_SQL} AS loose, {STRICT_SQL} AS strict FROM outputs",
)
def number_answers(spark, sf_dir):
    return math_outputs(spark, sf_dir).select(
        "o_orderkey",
        T.number_answer_loose(F.col("output")).alias("loose"),
        T.number_answer_strict(F.col("output")).alias("strict"),
    )


@query(
    "document_numbers",
    f"SELECT doc_id, {LOOSE_SQL.replace('output', 'text')} AS loose, {STRICT_SQL.replace('output', 'text')} AS strict FROM documents",
)
def document_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.number_answer_loose(F.col("text")).alias("loose"),
        T.number_answer_strict(F.col("text")).alias("strict"),
    )


@query(
    "gold_answers",
    f"""SELECT doc_id, list_extract(string_split_regex(trim(text, {TRIM}), '\\s+'), -1) AS last_word, doc_id::VARCHAR AS marked FROM documents""",
)
def gold_answers(spark, sf_dir):
    marked = F.concat("text", F.lit(" #### 1 #### "), F.col("doc_id").cast("string"), F.lit(" \n"))
    plain = F.regexp_replace("text", "####", "")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.gold_answer(plain).alias("last_word"), T.gold_answer(marked).alias("marked")
    )


ERROR_SQL = f"""{MATH_SQL}, pred AS (SELECT *, coalesce({LOOSE_SQL}, '') AS p FROM outputs),
judged AS (SELECT *, p = gold AS correct, CASE WHEN p = gold THEN NULL WHEN contains(output, gold) THEN 'extraction'
  WHEN abs(CASE WHEN p = '' THEN 0 ELSE try_cast(p AS DOUBLE) END - gold::DOUBLE) < abs(gold::DOUBLE) * 0.2 THEN 'arithmetic' ELSE 'reasoning' END AS error FROM pred)"""


@query("error_counts", f"WITH {ERROR_SQL} SELECT error, count(*) AS n FROM judged GROUP BY error")
def error_counts(spark, sf_dir):
    judged = S.judged_numbers(math_outputs(spark, sf_dir))
    return judged.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "error_examples",
    f"WITH {ERROR_SQL} SELECT error, o_orderkey, gold, nullif(p, '') AS predicted FROM judged WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY error ORDER BY o_orderkey) <= 5",
)
def error_examples(spark, sf_dir):
    wrong = S.judged_numbers(math_outputs(spark, sf_dir)).filter(~F.col("correct"))
    return first_per_group(wrong, ["error"], [F.col("o_orderkey")], 5).select(
        "error", "o_orderkey", "gold", "predicted"
    )


@query(
    "verifier_prompts",
    """SELECT o_orderkey, 'Question: ' || o_orderstatus || chr(10) || chr(10) || 'Answer: ' || o_orderpriority AS spaced,
    'Question: ' || o_orderstatus || ' Answer: ' || o_orderpriority AS inline FROM orders""",
)
def verifier_prompts(spark, sf_dir):
    q, a = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.verifier_text(q, a).alias("spaced"),
        T.verifier_inline_text(q, a).alias("inline"),
    )


@query(
    "cut_at_stops",
    "SELECT doc_id, split_part(split_part(split_part(text, chr(10), 1), '. T', 1), ', ', 1) AS kept FROM documents",
)
def cut_at_stops(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.cut_at_stops(F.col("text"), ["\n", ". T", ", "]).alias("kept")
    )


@query(
    "cleaned_context",
    f"""SELECT page_id, md5(replace(regexp_replace(replace(trim(body, {TRIM}), ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ')) AS cleaned_md5,
    upper(url[1]) || lower(url[2:]) AS capitalised FROM (SELECT page_id, url, ' ' || replace(replace(html, '<', '['), '>', ']') || ' [title] x  y [z] ' AS body FROM pages)""",
)
def cleaned_context(spark, sf_dir):
    bracketed = F.translate("html", "<>", "[]")
    body = F.concat(F.lit(" "), bracketed, F.lit(" [title] x  y [z] "))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.md5(T.cleaned_context(body).cast("binary")).alias("cleaned_md5"),
        T.capitalised(F.col("url")).alias("capitalised"),
    )


@query(
    "slugs",
    "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM pages",
)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "json_values",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM events""",
)
def json_values(spark, sf_dir):
    broken = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    parsed = T.json_or_null(broken)
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k")
    )


LOOSE_SQL = "replace(replace(replace(text, 'a', 'a' || chr(768)), 'e', 'e' || chr(769)), 'o', 'o' || chr(776))"


@query("composed_text", f"SELECT doc_id, md5(nfc_normalize({LOOSE_SQL})) AS nfc_md5 FROM documents")
def composed_text(spark, sf_dir):
    """Texts whose vowels carry accents of their own; putting them together changes every text."""
    loose = F.col("text")
    for letter, accent in (("a", "\u0300"), ("e", "\u0301"), ("o", "\u0308")):
        loose = F.replace(loose, F.lit(letter), F.lit(letter + accent))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.composed(loose).cast("binary")).alias("nfc_md5")
    )
