"""Preference pairs and verifier examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import preference as O
from tallyloom.plans.chat import CHAT_SQL, LINES_SQL, TRIM, _lines, document_chats
from tallyloom.plans.corpus import UNIFORM_SQL
from tallyloom.plans.registry import query, table

DIALOGUE_SQL = f"""{LINES_SQL}, sides AS (SELECT doc_id,
  array_to_string(list_transform(ls, lambda l, i: CASE WHEN i % 2 = 0 THEN chr(10) || chr(10) || 'Assistant: ' ELSE chr(10) || chr(10) || 'Human: ' END || l), '') AS chosen,
  array_to_string(list_transform(ls, lambda l, i: CASE WHEN i % 2 = 0 THEN chr(10) || chr(10) || 'Assistant: ' || reverse(l) ELSE chr(10) || chr(10) || 'Human: ' || l END), '') AS rejected,
  len(ls) AS n FROM lines),
cut AS (SELECT doc_id, string_split_regex(chosen, '\\n\\nAssistant:\\s*') AS c, string_split_regex(rejected, '\\n\\nAssistant:\\s*') AS r FROM sides),
pairs AS (SELECT doc_id, trim(c[-1], {TRIM}) AS chosen, trim(r[-1], {TRIM}) AS rejected,
  trim(array_to_string(c[1:len(c)-1], chr(10) || chr(10) || 'Assistant: '), {TRIM}) AS prompt FROM cut WHERE len(c) > 1 AND len(r) > 1)"""


def dialogues(spark, sf_dir):
    """Two full dialogues per document; the rejected one has its answers reversed."""

    def side(reverse):
        def turn(line, i):
            answer = F.reverse(line) if reverse else line
            return F.when(i % 2 == 1, F.concat(F.lit("\n\nAssistant: "), answer)).otherwise(
                F.concat(F.lit("\n\nHuman: "), line)
            )

        return F.array_join(F.transform("lines", turn), "")

    return _lines(spark, sf_dir).select(
        "doc_id", side(False).alias("chosen"), side(True).alias("rejected")
    )


@query(
    "dialogue_pairs",
    f"""WITH {DIALOGUE_SQL} SELECT doc_id, prompt, chosen, rejected, md5(CASE WHEN prompt <> '' THEN prompt || chr(10) ELSE '' END || chosen) AS chosen_md5,
    md5(CASE WHEN prompt <> '' THEN prompt || chr(10) ELSE '' END || rejected) AS rejected_md5 FROM pairs WHERE chosen <> '' AND rejected <> ''""",
)
def dialogue_pairs(spark, sf_dir):
    return O.dialogue_pairs(dialogues(spark, sf_dir)).select(
        "doc_id", "prompt", "chosen", "rejected",
        F.md5(F.col("chosen_text").cast("binary")).alias("chosen_md5"),
        F.md5(F.col("rejected_text").cast("binary")).alias("rejected_md5"),
    )


MESSAGE_SQL = f"""{CHAT_SQL}, shown AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || source ELSE '' END AS prompt,
  list_filter(list_transform(m, lambda x: x.content), lambda c, i: m[i].role = 'assistant') AS replies,
  trim(array_to_string(list_filter(list_transform(m, lambda x: CASE WHEN trim(x.content, {TRIM}) <> '' THEN upper(x.role[1]) || x.role[2:] || ': ' || trim(x.content, {TRIM}) END), lambda s: s IS NOT NULL), chr(10)), {TRIM}) AS whole FROM chats),
coerced AS (SELECT doc_id, prompt, CASE WHEN prompt <> '' AND len(replies) > 0 THEN trim(replies[-1], {TRIM}) ELSE whole END AS chosen, whole FROM shown)"""


@query(
    "message_pairs",
    f"""WITH {MESSAGE_SQL} SELECT doc_id, prompt, md5(chosen) AS chosen_md5, md5(CASE WHEN prompt <> '' THEN prompt || chr(10) ELSE '' END || rejected) AS rejected_text_md5
    FROM (SELECT doc_id, prompt, chosen, CASE WHEN prompt <> '' THEN 'User: ' || source ELSE 'User: ' || source END AS rejected FROM coerced JOIN documents USING (doc_id)) WHERE chosen <> ''""",
)
def message_pairs(spark, sf_dir):
    rows = document_chats(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" About "), F.col("source"))).alias("prompt"),
        F.col("messages").alias("chosen"),
        F.array(
            F.struct(F.lit("USER").alias("role"), F.concat("source", F.lit(" \n")).alias("content"))
        ).alias("rejected"),
    )
    return O.message_pairs(rows).select(
        "doc_id",
        "prompt",
        F.md5(F.col("chosen").cast("binary")).alias("chosen_md5"),
        F.md5(F.col("rejected_text").cast("binary")).alias("rejected_text_md5"),
    )


def math_problems(spark, sf_dir):
    """Orders as word problems whose worked answer ends in a marked number."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("problem_id"),
        F.concat(F.lit("How much is order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias(
            "question"
        ),
        F.concat(
            F.lit("It is "), F.col("o_custkey").cast("string"), F.lit(" and more.\n#### "),
            F.floor("o_totalprice").cast("string"), F.lit(" "),
        ).alias("answer"),
    )


@query(
    "verifier_positives",
    f"""SELECT o_orderkey AS problem_id, 1 AS label, 'Question: How much is order ' || o_orderkey || '?' || chr(10) || chr(10) || 'Answer: ' || floor(o_totalprice)::BIGINT AS text,
      {UNIFORM_SQL.format("'3:' || o_orderkey || ':0'")} AS order_key FROM orders""",
)
def verifier_positives(spark, sf_dir):
    rows = O.verifier_examples(math_problems(spark, sf_dir), seed=3).filter(F.col("label") == 1)
    return rows.select("problem_id", "label", "text", "order_key")


def _hash_sql(label):
    return f"('0x' || substr(md5('3{label}:' || o_orderkey || ':' || slot), 1, 13))::BIGINT"


NEGATIVE_SQL = f"""WITH golds AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS gold FROM orders),
placed AS (SELECT *, row_number() OVER (ORDER BY gold, o_orderkey) - 1 AS place, count(*) OVER () AS total FROM golds),
runs AS (SELECT gold, min(place) AS first, count(*) AS same FROM placed GROUP BY gold),
drawn AS (SELECT p.*, first, same, unnest([1, 2]) AS slot FROM placed p JOIN runs USING (gold)),
hashed AS (SELECT *, ({_hash_sql('s')} + 0.5::DOUBLE) / 4503599627370496::DOUBLE < 0.5 AS other, {_hash_sql('o')} % (total - same) AS skip,
  ([1.0, -1.0, 10.0, -10.0, 0.5, 2.0]::DOUBLE[])[({_hash_sql('c')} % 6 + 1)::INT] AS change,
  ({_hash_sql('m')} + 0.5::DOUBLE) / 4503599627370496::DOUBLE > 0.5 AS move FROM drawn),
made AS (SELECT *, CASE WHEN move OR gold::DOUBLE * change = gold::DOUBLE THEN gold::DOUBLE + change ELSE gold::DOUBLE * change END AS number FROM hashed)
SELECT m.o_orderkey AS problem_id, slot, 0 AS label, CASE WHEN other THEN q.gold WHEN number = floor(number) THEN number::BIGINT::VARCHAR
  ELSE rtrim(rtrim(number::DECIMAL(38,2)::VARCHAR, '0'), '.') END AS answer
FROM made m JOIN placed q ON q.place = (first + same + skip) % m.total"""


@query("verifier_negatives", NEGATIVE_SQL)
def verifier_negatives(spark, sf_dir):
    rows = O.verifier_examples(math_problems(spark, sf_dir), seed=3, negatives=2)
    return rows.filter(F.col("label") == 0).select("problem_id", "slot", "label", "answer")
