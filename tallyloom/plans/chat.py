"""Chat and instruction data. Conversations are made from the lines of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import chat as C
from tallyloom.operators import chat as O
from tallyloom.plans.registry import query, table, texts

LINES_SQL = """lines AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents)"""
CHAT_SQL = f"""{LINES_SQL},
chats AS (SELECT doc_id, source, list_transform(ls, lambda l, i: struct_pack(
  role := CASE WHEN i = 1 AND doc_id % 3 = 0 THEN 'system' WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END, content := l)) AS m FROM lines)"""
LAST_SQL = """last AS (SELECT doc_id, m, len(m) - list_position(list_reverse(list_transform(m, lambda x: x.role)), 'assistant') + 1 AS spot
  FROM chats WHERE list_contains(list_transform(m, lambda x: x.role), 'assistant')),
pairs AS (SELECT doc_id, m[spot].content AS output, trim(array_to_string(list_transform(m[1:spot-1],
  lambda x: CASE WHEN x.role = 'system' THEN '[System] ' || x.content ELSE x.content END), chr(10) || chr(10)), chr(9) || chr(10) || chr(13) || ' ') AS instruction
  FROM last WHERE spot > 1)"""


def _lines(spark, sf_dir):
    docs = texts(spark, sf_dir)
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return docs.select("doc_id", "source", "text", lines.alias("lines"))


def _role(index, first_is_system):
    return (
        F.when((index == 0) & first_is_system, "system")
        .when(index % 2 == 1, "assistant")
        .otherwise("user")
    )


def document_chats(spark, sf_dir):
    system = F.col("doc_id") % 3 == 0
    return _lines(spark, sf_dir).select(
        "doc_id",
        "source",
        F.transform(
            "lines",
            lambda l, i: F.struct(_role(i, system).alias("role"), l.alias("content")),
        ).alias("messages"),
    )


@query(
    "chat_last_answer",
    f"WITH {CHAT_SQL}, {LAST_SQL} SELECT doc_id, instruction, output FROM pairs WHERE instruction <> '' AND output <> ''",
)
def chat_last_answer(spark, sf_dir):
    chats = document_chats(spark, sf_dir).withColumn("_e", C.from_messages(F.col("messages")))
    return chats.filter(F.col("_e").isNotNull()).select(
        "doc_id", "_e.instruction", "_e.output"
    )


@query(
    "share_format_last_answer",
    f"""WITH {LINES_SQL},
    chats AS (SELECT doc_id, list_transform(ls, lambda l, i: struct_pack(
      role := CASE WHEN i % 5 = 0 THEN 'user' WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END, content := l)) AS m FROM lines),
    {LAST_SQL} SELECT doc_id, instruction, output FROM pairs WHERE instruction <> '' AND output <> ''""",
)
def share_format_last_answer(spark, sf_dir):
    turns = F.transform(
        "lines",
        lambda l, i: F.struct(
            F.when((i + 1) % 5 == 0, "tool")
            .when(i % 2 == 1, "gpt")
            .otherwise("human")
            .alias("from"),
            l.alias("value"),
        ),
    )
    rows = _lines(spark, sf_dir).select("doc_id", turns.alias("conversations"))
    adapted = rows.withColumn("_e", C.adapt_share())
    return adapted.filter(F.col("_e").isNotNull()).select(
        "doc_id", "_e.instruction", "_e.output"
    )


# Data set names given to documents, by document number.
SETS = [
    "x/tulu-3-sft-mixture:train", "HuggingFaceTB/SmolTalk", "y/OpenHermes-2.5", "m/metamathqa",
    "n/OpenMathInstruct-2", "z/ifeval-like-data", "stanfordnlp/coqa", "tatsu/alpaca", "other/set",
]
SETS_SQL = "[" + ", ".join(f"'{s}'" for s in SETS) + "]"


def from_line(n):
    """All lines from the ``n``-th on as one text, null if there are fewer."""
    return F.when(F.size("lines") >= n, F.array_join(F.slice("lines", n, F.size("lines")), "\n"))


def wide_examples(spark, sf_dir):
    """Document lines in the schema of the data set each document is assigned to."""
    kind = (F.col("doc_id") % len(SETS)).cast("int")
    first = F.try_element_at("lines", F.lit(1))
    second = F.try_element_at("lines", F.lit(2))
    others, third = from_line(2), from_line(3)
    odd = F.filter("lines", lambda l, i: i % 2 == 0)
    even = F.filter("lines", lambda l, i: i % 2 == 1)

    def only(*kinds, value):
        return F.when(F.col("kind").isin(*kinds), value)

    rows = _lines(spark, sf_dir).withColumn("kind", kind)
    return rows.select(
        "doc_id",
        F.element_at(F.array(*[F.lit(s) for s in SETS]), F.col("kind") + 1).alias("dataset"),
        only(
            0, 1,
            value=F.transform(
                "lines",
                lambda l, i: F.struct(_role(i, F.lit(True)).alias("role"), l.alias("content")),
            ),
        ).alias("messages"),
        only(
            2,
            value=F.transform(
                "lines",
                lambda l, i: F.struct(
                    F.when(i % 2 == 1, "gpt").otherwise("human").alias("from"),
                    l.alias("value"),
                ),
            ),
        ).alias("conversations"),
        only(7, 8, value=first).alias("instruction"),
        only(7, value=third).alias("input"),
        only(7, value=second).alias("output"),
        only(5, value=F.lit("")).alias("prompt"),
        only(3, 5, value=first).alias("query"),
        only(8, value=second).alias("question"),
        only(3, 5, value=others).alias("response"),
        only(8, value=third).alias("answer"),
        only(4, value=first).alias("problem"),
        only(4, value=second).alias("generated_solution"),
        only(4, value=third).alias("expected_answer"),
        only(6, value=F.col("text")).alias("story"),
        only(6, value=odd).alias("questions"),
        only(6, value=F.struct(even.alias("input_text"))).alias("answers"),
    )


WIDE_SQL = f"""{LINES_SQL},
wide AS (SELECT doc_id, ({SETS_SQL})[(doc_id % 9 + 1)::INT] AS dataset, doc_id % 9 AS kind, text, ls, ls[1] AS l1,
  CASE WHEN len(ls) >= 2 THEN CASE WHEN doc_id % 9 IN (3, 5) THEN array_to_string(ls[2:], chr(10)) ELSE ls[2] END END AS l2,
  CASE WHEN len(ls) >= 3 THEN array_to_string(ls[3:], chr(10)) END AS l3,
  len(ls) - list_position(list_reverse(list_transform(ls, lambda l, i: i % 2 = 0)), true) + 1 AS spot FROM lines)"""
TRIM = "chr(9) || chr(10) || chr(13) || ' '"


@query(
    "adapted_examples",
    f"""WITH {WIDE_SQL}, picked AS (
      SELECT doc_id, dataset,
        CASE WHEN kind IN (0, 1) THEN trim(array_to_string(list_transform(ls[1:spot-1], lambda l, i: CASE WHEN i = 1 THEN '[System] ' || l ELSE l END), chr(10) || chr(10)), {TRIM})
             WHEN kind = 2 THEN trim(array_to_string(ls[1:spot-1], chr(10) || chr(10)), {TRIM})
             WHEN kind = 8 THEN l2 ELSE l1 END AS instruction,
        CASE WHEN kind = 6 THEN text WHEN kind = 7 THEN coalesce(l3, '') ELSE '' END AS input,
        CASE WHEN kind <= 2 THEN ls[spot] WHEN kind = 8 THEN l3 ELSE coalesce(l2, CASE WHEN kind = 4 THEN l3 END) END AS output
      FROM wide WHERE kind > 2 OR (spot > 1 AND len(ls) > 1))
    SELECT * FROM picked WHERE instruction <> '' AND output <> ''""",
)
def adapted_examples(spark, sf_dir):
    return O.adapted_examples(wide_examples(spark, sf_dir), "dataset")


@query(
    "normalised_chats",
    f"""WITH {WIDE_SQL}, turns AS (SELECT doc_id, dataset, CASE
      WHEN kind IN (0, 1) THEN list_transform(ls, lambda l, i: CASE WHEN i = 1 THEN 'system' WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || l)
      WHEN kind = 2 THEN list_transform(ls, lambda l, i: CASE WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || l)
      WHEN kind = 6 THEN CASE WHEN len(ls) % 2 = 0 THEN list_concat(['system:' || text], list_transform(ls, lambda l, i: CASE WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || l)) END
      WHEN kind = 8 THEN CASE WHEN l3 IS NOT NULL THEN ['user:' || l2, 'assistant:' || l3] END
      WHEN l2 IS NOT NULL THEN ['user:' || l1, 'assistant:' || l2] END AS t FROM wide)
    SELECT doc_id, dataset, len(t) AS turns, md5(array_to_string(t, chr(10))) AS turns_md5 FROM turns
    WHERE len(list_filter(t, lambda x: starts_with(x, 'assistant:'))) > 0""",
)
def normalised_chats(spark, sf_dir):
    chats = O.normalised_chats(wide_examples(spark, sf_dir))
    said = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return chats.select(
        "doc_id",
        "dataset",
        F.size("messages").cast("long").alias("turns"),
        F.md5(F.array_join(said, "\n").cast("binary")).alias("turns_md5"),
    )


FORMAT_SQL = f"""{LINES_SQL}, formatted AS (SELECT doc_id, '### Instruction:' || chr(10) || trim(ls[1], {TRIM}) ||
  CASE WHEN trim(array_to_string(ls[3:], chr(10)), {TRIM}) <> '' THEN chr(10) || chr(10) || '### Input:' || chr(10) || trim(array_to_string(ls[3:], chr(10)), {TRIM}) ELSE '' END ||
  chr(10) || chr(10) || '### Response:' || chr(10) || trim(ls[2], {TRIM}) AS body FROM lines WHERE len(ls) >= 2)"""


def formatted_instructions(spark, sf_dir):
    rows = _lines(spark, sf_dir).filter(F.size("lines") >= 2)
    return rows.select(
        "doc_id",
        C.instruction_text(
            F.try_element_at("lines", F.lit(1)),
            from_line(3),
            F.try_element_at("lines", F.lit(2)),
        ).alias("text"),
    )


@query("instruction_text", f"WITH {FORMAT_SQL} SELECT doc_id, body AS text FROM formatted")
def instruction_text(spark, sf_dir):
    return formatted_instructions(spark, sf_dir)


@query(
    "instruction_dispatch",
    f"""WITH {FORMAT_SQL} SELECT 'instruction' AS kind, doc_id AS row_id, md5(body) AS text_md5 FROM formatted
    UNION ALL SELECT 'text', page_id, md5(html) FROM pages UNION ALL SELECT 'chosen', item_id, md5(text) FROM benchmark""",
)
def instruction_dispatch(spark, sf_dir):
    pair = _lines(spark, sf_dir).filter(F.size("lines") >= 2).select(
        F.col("doc_id").alias("row_id"),
        F.try_element_at("lines", F.lit(1)).alias("instruction"),
        from_line(3).alias("input"),
        F.try_element_at("lines", F.lit(2)).alias("output"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("row_id"), F.col("html").alias("text")
    )
    chosen = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_id"), F.col("text").alias("chosen")
    )
    parts = []
    for kind, rows in (("instruction", pair), ("text", pages), ("chosen", chosen)):
        text = C.instruction_row_text(rows.columns)
        parts.append(
            rows.select(
                F.lit(kind).alias("kind"),
                "row_id",
                F.md5(text.cast("binary")).alias("text_md5"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CHAR_IDS = "list_transform(string_split({0}, ''), lambda c: 2 + unicode(c) % 30)"


def _joined(name):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",")


@query(
    "response_only_labels",
    f"""WITH {FORMAT_SQL}, t AS (SELECT doc_id, body, {CHAR_IDS.format('body')} AS ids, least(len(body), 256) AS used,
      least(strpos(body, '### Response:' || chr(10)) + 13, 256) AS prompt FROM formatted)
    SELECT doc_id, array_to_string(list_concat(ids[1:used], list_transform(range(256 - used), lambda i: 0)), ',') AS input_ids,
      used AS attended, array_to_string(list_concat(list_transform(range(prompt), lambda i: -100), ids[prompt+1:used],
      list_transform(range(256 - used), lambda i: -100)), ',') AS labels FROM t""",
)
def response_only_labels(spark, sf_dir):
    rows = O.response_rows(formatted_instructions(spark, sf_dir), 256)
    return rows.select(
        "doc_id",
        _joined("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"),
        _joined("labels").alias("labels"),
    )


@query(
    "fixed_length_rows",
    f"""WITH t AS (SELECT conv_id, turn, {CHAR_IDS.format('text')} AS ids, least(length(text), 200) AS used FROM conversations WHERE text <> '')
    SELECT conv_id, turn, array_to_string(list_concat(ids[1:used], list_transform(range(200 - used), lambda i: 0)), ',') AS input_ids,
      array_to_string(list_concat(list_transform(range(used), lambda i: 1), list_transform(range(200 - used), lambda i: 0)), ',') AS attention_mask,
      array_to_string(list_concat(ids[1:used], list_transform(range(200 - used), lambda i: -100)), ',') AS labels FROM t""",
)
def fixed_length_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("text") != "")
    rows = O.padded_rows(turns.select("conv_id", "turn", "text"), 200)
    return rows.select(
        "conv_id",
        "turn",
        *[_joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


@query(
    "chat_loss_mask",
    f"""WITH {CHAT_SQL},
    parts AS (SELECT doc_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM chats),
    bits AS (SELECT doc_id, i, '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10) AS body,
      repeat('0', 13 + length(x.role)) || repeat(CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END, length(x.content)) || repeat('0', 11) AS mask,
      x.role AS role FROM parts),
    whole AS (SELECT doc_id, string_agg(body, '' ORDER BY i) AS body, string_agg(mask, '' ORDER BY i) || '0' AS mask FROM bits
      GROUP BY doc_id HAVING bool_or(role = 'assistant') AND sum(length(body)) <= 4096)
    SELECT doc_id, length(mask) AS n_tokens, md5(array_to_string({CHAR_IDS.format('body')}, ',') || ',1') AS ids_md5, md5(mask) AS mask_md5 FROM whole""",
)
def chat_loss_mask(spark, sf_dir):
    chats = O.normalised_chats(document_chats(spark, sf_dir))
    rows = O.chat_tokens(chats.select("doc_id", "messages"), 4096)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.md5(_joined("ids").cast("binary")).alias("ids_md5"),
        F.md5(F.array_join(F.transform("mask", lambda x: x.cast("string")), "").cast("binary")).alias(
            "mask_md5"
        ),
    )


@query(
    "question_history",
    f"""WITH {LINES_SQL}, pairs AS (SELECT doc_id, text, list_transform(range(1, len(ls) // 2 + 1), lambda k: 'Q: ' || ls[2*k-1] || chr(10) || 'A: ' || ls[2*k] || chr(10)) AS said, ls FROM lines),
    turns AS (SELECT doc_id, text, said, ls, unnest(range(len(said))) AS turn FROM pairs)
    SELECT doc_id, turn, md5('Passage: ' || text || chr(10) || array_to_string(said[1:turn], '') || 'Q: ' || ls[2*turn+1] || chr(10) || 'A:') AS prompt_md5, ls[2*turn+2] AS gold FROM turns""",
)
def question_history(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    passages = lines.select(
        "doc_id",
        F.col("text").alias("story"),
        F.filter("lines", lambda l, i: i % 2 == 0).alias("questions"),
        F.filter("lines", lambda l, i: i % 2 == 1).alias("answers"),
    )
    return O.with_history(passages).select(
        "doc_id",
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"),
        "gold",
    )
