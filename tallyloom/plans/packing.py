"""Shards and windows over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import tokens as K
from tallyloom.operators import packing, windows
from tallyloom.operators.ordered import totals_by_key, totals_by_sort
from tallyloom.plans.corpus import (
    COUNTED_SQL,
    MIX_SQL,
    counted_documents,
    mixed_documents,
)
from tallyloom.plans.registry import query, table, texts
from tallyloom.sources import shards
from tallyloom.sources.workspace import new_table_path, pin

SHARD_TOKENS = 5000
WINDOW = 512


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-counted documents in document order with their place in the token stream."""
    counted = counted_documents(spark, sf_dir)
    return totals_by_key(
        counted, {"before": F.col("n_tokens"), "position": F.lit(1)}, "doc_id"
    )


def streamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character ids with end of text, in document order."""
    docs = texts(spark, sf_dir).filter(F.col("text") != "")
    rows = docs.select(
        "doc_id",
        "source",
        "text",
        (F.char_length("text") + 1).cast("long").alias("n_tokens"),
    )
    placed = totals_by_key(rows, {"before": F.col("n_tokens")}, "doc_id", per_core=64)
    return placed.withColumn("ids", K.batch_char_ids(F.col("text"))).drop("text")


# Shards are a recurrence over rows, so the SQL walks the ordered rows one by one.
def aligned_sql(rows: str, order: str, size: int) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM {rows}),
walk AS (
  SELECT rn, 0::BIGINT AS shard_id, n_tokens::BIGINT AS filled FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.rn, CASE WHEN w.filled + n.n_tokens > {size} THEN w.shard_id + 1 ELSE w.shard_id END,
    CASE WHEN w.filled + n.n_tokens > {size} THEN n.n_tokens ELSE w.filled + n.n_tokens END
  FROM walk w JOIN numbered n ON n.rn = w.rn + 1),
packed AS (SELECT n.*, w.shard_id FROM numbered n JOIN walk w USING (rn))"""


@query(
    "mixed_shard_manifest",
    f"""WITH RECURSIVE {MIX_SQL}, {aligned_sql('mixed', 'position', SHARD_TOKENS)}
    SELECT shard_id, sum(n_tokens)::BIGINT AS tokens, count(*) AS examples, count(DISTINCT source) AS sources
    FROM packed GROUP BY shard_id""",
)
def mixed_shard_manifest(spark, sf_dir):
    packed = packing.aligned_shards(mixed_documents(spark, sf_dir), SHARD_TOKENS)
    return packing.manifest(packed).select(
        "shard_id", "tokens", "examples",
        F.size("source_counts").cast("long").alias("sources"),
    )


@query(
    "aligned_shards",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT doc_id, source, n_tokens, shard_id FROM packed""",
)
def aligned_shards(spark, sf_dir):
    packed = packing.aligned_shards(streamed_documents(spark, sf_dir), SHARD_TOKENS)
    return packed.select("doc_id", "source", "n_tokens", "shard_id")


@query(
    "shard_source_counts",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT shard_id, source, sum(n_tokens)::BIGINT AS tokens, count(*) AS examples FROM packed GROUP BY ALL""",
)
def shard_source_counts(spark, sf_dir):
    packed = packing.aligned_shards(streamed_documents(spark, sf_dir), SHARD_TOKENS)
    return packing.shard_source_counts(packed)


def _stored(spark, sf_dir):
    packed = pin(packing.aligned_shards(streamed_documents(spark, sf_dir), SHARD_TOKENS))
    path = new_table_path(spark, "shards")
    shards.write_shards(packed, path)
    stored = shards.read_shards(spark, path)
    listing = new_table_path(spark, "manifest")
    shards.write_manifest(stored, listing)
    return stored, shards.read_manifest(spark, listing)


@query(
    "stored_manifest",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT shard_id, sum(n_tokens)::BIGINT AS tokens, count(*) AS examples FROM packed GROUP BY shard_id""",
)
def stored_manifest(spark, sf_dir):
    return _stored(spark, sf_dir)[1]


@query(
    "shard_validation",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)},
    found AS (SELECT shard_id, sum(n_tokens)::BIGINT AS n FROM packed GROUP BY shard_id)
    SELECT shard_id, n AS found_tokens, CASE WHEN shard_id = 1 THEN n + 1 END AS listed_tokens,
      CASE WHEN shard_id = 1 THEN 'token count differs' ELSE 'unlisted' END AS problem FROM found WHERE shard_id IN (1, 2)
    UNION ALL SELECT 999999, NULL, 17, 'missing'""",
)
def shard_validation(spark, sf_dir):
    stored, listed = _stored(spark, sf_dir)
    spoiled = (
        listed.filter(F.col("shard_id") != 2)
        .withColumn("tokens", F.col("tokens") + F.when(F.col("shard_id") == 1, 1).otherwise(0))
        .unionByName(
            spark.createDataFrame([(999999, 17, 1)], "shard_id long, tokens long, examples long")
        )
    )
    return packing.validate_shards(stored, spoiled)


@query(
    "stale_shards",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT DISTINCT shard_id FROM packed WHERE shard_id > 3""",
)
def stale_shards(spark, sf_dir):
    stored, listed = _stored(spark, sf_dir)
    return packing.unlisted_shards(stored, listed.filter(F.col("shard_id") <= 3))


@query(
    "first_shards",
    f"""WITH RECURSIVE {COUNTED_SQL}, {aligned_sql('counted', 'doc_id', SHARD_TOKENS)}
    SELECT shard_id, source, sum(n_tokens)::BIGINT AS tokens, count(*) AS examples FROM packed WHERE shard_id < 6 GROUP BY ALL""",
)
def first_shards(spark, sf_dir):
    stored, listed = _stored(spark, sf_dir)
    return packing.shard_source_counts(packing.first_shards(stored, listed, 6))


CHARS_SQL = """chars AS (SELECT doc_id, source, text, length(text) + 1 AS n_tokens,
  coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM documents WHERE text <> '')"""


@query(
    "split_shards",
    f"""WITH {CHARS_SQL}, pieces AS (SELECT *, unnest(range(before // 20000, (before + n_tokens - 1) // 20000 + 1)) AS shard_id FROM chars)
    SELECT shard_id, source, sum(least(before + n_tokens, (shard_id + 1) * 20000) - greatest(before, shard_id * 20000))::BIGINT AS tokens,
      count(*) AS pieces FROM pieces GROUP BY ALL""",
)
def split_shards(spark, sf_dir):
    rows = streamed_ids(spark, sf_dir).drop("ids")
    pieces = packing.split_by_size(rows, 20000, "shard_id", arrays=())
    return pieces.groupBy("shard_id", "source").agg(
        F.sum("piece_tokens").alias("tokens"), F.count("*").alias("pieces")
    )


WINDOW_SQL = """stream AS (SELECT string_agg(text || chr(1), '' ORDER BY doc_id) AS s FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, unnest(range(before // 512, (before + n_tokens - 1) // 512 + 1)) AS window_id, text || chr(1) AS t, before, n_tokens FROM chars),
joined AS (SELECT window_id, string_agg(t[greatest(window_id * 512 - before, 0) + 1 : least((window_id + 1) * 512 - before, n_tokens)], '' ORDER BY before) AS body
  FROM pieces GROUP BY window_id),
windows AS (SELECT window_id, md5(array_to_string(list_transform(string_split(body, ''),
  lambda c: CASE WHEN c = chr(1) THEN 1 ELSE 2 + unicode(c) % 30 END), ',')) AS ids_md5 FROM joined WHERE length(body) = 512)"""


def _windows(spark, sf_dir):
    return packing.fixed_windows(streamed_ids(spark, sf_dir), WINDOW)


@query("token_windows", f"WITH {CHARS_SQL}, {WINDOW_SQL} SELECT * FROM windows")
def token_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        "window_id", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5")
    )


@query(
    "window_tail_split",
    f"""WITH {CHARS_SQL}, total AS (SELECT sum(n_tokens)::BIGINT // 512 AS n FROM chars)
    SELECT window_id, CASE WHEN window_id >= n - 40 THEN 'eval' ELSE 'train' END AS part
    FROM (SELECT unnest(range(n)) AS window_id, n FROM total)""",
)
def window_tail_split(spark, sf_dir):
    stream = table(spark, sf_dir, "documents").filter(F.col("text") != "")
    tokens = stream.agg(F.sum(F.char_length("text") + 1).alias("n")).first()["n"]
    train, held = packing.tail_split(_windows(spark, sf_dir), tokens // WINDOW, 40)
    return (
        train.select("window_id", F.lit("train").alias("part"))
        .unionByName(held.select("window_id", F.lit("eval").alias("part")))
    )


CHAT_SQL = """turns AS (SELECT conv_id, turn, role, text, length(role) + length(text) + 24 AS n FROM conversations WHERE role IN ('user', 'assistant', 'system')),
kept AS (SELECT conv_id, max(turn) AS last_turn FROM turns GROUP BY conv_id HAVING bool_or(role = 'assistant') AND sum(n) <= 4096),
sized AS (SELECT t.conv_id, turn, role, text, (n + CASE WHEN turn = last_turn THEN 1 ELSE 0 END)::BIGINT AS n_tokens FROM turns t JOIN kept USING (conv_id)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)"""


def packed_chat_turns(spark, sf_dir):
    """Chat turns of usable conversations in stream order, without joining the turns up.

    A conversation needs an assistant turn and at most 4096 tokens; its last turn
    carries the end-of-text token.
    """
    turns = table(spark, sf_dir, "conversations").filter(
        F.col("role").isin("user", "assistant", "system")
    )
    sized = turns.withColumn("_n", K.chat_turn_length(F.col("role"), F.col("text")))
    kept = (
        sized.groupBy("conv_id")
        .agg(
            F.max("turn").alias("_last"),
            F.bool_or(F.col("role") == "assistant").alias("_answered"),
            F.sum("_n").alias("_total"),
        )
        .filter(F.col("_answered") & (F.col("_total") <= 4096))
    )
    closing = F.when(F.col("turn") == F.col("_last"), 1).otherwise(0)
    lengths = sized.join(kept, "conv_id").select(
        "conv_id", "turn", closing.alias("closing"),
        (F.col("_n") + closing).cast("long").alias("n_tokens"),
    )
    placed = totals_by_sort(
        lengths, {"before": F.col("n_tokens")}, [F.col("conv_id"), F.col("turn")]
    )
    return placed.join(turns.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])


CHAT_SHARDS_SQL = f"""WITH {CHAT_SQL},
    spoken AS (SELECT before + 12 + length(role) + 1 AS b, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS n FROM placed),
    pieces AS (SELECT conv_id, before, n_tokens, unnest(range(before // 5000, (before + n_tokens - 1) // 5000 + 1)) AS shard_id FROM placed),
    asst AS (SELECT b, n, unnest(range(b // 5000, (b + n - 1) // 5000 + 1)) AS shard_id FROM spoken WHERE n > 0)
    SELECT shard_id, tokens, turns, coalesce(assistant_tokens, 0) AS assistant_tokens FROM
      (SELECT shard_id, sum(least(before + n_tokens, (shard_id + 1) * 5000) - greatest(before, shard_id * 5000))::BIGINT AS tokens, count(*) AS turns FROM pieces GROUP BY 1)
      LEFT JOIN (SELECT shard_id, sum(least(b + n, (shard_id + 1) * 5000) - greatest(b, shard_id * 5000))::BIGINT AS assistant_tokens FROM asst GROUP BY 1) USING (shard_id)"""


@query("chat_shards", CHAT_SHARDS_SQL)
def chat_shards(spark, sf_dir):
    return shard_totals(chat_pieces(spark, sf_dir))


@query("stored_chat_shards", CHAT_SHARDS_SQL)
def stored_chat_shards(spark, sf_dir):
    """Ids and loss masks written shard by shard and read back."""
    path = new_table_path(spark, "chat-shards")
    shards.write_shards(chat_pieces(spark, sf_dir), path, order="piece_start")
    return shard_totals(shards.read_shards(spark, path))


def shard_totals(pieces):
    return pieces.groupBy("shard_id").agg(
        F.sum(F.size("ids")).alias("tokens"),
        F.count("*").alias("turns"),
        F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("assistant_tokens"),
    )


def chat_ids(spark, sf_dir):
    """Chat turns with their place in the stream, ids and loss mask."""
    placed = packed_chat_turns(spark, sf_dir)
    pieces = K.chat_turn_pieces(F.col("role"), F.col("text"))
    closing_id = F.when(F.col("closing") == 1, F.array(F.lit(K.EOS_ID))).otherwise(
        F.array().cast("array<int>")
    )
    closing_mask = F.when(F.col("closing") == 1, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")
    )
    return placed.withColumn("_pieces", pieces).select(
        "conv_id", "before", "n_tokens",
        F.concat(K.piece_ids(F.col("_pieces")), closing_id).alias("ids"),
        F.concat(K.piece_mask(F.col("_pieces")), closing_mask).alias("mask"),
    )


def chat_pieces(spark, sf_dir):
    return packing.split_by_size(chat_ids(spark, sf_dir), 5000, "shard_id", arrays=("ids", "mask"))


STORED_TOKENS = 20_000
RUN = 8192


def stored_ids(spark, sf_dir):
    """Where the ids of all documents were stored, in shards of 20,000."""
    path = new_table_path(spark, "token-shards")
    windows.write_token_shards(streamed_ids(spark, sf_dir), path, STORED_TOKENS, RUN)
    return path


def _md5(name):
    """Of the numbers with commas between them; as JSON they are written without a string for each."""
    return F.md5(F.btrim(F.to_json(name), F.lit("[]")).cast("binary")).alias(f"{name}_md5")


IDS_SQL = """array_to_string(list_transform(string_split(body, ''), lambda c: CASE WHEN c = chr(1) THEN 1 ELSE 2 + unicode(c) % 30 END), ',')"""


@query(
    "stored_token_shards",
    f"""WITH {CHARS_SQL}, pieces AS (SELECT unnest(range(before // 20000, (before + n_tokens - 1) // 20000 + 1)) AS shard_id, text || chr(1) AS t, before, n_tokens FROM chars),
    joined AS (SELECT shard_id, string_agg(t[greatest(shard_id * 20000 - before, 0) + 1 : least((shard_id + 1) * 20000 - before, n_tokens)], '' ORDER BY before) AS body FROM pieces GROUP BY 1)
    SELECT shard_id, shard_id * 20000 AS first, length(body) AS tokens, md5({IDS_SQL}) AS ids_md5 FROM joined""",
)
def stored_token_shards(spark, sf_dir):
    """The index of the stored shards next to the ids read back from them."""
    path = stored_ids(spark, sf_dir)
    found = windows.stored_runs(spark, path).groupBy("shard_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "ids"))), lambda r: r["ids"])).alias("ids")
    )
    index = windows.shard_index(spark, path).select("shard_id", "first", "tokens")
    return index.join(found.select("shard_id", _md5("ids")), "shard_id")


@query("stored_token_windows", f"WITH {CHARS_SQL}, {WINDOW_SQL} SELECT * FROM windows")
def stored_token_windows(spark, sf_dir):
    """All windows, cut from the stored runs."""
    path = stored_ids(spark, sf_dir)
    return windows.windows_of(windows.stored_runs(spark, path), WINDOW).select("window_id", _md5("ids"))


@query(
    "windows_by_offset",
    f"WITH {CHARS_SQL}, {WINDOW_SQL} SELECT * FROM windows WHERE window_id IN (SELECT doc_id * 3 FROM documents)",
)
def windows_by_offset(spark, sf_dir):
    """Listed windows, each read from the one or two runs that hold it."""
    wanted = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("window_id"))
    return windows.windows_at(spark, stored_ids(spark, sf_dir), wanted, WINDOW).select("window_id", _md5("ids"))


@query(
    "stored_tail_windows",
    f"WITH {CHARS_SQL}, {WINDOW_SQL}, total AS (SELECT sum(n_tokens)::BIGINT // 512 AS n FROM chars) SELECT windows.* FROM windows, total WHERE window_id >= n - 40",
)
def stored_tail_windows(spark, sf_dir):
    """The held-out tail, of which only the last shards are read."""
    path = stored_ids(spark, sf_dir)
    total = windows.shard_index(spark, path).agg(F.sum("tokens")).first()[0] // WINDOW
    return windows.windows_between(spark, path, total - 40, total, WINDOW).select("window_id", _md5("ids"))


@query(
    "chat_windows",
    f"""WITH {CHAT_SQL}, said AS (SELECT before, n_tokens,
      '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) || CASE WHEN turn = last_turn THEN chr(1) ELSE '' END AS t,
      repeat('0', 13 + length(role)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text)) || repeat('0', 11 + CASE WHEN turn = last_turn THEN 1 ELSE 0 END) AS m
      FROM placed JOIN kept USING (conv_id)),
    pieces AS (SELECT *, unnest(range(before // 512, (before + n_tokens - 1) // 512 + 1)) AS window_id FROM said),
    cut AS (SELECT window_id, before, greatest(window_id * 512 - before, 0) + 1 AS a, least((window_id + 1) * 512 - before, n_tokens) AS b, t, m FROM pieces),
    joined AS (SELECT window_id, string_agg(t[a:b], '' ORDER BY before) AS body, string_agg(m[a:b], '' ORDER BY before) AS marks FROM cut GROUP BY 1)
    SELECT window_id, md5({IDS_SQL}) AS ids_md5, md5(array_to_string(string_split(marks, ''), ',')) AS mask_md5,
      length(replace(marks, '0', '')) AS loss_tokens FROM joined WHERE length(body) = 512""",
)
def chat_windows(spark, sf_dir):
    """Windows of stored chat shards; the loss mask goes along over the edges of turns and shards."""
    path = new_table_path(spark, "chat-token-shards")
    windows.write_token_shards(chat_ids(spark, sf_dir), path, 5000, 2048, ("ids", "mask"))
    found = windows.windows_of(windows.stored_runs(spark, path, ("ids", "mask")), WINDOW, ("ids", "mask"))
    loss = F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("loss_tokens")
    return found.select("window_id", _md5("ids"), _md5("mask"), loss)


SHARES_SQL = f"""{CHARS_SQL}, cells AS (SELECT source, unnest(range(before // 512, (before + n_tokens - 1) // 512 + 1)) AS window_id, before, n_tokens FROM chars),
held AS (SELECT window_id, source, sum(least(before + n_tokens, (window_id + 1) * 512) - greatest(before, window_id * 512))::BIGINT AS tokens FROM cells GROUP BY ALL),
targets AS (SELECT source, row_number() OVER (ORDER BY source) AS target FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
now AS (SELECT source, sum(tokens)::HUGEINT AS tokens FROM held GROUP BY 1),
factors AS (SELECT n.source, coalesce(t.target, 0)::HUGEINT * (SELECT sum(tokens)::HUGEINT FROM now) * 1000000
  // ((SELECT sum(target)::HUGEINT FROM targets JOIN now USING (source)) * n.tokens) AS factor FROM now n LEFT JOIN targets t USING (source)),
weights AS (SELECT window_id, sum(tokens * factor)::HUGEINT AS weight FROM held JOIN factors USING (source) GROUP BY 1),
ran AS (SELECT window_id, weight, sum(weight) OVER (ORDER BY window_id)::HUGEINT AS upto, sum(weight) OVER ()::HUGEINT AS total FROM weights),
drawn AS (SELECT window_id, (upto * 3000 + total // 4) // total - ((upto - weight) * 3000 + total // 4) // total AS copies FROM ran)"""
DRAWS = 3000


def _drawn(spark, sf_dir):
    docs = texts(spark, sf_dir).filter(F.col("text") != "")
    rows = docs.select("doc_id", "source", (F.char_length("text") + 1).cast("long").alias("n_tokens"))
    held = pin(windows.window_sources(totals_by_key(rows, {"before": F.col("n_tokens")}, "doc_id"), WINDOW))
    sources = table(spark, sf_dir, "documents").select("source").filter("source IS NOT NULL").distinct()
    by_name = W.orderBy("source")
    targets = sources.select("source", F.row_number().over(by_name).cast("long").alias("target"))
    return held, windows.resampled(pin(windows.window_weights(held, targets)), DRAWS, 0.25)


@query("reweighted_windows", f"WITH {SHARES_SQL} SELECT window_id, copies::BIGINT AS copies FROM drawn WHERE copies > 0")
def reweighted_windows(spark, sf_dir):
    """How often each window is drawn for the sources to come in wanted shares."""
    return _drawn(spark, sf_dir)[1]


@query(
    "reweighted_shares",
    f"""WITH {SHARES_SQL} SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens * coalesce(copies, 0))::BIGINT AS drawn_tokens
    FROM held LEFT JOIN drawn USING (window_id) GROUP BY 1""",
)
def reweighted_shares(spark, sf_dir):
    held, drawn = _drawn(spark, sf_dir)
    both = held.join(drawn, "window_id", "left").fillna(0, ["copies"])
    return both.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens")
    )
