"""Corpus scans, filters, mixing and statistics over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.draws import uniform
from tallyloom.functions.tokens import word_count
from tallyloom.operators import mixing
from tallyloom.operators.ordered import first_per_group
from tallyloom.operators.packing import mix_report
from tallyloom.operators.rollup import rows_per_source
from tallyloom.plans.registry import query, table, texts
from tallyloom.sources import corpora
from tallyloom.sources.workspace import new_table_path, pin

# The twenty sources of the driver table, weighted 1..5 in turn.
SHARES = [mixing.SourceShare(f"src{i}", i % 5 + 1.0) for i in range(20)]
SHARES_SQL = (
    "shares(source, source_pos, weight) AS (VALUES "
    + ", ".join(f"('{s.name}', {i}, {s.weight}::DOUBLE)" for i, s in enumerate(SHARES))
    + ")"
)
COUNTED_SQL = (
    "counted AS (SELECT doc_id, source, len(regexp_extract_all(text, '\\S+')) + 1 AS n_tokens"
    " FROM documents WHERE text <> '')"
)
TARGETS_SQL = (
    "targets AS (SELECT source, source_pos, sum(n_all) OVER () * 0.5 * weight / sum(weight) OVER ()"
    " AS target, sum(n_all) OVER () * 0.5 AS target_total FROM (SELECT s.*, coalesce(t.n, 0) AS"
    " n_all FROM shares s LEFT JOIN (SELECT source, sum(n_tokens)::BIGINT AS n FROM counted GROUP"
    " BY source) t USING (source)))"
)
MIX_SQL = f"""{SHARES_SQL}, {COUNTED_SQL}, {TARGETS_SQL},
rated AS (
  SELECT c.*, t.source_pos, t.target, t.target_total,
    coalesce(sum(n_tokens) OVER (PARTITION BY c.source ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS source_before
  FROM counted c JOIN targets t USING (source)),
placed AS (
  SELECT *, source_before / target AS served_share,
    coalesce(sum(n_tokens) OVER w, 0)::BIGINT AS before,
    coalesce(count(*) OVER w, 0) AS position
  FROM rated WHERE source_before / target < 1
  WINDOW w AS (ORDER BY source_before / target, source_pos, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mixed AS (SELECT * FROM placed WHERE before < target_total)"""
UNIFORM_SQL = "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty documents with their word count and one end-of-text token.

    Texts are read and counted once; all later steps use the three pinned numbers.
    """
    docs = corpora.text_rows(texts(spark, sf_dir), "text", ["doc_id", "source"])
    return pin(
        docs.select(
            "doc_id", "source", (word_count(F.col("text")) + 1).cast("long").alias("n_tokens")
        )
    )


def mix_targets(counted: DataFrame) -> DataFrame:
    """Half of all tokens, shared out by weight."""
    shares = mixing.share_table(counted.sparkSession, SHARES)
    found = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    everything = W.partitionBy(F.lit(0))
    total = F.sum("n_all").over(everything) * F.lit(0.5)
    return (
        shares.join(found, "source", "left")
        .withColumn("n_all", F.coalesce("n", F.lit(0)))
        .select(
            "source",
            "source_pos",
            (total * F.col("weight") / F.sum("weight").over(everything)).alias("target"),
            total.alias("target_total"),
        )
    )


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counted_documents(spark, sf_dir)
    return mixing.quota_mix(counted, mix_targets(counted))


@query(
    "text_scan",
    "SELECT doc_id, source, length(text) AS n_chars FROM documents WHERE text IS NOT NULL AND text <> ''",
)
def text_scan(spark, sf_dir):
    rows = corpora.text_rows(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return rows.select("doc_id", "source", F.char_length("text").cast("long").alias("n_chars"))


@query(
    "binary_text_scan",
    "SELECT page_id, length(html) AS n_chars, md5(html) AS text_md5 FROM pages WHERE html <> ''",
)
def binary_text_scan(spark, sf_dir):
    """Pages as bytes; every page gets a broken byte in its middle and one at its end, which must go."""
    whole = F.col("html").cast("binary")
    half = F.floor(F.char_length("html") / 2).cast("int")
    front = F.substring("html", F.lit(1), half).cast("binary")
    back = F.substring("html", half + 1, F.char_length("html")).cast("binary")
    broken = F.concat(front, F.unhex(F.lit("FF")), back, F.unhex(F.lit("C3")))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("html") != "", broken).otherwise(whole))
    rows = corpora.text_rows(pages, "html", ["page_id"])
    return rows.select(
        "page_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query(
    "source_health",
    """WITH wanted(source, critical) AS (VALUES ('src0', true), ('src1', true), ('src7', false), ('absent', false)),
    seen AS (SELECT source, count(*) AS n_rows, arg_min(text, doc_id) AS sample FROM documents WHERE text <> '' GROUP BY source)
    SELECT source, critical, coalesce(n_rows, 0) AS n_rows, substr(sample, 1, 100) AS sample,
      CASE WHEN n_rows IS NULL THEN 'no rows' ELSE 'ok' END AS status,
      NOT coalesce(bool_or(critical AND n_rows IS NULL) OVER (), false) AS all_critical_ok
    FROM wanted LEFT JOIN seen USING (source)""",
)
def source_health(spark, sf_dir):
    wanted = {"src0": True, "src1": True, "src7": False, "absent": False}
    return corpora.source_health(table(spark, sf_dir, "documents"), wanted)


@query(
    "source_subset",
    "SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src11') AND text <> ''",
)
def source_subset(spark, sf_dir):
    rows = corpora.text_rows(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    kept = mixing.only_sources(rows, ["src3", "src11", "other"], [s.name for s in SHARES])
    return kept.select("doc_id", "source")


@query(
    "min_length_filter",
    "SELECT source, count(*) AS kept, sum(length(text))::BIGINT AS kept_chars FROM documents WHERE length(text) >= 16 GROUP BY source",
)
def min_length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.char_length("text") >= 16)
    return docs.groupBy("source").agg(
        F.count("*").alias("kept"), F.sum(F.char_length("text")).alias("kept_chars")
    )


@query(
    "nonblank_filter",
    "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\S')",
)
def nonblank_filter(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.filter(T.strip(F.col("text")) != "").select("conv_id", "turn")


@query(
    "row_cap",
    "SELECT doc_id, source FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 150",
)
def row_cap(spark, sf_dir):
    spec = corpora.parse_spec("documents:150")
    docs = corpora.text_rows(table(spark, sf_dir, spec.name), "text", ["doc_id", "source"])
    return corpora.capped(docs, spec.cap, "doc_id").select("doc_id", "source")


@query(
    "per_source_cap",
    """WITH caps(source, cap) AS (VALUES ('src0', 3), ('src1', 5), ('src2', 8), ('src3', 13))
    SELECT doc_id, source FROM (SELECT doc_id, source, cap, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
      FROM documents JOIN caps USING (source)) WHERE r <= cap""",
)
def per_source_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpora.capped_by_catalogue(
        docs, {"src0": 3, "src1": 5, "src2": 8, "src3": 13}, "source", F.col("doc_id")
    )


@query(
    "concat_sources",
    """SELECT origin, count(*) AS n_rows, sum(length(text))::BIGINT AS chars, count(lang) AS with_lang FROM (
      SELECT 'documents' AS origin, text, lang FROM documents UNION ALL
      SELECT 'pages', html, NULL FROM pages UNION ALL
      SELECT 'benchmark', text, NULL FROM benchmark) WHERE text <> '' GROUP BY origin""",
)
def concat_sources(spark, sf_dir):
    parts = {
        "documents": lambda: table(spark, sf_dir, "documents").select("text", "lang"),
        "pages": lambda: table(spark, sf_dir, "pages").select(F.col("html").alias("text")),
        "absent": lambda: table(spark, sf_dir, "absent"),
        "benchmark": lambda: table(spark, sf_dir, "benchmark").select("text"),
    }
    joined = corpora.concatenated(parts)
    return (
        joined.filter(F.col("text") != "")
        .groupBy("origin")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum(F.char_length("text")).alias("chars"),
            F.count("lang").alias("with_lang"),
        )
    )


@query(
    "file_census",
    """SELECT lang, count(*) AS n_rows, 'ok' AS status FROM (SELECT coalesce(lang, 'none') AS lang FROM documents) GROUP BY 1
    UNION ALL SELECT 'broken', 0, 'no rows'""",
)
def file_census(spark, sf_dir):
    """Files by language next to one that is no table at all."""
    path = new_table_path(spark, "census")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.repartition(tasks, "lang").select("doc_id", F.concat(F.lit("lang="), "lang").alias("part")).write.partitionBy("part").parquet(path)
    noise = table(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("value"))
    noise.limit(5).coalesce(1).write.text(f"{path}/part=lang%3Dbroken")
    lang = F.regexp_extract("file", "lang(?:=|%3D|%253D)([a-z]+)", 1)
    found = corpora.file_census(spark, path, "doc_id long")
    return found.select(lang.alias("lang"), "n_rows", "status")


@query(
    "configured_sources",
    """SELECT spec, source AS name,
      CASE doc_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN lang ELSE CASE WHEN source = 'src0' THEN 'plain' END END AS config, count(*) AS n FROM
    (SELECT *, source || CASE doc_id % 3 WHEN 0 THEN '::raw' WHEN 1 THEN ':' || lang ELSE '' END AS spec FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL""",
)
def configured_sources(spark, sf_dir):
    """Source names written with a configuration in either way, or registered with one."""
    docs = corpora.require_columns(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    kind = F.col("doc_id") % 3
    spec = F.concat("source", F.when(kind == 0, "::raw").when(kind == 1, F.concat(F.lit(":"), "lang")).otherwise(""))
    named = docs.filter("source IS NOT NULL AND lang IS NOT NULL").select(spec.alias("spec"), corpora.config_of(spec, {"src0": "plain"}).alias("_c"))
    return named.groupBy("spec", "_c.name", "_c.config").agg(F.count("*").alias("n"))


@query(
    "inferred_source_cap",
    """WITH cap AS (SELECT greatest(1024, ceil(700 * 32 / count(DISTINCT source)))::BIGINT AS c FROM documents)
    SELECT source, least(count(*), (SELECT c FROM cap)) AS n_rows, max(doc_id) AS last_doc, (SELECT c FROM cap) AS cap FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL) WHERE r <= (SELECT c FROM cap) GROUP BY source""",
)
def inferred_source_cap(spark, sf_dir):
    """Rows per source where none is configured: enough for the steps of the run."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source", "doc_id")
    sources = docs.agg(F.count_distinct("source").alias("n")).first()["n"]
    cap = rows_per_source(None, 700, 32, sources)
    kept = first_per_group(docs, ["source"], [F.col("doc_id")], cap)
    return kept.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.max("doc_id").alias("last_doc"), F.lit(cap).cast("long").alias("cap")
    )


@query(
    "all_splits",
    "SELECT event_id, event_type FROM events",
)
def all_splits(spark, sf_dir):
    """A benchmark that comes in parts of its own instead of a test split."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    kinds = ("click", "error", "purchase", "signup", "view")
    return corpora.all_splits_or_test({k: events.filter(F.col("event_type") == k) for k in kinds})


@query(
    "resolved_split",
    "SELECT event_id, user_id FROM events WHERE event_type = 'signup'",
)
def resolved_split(spark, sf_dir):
    """The split a set calls by another name; set names ignore case."""
    aliases = {"org/pairs": {"train": "click", "eval": "signup", "test": "signup"}}
    split = corpora.resolve_split("Org/Pairs", "test", aliases)
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == split)
    return events.select("event_id", "user_id")


@query(
    "manifest_scan",
    "SELECT doc_id, length(text) AS n_chars FROM documents WHERE text <> ''",
)
def manifest_scan(spark, sf_dir):
    """Documents stored as JSON lines in three folders that a list file names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folders = [new_table_path(spark, "jsonl") for _ in range(3)]
    for i, folder in enumerate(folders):
        docs.filter(F.col("doc_id") % 3 == i).write.json(folder)
    listing = new_table_path(spark, "listing")
    lines = [(line,) for folder in folders for line in (f" {folder} ", "")]
    spark.createDataFrame(lines, "value string").write.text(listing)
    rows = corpora.read_manifest(spark, listing, "doc_id long, text string")
    found = corpora.text_rows(rows, "text", ["doc_id"])
    return found.select("doc_id", F.char_length("text").alias("n_chars"))


@query(
    "quota_mix",
    f"""WITH {MIX_SQL} SELECT doc_id, source, n_tokens, position, before,
    round(served_share, 9) AS served_share FROM mixed""",
)
def quota_mix(spark, sf_dir):
    return mixed_documents(spark, sf_dir).select(
        "doc_id", "source", "n_tokens", "position", "before",
        F.round("served_share", 9).alias("served_share"),
    )


@query(
    "quota_mix_report",
    f"""WITH {MIX_SQL}, sums AS (SELECT source, sum(n_tokens)::BIGINT AS emitted, count(*) AS examples FROM mixed GROUP BY source)
    SELECT source, round(target, 4) AS target, coalesce(emitted, 0) AS emitted, coalesce(examples, 0) AS examples,
      round(coalesce(emitted, 0) / sum(emitted) OVER (), 9) AS emitted_share,
      round(target / sum(target) OVER (), 9) AS target_share, coalesce(emitted, 0) < target AS exhausted
    FROM targets LEFT JOIN sums USING (source)""",
)
def quota_mix_report(spark, sf_dir):
    counted = counted_documents(spark, sf_dir)
    targets = mix_targets(counted)
    report = mix_report(mixing.quota_mix(counted, targets), targets)
    return (
        report.withColumn("target", F.round("target", 4))
        .withColumn("emitted_share", F.round("emitted_share", 9))
        .withColumn("target_share", F.round("target_share", 9))
    )


ARRIVAL_SQL = f"""{SHARES_SQL}, {COUNTED_SQL},
gaps AS (SELECT c.*, CAST(floor(-ln({UNIFORM_SQL.format("'0:' || source || ':' || doc_id")}) / weight * 1048576) AS BIGINT) AS gap
  FROM counted c JOIN shares USING (source)),
arrivals AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY source ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS arrival FROM gaps),
drawn AS (SELECT *, row_number() OVER w - 1 AS position,
  coalesce(sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM arrivals WINDOW w AS (ORDER BY arrival, source, doc_id))"""


@query("weighted_mix", f"WITH {ARRIVAL_SQL} SELECT doc_id, source, position FROM drawn")
def weighted_mix(spark, sf_dir):
    counted = counted_documents(spark, sf_dir)
    shares = mixing.share_table(spark, SHARES)
    return mixing.weighted_mix(counted, shares, seed=0).select("doc_id", "source", "position")


@query(
    "weighted_mix_to_target",
    f"WITH {ARRIVAL_SQL} SELECT doc_id, source, position, before FROM drawn WHERE before < 20000",
)
def weighted_mix_to_target(spark, sf_dir):
    counted = counted_documents(spark, sf_dir)
    shares = mixing.share_table(spark, SHARES)
    return mixing.weighted_mix(counted, shares, seed=0, target_tokens=20000).select(
        "doc_id", "source", "position", "before"
    )


REPLAY_SQL = f"""WITH {SHARES_SQL},
edges AS (SELECT *, sum(weight / 60) OVER (ORDER BY source_pos) AS hi, sum(weight / 60) OVER (ORDER BY source_pos) - weight / 60 AS lo FROM shares),
sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
u AS (SELECT draw, {UNIFORM_SQL.format("'42:' || draw")} AS u FROM (SELECT unnest(range((SELECT (max(n) * 60 * 2 + 1000)::BIGINT FROM sized))) AS draw)),
picked AS (SELECT draw, source FROM u JOIN edges ON u >= lo - 1e-15 AND u < hi),
taken AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS taken FROM picked),
cut AS (SELECT max(draw) AS last_draw FROM taken JOIN sized USING (source) WHERE taken = n - 1),
indexed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)
SELECT draw, t.source, (taken // n)::BIGINT AS replay, doc_id
FROM taken t JOIN sized USING (source) JOIN indexed i ON i.source = t.source AND i.r = t.taken % n
WHERE draw <= (SELECT last_draw FROM cut)"""


@query("interleave_with_replay", REPLAY_SQL)
def interleave_with_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.interleave_with_replay(docs, SHARES, seed=42).select(
        "draw", "source", "replay", "doc_id"
    )


@query(
    "epoch_assignment",
    f"""WITH ordered AS (SELECT doc_id, row_number() OVER (ORDER BY {UNIFORM_SQL.format("'7:2:' || doc_id")}, doc_id) - 1 AS position,
      count(*) OVER () AS total FROM documents)
    SELECT doc_id, position, position % 7 AS worker FROM ordered WHERE position < total // 7 * 7""",
)
def epoch_assignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mixing.epoch_assignment(docs, world=7, seed=7, epoch=2, key="doc_id")


@query(
    "worker_stream",
    "SELECT doc_id, source, doc_id % 4 AS worker FROM documents WHERE text <> ''",
)
def worker_stream(spark, sf_dir):
    rows = corpora.text_rows(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mixing.with_worker(rows, "doc_id", workers=4).select("doc_id", "source", "worker")


@query(
    "seeded_shuffle",
    f"""SELECT doc_id, {UNIFORM_SQL.format("'42:' || doc_id")} AS order_key FROM documents""",
)
def seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mixing.shuffled(docs, seed=42, key="doc_id").withColumn(
        "order_key", uniform(42, F.col("doc_id"))
    )


@query(
    "corpus_statistics",
    f"""WITH {COUNTED_SQL} SELECT source, count(*) AS samples, round(avg(n_tokens), 6) AS avg_tokens,
    sum(n_tokens)::BIGINT AS total_tokens FROM counted GROUP BY source""",
)
def corpus_statistics(spark, sf_dir):
    docs = corpora.text_rows(table(spark, sf_dir, "documents"), "text", ["source"])
    counted = docs.select("source", (word_count(F.col("text")) + 1).alias("n_tokens"))
    return corpora.statistics(counted).withColumn(
        "avg_tokens", F.round("avg_tokens", 6)
    )


@query(
    "skip_counters",
    """SELECT count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS skipped,
      sum(length(text)) FILTER (used)::BIGINT AS used_chars FROM (SELECT text, length(text) >= 400 AS used FROM documents)""",
)
def skip_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpora.use_counters(docs, F.char_length("text") >= 400, F.char_length("text"))


@query(
    "repetition_rate",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
    g AS (SELECT doc_id, list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i+9], ' ')) AS grams FROM w)
    SELECT doc_id, CASE WHEN len(grams) = 0 THEN 0 ELSE round((len(grams) - len(list_distinct(grams))) / len(grams), 9) END::DOUBLE AS repetition FROM g""",
)
def repetition_rate(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.round(T.repetition(F.col("text"), 10), 9).alias("repetition"))
