"""Run summaries and stage results. Summaries are made from events: a user is a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import rollup as R
from tallyloom.plans.registry import query, table
from tallyloom.plans.scoring import rounded
from tallyloom.sources import records
from tallyloom.sources.workspace import dealt_by_file, new_table_path, pin

TASKS = ["click", "error", "purchase", "signup", "view"]
BASE_SQL = """base AS (SELECT user_id, event_type AS task, count(*) AS n, max(value) AS hi, min(value) AS lo, max(event_id) AS last,
  CASE WHEN max(event_id) % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE max(value) END AS metric FROM events GROUP BY ALL)"""


def summary_files(spark, sf_dir):
    """One summary text per model, built from at most one task row per event type."""
    base = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.col("event_type").alias("task"))
        .agg(
            F.count("*").alias("n"),
            F.max("value").alias("hi"),
            F.min("value").alias("lo"),
            F.max("event_id").alias("last"),
        )
    )
    raw = F.struct(
        F.col("hi").alias("accuracy"),
        F.lit("text").alias("glue_score"),
        F.col("lo").alias("exact_match"),
        F.struct(
            F.struct(F.col("lo").alias("acc"), F.lit("x").alias("label")).alias("low"),
            F.struct(F.col("hi").alias("acc"), F.col("n").alias("n")).alias("high"),
            F.lit(3).alias("count"),
        ).alias("per_category"),
        F.struct(F.col("n").alias("rows")).alias("overall"),
    )
    task = F.struct(
        "task",
        F.when(F.col("last") % 4 == 0, "failed").otherwise("ok").alias("status"),
        F.when(F.col("last") % 3 == 0, None).otherwise(F.col("hi")).alias("metric"),
        F.array(F.lit("accuracy"), F.lit("absent")).alias("metric_keys_tried"),
        raw.alias("raw"),
    )
    grouped = base.groupBy("user_id").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    user = F.col("user_id").cast("string")
    text = F.to_json(
        F.struct(
            F.concat(F.lit("runs/"), user, F.lit(".pt")).alias("checkpoint"),
            F.when(F.col("user_id") % 2 == 0, "tok").alias("tokenizer"),
            (F.col("user_id") % 5 == 0).alias("fast"),
            F.col("user_id").cast("double").alias("total_elapsed_s"),
            "tasks",
        )
    )
    broken = F.when(F.col("user_id") % 10 == 3, F.substr(text, F.lit(2))).otherwise(text)
    return grouped.select(F.concat(F.lit("out/"), user).alias("path"), broken.alias("content"))


def summary_tasks(spark, sf_dir):
    return R.summary_tasks(R.parsed_summaries(summary_files(spark, sf_dir)))


READABLE = "user_id % 10 <> 3"


@query(
    "parsed_summaries",
    f"""WITH {BASE_SQL} SELECT 'out/' || user_id AS path, 'runs/' || user_id || '.pt' AS checkpoint, CASE WHEN user_id % 2 = 0 THEN 'tok' END AS tokenizer,
    user_id % 5 = 0 AS fast, user_id::DOUBLE AS elapsed_s, count(*) AS tasks FROM base WHERE {READABLE} GROUP BY user_id""",
)
def parsed_summaries(spark, sf_dir):
    parsed = R.parsed_summaries(summary_files(spark, sf_dir))
    return parsed.withColumn("tasks", F.size("tasks").cast("long"))


@query(
    "summary_file_scan",
    f"""WITH {BASE_SQL} SELECT 'runs/' || user_id || '.pt' AS checkpoint, count(*) AS tasks, count(*) FILTER (status = 'ok') AS ok_tasks FROM base WHERE {READABLE} GROUP BY user_id""",
)
def summary_file_scan(spark, sf_dir):
    """Summaries stored as one file each and found again anywhere under the folder."""
    files = pin(summary_files(spark, sf_dir).withColumn("model", F.split_part("path", F.lit("/"), F.lit(2))))
    folder = new_table_path(spark, "summaries")
    dealt = dealt_by_file(files.select("model", "content"), "model", files.count())
    dealt.write.partitionBy("model").text(folder)
    parsed = R.parsed_summaries(records.read_summary_files(spark, folder, "*.txt"))
    return parsed.select(
        "checkpoint",
        F.size("tasks").cast("long").alias("tasks"),
        F.size(F.filter("tasks", lambda t: t["status"] == "ok")).cast("long").alias("ok_tasks"),
    )


FLAT_SQL = f"""{BASE_SQL}, flat AS (
  SELECT 'out/' || user_id AS path, task, 'Overall' AS subtask, 'status' AS metric, NULL::DOUBLE AS value, status AS text FROM base WHERE status <> 'ok' AND {READABLE}
  UNION ALL SELECT 'out/' || user_id, task, 'Overall', unnest(['accuracy', 'exact_match']), unnest([hi, lo]), NULL FROM base WHERE status = 'ok' AND {READABLE}
  UNION ALL SELECT 'out/' || user_id, task, unnest(['low', 'high', 'high']), unnest(['acc', 'acc', 'n']), unnest([lo, hi, n]), NULL FROM base WHERE status = 'ok' AND {READABLE})"""


@query("flattened_summaries", f"WITH {FLAT_SQL} SELECT * FROM flat")
def flattened_summaries(spark, sf_dir):
    return R.flattened(summary_tasks(spark, sf_dir))


@query(
    "wide_metrics",
    f"""WITH {FLAT_SQL} SELECT path, """
    + ", ".join(
        f"max(CASE WHEN task = '{t}' AND subtask = '{s}' AND metric = '{m}' THEN coalesce(value::VARCHAR, text) END) AS \"{t} | {s} | {m}\""
        for t in TASKS
        for s, m in (("Overall", "status"), ("Overall", "accuracy"), ("Overall", "exact_match"), ("low", "acc"), ("high", "acc"), ("high", "n"))
    )
    + " FROM flat GROUP BY path",
)
def wide_metrics(spark, sf_dir):
    return R.wide_metrics(R.flattened(summary_tasks(spark, sf_dir)))


@query(
    "headline_metrics",
    f"""WITH {BASE_SQL} SELECT 'out/' || user_id AS path, task, lo AS by_order, n::DOUBLE AS under_overall, NULL::DOUBLE AS none FROM base WHERE {READABLE}""",
)
def headline_metrics(spark, sf_dir):
    def keys(*names):
        return F.array(*[F.lit(n) for n in names])

    return summary_tasks(spark, sf_dir).select(
        "path",
        "task",
        R.headline_metric(F.col("raw"), keys("glue_score", "exact_match", "accuracy")).alias("by_order"),
        R.headline_metric(F.col("raw"), keys("average", "rows")).alias("under_overall"),
        R.headline_metric(F.col("raw"), keys("pass@1")).alias("none"),
    )


@query(
    "complete_summaries",
    f"""WITH {BASE_SQL} SELECT 'out/' || user_id AS path, count(*) FILTER (status = 'ok' AND task IN ('click', 'error', 'view')) AS ok_tasks,
    count(*) FILTER (status = 'ok' AND task IN ('click', 'error', 'view')) = 3 AS complete FROM base WHERE {READABLE} GROUP BY user_id""",
)
def complete_summaries(spark, sf_dir):
    return R.completed(summary_tasks(spark, sf_dir), ["click", "error", "view"])


@query(
    "sweep_table",
    f"""WITH {BASE_SQL} SELECT 'out/' || user_id AS path, """
    + ", ".join(
        f"coalesce(max(CASE WHEN task = '{t}' THEN CASE WHEN metric IS NULL THEN status ELSE printf('%.4f', metric) END END), '') AS {t}"
        for t in TASKS
    )
    + f" FROM base WHERE {READABLE} GROUP BY user_id",
)
def sweep_table(spark, sf_dir):
    """Pivoted results, written as CSV and read back."""
    tasks = summary_tasks(spark, sf_dir)
    path = new_table_path(spark, "sweep")
    records.write_table_csv(R.sweep_table(tasks, R.task_columns(tasks)), path)
    stored = spark.read.option("header", True).csv(path)
    return stored.fillna("")


@query(
    "pending_jobs",
    f"""WITH {BASE_SQL}, done AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'tok' END AS tokenizer FROM base WHERE {READABLE} AND user_id % 5 <> 0
      GROUP BY user_id HAVING count(*) FILTER (status = 'ok' AND task IN ('click', 'error')) = 2),
    jobs AS (SELECT c_custkey AS job_id, CASE c_custkey % 3 WHEN 0 THEN '/work/runs/' || c_custkey || '.pt' WHEN 1 THEN 'runs/' || c_custkey || '.pt' ELSE 'hub/' || c_custkey END AS spec,
      CASE WHEN c_custkey % 2 = 0 THEN 'tok' END AS tokenizer FROM customer)
    SELECT job_id, spec, jobs.tokenizer, job_id % 3 <> 2 AND user_id IS NOT NULL AND jobs.tokenizer IS NOT DISTINCT FROM done.tokenizer AS cached FROM jobs LEFT JOIN done ON user_id = job_id""",
)
def pending_jobs(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    spec = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/work/runs/"), key, F.lit(".pt")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("runs/"), key, F.lit(".pt")))
        .otherwise(F.concat(F.lit("hub/"), key))
    )
    jobs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"),
        spec.alias("spec"),
        F.when(F.col("c_custkey") % 2 == 0, "tok").alias("tokenizer"),
    )
    summaries = R.parsed_summaries(summary_files(spark, sf_dir))
    complete = R.completed(R.summary_tasks(summaries), ["click", "error"])
    return R.pending_jobs(jobs, summaries, complete, fast=False, root="/work")


@query(
    "merged_summaries",
    """SELECT 'runs/' || user_id AS checkpoint, event_type AS task, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS place,
      arg_max(CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END, (event_id % 4) * 1000000000 + event_id) AS status, arg_max(value, (event_id % 4) * 1000000000 + event_id) AS metric
    FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id, event_type""",
)
def merged_summaries(spark, sf_dir):
    tasks = table(spark, sf_dir, "events").select(
        F.concat(F.lit("runs/"), F.col("user_id").cast("string")).alias("checkpoint"),
        F.col("event_type").alias("task"),
        (F.col("event_id") % 4).alias("file_no"),
        F.col("event_id").alias("slot"),
        F.when(F.col("event_id") % 4 == 0, "failed").otherwise("ok").alias("status"),
        F.col("value").alias("metric"),
    )
    return R.merged_summary(tasks, ["view", "click", "error"])


@query(
    "chosen_results",
    "SELECT event_id, event_type AS task, value FROM events WHERE event_type IN ('click', 'view')",
)
def chosen_results(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("task"), "value"
    )
    return R.chosen_results(rows, TASKS, ["view", "error", "click"], skip=["error"])


@query(
    "merged_elapsed",
    "SELECT 'runs/' || user_id AS checkpoint, round(sum(value), 4) AS elapsed_s FROM events GROUP BY user_id",
)
def merged_elapsed(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("runs/"), F.col("user_id").cast("string")).alias("checkpoint")
    ).agg(F.round(F.sum("value"), 4).alias("elapsed_s"))


STAGE_SQL = """results AS (SELECT * FROM (SELECT user_id AS model, CASE event_type WHEN 'view' THEN 'pretrain' WHEN 'click' THEN 'sft' WHEN 'error' THEN 'dpo' ELSE 'base' END AS stage,
  CASE WHEN max(event_id) % 7 = 0 THEN 0 ELSE max(value) / 500 END AS sst2, min(value) / 500 AS gsm8k FROM events GROUP BY ALL) WHERE (model + length(stage)) % 3 <> 0)"""


def stage_results(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stage = (
        F.when(F.col("event_type") == "view", "pretrain")
        .when(F.col("event_type") == "click", "sft")
        .when(F.col("event_type") == "error", "dpo")
        .otherwise("base")
    )
    results = events.groupBy(F.col("user_id").alias("model"), stage.alias("stage")).agg(
        F.when(F.max("event_id") % 7 == 0, 0.0).otherwise(F.max("value") / 500).alias("sst2"),
        (F.min("value") / 500).alias("gsm8k"),
    )
    # A third of the stages never ran; the others use all their events.
    return results.where((F.col("model") + F.length("stage")) % 3 != 0)


@query(
    "stage_gains",
    f"""WITH {STAGE_SQL}, r AS (SELECT *, CASE stage WHEN 'pretrain' THEN 0 WHEN 'sft' THEN 1 ELSE 2 END AS rk FROM results WHERE stage <> 'base'),
    l AS (SELECT *, lag(sst2) OVER w AS ps, lag(gsm8k) OVER w AS pg FROM r WINDOW w AS (PARTITION BY model ORDER BY rk))
    SELECT model, stage, sst2, gsm8k, round(CASE WHEN coalesce(ps, 0) <> 0 THEN sst2 - ps ELSE 0 END, 9) AS sst2_gain, round(CASE WHEN coalesce(pg, 0) <> 0 THEN gsm8k - pg ELSE 0 END, 9) AS gsm8k_gain FROM l""",
)
def stage_gains(spark, sf_dir):
    found = R.stage_gains(stage_results(spark, sf_dir), ["sst2", "gsm8k"])
    return rounded(found, "sst2_gain", "gsm8k_gain")


@query(
    "comparison_table",
    """SELECT o_orderkey AS model, CASE WHEN o_custkey % 9 = 0 THEN 'N/A' ELSE printf('%.1f%%', (o_custkey % 9) / 8.0 * 100) END AS sst2, CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE '25.0%' END AS gsm8k,
    CASE WHEN o_orderkey % 4 = 0 THEN 'HF Baseline' WHEN o_orderkey % 4 = 1 THEN '' ELSE 'sft' END AS notes FROM orders""",
)
def comparison_table(spark, sf_dir):
    results = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("model"),
        ((F.col("o_custkey") % 9) / 8.0).alias("sst2"),
        F.when(F.col("o_orderstatus") != "P", 0.25).alias("gsm8k"),
        (F.col("o_orderkey") % 4 == 0).alias("is_baseline"),
        F.when(F.col("o_orderkey") % 4 != 1, "sft").alias("stage"),
    )
    return R.comparison_table(results, ["sst2", "gsm8k"])


@query(
    "stage_metrics",
    f"WITH {STAGE_SQL} SELECT model, stage, sst2 AS perplexity FROM results WHERE stage IN ('base', 'sft', 'dpo') AND sst2 <> 0",
)
def stage_metrics(spark, sf_dir):
    """Stages that exist, written as CSV and read back."""
    results = stage_results(spark, sf_dir).select(
        "model", "stage", F.nullif("sst2", F.lit(0.0)).alias("perplexity")
    )
    path = new_table_path(spark, "stages")
    records.write_table_csv(R.stage_metrics(results), path)
    return spark.read.schema("model long, stage string, perplexity double").option(
        "header", True
    ).csv(path)


PATH_SQL = """paths AS (SELECT event_id, user_id AS run, 'runs/' || CASE WHEN user_id % 6 = 0 THEN 'archive/' ELSE '' END || CASE WHEN event_id % 10 = 0 THEN 'Verifier-x/' ELSE '' END || user_id || '/g-'
  || CASE event_type WHEN 'view' THEN 'pretrain' WHEN 'click' THEN 'sft' ELSE 'dpo' END || CASE event_id % 3 WHEN 0 THEN '_final' WHEN 1 THEN '_best' ELSE '_step' || event_id END || CASE WHEN event_type = 'signup' THEN '.txt' ELSE '.pt' END AS path FROM events)"""


def checkpoint_paths(spark, sf_dir):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    stage = (
        F.when(F.col("event_type") == "view", "pretrain")
        .when(F.col("event_type") == "click", "sft")
        .otherwise("dpo")
    )
    kind = (
        F.when(F.col("event_id") % 3 == 0, "_final")
        .when(F.col("event_id") % 3 == 1, "_best")
        .otherwise(F.concat(F.lit("_step"), event))
    )
    path = F.concat(
        F.lit("runs/"),
        F.when(F.col("user_id") % 6 == 0, "archive/").otherwise(""),
        F.when(F.col("event_id") % 10 == 0, "Verifier-x/").otherwise(""),
        user, F.lit("/g-"), stage, kind,
        F.when(F.col("event_type") == "signup", ".txt").otherwise(".pt"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run"), path.alias("path")
    )


@query(
    "kept_checkpoints",
    f"WITH {PATH_SQL} SELECT event_id, run, path FROM paths WHERE ends_with(path, '.pt') AND NOT contains(lower(path), 'verifier') AND NOT contains(path, 'archive')",
)
def kept_checkpoints(spark, sf_dir):
    return R.kept_checkpoints(checkpoint_paths(spark, sf_dir), "skip")


@query(
    "stage_checkpoints",
    f"""WITH {PATH_SQL}, m AS (SELECT run, stage, path, event_id, CASE WHEN contains(path, '_final') THEN 0 WHEN contains(path, '_best') THEN 1 ELSE 2 END AS rk
      FROM paths, (SELECT unnest(['pretrain', 'sft', 'dpo']) AS stage) WHERE contains(path, stage) AND ends_with(path, '.pt'))
    SELECT run, stage, path FROM m QUALIFY row_number() OVER (PARTITION BY run, stage ORDER BY rk, event_id DESC) = 1""",
)
def stage_checkpoints(spark, sf_dir):
    patterns = {
        s: [rf"{s}.*final.*\.pt$", rf"{s}.*best.*\.pt$", rf"{s}.*step.*\.pt$"]
        for s in ("pretrain", "sft", "dpo")
    }
    return R.stage_checkpoints(checkpoint_paths(spark, sf_dir), patterns, F.col("event_id"))


@query(
    "identity_overlap",
    """SELECT c_custkey, c_custkey % 4 <> 3 AS same_model FROM customer""",
)
def identity_overlap(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    short = F.concat(F.lit("runs/"), key, F.lit(".pt"))
    other = F.when(F.col("c_custkey") % 4 == 3, F.concat(F.lit("runs/x"), key, F.lit(".pt"))).otherwise(
        F.concat(F.lit("/work/"), short)
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", R.share_identity(short, other, "/work").alias("same_model")
    )


@query(
    "latest_results",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL",
)
def latest_results(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return R.latest_results(rows, ["user_id", "event_type"], "event_id")
