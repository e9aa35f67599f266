"""Rollups of run summaries and stage results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import lenient_json

# The metrics that count for each task of the language-understanding score.
GLUE_PRIMARY = {
    "cola": ["matthews_corrcoef"],
    "sst2": ["accuracy"],
    "mrpc": ["accuracy", "f1"],
    "qqp": ["accuracy", "f1"],
    "mnli": ["accuracy_matched", "accuracy_mismatched"],
    "qnli": ["accuracy"],
    "rte": ["accuracy"],
    "stsb": ["pearson", "spearman"],
}


def glue_score(metrics: DataFrame) -> DataFrame:
    """Mean over tasks of the mean of each task's primary metrics, by model."""
    pairs = [(t, m) for t, names in GLUE_PRIMARY.items() for m in names]
    primary = metrics.sparkSession.createDataFrame(pairs, "task string, metric string")
    per_task = (
        metrics.join(primary, ["task", "metric"])
        .groupBy("model", "task")
        .agg(F.avg("value").alias("value"))
    )
    return per_task.groupBy("model").agg(
        F.avg("value").alias("score"), F.count("*").alias("tasks")
    )


# Metrics shown even when a task does not list them, and the fields that
# hold a table of metrics per part of a task.
ALWAYS_SHOWN = ["glue_score", "exact_match", "f1", "prompt_accuracy", "instruction_accuracy"]
PART_FIELDS = ["per_subject", "per_category", "per_round", "per_task"]
# The stages a model goes through.
GAIN_STAGES = ["pretrain", "sft", "dpo"]
METRIC_STAGES = ["base", "sft", "dpo"]

SUMMARY = (
    "checkpoint string, tokenizer string, fast boolean, total_elapsed_s double, "
    "tasks array<string>"
)
TASK = "task string, status string, metric double, metric_keys_tried array<string>, raw variant"


def parsed_summaries(files: DataFrame) -> DataFrame:
    """Summary texts as columns; texts that are no JSON object are left out.

    Of repeated keys the last one counts; a field of another type is null, and entries of
    the task list that are no object are skipped.
    """
    plain = files.withColumn("_plain", lenient_json(F.col("content")))
    rows = plain.filter(F.ltrim("_plain").startswith("{")).withColumn(
        "_s", F.from_json("_plain", SUMMARY)
    )
    entries = F.filter("_s.tasks", lambda t: F.ltrim(t).startswith("{"))
    tasks = F.transform(entries, lambda t: F.from_json(t, TASK))
    return rows.select(
        "path", "_s.checkpoint", "_s.tokenizer", F.coalesce("_s.fast", F.lit(False)).alias("fast"),
        F.col("_s.total_elapsed_s").alias("elapsed_s"),
        F.coalesce(tasks, F.array()).alias("tasks"),
    )


def summary_tasks(summaries: DataFrame) -> DataFrame:
    """One row per task of a summary; of repeated names the last one counts."""
    rows = summaries.select("path", F.posexplode("tasks").alias("slot", "_t"))
    return (
        rows.groupBy("path", F.col("_t.task").alias("task"))
        .agg(F.max_by("_t", "slot").alias("_t"), F.min("slot").alias("slot"))
        .select("path", "task", "slot", "_t.status", "_t.metric", "_t.metric_keys_tried", "_t.raw")
    )


def _number(value: Column) -> Column:
    """Number of a JSON value; truth values count as numbers, everything else is null."""
    kind = F.schema_of_variant(value)
    numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|BOOLEAN)$")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def headline_metric(raw: Column, keys: Column) -> Column:
    """First numeric metric in key order, then the same under ``overall``.

    A list of results stands for its last entry, when that is an object.
    """
    last = F.try_element_at(F.try_variant_get(raw, "$", "array<variant>"), F.lit(-1))
    fields = F.coalesce(_fields(raw), _fields(last))

    def first_number(found: Column) -> Column:
        numbers = F.transform(keys, lambda k: _number(F.try_element_at(found, k)))
        return F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(1))

    return F.coalesce(
        first_number(fields),
        first_number(_fields(F.try_element_at(fields, F.lit("overall")))),
    )


def flattened(tasks: DataFrame) -> DataFrame:
    """Long table (path, task, subtask, metric, value) of all numbers in a summary.

    A task that did not run well shows its status instead.
    """
    ok = F.col("status") == "ok"
    status = tasks.filter(~ok | F.col("status").isNull()).select(
        "path", "task", F.lit("Overall").alias("subtask"), F.lit("status").alias("metric"),
        F.lit(None).cast("double").alias("value"),
        F.coalesce("status", F.lit("failed")).alias("text"),
    )
    good = tasks.filter(ok).select(
        "path", "task", _fields(F.col("raw")).alias("_raw"), "metric_keys_tried"
    )
    shown = F.array_union(
        F.coalesce("metric_keys_tried", F.array().cast("array<string>")),
        F.array(*[F.lit(k) for k in ALWAYS_SHOWN]),
    )
    overall = good.select("path", "task", "_raw", F.explode(shown).alias("metric")).select(
        "path", "task", F.lit("Overall").alias("subtask"), "metric",
        _number(F.try_element_at(F.col("_raw"), F.col("metric"))).alias("value"),
    )
    parts = (
        good.select("path", "task", F.explode(
            F.array(*[_fields(F.try_element_at("_raw", F.lit(p))) for p in PART_FIELDS])
        ).alias("_parts"))
        .select("path", "task", F.explode("_parts").alias("subtask", "_metrics"))
        .select("path", "task", "subtask", F.explode(_fields(F.col("_metrics"))).alias("metric", "_v"))
        .select("path", "task", "subtask", "metric", _number(F.col("_v")).alias("value"))
    )
    numbers = overall.unionByName(parts).filter(F.col("value").isNotNull())
    return status.unionByName(numbers.withColumn("text", F.lit(None).cast("string")))


def wide_metrics(long: DataFrame) -> DataFrame:
    """One row per summary and one column per task, part and metric."""
    named = long.withColumn("_c", F.concat_ws(" | ", "task", "subtask", "metric"))
    names = sorted(r["_c"] for r in named.select("_c").distinct().collect())
    cell = F.coalesce(F.col("value").cast("string"), F.col("text"))
    return named.groupBy("path").pivot("_c", names).agg(F.first(cell))


def completed(tasks: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Summaries in which every expected task ran well."""
    ran_well = F.col("task").isin(list(expected)) & (F.col("status") == "ok")
    return (
        tasks.groupBy("path")
        .agg(F.count_if(ran_well).alias("ok_tasks"))
        .withColumn("complete", F.col("ok_tasks") == len(set(expected)))
    )


def task_columns(tasks: DataFrame) -> list[str]:
    """Task names in the order in which they first appear."""
    seen = tasks.groupBy("task").agg(F.min(F.struct("path", "slot")).alias("_at"))
    return [r["task"] for r in seen.orderBy("_at", "task").collect() if r["task"]]


def sweep_table(tasks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per summary: the metric of each task, or its status when it has none."""
    cell = F.when(F.col("metric").isNull(), F.coalesce("status", F.lit(""))).otherwise(
        F.format_string("%.4f", F.col("metric"))
    )
    table = tasks.groupBy("path").pivot("task", list(names)).agg(F.first(cell))
    return table.fillna("", list(names))


def pending_jobs(
    jobs: DataFrame, summaries: DataFrame, complete: DataFrame, fast: bool, root: str
) -> DataFrame:
    """Jobs with ``cached``: is there a complete summary of the same model and settings?

    Models match when any of their identity keys is equal. Keys are rows, so this is an
    equi-join; the tokenizer may be null on both sides.
    """
    done = summaries.join(complete.filter("complete"), "path", "left_semi").filter(
        F.col("fast") == F.lit(fast)
    )
    done_keys = done.select(
        F.explode(identity_keys(F.col("checkpoint"), root)).alias("_key"),
        F.col("tokenizer").alias("_tokenizer"),
    ).distinct()
    job_keys = jobs.select(
        "job_id", "tokenizer", F.explode(identity_keys(F.col("spec"), root)).alias("_key")
    )
    same = (job_keys["_key"] == done_keys["_key"]) & job_keys["tokenizer"].eqNullSafe(
        done_keys["_tokenizer"]
    )
    hits = job_keys.join(done_keys, same, "left_semi").select("job_id").distinct()
    return jobs.join(hits.withColumn("_hit", F.lit(True)), "job_id", "left").select(
        *jobs.columns, F.coalesce("_hit", F.lit(False)).alias("cached")
    )


def identity_keys(spec: Column, root: str) -> Column:
    """Names under which a model may be known: as given, and a file's full and short path."""
    base = root.rstrip("/") + "/"
    full = F.when(F.startswith(spec, F.lit("/")), spec).otherwise(F.concat(F.lit(base), spec))
    short = F.when(
        F.startswith(full, F.lit(base)), F.substr(full, F.lit(len(base) + 1))
    )
    names = F.when(F.endswith(spec, F.lit(".pt")), F.array(spec, full, short)).otherwise(
        F.array(spec)
    )
    return F.array_distinct(F.filter(names, lambda k: k.isNotNull() & (k != "")))


def share_identity(left: Column, right: Column, root: str) -> Column:
    return F.arrays_overlap(identity_keys(left, root), identity_keys(right, root))


def merged_summary(tasks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tasks of a model's part files: the last file wins, in the given task order."""
    rank = F.create_map(*[F.lit(v) for i, t in enumerate(order) for v in (t, i)])
    return (
        tasks.filter(F.col("task").isin(list(order)))
        .groupBy("checkpoint", "task")
        .agg(F.max_by(F.struct("status", "metric"), F.struct("file_no", "slot")).alias("_t"))
        .select("checkpoint", "task", rank[F.col("task")].alias("place"), "_t.*")
    )


def chosen_tasks(known: Sequence[str], wanted: Sequence[str] | None, skip: Sequence[str]) -> list[str]:
    """Known tasks to run, in list order; an unknown name is an error."""
    unknown = sorted((set(wanted or ()) | set(skip)) - set(known))
    if unknown:
        raise ValueError(f"unknown tasks: {unknown}")
    return [t for t in known if (wanted is None or t in wanted) and t not in set(skip)]


def chosen_results(
    results: DataFrame, known: Sequence[str], wanted: Sequence[str] | None, skip: Sequence[str]
) -> DataFrame:
    """Rows of the chosen tasks."""
    return results.filter(F.col("task").isin(chosen_tasks(known, wanted, skip)))


def stage_gains(results: DataFrame, metrics: Sequence[str], model: str = "model") -> DataFrame:
    """Change of each metric against the previous stage that exists.

    The change is 0 when there is no earlier stage or its value is 0.
    """
    rank = F.create_map(*[F.lit(v) for i, s in enumerate(GAIN_STAGES) for v in (s, i)])
    ranked = results.filter(F.col("stage").isin(GAIN_STAGES)).withColumn(
        "_rank", rank[F.col("stage")]
    )
    by_stage = W.partitionBy(model).orderBy("_rank")

    def gain(name: str) -> Column:
        now, before = F.coalesce(name, F.lit(0.0)), F.lag(F.coalesce(name, F.lit(0.0))).over(by_stage)
        return F.when(F.coalesce(before, F.lit(0.0)) != 0, now - before).otherwise(F.lit(0.0))

    return ranked.select(
        model, "stage", *metrics, *[gain(m).alias(f"{m}_gain") for m in metrics]
    )


def comparison_table(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics as percentages; a missing or zero one shows as N/A."""
    shown = [
        F.when(F.coalesce(m, F.lit(0.0)) == 0, "N/A")
        .otherwise(F.format_string("%.1f%%", F.col(m) * 100))
        .alias(m)
        for m in metrics
    ]
    notes = F.when(F.col("is_baseline"), "HF Baseline").otherwise(F.coalesce("stage", F.lit("")))
    return results.select("model", *shown, notes.alias("notes"))


def stage_metrics(results: DataFrame) -> DataFrame:
    """Rows of the stages that exist."""
    return results.filter(F.col("stage").isin(METRIC_STAGES) & F.col("perplexity").isNotNull())


def kept_checkpoints(paths: DataFrame, archived: str | None, folder: str = "archive") -> DataFrame:
    """Model files without verifier heads; archived ones are skipped, alone, or included."""
    parts = F.split("path", "/")
    in_archive = F.array_contains(parts, folder)
    kept = paths.filter(F.endswith("path", F.lit(".pt")) & ~F.contains(F.lower("path"), F.lit("verifier")))
    if archived == "skip":
        return kept.filter(~in_archive)
    return kept.filter(in_archive) if archived == "only" else kept


def stage_checkpoints(paths: DataFrame, patterns: Mapping[str, Sequence[str]], newest: Column) -> DataFrame:
    """The file of each stage: by its first pattern that matches, the newest of those."""
    ranks = [
        F.struct(F.lit(stage).alias("stage"), F.lit(i).alias("rank"), F.col("path").rlike(p).alias("hit"))
        for stage, regexes in patterns.items()
        for i, p in enumerate(regexes)
    ]
    hits = paths.withColumn("_newest", newest).select(
        *paths.columns, "_newest", F.explode(F.array(*ranks)).alias("_m")
    ).filter("_m.hit")
    return hits.groupBy("run", F.col("_m.stage").alias("stage")).agg(
        F.max_by("path", F.struct(-F.col("_m.rank"), F.col("_newest"), F.col("path"))).alias("path")
    )


def latest_results(appended: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row of each key in an append-only result table."""
    others = [c for c in appended.columns if c not in keys]
    return (
        appended.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), version).alias("_r"))
        .select(*keys, "_r.*")
    )


def rows_per_source(explicit: int | None, steps: int, batch: int, sources: int) -> int:
    """Row cap of each instruction source: as given, else enough for the run."""
    if sources <= 0:
        raise ValueError("there must be at least one source")
    if explicit is not None:
        if explicit <= 0:
            raise ValueError("the row cap must be positive")
        return explicit
    return max(1024, -(-max(1, steps * batch) // sources))
