import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import decoded
from tallyloom.operators import rollup as R
from tallyloom.operators import runlogs as G
from tallyloom.operators import vocab as V
from tallyloom.sources import corpora, records, workspace
from tallyloom.streaming import jobs

LOG = (
    "step=1 loss=9.0 lr=1e-4\nPretraining starts\rstep=2 loss=3.5 acc=1 lr=1.0e-04\n"
    "step=1 loss=4.0 lr=1e-4\nstep=2 loss=0.1 lr=1e-4\nstep=3 loss=0.0005 lr=1e-4\n"
    "Stage 3: dpo\nstep=0 loss=0.0 lr=1e-5\nstep=0 loss=0.7 accuracy=10.00% lr=5.000e-06\n"
)


def points(spark, tmp_path, width):
    folder = tmp_path / "logs" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.out").write_text(LOG, newline="")
    return G.block_loss_points(records.read_log_lines(spark, str(tmp_path / "logs")), width)


@pytest.mark.parametrize("width", [1 << 16, 2])
def test_log_parsing(spark, tmp_path, width):
    found = points(spark, tmp_path, width)
    got = sorted((r["stage"], r["step"], r["loss"], r["lr"]) for r in found.collect())
    assert got == [("dpo", 0, 0.7, 5e-06), ("pretrain", 1, 4.0, 1e-4), ("pretrain", 2, 3.5, 1e-4)]
    row = G.stage_summary(found).filter("stage = 'pretrain'").first()
    assert (row["steps"], row["first_loss"], row["last_loss"], row["min_loss_step"]) == (2, 4.0, 3.5, 2)
    assert row["improvement"] == 12.5


def test_blocks_of_a_log_equal_the_whole(spark, tmp_path):
    """Blocks cut lines, runs of line ends and stages anywhere; the points are those of the whole text."""
    rng = random.Random(12)
    names = ["Pretraining", "sft run", "dpo", "verifier", "idle"]
    folder = tmp_path / "blocks"
    folder.mkdir()
    texts = {}
    for name in ("a", "b"):
        parts = []
        for i in range(200):
            line = f"now {rng.choice(names)}" if rng.random() < 0.02 else f"step={rng.randrange(90)} loss={rng.random():.4f} x lr=1.5e-{rng.randrange(3, 6)}"
            parts.append(("é" * rng.randrange(40) if i % 5 == 0 else line) + rng.choice(("\n", "\r", "\r\n", "\n\n\n", "\r\r")))
        texts[name] = "".join(parts)
        (folder / name).write_text(texts[name], newline="")
    rows = spark.createDataFrame(list(texts.items()), "file string, content string")
    want = {tuple(r) for r in G.loss_points(G.log_lines(rows)).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("211b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            lines = records.read_log_lines(spark, str(folder))
            found = G.block_loss_points(lines).collect()
            if size != "1m":
                assert lines.select("block").distinct().count() > 10
            assert {(r["file"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in found} == want and len(found) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def summary(**changes):
    task = {"task": "glue", "status": "ok", "metric": 0.5, "metric_keys_tried": ["average"],
            "raw": {"average": 0.5, "glue_score": True, "f1": "no", "per_task": {"cola": {"accuracy": 1, "n": "x"}, "bad": 3}}}
    failed = {"task": "mmlu", "status": "failed", "metric": None}
    return {"checkpoint": "runs/a.pt", "tokenizer": None, "fast": False, "tasks": [task, failed], **changes}


def test_summaries(spark, tmp_path):
    for name, text in (("a", json.dumps(summary())), ("b", "{broken"), ("c", "[1]"), ("d", json.dumps({"tasks": None}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "eval_all_summary.json").write_text(text)
    (tmp_path / "a" / "other.json").write_text(json.dumps(summary()))
    parsed = R.parsed_summaries(records.read_summary_files(spark, str(tmp_path)))
    assert parsed.count() == 2
    tasks = R.summary_tasks(parsed)
    flat = {(r["task"], r["subtask"], r["metric"]): (r["value"], r["text"]) for r in R.flattened(tasks).collect()}
    assert flat == {
        ("mmlu", "Overall", "status"): (None, "failed"),
        ("glue", "Overall", "average"): (0.5, None),
        ("glue", "Overall", "glue_score"): (1.0, None),
        ("glue", "cola", "accuracy"): (1.0, None),
    }
    row = R.sweep_table(tasks, ["glue", "mmlu", "other"]).first()
    assert (row["glue"], row["mmlu"], row["other"]) == ("0.5000", "failed", "")
    assert R.completed(tasks, ["glue"]).first()["complete"]
    assert not R.completed(tasks, ["glue", "mmlu"]).first()["complete"]


def test_headline_metric(spark):
    raws = ['{"a": "x", "b": 2}', '{"overall": {"a": 3}}', '[{"a": 1}, {"a": 4}]', '[1]', '{}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    keys = F.array(F.lit("a"), F.lit("b"))
    got = df.select("i", R.headline_metric(F.try_parse_json("r"), keys).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [2.0, 3.0, 4.0, None, None]


def test_pending_jobs_match_any_identity(spark):
    texts = [("p1", json.dumps(summary())), ("p2", json.dumps(summary(checkpoint="hub/x", tokenizer="t"))),
             ("p3", json.dumps(summary(checkpoint="runs/f.pt", fast=True)))]
    parsed = R.parsed_summaries(spark.createDataFrame(texts, "path string, content string"))
    complete = R.completed(R.summary_tasks(parsed), ["glue"])
    rows = [(1, "/w/runs/a.pt", None), (2, "runs/a.pt", "t"), (3, "hub/x", "t"), (4, "hub/x", None), (5, "runs/f.pt", None)]
    jobs_df = spark.createDataFrame(rows, "job_id int, spec string, tokenizer string")
    got = R.pending_jobs(jobs_df, parsed, complete, False, "/w").orderBy("job_id").collect()
    assert [r["cached"] for r in got] == [True, False, True, False, False]


def test_stage_gains_skip_missing_stages(spark):
    rows = [("m", "pretrain", 0.5), ("m", "dpo", 0.75), ("z", "pretrain", 0.0), ("z", "sft", 0.3)]
    got = R.stage_gains(spark.createDataFrame(rows, "model string, stage string, s double"), ["s"]).collect()
    assert {(r["model"], r["stage"]): r["s_gain"] for r in got} == {
        ("m", "pretrain"): 0.0, ("m", "dpo"): 0.25, ("z", "pretrain"): 0.0, ("z", "sft"): 0.0
    }


def test_caps_and_task_choice():
    assert R.rows_per_source(None, 4000, 32, 8) == 16000
    assert R.rows_per_source(None, 1, 1, 8) == 1024
    assert R.rows_per_source(4096, 1, 1, 8) == 4096
    for bad in ((0, 1, 1, 8), (None, 1, 1, 0)):
        with pytest.raises(ValueError):
            R.rows_per_source(*bad)
    assert R.chosen_tasks(["a", "b", "c"], None, ["b"]) == ["a", "c"]
    with pytest.raises(ValueError):
        R.chosen_tasks(["a"], ["x"], [])


def test_specs_and_splits():
    assert corpora.parse_spec("wiki:50") == corpora.Spec("wiki", 50)
    assert corpora.parse_spec("org/set:main") == corpora.Spec("org/set:main")
    assert corpora.resolve_config("a::b", {}) == ("a", "b")
    assert corpora.resolve_config("a:b", {}) == ("a", "b")
    assert corpora.resolve_config("a", {"a": "c"}) == ("a", "c")
    aliases = {"org/prefs": {"train": "train_prefs", "test": "test_prefs"}}
    assert corpora.resolve_split("Org/Prefs", "train", aliases) == "train_prefs"
    assert corpora.resolve_split("other", "train", aliases) == "train"


def test_configurations_as_columns(spark):
    names = ["a::b", "a:b", "a", "x::", "a::b:c", ":b", "p:q:r", "b:", "", "::z"]
    known = {"a": "c", "b:": "d", "": "e"}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["name"]: tuple(r["c"]) for r in rows.select("name", corpora.config_of(F.col("name"), known).alias("c")).collect()}
    assert found == {n: corpora.resolve_config(n, known) for n in names}


def test_files_that_break(spark, tmp_path):
    folder = str(tmp_path / "files")
    spark.range(0, 50, 1, 2).write.parquet(folder)
    good = sorted((tmp_path / "files").glob("*.parquet"))
    (tmp_path / "files" / "bad.parquet").write_bytes(good[0].read_bytes()[:-20])
    (tmp_path / "files" / "none.parquet").write_bytes(b"")
    assert corpora.read_readable(spark, folder, "id long").count() == 50
    census = {r["file"].rsplit("/", 1)[1]: (r["n_rows"], r["status"]) for r in corpora.file_census(spark, folder, "id long").collect()}
    assert census == {good[0].name: (25, "ok"), good[1].name: (25, "ok"), "bad.parquet": (0, "no rows")}


def test_manifest_and_text_rows(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"text": "a"}\n{"text": ""}\n')
    (tmp_path / "two.jsonl").write_text('{"text": "b"}\n')
    listing = tmp_path / "urls.txt"
    listing.write_text(f"{tmp_path}/one.jsonl\n\n  {tmp_path}/two.jsonl \n")
    rows = corpora.text_rows(corpora.read_manifest(spark, str(listing), "text string"), "text")
    assert sorted(r["text"] for r in rows.collect()) == ["a", "b"]
    (tmp_path / "empty.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        corpora.manifest_paths(spark, str(tmp_path / "empty.txt"))
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xffb"),), (None,)], "raw binary")
    assert [r["text"] for r in corpora.text_rows(raw, "raw").collect()] == ["ok", "ab"]
    with pytest.raises(ValueError):
        corpora.text_rows(rows, "absent")


def test_splits(spark):
    a, b = spark.range(2), spark.range(3)
    assert corpora.all_splits_or_test({"test": a, "train": b}).count() == 2
    assert corpora.all_splits_or_test({"age": a, "race": b}).count() == 5
    with pytest.raises(ValueError):
        corpora.concatenated({})


def test_merges_equal_the_library_trainer(spark):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    texts = [
        r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    ] + ["it's  we'll  don't  12 34\n\n x_y", "café été"]
    library = Tokenizer(models.BPE())
    library.normalizer = normalizers.NFC()
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.train_from_iterator(
        texts,
        trainers.BpeTrainer(
            vocab_size=7 + 256 + 60, min_frequency=2, special_tokens=V.SPECIAL_TOKENS,
            initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False,
        ),
    )
    wanted = [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]
    counts = V.piece_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    learned = V.learned_merges(counts, 60)
    assert [(a, b) for a, b, _ in V.spelled(learned)] == wanted
    ours = Tokenizer.from_str(V.tokenizer_json(learned))
    assert ours.encode(texts[0]).ids == library.encode(texts[0]).ids


def test_metrics_keep_up_with_appended_records(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "phase string, step long, loss double"
    records.append_metrics(spark.createDataFrame([("train", 1, 3.0), ("eval", 1, 5.0)], schema), landing)
    jobs.follow_metrics(spark, landing, out)
    records.append_metrics(spark.createDataFrame([("train", 2, 2.0)], schema), landing)
    jobs.follow_metrics(spark, landing, out)
    got = {r["phase"]: (r["step"], r["loss"], r["records"]) for r in jobs.followed_metrics(spark, out).collect()}
    assert got == {"train": (2, 2.0, 2), "eval": (1, 5.0, 1)}


def test_broken_bytes_are_dropped(spark):
    rng = random.Random(6)
    good = "aé\u20ac\U0001f600\ufffd\uf8ff01".encode()
    rows = [(0, bytearray(good)), (1, bytearray(b"")), (2, None)]
    for i in range(3, 200):
        raw = bytearray(good * 2)
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(len(raw))] = rng.choice([rng.randrange(256), 0xE2, 0xF0, 0x80, 0xC3])
        rows.append((i, raw[: rng.randint(1, len(raw))]))
    df = spark.createDataFrame(rows, "i int, raw binary")
    got = {r["i"]: r["t"] for r in df.select("i", decoded(F.col("raw")).alias("t")).collect()}
    for i, raw in rows:
        assert got[i] == (None if raw is None else bytes(raw).decode("utf-8", "ignore")), raw


def test_summaries_keep_odd_entries(spark):
    task = '{"task": "t", "status": "ok", "raw": {"a": 1, "a": 2}}'
    texts = [("p", '{"checkpoint": "c", "tasks": [' + task + ', 5, "x", null]}'), ("q", '{"total_elapsed_s": "x", "tasks": 3}')]
    parsed = R.parsed_summaries(spark.createDataFrame(texts, "path string, content string"))
    assert {r["path"]: len(r["tasks"]) for r in parsed.collect()} == {"p": 1, "q": 0}
    row = R.summary_tasks(parsed).select("task", F.try_variant_get("raw", "$.a", "int").alias("a")).collect()
    assert [tuple(r) for r in row] == [("t", 2)]


def test_lenient_checks(spark):
    texts = ['{"a":1,"a":2}', "[NaN]", "```[1]```", "{1}", "no", "<<a\rb>>", "<<a b>>", "<<a\nb>>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    from tallyloom.functions import checks

    none = F.from_json(F.lit("{}"), "num_placeholders int, num_highlights int, num_sections int, section_spliter string, end_phrase string, prompt_to_repeat string, postscript_marker string")
    got = rows.select("i", checks.json_text(F.col("r"), none).alias("json"), checks.title(F.col("r"), none).alias("title"),
                      *[F.coalesce(f(F.col("r"), none), F.lit(False)).alias(f"n{k}") for k, f in enumerate((checks.placeholder_number, checks.highlight_number, checks.section_number, checks.ends_with_phrase, checks.repeats_prompt))])
    found = got.orderBy("i").collect()
    assert [r["json"] for r in found] == [True, True, True, False, False, False, False, False]
    assert [r["title"] for r in found] == [False] * 5 + [True, True, False]
    assert not any(r[f"n{k}"] for r in found for k in range(5))


def test_many_files_are_dealt_over_more_tasks(spark):
    rows = spark.range(1000).selectExpr("id % 500 AS model")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert workspace.dealt_by_file(rows, "model", 5).rdd.getNumPartitions() == usual
    many = workspace.FILES_PER_TASK * (usual + 3) + 1
    assert workspace.dealt_by_file(rows, "model", many).rdd.getNumPartitions() == usual + 4
    assert workspace.dealt_by_file(rows, "model", many).count() == 1000


def test_logs_that_share_files(spark):
    """Few files for many logs, cut by blocks; a line may hold tabs, a log may have no name."""
    rng = random.Random(5)
    names = ["Pretraining", "sft\trun", "dpo", "idle"]
    rows = []
    for log in [None, -4, *range(10)]:
        for i in range(rng.randrange(1, 40)):
            line = f"now {rng.choice(names)}" if rng.random() < 0.2 else f"step={rng.randrange(9)} loss={rng.random():.4f} x lr=1.5e-4"
            rows.append((log, i, line, rng.choice("\n\r")))
    lines = spark.createDataFrame(rows, "log long, line_no long, line string, ending string")
    named = lines.select(F.coalesce(F.col("log").cast("string"), F.lit("")).alias("file"), "line_no", "line")
    want = {tuple(r) for r in G.loss_points(named).collect()}
    path = workspace.new_table_path(spark, "shared-logs")
    records.write_shared_logs(lines.withColumn("value", F.concat("line", "ending")), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "397b")
        read = records.read_shared_logs(spark, path)
        assert read.count() == len(rows)
        found = G.block_loss_points(read, log="log").collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_log_files_do_not_grow_with_the_users(spark, tmp_path, monkeypatch):
    from tallyloom.plans import runlogs as plan

    rows = [(i, i % 300, "view" if i < 900 else "click", 1.5) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    stored = tmp_path / "stored"
    monkeypatch.setattr(plan, "new_table_path", lambda *_: str(stored))
    found = {tuple(r) for r in plan.log_file_points(spark, str(tmp_path)).collect()}
    assert found == {tuple(r) for r in plan.loss_points(spark, str(tmp_path)).collect()} and found
    assert len(list(stored.rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
