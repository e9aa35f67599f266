"""Training logs: parsing, smoothing and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordered import CHUNK, carry_forward, totals_by_key, trailing_mean
from tallyloom.sources.workspace import pin

# Fixed pattern of a loss line: step, loss and learning rate.
LOSS_LINE = r"step=(\d+)\s+loss=([\d.]+)[^\n]*?lr=([\d.e+-]+)"
# Stages and the words that announce them, in the order they are tried.
STAGES = {
    "pretrain": "(?i)pretrain",
    "sft": "(?i)sft|fine-tuning|stage 2",
    "dpo": "(?i)dpo|preference|stage 3",
    "verifier": "(?i)verifier|stage 4",
}
# Fixed value: losses not above this are artefacts.
SMALLEST_LOSS = 0.001


#: Numbers of lines in one chunk of a log file's blocks, about as many bytes of it.
BLOCK_CHUNK = 1 << 26


def log_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of short log texts; a carriage return ends a line too."""
    lines = F.split(F.translate("content", "\r", "\n"), "\n")
    return files.select("file", F.posexplode(lines).alias("line_no", "line"))


def _marked(lines: DataFrame, *keep: str) -> DataFrame:
    """The lines that name a stage or a loss, parsed."""
    stage = F.lit(None).cast("string")
    for name, pattern in reversed(list(STAGES.items())):
        stage = F.when(F.col("line").rlike(pattern), name).otherwise(stage)
    part = lambda i: F.regexp_extract("line", LOSS_LINE, i)
    parsed = lines.select(
        *keep,
        stage.alias("named"),
        part(1).try_cast("long").alias("step"),
        part(2).try_cast("double").alias("loss"),
        part(3).try_cast("double").alias("lr"),
    )
    return pin(parsed.filter(F.col("named").isNotNull() | F.col("step").isNotNull()))


def _first_losses(marked: DataFrame, width: int) -> DataFrame:
    staged = carry_forward(marked, "named", "line_no", ["file"], "stage", width)
    usable = staged.filter(
        F.col("stage").isNotNull() & F.col("step").isNotNull() & (F.col("loss") > SMALLEST_LOSS)
    )
    return (
        usable.groupBy("file", "stage", "step")
        .agg(F.min_by(F.struct("loss", "lr"), "line_no").alias("_p"))
        .select("file", "stage", "step", "_p.*")
    )


def loss_points(lines: DataFrame, width: int = CHUNK) -> DataFrame:
    """First loss of each step in each stage of a log file.

    The stage named last before a line is the line's stage; lines before any stage
    are dropped. Lines are parsed once; only those that name a stage or a loss are kept.
    """
    return _first_losses(_marked(lines, "file", "line_no"), width)


def block_loss_points(lines: DataFrame, width: int = BLOCK_CHUNK, log: str = "file") -> DataFrame:
    """``loss_points`` of lines that were read in blocks (``file``, ``block``, ``place``, ``line``).

    ``log`` names the log of a line where a file holds several; a log must not go on in another file.

    Only parsed lines are kept and numbered: a block of n bytes has at most n + 1 lines, so twice its start plus
    the place after its first kept line is in file order. The stage goes on over the edges of blocks.
    """
    marked = _marked(lines, *dict.fromkeys(["file", "block", "place", log]))
    begins = marked.groupBy("file", "block").agg(F.min("place").alias("_begin"))
    numbered = marked.join(begins, ["file", "block"]).select(
        F.col(log).alias("file"), (2 * F.col("block") + F.col("place") - F.col("_begin")).alias("line_no"), "named", "step", "loss", "lr"
    )
    return _first_losses(numbered, width)


def smoothed(points: DataFrame, window: int = 10) -> DataFrame:
    """Trailing mean of the losses in step order; the first ``window - 1`` stay raw."""
    groups = ["file", "stage"]
    placed = totals_by_key(pin(points), {"place": F.lit(1)}, "step", groups)
    return trailing_mean(placed, "loss", "place", groups, window, "smoothed").drop("place")


def stage_summary(points: DataFrame) -> DataFrame:
    """Steps, range and losses of each stage; the lowest loss goes to its first step."""
    found = points.groupBy("file", "stage").agg(
        F.count("*").alias("steps"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.min("loss").alias("min_loss"),
        F.min_by("step", F.struct("loss", "step")).alias("min_loss_step"),
        F.max("loss").alias("max_loss"),
    )
    drop = (F.col("first_loss") - F.col("last_loss")) / F.col("first_loss") * 100
    return found.withColumn("improvement", F.when(F.col("first_loss") > 0, drop))


def progress_rates(examples: DataFrame, every: int, key: str) -> DataFrame:
    """Examples, tokens and tokens per second at every ``every``-th written example."""
    ran = totals_by_key(
        examples, {"_tokens": F.col("n_tokens"), "_examples": F.lit(1)}, key
    )
    at = F.col("_examples") + 1
    tokens = F.col("_tokens") + F.col("n_tokens")
    return ran.filter(at % every == 0).select(
        at.alias("examples"),
        tokens.alias("tokens"),
        F.try_divide(tokens, F.col("elapsed_s")).alias("tokens_per_s"),
    )


def token_budget(runs: DataFrame) -> DataFrame:
    """Tokens seen against twenty per parameter, and the band the ratio falls in."""
    seen = F.col("steps") * F.col("batch") * F.col("seq_len")
    wanted = F.col("parameters") * 20
    ratio = seen / wanted
    band = (
        F.when(ratio > 3, "overtrained").when(ratio > 1.5, "slightly overtrained").otherwise("fine")
    )
    return runs.withColumns({"tokens_seen": seen, "ratio": ratio, "band": band})


def run_curves(points: DataFrame) -> DataFrame:
    """Validation losses and perplexities of every run in step order."""
    return points.orderBy("run_name", "global_step", "checkpoint")
