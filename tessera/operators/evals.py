"""Answer evaluation tables.

Input is an answers frame scored by ``with_answer_scores`` (``is_correct``,
``is_near_correct``). "First" always means first by an explicit order
column (H14); per-key picks use ``min_by``/``max_by`` aggregates, which
combine partially before the shuffle, so a question or agent holding a
large share of the rows never lands whole on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import NON_ANSWERS
from .ordered import prefix_sum

# Fixed values that must equal the reference's: attachment classes by extension.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")
DOCUMENT_EXTENSIONS = ("pdf", "xls", "xlsx", "docx", "doc", "xml")
AUDIO_EXTENSIONS = ("mp3", "m4a", "wav")
# Error types counted per run.
ERROR_TYPES = ("AgentParsingError", "AgentExecutionError", "AgentMaxIterationsError", "AgentGenerationError")


def first_per_key(df: DataFrame, keys, order: str) -> DataFrame:
    """Keep the first row per key by ``order`` (drop_duplicates keep first)."""
    cols = [c for c in df.columns]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_r"))
    return picked.select("_r.*")


def duration_seconds(start: str, end: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """whole seconds between two timestamp strings."""
    return (F.unix_timestamp(F.col(end), fmt) - F.unix_timestamp(F.col(start), fmt)).cast("int")


def parse_subset_name(name) -> list[Column]:
    """``org__model__action__task`` -> model "org/model", action, task."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, "__")
    n = F.size(parts)
    model = F.array_join(F.slice(parts, F.lit(1), n - 2), "/")
    return [model.alias("model_id"), F.element_at(parts, -2).alias("agent_action_type"),
            F.element_at(parts, -1).alias("task")]


def file_extension(path) -> Column:
    """text after the last dot."""
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, r"\."), -1)


def attachment_class(path) -> Column:
    """image / document / audio / other by extension; empty -> none."""
    p = F.col(path) if isinstance(path, str) else path
    ext = file_extension(p)
    return (F.when(p.isNull() | (p == ""), F.lit("none"))
            .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
            .when(ext.isin(*DOCUMENT_EXTENSIONS), F.lit("document"))
            .when(ext.isin(*AUDIO_EXTENSIONS), F.lit("audio"))
            .otherwise(F.lit("other")))


def accuracy_by_subset(scored: DataFrame, keys=("model_id", "agent_action_type", "source"),
                       min_scored: int = 30) -> DataFrame:
    """Accuracy x100 per subset, to two digits; subsets with <= ``min_scored``
    scored answers are dropped."""
    return (scored.groupBy(*keys)
            .agg(F.round(F.avg(F.col("is_correct").cast("double")) * 100, 2).alias("acc"),
                 F.count("is_correct").alias("n_scored"))
            .where(F.col("n_scored") > min_scored))


def accuracy_pivot(acc: DataFrame) -> DataFrame:
    """Rows (model, source), one accuracy column per action type that is there."""
    values = sorted(r[0] for r in acc.select("agent_action_type").distinct().collect())  # column names
    return acc.groupBy("model_id", "source").agg(*[
        F.max(F.when(F.col("agent_action_type") == v, F.col("acc"))).alias("acc_" + v.replace("-", "_")) for v in values])


def answer_counts(scored: DataFrame, order: str = "task_id"):
    """Answers per agent, and per (agent, task) after W2 dedupe."""
    per_agent = scored.groupBy("agent_name").agg(F.count(F.lit(1)).alias("n_answers"))
    dedup = first_per_key(scored, ["agent_name", "question"], order)
    return per_agent, dedup.groupBy("agent_name", "task").agg(F.count(F.lit(1)).alias("n_answers"))


def completeness(scored: DataFrame, expected_total: int) -> DataFrame:
    """Number of answers, one per (agent, question), and whether all are there."""
    total = scored.select("agent_name", "question").distinct().agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", (F.col("total") == expected_total).alias("is_complete"))


def mean_score_by_agent(scored: DataFrame) -> DataFrame:
    """Mean score of each agent, to three digits."""
    return scored.groupBy("agent_name").agg(F.round(F.avg(F.col("is_correct").cast("double")), 3).alias("mean_is_correct"))


def agent_task_table(scored: DataFrame) -> DataFrame:
    """A39 (+A41, F9): per (agent, task) mean correct, near-correct, steps,
    duration and the answer count."""
    df = scored.withColumn("count_steps", F.size("intermediate_steps")) \
               .withColumn("duration", duration_seconds("start_time", "end_time"))
    return df.groupBy("agent_name", "task").agg(
        F.avg(F.col("is_correct").cast("double")).alias("is_correct"),
        F.avg(F.col("is_near_correct").cast("double")).alias("is_near_correct"),
        F.avg("count_steps").alias("count_steps"),
        F.count("question").alias("count"),
        F.avg("duration").alias("duration"))


def error_counts_by_correctness(scored: DataFrame, error_types=ERROR_TYPES) -> DataFrame:
    """Count errors by type per run from the nested steps (no explode),
    average per correctness, melted to (is_correct, variable, value)."""
    steps = F.col("intermediate_steps")
    cols = [F.size(F.filter(steps, lambda s: s["error_type"] == e)).alias(e) for e in error_types]
    per_run = scored.select("is_correct", *cols, F.size(steps).alias("Count steps"))
    names = list(error_types) + ["Count steps"]
    means = per_run.groupBy("is_correct").agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return means.select("is_correct", F.inline(F.array(*[
        F.struct(F.lit(n).alias("variable"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])))


TOOL_CALL_PATTERN = r"\b(\w+)\("


def tool_call_counts(scored: DataFrame, keys=("agent_name",), text_field: str = "llm_output") -> DataFrame:
    """Function-call names (lower-case only) found in the step outputs,
    counted per key."""
    calls = scored.select(*keys, F.explode(F.flatten(F.transform(
        F.col("intermediate_steps"),
        lambda s: F.regexp_extract_all(F.coalesce(s[text_field], F.lit("")), F.lit(TOOL_CALL_PATTERN), 1)))).alias("tool"))
    lower_only = (F.col("tool") == F.lower("tool")) & (F.col("tool") != F.upper("tool"))
    return calls.where(lower_only).groupBy(*keys, "tool").agg(F.count(F.lit(1)).alias("n_calls"))


def exclude_non_answers(df: DataFrame, col: str = "prediction") -> DataFrame:
    """P8."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*NON_ANSWERS))


def majority_vote(scored: DataFrame, order: str = "task_id") -> DataFrame:
    """A43 + J3: most frequent prediction per question (ties -> smallest),
    joined to the first row with that (question, prediction)."""
    df = exclude_non_answers(scored)
    counts = df.groupBy("question", "prediction").agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy("question").agg(
        F.min_by(F.col("prediction"), F.struct((-F.col("_n")).alias("a"), F.col("prediction").alias("b")))
        .alias("prediction"))
    first = df.groupBy("question", "prediction").agg(
        F.min_by(F.struct("task", "is_correct"), F.col(order)).alias("_f"))
    return mode.join(first, ["question", "prediction"], "left").select(
        "question", "prediction", "_f.task", "_f.is_correct")


def oracle_ensemble(scored: DataFrame, order: str = "task_id") -> DataFrame:
    """Per question the first correct row, else the first row."""
    pick = scored.groupBy("question").agg(F.min_by(
        F.struct(F.col(order).alias(order), "agent_name", "prediction", "is_correct"),
        F.struct((~F.col("is_correct")).alias("wrong"), F.col(order).alias("o"))).alias("_r"))
    return pick.select("question", "_r.*")


def ensemble_scores(scored: DataFrame, min_answers: int, order: str = "task_id") -> DataFrame:
    """A38/A43/A44 summary over agents with more than ``min_answers`` answers
    (P9): majority and oracle scores in percent, one row."""
    keep = keep_agents_with_more_than(scored, min_answers)
    maj = majority_vote(keep, order).agg((F.avg(F.col("is_correct").cast("double")) * 100).alias("majority_score"))
    ora = oracle_ensemble(keep, order).agg((F.avg(F.col("is_correct").cast("double")) * 100).alias("oracle_score"))
    # two one-row aggregates side by side: union then fold, no join needed
    return maj.unionByName(ora, allowMissingColumns=True).agg(
        F.max("majority_score").alias("majority_score"), F.max("oracle_score").alias("oracle_score"))


def keep_agents_with_more_than(scored: DataFrame, n: int) -> DataFrame:
    """Rows of agents having more than ``n`` answers (count + left semi)."""
    big = scored.groupBy("agent_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
    return scored.join(big.select("agent_name"), "agent_name", "left_semi")


def expanding_accuracy(scored: DataFrame, order: str = "task_id", label_chars: int = 50) -> DataFrame:
    """Running mean of correctness and running index per agent, with a
    question label of ``label_chars`` characters. Running sums use the
    two-level prefix sum, so one agent's rows are not sorted in one task."""
    t = scored.select("agent_name", order, F.col("is_correct").cast("long").alias("c"), F.lit(1).cast("long").alias("one"),
                      F.substring("question", 1, label_chars).alias("question_label"))
    r = prefix_sum(t, ["agent_name"], order, ["c", "one"], inclusive=True)
    return r.select("agent_name", order, "question_label",
                    F.col("cum_one").alias("running_index"),
                    (F.col("cum_c") / F.col("cum_one")).alias("expanding_accuracy"))


def correct_subset(scored: DataFrame, correct: bool = True) -> DataFrame:
    """P10."""
    return scored.where(F.col("is_correct") == F.lit(correct))


def unanswered_tasks(tasks: DataFrame, answered: DataFrame, key: str = "question",
                     only: DataFrame | None = None) -> DataFrame:
    """J4 resume: tasks whose key has no answer yet (left anti), optionally
    restricted to requested ids (left semi)."""
    todo = tasks.join(answered.select(key).distinct(), key, "left_anti")
    if only is not None:
        todo = todo.join(only.select(key).distinct(), key, "left_semi")
    return todo
