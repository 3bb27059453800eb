"""Running run monitor and step display as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.traces import step_messages


def monitor_stream(steps: DataFrame) -> DataFrame:
    """ST2: per run step count, token totals and total duration, updated as
    steps arrive (streaming aggregate; use outputMode update)."""
    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.sum("duration").alias("total_duration"))


def display_stream(steps: DataFrame, summary_mode: bool = False) -> DataFrame:
    """ST3: chat messages for each finished step, stateless (append mode)."""
    return step_messages(steps, summary_mode)
