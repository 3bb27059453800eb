"""Data-quality invariants of backtest facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balance_rollforward_breaks(df: DataFrame, account_col: str = "account_id",
                               stmt_col: str = "statement_month", horizon_col: str = "horizon",
                               eos: str = "actual_eos", purchases: str = "actual_purchase_volume",
                               payments: str = "actual_payment") -> DataFrame:
    """eos_h must equal max(eos_{h-1} + purchases_h - payments_h, 0) per
    account x statement month. Facts are first summed per (account, month,
    horizon); the lag window is partitioned by (account, month), so a window
    holds at most one row per horizon. Returns one row per checked step."""
    g = df.groupBy(account_col, stmt_col, horizon_col).agg(
        F.sum(eos).alias("eos"), F.sum(purchases).alias("purchases"), F.sum(payments).alias("payments"))
    w = Window.partitionBy(account_col, stmt_col).orderBy(horizon_col)
    # a step is checked against the horizon just before it, not against one across a gap
    prev = F.when(F.lag(horizon_col).over(w) == F.col(horizon_col) - 1, F.lag("eos").over(w))
    # (``greatest`` skips nulls, so the guard is explicit)
    expected = F.when(prev.isNotNull(), F.greatest(prev + F.col("purchases") - F.col("payments"), F.lit(0)))
    out = g.select(account_col, stmt_col, horizon_col, "eos", expected.alias("expected_eos"))
    return out.where(F.col("expected_eos").isNotNull()).withColumn(
        "is_break", F.col("eos") != F.col("expected_eos"))


def rollforward_summary(checks: DataFrame, stmt_col: str = "statement_month") -> DataFrame:
    """W6 report: checked steps and breaks per statement month."""
    return checks.groupBy(stmt_col).agg(F.count(F.lit(1)).alias("n_checked"),
                                        F.sum(F.col("is_break").cast("int")).alias("n_breaks"))


def static_feature_violations(df: DataFrame, features, account_col: str = "account_id",
                              stmt_col: str = "statement_month") -> DataFrame:
    """(account, month, feature) with more than one distinct value."""
    aggs = [F.count_distinct(f).alias(f) for f in features]
    g = df.groupBy(account_col, stmt_col).agg(*aggs)
    long = g.select(account_col, stmt_col, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("n_distinct")) for f in features])))
    return long.where(F.col("n_distinct") > 1)
