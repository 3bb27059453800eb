"""Monthly backtest summary and dashboard tables.

The reference scans the data once per target and runs three aggregations
each; here one two-stage aggregate covers every target: stage 1 sums all
targets per (month, horizon) (partial aggregation before the shuffle),
stage 2 works on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtest import TARGETS, apply_row_filter


def monthly_summary(df: DataFrame, targets=TARGETS, full_horizon: int = 28,
                    stmt_col: str = "statement_month", horizon_col: str = "horizon",
                    row_filter: str | None = None) -> DataFrame:
    """Per statement month the max horizon, completeness flag and
    per target MPE/AMPE in percent (flow: sum over horizons; stock: mean of
    the per-horizon portfolio sums), plus the negative-prediction flag for
    stock targets."""
    df = apply_row_filter(df, row_filter)
    stage1 = df.groupBy(F.col(stmt_col).alias("statement_month"), F.col(horizon_col).alias("horizon")).agg(
        *[F.sum(t.actual).alias(f"{t.name}__a") for t in targets],
        *[F.sum(t.predicted).alias(f"{t.name}__p") for t in targets])
    aggs = [F.max("horizon").alias("max_horizon")]
    for t in targets:
        for side in ("a", "p"):
            c = F.col(f"{t.name}__{side}")
            if t.metric_type == "flow":
                v = F.sum(c).cast("double")
            else:
                v = F.sum(c).cast("double") / F.count(c)
            aggs.append(v.alias(f"{t.name}__{side}"))
    stage2 = stage1.groupBy("statement_month").agg(*aggs)
    cols = [F.col("statement_month"), F.col("max_horizon"),
            (F.col("max_horizon") >= full_horizon).alias("complete")]
    for t in targets:
        a, p = F.col(f"{t.name}__a"), F.col(f"{t.name}__p")
        mpe = F.when(a != 0, (p - a) / a * 100)
        cols += [mpe.alias(f"{t.name}_mpe"), F.abs(mpe).alias(f"{t.name}_ampe")]
        if t.metric_type == "stock":
            cols.append((p < 0).alias(f"{t.name}_pred_negative"))
    return stage2.select(*cols).orderBy("statement_month")


def mean_errors_by_target(summary: DataFrame, targets=TARGETS) -> DataFrame:
    """Mean MPE and mean AMPE per target across months (unpivot + avg)."""
    long = summary.select(F.inline(F.array(*[
        F.struct(F.lit(t.name).alias("target"), F.col(f"{t.name}_mpe").alias("mpe"),
                 F.col(f"{t.name}_ampe").alias("ampe")) for t in targets])))
    return long.groupBy("target").agg(F.avg("mpe").alias("mean_MPE"), F.avg("ampe").alias("mean_AMPE"))


def negative_prediction_months(summary: DataFrame, targets=TARGETS) -> DataFrame:
    """Months where any stock target's portfolio prediction is negative."""
    flags = [f"{t.name}_pred_negative" for t in targets if t.metric_type == "stock"]
    if not flags:
        raise ValueError("no stock targets")
    cond = F.lit(False)
    for f in flags:
        cond = cond | F.coalesce(F.col(f), F.lit(False))
    return summary.where(cond).select(F.date_format("statement_month", "yyyy-MM").alias("statement_month"), *flags)


def ampe_flag_months(summary: DataFrame, threshold: float = 10.0, targets=TARGETS) -> DataFrame:
    """A33 (+F12): months with any target AMPE above ``threshold`` and the
    flags as text ``"Name: 12.34%"`` joined by ``",  "``."""
    parts = [F.when(F.col(f"{t.name}_ampe") > threshold,
                    F.concat(F.lit(f"{t.name}: "), F.format_string("%.2f", F.col(f"{t.name}_ampe")), F.lit("%")))
             for t in targets]
    flags = F.array_compact(F.array(*parts))
    return (summary.select(F.date_format("statement_month", "yyyy-MM").alias("statement_month"),
                           flags.alias("_f"))
            .where(F.size("_f") > 0)
            .select("statement_month", F.array_join("_f", ",  ").alias("ampe_flags")))
