"""Forecast backtest aggregation.

``aggregate`` groups actual vs predicted by one dimension (statement month,
vintage, horizon, performance month or feature bins) as flow (sum over all
horizons) or stock (only rows at the last horizon of their statement month)
and adds the group-level error columns. Everything stays one lazy plan; the
only driver round trip is the list of bin edges (at most n+1 numbers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import exact_quantiles

DIMENSIONS = ("statement_month", "vintage", "horizon", "performance_month", "feature_bins")
VINTAGE_PERIODS = {"year": "YEAR", "quarter": "QUARTER", "month": "MONTH"}


@dataclass(frozen=True)
class Target:
    """An (actual, predicted) column pair and whether it is a flow or a stock."""
    name: str
    actual: str
    predicted: str
    metric_type: str = "flow"  # "flow" | "stock"


# Targets of the backtest fixture (fixed values, mirroring the reference config).
TARGETS = (
    Target("Payment", "actual_payment", "predicted_payment", "flow"),
    Target("PurchaseVolume", "actual_purchase_volume", "predicted_purchase_volume", "flow"),
    Target("EOS", "actual_eos", "predicted_eos", "stock"),
)


def require_columns(df: DataFrame, needed) -> None:
    """Schema guard listing the missing and the available columns."""
    missing = [c for c in needed if c and c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in the frame, which has {df.columns}")


def column_check(df: DataFrame, needed) -> DataFrame:
    """S12 as a table: of each needed column whether it is there and, if so, how
    many rows have a value, from one pass over those columns."""
    there = [c for c in needed if c in df.columns]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in there], F.count(F.lit(1)).alias("__rows"))
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(c in there).alias("available"),
        (F.col(c) if c in there else F.lit(None)).cast("long").alias("n_values"), F.col("__rows").alias("n_rows"))
        for c in needed])))


def apply_row_filter(df: DataFrame, row_filter: str | None) -> DataFrame:
    """Optional SQL predicate applied before any projection or aggregation.

    Empty means no filter; a bad expression raises AnalysisException when the
    plan is analysed. Being a plain Catalyst filter it is pushed into the scan.
    """
    if row_filter is None or not row_filter.strip():
        return df
    return df.filter(F.expr(row_filter))


def default_row_filter(horizon_max: int, before: str, after: str) -> str:
    """``horizon <= H and ((stmt <= D1 and perf <= D1) or stmt >= D2)``."""
    return (f"horizon <= {int(horizon_max)} and ((statement_month <= DATE'{before}' and "
            f"performance_month <= DATE'{before}') or statement_month >= DATE'{after}')")


def available_months(df: DataFrame, month_col: str = "statement_month", n: int = 5) -> DataFrame:
    """First and last ``n`` distinct months, for the empty-result message.

    Distinct months are few (one per calendar month), so both ends are cheap
    top-n sorts over the distinct set.
    """
    months = df.select(F.trunc(F.col(month_col), "MONTH").alias("month")).where("month IS NOT NULL").distinct()
    first = months.orderBy(F.col("month").asc()).limit(n).withColumn("end", F.lit("first"))
    last = months.orderBy(F.col("month").desc()).limit(n).withColumn("end", F.lit("last"))
    return first.unionByName(last)


def stock_filter(df: DataFrame, stmt_col: str = "statement_month", horizon_col: str = "horizon") -> DataFrame:
    """Keep rows at the max horizon of their statement month.

    The per-month max is a small aggregate, which Spark broadcasts when its size
    allows. Null months and horizons drop out (null never equals null), as in the
    reference. Sums over stock rows do not need this join (``aggregate``).
    """
    last = df.groupBy(F.col(stmt_col).alias("_m")).agg(F.max(horizon_col).alias("_max_h"))
    return (df.join(last, (F.col(stmt_col) == F.col("_m")) & (F.col(horizon_col) == F.col("_max_h")), "inner")
            .drop("_m", "_max_h"))


def _stock_sums(df: DataFrame, keys, sums: dict, stmt_col: str, horizon_col: str) -> DataFrame:
    """Sums by ``keys`` of the rows at the max horizon of their statement month:
    the facts are summed by (month, horizon, keys) once, and the horizons are
    picked on that small table."""
    names = [f"_k{i}" for i in range(len(keys))]
    outer = df.select(*keys, F.col(stmt_col).alias("_m"), F.col(horizon_col).alias("_h"), *sums).toDF(
        *names, "_m", "_h", *sums)
    small = cut_lineage(outer.where("_m is not null and _h is not null").groupBy(*names, "_m", "_h").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_rows")))
    last = small.groupBy("_m").agg(F.max("_h").alias("_h"))
    return small.join(last, ["_m", "_h"]).groupBy(*names).agg(
        *[_sum_as_double(c).alias(name) for c, name in sums.items()], F.sum("n_rows").alias("n_rows"))


# ---------------------------------------------------------------- feature bins

def quantile_edges(df: DataFrame, feature: str, n_bins: int, exact: bool = True,
                   accuracy: int = 10000, is_table: bool = False) -> list[float]:
    """A6 edges: quantiles at i/n (linear interpolation), duplicates dropped.

    One aggregate returns n+1 numbers to the driver. ``exact=False`` switches
    to ``percentile_approx`` which keeps a bounded sketch per partition instead
    of a value map (use it when the feature has very many distinct values).
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    x = F.col(feature).cast("double")
    if exact:
        # distributed exact selection (no value map of the whole column in one task)
        row = exact_quantiles(df, [], feature, probs, is_table).select(F.col("quantiles").alias("q")).first()
    else:
        row = df.where(x.isNotNull()).agg(
            F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy).alias("q")).first()
    if row is None or row["q"] is None:
        raise ValueError(f"every value of {feature!r} is null: no bins can be made")
    edges: list[float] = []
    for v in row["q"]:
        if not edges or v != edges[-1]:
            edges.append(float(v))
    if len(edges) < 2:
        raise ValueError(f"the values of {feature!r} give fewer than two distinct edges")
    return edges


def width_edges(df: DataFrame, feature: str, n_bins: int) -> list[float]:
    """A7 edges: min/max in one aggregate, n equal-width bins between them."""
    x = F.col(feature).cast("double")
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"every value of {feature!r} is null: no bins can be made")
    lo, hi = float(row["lo"]), float(row["hi"])
    return [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]


def _count_below(x: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x > F.lit(e), 1).otherwise(0)
    return out


def bin_index(x: Column, method: str, edges: list[float]) -> Column:
    """1-based bin index of ``x``; right-closed bins, lowest value included.

    quantile/width: edges e0 < ... < em, bin k = (e_{k-1}, e_k], e0 in bin 1.
    thresholds: (-inf, t1], (t1, t2], ... (tn, +inf) -> bins 1..n+1.
    Nulls get a null index (their own "nan" group).
    """
    x = x.cast("double")
    if method == "thresholds":
        idx = F.lit(1) + _count_below(x, edges)
    else:
        idx = F.greatest(F.lit(1), _count_below(x, edges))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(idx.cast("int"))


def bin_bounds(idx: Column, method: str, edges: list[float]) -> tuple[Column, Column]:
    """Lower/upper bound of a bin index (infinite ends for threshold bins)."""
    if method == "thresholds":
        lows = [float("-inf")] + edges
        highs = edges + [float("inf")]
    else:
        lows, highs = edges[:-1], edges[1:]
    # explicit null guard: element_at over a literal array with a null index
    # does not return null in every Spark version
    lo = F.when(idx.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in lows]), idx))
    hi = F.when(idx.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in highs]), idx))
    return lo, hi


def feature_bin_edges(df: DataFrame, feature: str, method: str = "quantile", n_bins: int = 5,
                      thresholds: list[float] | None = None, exact: bool = True,
                      is_table: bool = False) -> tuple[str, list[float]]:
    """Pick A6/A7/A8 and return (method, edges); ``is_table``: reading ``df`` again costs a scan only."""
    if thresholds:
        return "thresholds", sorted(set(float(t) for t in thresholds))
    if method == "quantile":
        return "quantile", quantile_edges(df, feature, n_bins, exact=exact, is_table=is_table)
    if method in ("width", "equal_width", "uniform"):
        return "width", width_edges(df, feature, n_bins)
    raise ValueError(f"unknown bin method {method!r}")


# ------------------------------------------------------------------ aggregation

def group_metrics(agg: DataFrame, level: str = "portfolio") -> DataFrame:
    """A11 + A12 on aggregated sums: per-account values, plot columns, MPE, AMPE."""
    n = F.col("n_rows")
    per_a = F.col("total_actual") / n
    per_p = F.col("total_predicted") / n
    out = agg.withColumn("per_account_actual", per_a).withColumn("per_account_predicted", per_p)
    if level == "account":
        pa, pp = F.col("per_account_actual"), F.col("per_account_predicted")
    elif level == "portfolio":
        pa, pp = F.col("total_actual"), F.col("total_predicted")
    else:
        raise ValueError("level must be 'portfolio' or 'account'")
    out = out.withColumn("plot_actual", pa).withColumn("plot_predicted", pp)
    mpe = F.when(F.col("plot_actual") != 0,
                 (F.col("plot_predicted") - F.col("plot_actual")) / F.col("plot_actual"))
    return out.withColumn("MPE", mpe).withColumn("AMPE", F.abs(F.col("MPE")))


def _sum_as_double(c: str) -> Column:
    # H4: sum over only nulls is 0 like the reference; decimal sums are exact,
    # the double cast comes last.
    return F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("double")


def dimension_column(df: DataFrame, dimension: str, *, vintage_period: str = "year",
                     vintage_col: str = "origination_date", stmt_col: str = "statement_month",
                     perf_col: str = "performance_month", horizon_col: str = "horizon",
                     feature: str | None = None, bin_method: str = "quantile", n_bins: int = 5,
                     thresholds: list[float] | None = None, exact_bins: bool = True, is_table: bool = False):
    """(grouping columns, output name) for a dimension."""
    if dimension == "statement_month":
        return [F.trunc(F.col(stmt_col), "MONTH").alias("statement_month")], None
    if dimension == "vintage":
        unit = VINTAGE_PERIODS.get(vintage_period, "YEAR")  # unknown period -> year (A3)
        period = vintage_period if vintage_period in VINTAGE_PERIODS else "year"
        return [F.trunc(F.col(vintage_col), unit).alias(f"vintage_{period}")], None
    if dimension == "horizon":
        return [F.col(horizon_col).alias(horizon_col)], None
    if dimension == "performance_month":
        return [F.trunc(F.col(perf_col), "MONTH").alias("performance_month")], None
    if dimension == "feature_bins":
        if not feature:
            raise ValueError("feature_bins needs a feature column")
        method, edges = feature_bin_edges(df, feature, bin_method, n_bins, thresholds, exact_bins, is_table)
        return [bin_index(F.col(feature), method, edges).alias("bin_idx")], (method, edges)
    raise ValueError(f"dimension must be one of {DIMENSIONS}")


def aggregate(df: DataFrame, actual: str, predicted: str, dimension: str = "statement_month",
              metric_type: str = "flow", level: str = "portfolio", row_filter: str | None = None,
              **dim_opts) -> DataFrame:
    """Group sums, row counts and group-level error metrics, sorted by group.

    Plan shape: scan (pruned + pushed filter) -> partial hash aggregate -> one
    shuffle on the group key -> final aggregate [stock: by month and horizon
    first, and the last horizon of each month from that].
    """
    require_columns(df, [actual, predicted])
    df = apply_row_filter(df, row_filter)
    if metric_type not in ("flow", "stock"):
        raise ValueError("metric_type must be 'flow' or 'stock'")
    stmt_col, horizon_col = dim_opts.get("stmt_col", "statement_month"), dim_opts.get("horizon_col", "horizon")
    if metric_type == "stock" and dimension == "feature_bins":
        df = stock_filter(df, stmt_col, horizon_col)  # the edges are those of the stock rows
    feature = dim_opts.get("feature")
    by_rank = dimension == "feature_bins" and feature and not dim_opts.get("thresholds") and dim_opts.get("bin_method", "quantile") == "quantile"
    if by_rank:  # read by the sketch, the bands and the bins: joined once
        df = cut_lineage(df.select(*dict.fromkeys([feature, actual, predicted])))
    keys, bins = dimension_column(df, dimension, is_table=bool(by_rank), **dim_opts)
    if metric_type == "stock" and bins is None:
        name = df.select(*keys).columns
        agg = _stock_sums(df, keys, {actual: "total_actual", predicted: "total_predicted"}, stmt_col, horizon_col)
        agg = agg.withColumnsRenamed({f"_k{i}": n for i, n in enumerate(name)})
    else:
        agg = df.groupBy(*keys).agg(
            _sum_as_double(actual).alias("total_actual"),
            _sum_as_double(predicted).alias("total_predicted"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    if bins is not None:
        lo, hi = bin_bounds(F.col("bin_idx"), *bins)
        agg = agg.withColumn("bin_lower", lo).withColumn("bin_upper", hi)
    out = group_metrics(agg, level)
    key_name = "bin_idx" if bins is not None else out.columns[0]
    return out.orderBy(F.col(key_name).asc_nulls_first())


def result_summary(agg: DataFrame, group_col: str) -> DataFrame:
    """Group count, first/last group, mean MPE and mean AMPE (one row)."""
    return agg.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min(group_col).alias("first_group"),
        F.max(group_col).alias("last_group"),
        F.avg("MPE").alias("mean_MPE"),
        F.avg("AMPE").alias("mean_AMPE"),
    )


# ---------------------------------------------------------------- distribution

def distribution(df: DataFrame, actual: str, predicted: str, dimension: str = "statement_month",
                 metric_type: str = "flow", account_col: str = "account_id",
                 row_filter: str | None = None, **dim_opts) -> DataFrame:
    """One row per account per dimension value with row-level MPE/AMPE.

    Flow sums an account's horizons; stock first keeps the max horizon of
    each statement month. Rows with undefined MPE (actual 0) are dropped. The
    shuffle is on (dimension, account), so no single month lands on one task.
    """
    require_columns(df, [actual, predicted, account_col])
    df = apply_row_filter(df, row_filter)
    if metric_type == "stock":
        df = stock_filter(df, dim_opts.get("stmt_col", "statement_month"), dim_opts.get("horizon_col", "horizon"))
    keys, _ = dimension_column(df, dimension, **dim_opts)
    agg = df.groupBy(*keys, F.col(account_col)).agg(
        _sum_as_double(actual).alias("actual"),
        _sum_as_double(predicted).alias("predicted"),
    )
    mpe = (F.col("predicted") - F.col("actual")) / F.col("actual")
    return (agg.where(F.col("actual") != 0)
            .withColumn("MPE", mpe).withColumn("AMPE", F.abs(F.col("MPE"))))


def distribution_summary(dist: DataFrame, group_col: str) -> DataFrame:
    """Rows, distinct groups, rows per group and median MPE (one row).

    The groups are counted from a distinct projection and the median comes
    from the distributed exact selection; the three one-row results are
    stacked and folded rather than joined."""
    counts = dist.agg(F.count(F.lit(1)).alias("n_rows"))
    groups = dist.select(group_col).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    med = exact_quantiles(dist, [], "MPE", [0.5]).select(F.col("quantiles")[0].alias("median_MPE"))
    parts = counts.unionByName(groups, allowMissingColumns=True).unionByName(med, allowMissingColumns=True)
    folded = parts.agg(F.max("n_rows").alias("n_rows"), F.max("n_groups").alias("n_groups"),
                       F.max("median_MPE").alias("median_MPE"))
    return folded.select("n_rows", "n_groups", (F.col("n_rows") / F.col("n_groups")).alias("rows_per_group"),
                         "median_MPE")
