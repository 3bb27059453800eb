"""Chart-ready tables. Drawing is not built; these are
the numbers behind each chart, computed as grouped aggregates.

Means are computed as ``sum / count`` with the sum in the column's own type
(exact for decimals) so results do not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .backtest import bin_bounds, bin_index
from .metrics import MAX_BROADCAST_GROUPS
from .ordered import exact_quantiles


def _mean(c: str):
    return F.sum(F.col(c)).cast("double") / F.count(F.col(c))


def bar_means(df: DataFrame, x: str, ys, hue: str | None = None) -> DataFrame:
    """Mean of each y column per x (and hue), long form with a
    display label per series."""
    keys = [x] + ([hue] if hue else [])
    wide = df.groupBy(*keys).agg(*[_mean(y).alias(y) for y in ys])
    long = wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(y).alias("series"),
                 F.lit(y.replace("_", " ").title()).alias("label"),
                 F.col(y).alias("value")) for y in ys])))
    return long


def trend_long(df: DataFrame, x: str, ys, group: str | None = None) -> DataFrame:
    """Y series over x in long form, sorted; columns whose name holds
    'pred' get a dashed style. Text x values are parsed as dates."""
    xcol = F.col(x)
    if dict(df.dtypes)[x] == "string":
        xcol = F.coalesce(F.try_to_timestamp(F.col(x)).cast("date"), F.lit(None).cast("date"))
    keys = [xcol.alias(x)] + ([F.col(group)] if group else [])
    out = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("value"),
                 F.lit("dashed" if "pred" in y.lower() else "solid").alias("style")) for y in ys])))
    return out.orderBy(*([group] if group else []), x, "series")


def box_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per x the quartiles, whiskers (furthest values within 1.5 IQR of
    the box) and outlier count. Quartiles are one row for each x, which goes to
    all tasks when there are few, so the rows are not shuffled for it."""
    v = F.col(y).cast("double")
    q = exact_quantiles(df, [x], y, [0.25, 0.5, 0.75])
    q = q.select(x, F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
                 F.col("quantiles")[2].alias("q3"))
    lo = F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5
    hi = F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5
    q = cut_lineage(q)
    j = df.select(x, v.alias("_v")).join(F.broadcast(q) if q.count() <= MAX_BROADCAST_GROUPS else q, x)
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return j.groupBy(x, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def correlation_long(df: DataFrame, cols) -> DataFrame:
    """C4: pairwise Pearson correlation (pairwise complete rows) of numeric
    columns in one aggregate, returned as (col_a, col_b, corr)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs]
    row = df.agg(*aggs)
    structs = []
    for a, b in pairs:
        c = F.col(f"{a}__{b}") if a != b else F.lit(1.0)
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), c.alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), c.alias("corr")))
    return row.select(F.inline(F.array(*structs)))


def histogram(df: DataFrame, value: Column | str, n_bins: int = 20) -> DataFrame:
    """Equal-width histogram (right-closed bins like A7) with the count as a
    share of n and width; ``density_curve`` has the curve. min, max and n come from one aggregate."""
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    r = base.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not r["n"]:
        raise ValueError("histogram of an empty column")
    lo_v, hi_v, n = float(r["lo"]), float(r["hi"]), int(r["n"])
    edges = [lo_v + (hi_v - lo_v) * i / n_bins for i in range(n_bins)] + [hi_v]
    h = base.groupBy(bin_index(F.col("_v"), "width", edges).alias("bin_idx")).agg(
        F.count(F.lit(1)).alias("count"))
    lo, hi = bin_bounds(F.col("bin_idx"), "width", edges)
    return (h.withColumn("bin_lower", lo).withColumn("bin_upper", hi)
            .withColumn("density", F.col("count") / (F.lit(float(n)) * (F.col("bin_upper") - F.col("bin_lower"))))
            .orderBy("bin_idx"))


def density_curve(df: DataFrame, value: Column | str, points: int = 100, cells: int = 2048) -> DataFrame:
    """The density curve over a histogram: a Gaussian kernel estimate with
    Scott's bandwidth at ``points`` + 1 places from min to max. Values are counted
    in ``cells`` narrow cells first, so the sum runs over cells, not rows; densities
    are rounded to 1e-9."""
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    r = base.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"),
                 F.stddev_samp("_v").alias("sd")).first()
    if not r["n"] or not r["sd"]:
        raise ValueError("a density needs two different values")
    lo, width, n, h = r["lo"], r["hi"] - r["lo"], r["n"], r["sd"] * r["n"] ** -0.2
    cell = F.least(F.floor((F.col("_v") - lo) / width * cells), F.lit(cells - 1))
    counts = base.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    x = F.lit(lo) + F.lit(width) * F.col("point") / points
    u = (F.col("x") - (F.lit(lo) + F.lit(width) * (F.col("cell") + 0.5) / cells)) / h
    return (counts.select("cell", "c", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("point")).withColumn("x", x)
            .groupBy("point", "x").agg((F.sum(F.col("c") * F.exp(-0.5 * u * u)) / (n * h * F.sqrt(2 * F.pi()))).alias("d"))
            .select("point", "x", F.round("d", 9).alias("density")))


def residuals(agg: DataFrame, key: str, actual: str = "plot_actual", predicted: str = "plot_predicted") -> DataFrame:
    """residual = predicted - actual against predicted, zero line at 0."""
    return agg.select(key, F.col(predicted).alias("predicted"),
                      (F.col(predicted) - F.col(actual)).alias("residual"), F.lit(0.0).alias("zero_line"))


def scatter_with_fit_line(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """(actual, predicted) pairs plus the shared bounds of the perfect-fit
    line. The bounds are one aggregate (two numbers) read back to the driver."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    b = df.agg(F.least(F.min(a), F.min(p)).alias("lo"), F.greatest(F.max(a), F.max(p)).alias("hi")).first()
    return df.select(*keys, F.col(actual).cast("double").alias("actual"),
                     F.col(predicted).cast("double").alias("predicted"),
                     F.lit(b["lo"]).alias("line_lo"), F.lit(b["hi"]).alias("line_hi"))


def segment_report(df: DataFrame, actual: str, predicted: str, segment: str, n_bins: int = 20) -> dict:
    """The full report = scatter (C7), residuals (C6), error histogram
    and segment means (A34), each a DataFrame."""
    return {
        "scatter": scatter_with_fit_line(df, actual, predicted, [segment]),
        "residuals": df.select(segment, F.col(predicted).cast("double").alias("predicted"),
                               (F.col(predicted) - F.col(actual)).cast("double").alias("residual")),
        "error_histogram": histogram(df, (F.col(predicted) - F.col(actual)), n_bins),
        "segment_means": bar_means(df, segment, [actual, predicted]),
    }


def segment_report_long(df: DataFrame, actual: str, predicted: str, segment: str, n_bins: int = 20) -> DataFrame:
    """C8 as one table: (component, segment, x, y) rows of the scatter with
    its fit-line bounds, the residuals, the error histogram and the segment
    means, so a report is one result set."""
    parts = segment_report(df, actual, predicted, segment, n_bins)
    sc = parts["scatter"]
    scatter = sc.select(F.lit("scatter").alias("component"), F.col(segment).cast("string").alias("segment"),
                        F.col("actual").alias("x"), F.col("predicted").alias("y"))
    line = sc.agg(F.max("line_lo").alias("x"), F.max("line_hi").alias("y")).select(
        F.lit("fit_line").alias("component"), F.lit(None).cast("string").alias("segment"), "x", "y")
    resid = parts["residuals"].select(F.lit("residual").alias("component"),
                                      F.col(segment).cast("string").alias("segment"),
                                      F.col("predicted").alias("x"), F.col("residual").alias("y"))
    hist = parts["error_histogram"].select(F.lit("histogram").alias("component"),
                                           F.lit(None).cast("string").alias("segment"),
                                           F.col("bin_lower").alias("x"), F.col("count").cast("double").alias("y"))
    means = parts["segment_means"].select(F.concat(F.lit("mean_"), F.col("series")).alias("component"),
                                          F.col(segment).cast("string").alias("segment"),
                                          F.lit(None).cast("double").alias("x"), F.col("value").alias("y"))
    return scatter.unionByName(line).unionByName(resid).unionByName(hist).unionByName(means)
