"""Ordered computations within groups that stay distributed for hot groups.

A window ``PARTITION BY key ORDER BY ...`` sorts a whole group in one task;
when one key holds a large share of the rows that task becomes the job. Here
rows are dealt into ranges of (keys, order columns) instead, as many as the
session has shuffle partitions, so small groups share a range and a large one
goes over several. Windows run within (range, group); what a group brings from
earlier ranges comes from a table with a row for each range that a group
crosses into, which is never larger than the number of ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART = "__part"


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating nulls as equal; keeps one copy of the keys."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on_keys needs at least one key")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def in_ranges(t: DataFrame, keys, order_cols, ranges: int | None = None) -> DataFrame:
    """``t`` dealt into ranges of (keys, order columns), with the number of its
    range in ``__part``; written once to the shared checkpoint folder, since
    several branches read it. Rows equal in all these columns share a range."""
    n = ranges or int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in [*keys, *order_cols]]
    return cut_lineage(t.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id()))


def _crossing(per_range: DataFrame, keys) -> DataFrame:
    """Adds ``__ranges``, the number of ranges a group is in, and keeps groups in
    more than one: at most two rows for each range, so it may be broadcast."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return per_range.withColumn("__ranges", F.count(F.lit(1)).over(w)).where("__ranges > 1")


def _earlier(keys):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(PART)


def prefix_sum(t: DataFrame, keys, order_cols, value_cols, inclusive: bool = True,
               with_totals: bool = False, ranges: int | None = None) -> DataFrame:
    """Running sums ``cum_<v>`` of ``value_cols`` in ``order_cols`` order per group
    (and the group totals ``tot_<v>`` when ``with_totals``).

    Rows tied on all order columns are ordered arbitrarily, as in a ROWS
    window; give a unique tie-breaker for a deterministic result.
    """
    keys = list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    tb = in_ranges(t, keys, order_cols, ranges)
    sums = tb.groupBy(PART, *keys).agg(*[F.sum(v).alias(f"__s_{v}") for v in value_cols])
    before = _earlier(keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carry = _crossing(sums, keys).select(
        PART, *keys, *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__before_{v}") for v in value_cols],
        *[(F.sum(f"__s_{v}").over(whole) - F.coalesce(F.col(f"__s_{v}"), F.lit(0))).alias(f"__others_{v}")
          for v in value_cols if with_totals])
    own = Window.partitionBy(PART, *keys)
    upto = own.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = tb.select("*", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"__in_{v}") for v in value_cols],
                    *[F.sum(v).over(own).alias(f"__own_{v}") for v in value_cols if with_totals])
    out = join_on_keys(out, F.broadcast(carry), [PART, *keys], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", plus(f"__in_{v}", f"__before_{v}"))
        if with_totals:
            out = out.withColumn(f"tot_{v}", plus(f"__own_{v}", f"__others_{v}"))
    return out.drop(PART, *[f"__{x}_{v}" for v in value_cols for x in ("in", "before", "own", "others")])


def lag_values(t: DataFrame, keys, order_cols, value_cols, ranges: int | None = None) -> DataFrame:
    """``prev_<v>``: the value of the previous row in order within each group.

    Within a range it is a plain ``lag``; the first row of a group in a range
    takes the group's last row of the nearest earlier range.
    """
    keys = list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    tb = in_ranges(t, keys, order_cols, ranges)
    own = Window.partitionBy(PART, *keys).orderBy(*order_cols)
    values = F.struct(*[F.col(v) for v in value_cols])
    ends = tb.groupBy(PART, *keys).agg(F.max_by(values, F.struct(*[F.col(c) for c in order_cols])).alias("__last"))
    carry = _crossing(ends, keys).select(PART, *keys, F.lag("__last").over(_earlier(keys)).alias("__edge"))
    out = join_on_keys(tb.select("*", F.row_number().over(own).alias("__rn"), F.lag(values).over(own).alias("__lag")),
                       F.broadcast(carry), [PART, *keys], "left")
    prev = F.when(F.col("__rn") == 1, F.col("__edge")).otherwise(F.col("__lag"))
    return out.withColumn("__prev", prev).select(
        *t.columns, *[F.col("__prev")[v].alias(f"prev_{v}") for v in value_cols])


def as_of(rows: DataFrame, at_col: str, others: DataFrame, ts_col: str, keys, value_cols=(),
          ranges: int | None = None) -> DataFrame:
    """Each row of ``rows`` with its neighbours in time among ``others`` of the same
    keys: structs ``before`` (the last at or before ``at_col``) and ``after`` (the
    first later than it) of ``ts_col`` and ``value_cols``, null where there is none.

    Both sides are merged and dealt into ranges of (keys, time), so no pairs are made,
    whatever the number of times asked for, and a hot key goes over several ranges.
    The others nearest across the edge of a range come from a table with at most two
    rows for each range (keep ``value_cols`` narrow). Of others at one time, ``before``
    takes the greatest values and ``after`` the least. Null keys meet null keys; a row
    without a time has no neighbours; others without a time are nobody's.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    key_cols = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    left = rows.select(*key_cols, F.col(f"`{at_col}`").alias("__at"), F.lit(True).alias("__asks"),
                       F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    right = others.select(*key_cols, F.col(f"`{ts_col}`").alias("__at"), F.lit(False).alias("__asks"),
                          F.struct(*[F.col(f"`{c}`") for c in (ts_col, *value_cols)]).alias("__own"))
    tb = in_ranges(left.unionByName(right.where("__at is not null"), allowMissingColumns=True), names, ["__at"], ranges)
    ends = tb.groupBy(PART, *names).agg(F.min("__own").alias("__first"), F.max("__own").alias("__last"))
    edge = _earlier(names)
    carry = _crossing(ends, names).select(
        PART, *names, F.last("__last", True).over(edge.rowsBetween(Window.unboundedPreceding, -1)).alias("__from"),
        F.last("__first", True).over(edge.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)).alias("__to"))
    own = Window.partitionBy(PART, *names)
    # in both directions a running value; others of a row's own time stand before it and are not after it
    out = tb.select(PART, *names, "__at", "__asks", "__row",
                    F.max("__own").over(own.orderBy("__at", "__asks")).alias("__b"),
                    F.min("__own").over(own.orderBy(F.desc("__at"), F.desc("__asks"))).alias("__a")).where("__asks")
    out = join_on_keys(out, F.broadcast(carry), [PART, *names], "left")
    timed = F.col("__at").isNotNull()
    return out.select("__row.*", F.when(timed, F.coalesce("__b", "__from")).alias("before"),
                      F.when(timed, F.coalesce("__a", "__to")).alias("after"))


#: Rows of a group's bands up to which one window runs over them; more go over ranges.
WINDOW_ROWS = 2_000_000
#: Groups up to which their bands (two numbers for each quantile) are broadcast.
BROADCAST_GROUPS = 100_000


def exact_quantiles(df: DataFrame, keys, value_col: str, probs, is_table: bool = False,
                    accuracy: int = 10_000, window_rows: int = WINDOW_ROWS,
                    broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Exact p-quantiles per group with linear interpolation between the
    values at ranks floor((n-1)p) and ceil((n-1)p) (the definition of
    ``percentile`` / ``quantile_cont``).

    By selection in two passes: a sketch of each group bounds every wanted rank by
    a narrow band of values (ten times the sketch's rank error to either side);
    then what lies between bands is only counted, and only the values inside are
    put in order. No group is sorted and no task keeps its values. The values are
    written to the shared folder first, unless ``is_table`` says they already are.
    Returns keys, ``n``, ``quantiles`` and ``above`` (rows above each quantile),
    arrays in ``probs`` order; null values are ignored, groups without values absent.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    t = df.select(*keys, F.col(value_col).cast("double").alias("__v")).where("__v is not null")
    t = t if is_table else cut_lineage(t)
    margin = 10 / accuracy
    marks = F.array(*[F.lit(x) for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))])
    everything = F.array(*[F.lit(x) for _ in probs for x in (float("-inf"), float("inf"))])
    bands = t.groupBy(*keys).agg(F.when(F.count(F.lit(1)) * margin < 2, everything).otherwise(  # less than two ranks wide
        F.percentile_approx("__v", marks, accuracy)).alias("__q"))
    if keys:  # a row for each group: sent to the values where they are few, so no group's values go to one task
        bands = cut_lineage(bands)
        t = join_on_keys(t, F.broadcast(bands) if bands.count() <= broadcast_groups else bands, keys)
    else:
        t = t.withColumn("__q", F.lit(bands.first()["__q"]).cast("array<double>"))  # two numbers for each p
    v, ends = F.col("__v"), [(F.col("__q")[2 * i], F.col("__q")[2 * i + 1]) for i in range(len(probs))]
    inside = reduce(lambda x, y: x | y, [(v >= lo) & (v <= hi) for lo, hi in ends])
    passed = reduce(lambda x, y: x + y, [F.when(v > hi, 1).otherwise(0) for _, hi in ends])
    few = cut_lineage(t.groupBy(*keys, passed.alias("__passed"), F.when(inside, v).alias("__v")).agg(F.count(F.lit(1)).alias("__c")))

    order = ["__passed", "__v"]  # what is only counted (null) comes before the band it lies below
    if few.count() <= window_rows:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        ps = few.withColumn("cum___c", F.sum("__c").over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        ps = ps.withColumn("tot___c", F.sum("__c").over(whole))
    else:
        ps = prefix_sum(few, keys, order, ["__c"], with_totals=True)
    n, upto = F.col("tot___c"), F.col("cum___c")
    aggs = [F.max(n).alias("n")]
    for i, p in enumerate(probs):
        pos = (n - 1).cast("double") * F.lit(p)
        for name, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (upto - F.col("__c") <= rank) & (rank < upto)
            aggs.append(F.max(F.when(here, F.struct(F.col("__v").alias("v"), (n - upto).alias("above")))).alias(f"__{name}{i}"))
        aggs.append(F.max(pos).alias(f"__pos{i}"))
    g = ps.groupBy(*keys).agg(*aggs)
    quantiles, above = [], []
    for i, _ in enumerate(probs):
        pos, lo, hi = F.col(f"__pos{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outside = F.raise_error(F.lit("a quantile lies outside the band of its sketch")).cast("double")
        low, high = (F.when(x["v"].isNull(), outside).otherwise(x["v"]) for x in (lo, hi))
        q = F.when(F.floor(pos) == F.ceil(pos), low).otherwise(low + (pos - F.floor(pos)) * (high - low))
        quantiles.append(q)
        above.append(F.when(q >= high, hi["above"]).otherwise(lo["above"]))
    return g.where("n > 0").select(*keys, "n", F.array(*quantiles).alias("quantiles"), F.array(*above).alias("above"))
