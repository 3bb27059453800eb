"""Backtest queries (family A) over the lineitem/orders-derived fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..sources.fixtures import backtest_facts
from .oracle_views import with_backtest
from .registry import register

PAY = ("actual_payment", "predicted_payment")
PV = ("actual_purchase_volume", "predicted_purchase_volume")
EOS = ("actual_eos", "predicted_eos")


def sql_group_metrics(inner: str, key: str, level: str = "portfolio", extra: str = "") -> str:
    """SQL twin of ``bt.group_metrics`` over an inner aggregate."""
    if level == "account":
        pa, pp = "total_actual / n_rows", "total_predicted / n_rows"
    else:
        pa, pp = "total_actual", "total_predicted"
    return f"""
SELECT {key}, total_actual, total_predicted, n_rows{extra},
  total_actual / n_rows AS per_account_actual,
  total_predicted / n_rows AS per_account_predicted,
  {pa} AS plot_actual, {pp} AS plot_predicted,
  CASE WHEN {pa} <> 0 THEN ({pp} - {pa}) / ({pa}) END AS MPE,
  abs(CASE WHEN {pa} <> 0 THEN ({pp} - {pa}) / ({pa}) END) AS AMPE
FROM ({inner}) g
ORDER BY {key.split(' AS ')[-1]} NULLS FIRST"""


def sql_agg(key_expr: str, key: str, a: str, p: str, source: str = "backtest", where: str = "") -> str:
    return (f"SELECT {key_expr} AS {key}, CAST(coalesce(sum({a}), 0) AS DOUBLE) AS total_actual, "
            f"CAST(coalesce(sum({p}), 0) AS DOUBLE) AS total_predicted, count(*) AS n_rows "
            f"FROM {source} {where} GROUP BY 1")


STOCK_CTE = """,
stock AS (
  SELECT b.* FROM backtest b
  JOIN (SELECT statement_month AS _m, max(horizon) AS _max_h FROM backtest GROUP BY 1) mh
    ON b.statement_month = mh._m AND b.horizon = mh._max_h
)
"""


# ---- A1/A2/A10(flow)/A11/A12: the flagship ----------------------------------

def flow_by_statement_month(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", *PAY])
    return bt.aggregate(facts, *PAY, dimension="statement_month", metric_type="flow")


register("A1_flow_payment_by_statement_month",
         with_backtest(sql_group_metrics(
             sql_agg("CAST(date_trunc('month', statement_month) AS DATE)", "statement_month", *PAY),
             "statement_month")), headline=True)(flow_by_statement_month)


@register("A11_account_level_purchase_by_statement_month",
          with_backtest(sql_group_metrics(
              sql_agg("CAST(date_trunc('month', statement_month) AS DATE)", "statement_month", *PV),
              "statement_month", level="account")))
def account_level_purchase(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", *PV])
    return bt.aggregate(facts, *PV, dimension="statement_month", level="account")


@register("A3_vintage_quarter_payment",
          with_backtest(sql_group_metrics(
              sql_agg("CAST(date_trunc('quarter', origination_date) AS DATE)", "vintage_quarter", *PAY),
              "vintage_quarter")))
def vintage_quarter(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["origination_date", *PAY])
    return bt.aggregate(facts, *PAY, dimension="vintage", vintage_period="quarter")


@register("A3_vintage_year_purchase",
          with_backtest(sql_group_metrics(
              sql_agg("CAST(date_trunc('year', origination_date) AS DATE)", "vintage_year", *PV),
              "vintage_year")))
def vintage_year(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["origination_date", *PV])
    # unknown period falls back to year (A3)
    return bt.aggregate(facts, *PV, dimension="vintage", vintage_period="decade")


@register("A4_horizon_payment",
          with_backtest(sql_group_metrics(sql_agg("horizon", "horizon", *PAY), "horizon")))
def by_horizon(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["horizon", *PAY])
    return bt.aggregate(facts, *PAY, dimension="horizon")


@register("A5_performance_month_purchase",
          with_backtest(sql_group_metrics(
              sql_agg("CAST(date_trunc('month', performance_month) AS DATE)", "performance_month", *PV),
              "performance_month")))
def by_performance_month(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["performance_month", *PV])
    return bt.aggregate(facts, *PV, dimension="performance_month")


# ---- J1 / A10 stock ---------------------------------------------------------

def stock_sql(body: str) -> str:
    return with_backtest("", STOCK_CTE) + body


@register("J1_stock_eos_by_statement_month",
          stock_sql(sql_group_metrics(
              sql_agg("statement_month", "statement_month", *EOS, source="stock"), "statement_month")))
def stock_by_month(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "horizon", *EOS])
    return bt.aggregate(facts, *EOS, dimension="statement_month", metric_type="stock")


@register("A10_stock_eos_by_vintage_month",
          stock_sql(sql_group_metrics(
              sql_agg("CAST(date_trunc('month', origination_date) AS DATE)", "vintage_month", *EOS,
                      source="stock"), "vintage_month", level="account")))
def stock_by_vintage(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "horizon", "origination_date", *EOS])
    return bt.aggregate(facts, *EOS, dimension="vintage", vintage_period="month",
                        metric_type="stock", level="account")


# ---- A6-A9 feature bins -----------------------------------------------------

def _bins_sql(edges_sql: str, idx_sql: str, a: str, p: str, source: str, level: str = "portfolio",
              lower: str = "e[bin_idx]", upper: str = "e[bin_idx + 1]") -> str:
    inner = (f"SELECT bin_idx, CAST(coalesce(sum({a}), 0) AS DOUBLE) AS total_actual, "
             f"CAST(coalesce(sum({p}), 0) AS DOUBLE) AS total_predicted, count(*) AS n_rows, "
             f"any_value({lower}) AS bin_lower, any_value({upper}) AS bin_upper "
             f"FROM (SELECT s.*, ed.e, CAST({idx_sql} AS INTEGER) AS bin_idx FROM {source} s, ({edges_sql}) ed) x GROUP BY bin_idx")
    return sql_group_metrics(inner, "bin_idx", level, extra=", bin_lower, bin_upper")


QUANTILE_EDGES_SQL = ("SELECT list_sort(list_distinct(quantile_cont(credit_limit, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e "
                      "FROM backtest WHERE credit_limit IS NOT NULL")
RANGE_IDX = ("CASE WHEN credit_limit IS NULL THEN NULL "
             "ELSE greatest(1, len(list_filter(e, lambda v: credit_limit > v))) END")


@register("A6_quantile_bins_credit_limit_payment",
          with_backtest(_bins_sql(QUANTILE_EDGES_SQL, RANGE_IDX, *PAY, "backtest")))
def quantile_bins(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["credit_limit", *PAY])
    return bt.aggregate(facts, *PAY, dimension="feature_bins", feature="credit_limit",
                        bin_method="quantile", n_bins=5)


WIDTH_EDGES_SQL = ("SELECT [lo, lo + (hi - lo) * 1 / 4, lo + (hi - lo) * 2 / 4, lo + (hi - lo) * 3 / 4, hi] AS e "
                   "FROM (SELECT CAST(min(credit_limit) AS DOUBLE) AS lo, CAST(max(credit_limit) AS DOUBLE) AS hi FROM stock)")


@register("A7_width_bins_credit_limit_eos_stock",
          stock_sql(_bins_sql(WIDTH_EDGES_SQL, RANGE_IDX, *EOS, "stock")))
def width_bins(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "horizon", "credit_limit", *EOS])
    return bt.aggregate(facts, *EOS, dimension="feature_bins", metric_type="stock",
                        feature="credit_limit", bin_method="width", n_bins=4)


THRESHOLDS = [5000.0, 0.0, 2500.0, 7500.0, 2500.0]  # unsorted, with a duplicate
THRESH_EDGES_SQL = "SELECT [0.0, 2500.0, 5000.0, 7500.0] AS e"
THRESH_IDX = ("CASE WHEN credit_limit IS NULL THEN NULL "
              "ELSE 1 + len(list_filter(e, lambda v: credit_limit > v)) END")


@register("A8_threshold_bins_credit_limit_purchase",
          with_backtest(_bins_sql(THRESH_EDGES_SQL, THRESH_IDX, *PV, "backtest", level="account",
                                  lower="([-'infinity'::DOUBLE] || e)[bin_idx]",
                                  upper="(e || ['infinity'::DOUBLE])[bin_idx]")))
def threshold_bins(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["credit_limit", *PV])
    return bt.aggregate(facts, *PV, dimension="feature_bins", feature="credit_limit",
                        thresholds=THRESHOLDS, level="account")


# ---- P1/P2 row filters --------------------------------------------------------

DEFAULT_FILTER = bt.default_row_filter(7, "1996-02-01", "1998-07-01")


@register("P2_default_filter_payment_by_statement_month",
          with_backtest(sql_group_metrics(
              sql_agg("statement_month", "statement_month", *PAY,
                      where="WHERE horizon <= 7 AND ((statement_month <= DATE '1996-02-01' AND "
                            "performance_month <= DATE '1996-02-01') OR statement_month >= DATE '1998-07-01')"),
              "statement_month")))
def default_filter(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "performance_month", "horizon", *PAY])
    return bt.aggregate(facts, *PAY, dimension="statement_month", row_filter=DEFAULT_FILTER)


@register("P1_row_filter_urgent_payment_by_horizon",
          with_backtest(sql_group_metrics(
              sql_agg("horizon", "horizon", *PAY, where="WHERE risk_segment = '1-URGENT' AND credit_limit > 0"),
              "horizon")))
def row_filter_horizon(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["horizon", "risk_segment", "credit_limit", *PAY])
    return bt.aggregate(facts, *PAY, dimension="horizon",
                        row_filter="risk_segment = '1-URGENT' and credit_limit > 0")


@register("P3_available_months",
          with_backtest("""
SELECT month, 'first' AS "end" FROM (SELECT DISTINCT statement_month AS month FROM backtest ORDER BY month LIMIT 5)
UNION ALL
SELECT month, 'last' AS "end" FROM (SELECT DISTINCT statement_month AS month FROM backtest ORDER BY month DESC LIMIT 5)"""))
def available_months(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month"])
    return bt.available_months(facts)


# ---- A13 result summary, A14/A15 distribution ---------------------------------

@register("A13_result_summary_payment_by_month",
          with_backtest(f"""
SELECT count(*) AS n_groups, min(statement_month) AS first_group, max(statement_month) AS last_group,
       avg(MPE) AS mean_MPE, avg(AMPE) AS mean_AMPE
FROM ({sql_group_metrics(sql_agg("statement_month", "statement_month", *PAY), "statement_month")}) r"""))
def result_summary(spark, sf_dir):
    return bt.result_summary(flow_by_statement_month(spark, sf_dir), "statement_month")


DIST_SQL = """
SELECT statement_month, account_id, actual, predicted,
       (predicted - actual) / actual AS MPE, abs((predicted - actual) / actual) AS AMPE
FROM (SELECT statement_month, account_id,
             CAST(coalesce(sum(actual_payment), 0) AS DOUBLE) AS actual,
             CAST(coalesce(sum(predicted_payment), 0) AS DOUBLE) AS predicted
      FROM backtest GROUP BY 1, 2) d
WHERE actual <> 0"""


def _distribution(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["account_id", "statement_month", *PAY])
    return bt.distribution(facts, *PAY, dimension="statement_month")


register("A14_distribution_account_month_payment", with_backtest(DIST_SQL))(_distribution)


@register("A15_distribution_summary",
          with_backtest(f"""
SELECT count(*) AS n_rows, count(DISTINCT statement_month) AS n_groups,
       count(*) / count(DISTINCT statement_month) AS rows_per_group,
       quantile_cont(MPE, 0.5) AS median_MPE
FROM ({DIST_SQL}) d"""))
def distribution_summary(spark, sf_dir):
    return bt.distribution_summary(_distribution(spark, sf_dir), "statement_month")


@register("A14_distribution_stock_eos_by_horizon",
          stock_sql("""
SELECT horizon, account_id, actual, predicted,
       (predicted - actual) / actual AS MPE, abs((predicted - actual) / actual) AS AMPE
FROM (SELECT horizon, account_id,
             CAST(coalesce(sum(actual_eos), 0) AS DOUBLE) AS actual,
             CAST(coalesce(sum(predicted_eos), 0) AS DOUBLE) AS predicted
      FROM stock GROUP BY 1, 2) d
WHERE actual <> 0"""))
def distribution_stock(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["account_id", "statement_month", "horizon", *EOS])
    return bt.distribution(facts, *EOS, dimension="horizon", metric_type="stock")


@register("A9_quantile_bins_with_null_bin",
          with_backtest(_bins_sql(
              "SELECT list_sort(list_distinct(quantile_cont(cl, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e "
              "FROM (SELECT CASE WHEN credit_limit >= 0 THEN credit_limit END AS cl FROM backtest) WHERE cl IS NOT NULL",
              "CASE WHEN cl IS NULL THEN NULL ELSE greatest(1, len(list_filter(e, lambda v: cl > v))) END",
              *PV, "(SELECT *, CASE WHEN credit_limit >= 0 THEN credit_limit END AS cl FROM backtest)")))
def null_bins(spark, sf_dir):
    # a feature with missing values: balances below zero are unknown limits
    facts = backtest_facts(spark, sf_dir, ["credit_limit", *PV]).withColumn(
        "credit_limit", F.when(F.col("credit_limit") >= 0, F.col("credit_limit")))
    return bt.aggregate(facts, *PV, dimension="feature_bins", feature="credit_limit",
                        bin_method="quantile", n_bins=4)
