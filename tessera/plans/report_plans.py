"""Summary, dashboard, chart and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import quality as Q
from ..operators import summary as S
from ..operators.backtest import TARGETS
from ..sources.fixtures import FULL_HORIZON, backtest_facts
from .backtest_plans import flow_by_statement_month, sql_agg, sql_group_metrics
from .oracle_views import with_backtest
from .registry import register

ALL_TARGET_COLS = [c for t in TARGETS for c in (t.actual, t.predicted)]


def _summary_ctes() -> str:
    s1 = ", ".join(f"sum({t.actual}) AS {t.name}__a, sum({t.predicted}) AS {t.name}__p" for t in TARGETS)
    s2 = []
    for t in TARGETS:
        for side in ("a", "p"):
            c = f"{t.name}__{side}"
            s2.append(f"CAST(sum({c}) AS DOUBLE) AS {c}" if t.metric_type == "flow"
                      else f"CAST(sum({c}) AS DOUBLE) / count({c}) AS {c}")
    s3 = []
    for t in TARGETS:
        a, p = f"{t.name}__a", f"{t.name}__p"
        mpe = f"CASE WHEN {a} <> 0 THEN ({p} - {a}) / {a} * 100 END"
        s3 += [f"{mpe} AS {t.name}_mpe", f"abs({mpe}) AS {t.name}_ampe"]
        if t.metric_type == "stock":
            s3.append(f"{p} < 0 AS {t.name}_pred_negative")
    return f""",
sum1 AS (SELECT statement_month, horizon, {s1} FROM backtest GROUP BY statement_month, horizon),
sum2 AS (SELECT statement_month, max(horizon) AS max_horizon, {", ".join(s2)} FROM sum1 GROUP BY statement_month),
summary AS (SELECT statement_month, max_horizon, max_horizon >= {FULL_HORIZON} AS complete, {", ".join(s3)} FROM sum2)"""


def summary_sql(body: str) -> str:
    return with_backtest(body, _summary_ctes())


def _summary(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "horizon", *ALL_TARGET_COLS])
    return S.monthly_summary(facts, full_horizon=FULL_HORIZON)


register("A27_A30_monthly_summary", summary_sql("SELECT * FROM summary ORDER BY statement_month"),
         headline=True)(_summary)


@register("A31_mean_errors_by_target",
          summary_sql(" UNION ALL ".join(
              f"SELECT '{t.name}' AS target, avg({t.name}_mpe) AS mean_MPE, avg({t.name}_ampe) AS mean_AMPE FROM summary"
              for t in TARGETS)))
def mean_errors(spark, sf_dir):
    return S.mean_errors_by_target(_summary(spark, sf_dir))


# a round whose stock predictions of spring are far too low
LOW_SPRING = 100000000


@register("A32_negative_prediction_months",
          with_backtest("SELECT strftime(statement_month, '%Y-%m') AS statement_month, EOS_pred_negative "
                        "FROM summary WHERE coalesce(EOS_pred_negative, false)",
                        _summary_ctes().replace("FROM backtest", f"""FROM (SELECT * REPLACE (
  CASE WHEN month(statement_month) BETWEEN 3 AND 5 THEN predicted_eos - {LOW_SPRING} ELSE predicted_eos END AS predicted_eos)
  FROM backtest) backtest""")))
def negative_months(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "horizon", *ALL_TARGET_COLS])
    low = F.when(F.month("statement_month").between(3, 5), F.col("predicted_eos") - LOW_SPRING).otherwise(F.col("predicted_eos"))
    return S.negative_prediction_months(S.monthly_summary(facts.withColumn("predicted_eos", low), full_horizon=FULL_HORIZON))


AMPE_THRESHOLD = 2.0


def _flag_sql():
    parts = ", ".join(f"CASE WHEN {t.name}_ampe > {AMPE_THRESHOLD} THEN '{t.name}: ' || printf('%.2f', {t.name}_ampe) || '%' END"
                      for t in TARGETS)
    return summary_sql(f"""
SELECT statement_month, array_to_string(f, ',  ') AS ampe_flags FROM (
  SELECT strftime(statement_month, '%Y-%m') AS statement_month, list_filter([{parts}], lambda x: x IS NOT NULL) AS f
  FROM summary) WHERE len(f) > 0""")


@register("A33_F12_ampe_flag_months", _flag_sql())
def ampe_flags(spark, sf_dir):
    return S.ampe_flag_months(_summary(spark, sf_dir), threshold=AMPE_THRESHOLD)


# ---- charts -------------------------------------------------------------------

def _bar_sql(x, ys, hue=None):
    keys = x + (f", {hue}" if hue else "")
    return with_backtest(" UNION ALL ".join(
        f"SELECT {keys}, '{y}' AS series, '{y.replace('_', ' ').title()}' AS label, "
        f"CAST(sum({y}) AS DOUBLE) / count({y}) AS value FROM backtest GROUP BY {keys}" for y in ys))


@register("A34_mean_actual_predicted_by_geography", _bar_sql("geography", ["actual_payment", "predicted_payment"]))
def segment_means(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["geography", "actual_payment", "predicted_payment"])
    return C.bar_means(facts, "geography", ["actual_payment", "predicted_payment"])


@register("C1_bar_means_by_risk_segment_and_horizon",
          _bar_sql("risk_segment", ["actual_eos", "predicted_eos", "actual_purchase_volume"], hue="horizon"))
def bar_means(spark, sf_dir):
    ys = ["actual_eos", "predicted_eos", "actual_purchase_volume"]
    facts = backtest_facts(spark, sf_dir, ["risk_segment", "horizon", *ys])
    return C.bar_means(facts, "risk_segment", ys, hue="horizon")


A1_SQL_BODY = sql_group_metrics(
    sql_agg("CAST(date_trunc('month', statement_month) AS DATE)", "statement_month",
            "actual_payment", "predicted_payment"), "statement_month")


@register("C2_trend_payment_by_month",
          with_backtest(f"""
SELECT statement_month, 'plot_actual' AS series, plot_actual AS value, 'solid' AS style FROM ({A1_SQL_BODY}) a
UNION ALL
SELECT statement_month, 'plot_predicted', plot_predicted, 'dashed' FROM ({A1_SQL_BODY}) b"""))
def trend(spark, sf_dir):
    return C.trend_long(flow_by_statement_month(spark, sf_dir), "statement_month", ["plot_actual", "plot_predicted"])


@register("C3_box_payment_by_horizon",
          with_backtest("""
SELECT b.horizon, qs[1] AS q1, qs[2] AS median, qs[3] AS q3,
  min(CASE WHEN v >= qs[1] - (qs[3] - qs[1]) * 1.5 AND v <= qs[3] + (qs[3] - qs[1]) * 1.5 THEN v END) AS whisker_low,
  max(CASE WHEN v >= qs[1] - (qs[3] - qs[1]) * 1.5 AND v <= qs[3] + (qs[3] - qs[1]) * 1.5 THEN v END) AS whisker_high,
  sum(CASE WHEN v >= qs[1] - (qs[3] - qs[1]) * 1.5 AND v <= qs[3] + (qs[3] - qs[1]) * 1.5 THEN 0 ELSE 1 END) AS n_outliers,
  count(*) AS n
FROM (SELECT horizon, CAST(actual_payment AS DOUBLE) AS v FROM backtest) b JOIN q ON b.horizon = q.horizon
GROUP BY b.horizon, qs""", """,
q AS (SELECT horizon, quantile_cont(CAST(actual_payment AS DOUBLE), [0.25, 0.5, 0.75]) AS qs
      FROM backtest GROUP BY horizon)"""))
def box(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["horizon", "actual_payment"])
    return C.box_stats(facts, "horizon", "actual_payment")


CORR_COLS = ["credit_limit", "actual_payment", "predicted_payment", "actual_eos"]


def _corr_sql():
    rows = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            if a == b:
                rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1.0 AS DOUBLE) AS corr")
                continue
            v = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS corr FROM backtest")
            if a != b:
                rows.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {v} AS corr FROM backtest")
    return with_backtest(" UNION ALL ".join(rows))


@register("C4_correlation_matrix", _corr_sql())
def correlation(spark, sf_dir):
    return C.correlation_long(backtest_facts(spark, sf_dir, CORR_COLS), CORR_COLS)


@register("C5_error_histogram_payment",
          with_backtest("""
SELECT bin_idx, count(*) AS count, any_value(e[bin_idx]) AS bin_lower, any_value(e[bin_idx + 1]) AS bin_upper,
       count(*) / (any_value(n) * (any_value(e[bin_idx + 1]) - any_value(e[bin_idx]))) AS density
FROM (SELECT CAST(greatest(1, len(list_filter(e, lambda x: v > x))) AS INTEGER) AS bin_idx, e, n
      FROM (SELECT CAST(predicted_payment - actual_payment AS DOUBLE) AS v FROM backtest) d,
           (SELECT [lo + (hi - lo) * i / 20 for i in range(20)] || [hi] AS e, CAST(n AS DOUBLE) AS n
            FROM (SELECT min(CAST(predicted_payment - actual_payment AS DOUBLE)) AS lo,
                         max(CAST(predicted_payment - actual_payment AS DOUBLE)) AS hi, count(*) AS n FROM backtest)) ed) x
GROUP BY bin_idx"""))
def error_histogram(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["actual_payment", "predicted_payment"])
    return C.histogram(facts, F.col("predicted_payment") - F.col("actual_payment"), 20)


@register("C5_error_density_payment",
          with_backtest("""
SELECT CAST(p AS INTEGER) AS point, lo + (hi - lo) * p / 100 AS x,
       round(sum(c * exp(-0.5 * pow((lo + (hi - lo) * p / 100 - (lo + (hi - lo) * (cell + 0.5) / 2048)) / h, 2)))
             / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM (SELECT least(CAST(floor((v - lo) / (hi - lo) * 2048) AS BIGINT), 2047) AS cell, count(*) AS c, any_value(lo) AS lo,
             any_value(hi) AS hi, any_value(n) AS n, any_value(sd * pow(n, -0.2)) AS h
      FROM (SELECT CAST(predicted_payment - actual_payment AS DOUBLE) AS v FROM backtest) d,
           (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, stddev_samp(v) AS sd
            FROM (SELECT CAST(predicted_payment - actual_payment AS DOUBLE) AS v FROM backtest)) s GROUP BY 1) cells,
     range(0, 101) r(p)
GROUP BY p, lo, hi"""))
def error_density(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["actual_payment", "predicted_payment"])
    return C.density_curve(facts, F.col("predicted_payment") - F.col("actual_payment"))


@register("C6_residuals_payment_by_month",
          with_backtest(f"SELECT statement_month, plot_predicted AS predicted, plot_predicted - plot_actual AS residual, "
                        f"CAST(0.0 AS DOUBLE) AS zero_line FROM ({A1_SQL_BODY}) a"))
def residual_table(spark, sf_dir):
    return C.residuals(flow_by_statement_month(spark, sf_dir), "statement_month")


@register("C7_scatter_rounds_by_month",
          with_backtest("""
SELECT round, statement_month, CAST(actual AS DOUBLE) AS actual, CAST(predicted AS DOUBLE) AS predicted,
       (SELECT least(min(CAST(actual AS DOUBLE)), min(CAST(predicted AS DOUBLE))) FROM r) AS line_lo,
       (SELECT greatest(max(CAST(actual AS DOUBLE)), max(CAST(predicted AS DOUBLE))) FROM r) AS line_hi
FROM r""", """,
r AS (SELECT round, statement_month, sum(actual_payment) AS actual, sum(predicted_payment) AS predicted
      FROM backtest_rounds GROUP BY round, statement_month)"""))
def scatter(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["statement_month", "actual_payment", "predicted_payment"], rounds=True)
    g = facts.groupBy("round", "statement_month").agg(F.sum("actual_payment").alias("actual"),
                                                      F.sum("predicted_payment").alias("predicted"))
    return C.scatter_with_fit_line(g, "actual", "predicted", ["round", "statement_month"])


# ---- quality ------------------------------------------------------------------

@register("W6_balance_rollforward_breaks_by_month",
          with_backtest("""
SELECT statement_month, count(*) AS n_checked, sum(CASE WHEN eos <> expected_eos THEN 1 ELSE 0 END) AS n_breaks
FROM (SELECT statement_month, eos,
             CASE WHEN lag(horizon) OVER (PARTITION BY account_id, statement_month ORDER BY horizon) = horizon - 1
                  THEN greatest(lag(eos) OVER (PARTITION BY account_id, statement_month ORDER BY horizon) + purchases - payments, 0)
                  END AS expected_eos
      FROM (SELECT account_id, statement_month, horizon, sum(actual_eos) AS eos,
                   sum(actual_purchase_volume) AS purchases, sum(actual_payment) AS payments
            FROM backtest GROUP BY 1, 2, 3) g) c
WHERE expected_eos IS NOT NULL GROUP BY statement_month"""))
def rollforward(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["account_id", "statement_month", "horizon", "actual_eos",
                                           "actual_purchase_volume", "actual_payment"])
    return Q.rollforward_summary(Q.balance_rollforward_breaks(facts))


@register("W7_static_feature_violations",
          with_backtest("""
SELECT account_id, statement_month, feature, n_distinct FROM (
  SELECT account_id, statement_month, 'credit_limit' AS feature, count(DISTINCT credit_limit) AS n_distinct
  FROM backtest GROUP BY 1, 2
  UNION ALL
  SELECT account_id, statement_month, 'product_type', count(DISTINCT product_type) FROM backtest GROUP BY 1, 2
) WHERE n_distinct > 1"""))
def static_features(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["account_id", "statement_month", "credit_limit", "product_type"])
    return Q.static_feature_violations(facts, ["credit_limit", "product_type"])


REPORT_SQL = """
SELECT 'scatter' AS component, risk_segment AS segment, a AS x, p AS y FROM g
UNION ALL SELECT 'fit_line', NULL, least(min(a), min(p)), greatest(max(a), max(p)) FROM g
UNION ALL SELECT 'residual', risk_segment, p, CAST(predicted - actual AS DOUBLE) FROM g
UNION ALL SELECT 'histogram', NULL, e[k], CAST(count(*) AS DOUBLE)
  FROM (SELECT e, greatest(1, len(list_filter(e, lambda x: v > x))) AS k
        FROM (SELECT CAST(predicted - actual AS DOUBLE) AS v FROM g) d,
             (SELECT [lo + (hi - lo) * i / 20 for i in range(20)] || [hi] AS e
              FROM (SELECT min(CAST(predicted - actual AS DOUBLE)) AS lo, max(CAST(predicted - actual AS DOUBLE)) AS hi FROM g)))
  GROUP BY e, k
UNION ALL SELECT 'mean_actual', risk_segment, CAST(NULL AS DOUBLE), CAST(sum(actual) AS DOUBLE) / count(*) FROM g GROUP BY risk_segment
UNION ALL SELECT 'mean_predicted', risk_segment, NULL, CAST(sum(predicted) AS DOUBLE) / count(*) FROM g GROUP BY risk_segment"""


@register("C8_segment_report", with_backtest(REPORT_SQL, """,
g AS (SELECT risk_segment, statement_month, sum(actual_payment) AS actual, sum(predicted_payment) AS predicted,
             CAST(sum(actual_payment) AS DOUBLE) AS a, CAST(sum(predicted_payment) AS DOUBLE) AS p
      FROM backtest GROUP BY 1, 2)"""))
def segment_report(spark, sf_dir):
    # per (segment, month) totals: scatter + fit line, residuals, error histogram, segment means
    facts = backtest_facts(spark, sf_dir, ["risk_segment", "statement_month", "actual_payment", "predicted_payment"])
    g = facts.groupBy("risk_segment", "statement_month").agg(
        F.sum("actual_payment").alias("actual"), F.sum("predicted_payment").alias("predicted"))
    return C.segment_report_long(g, "actual", "predicted", "risk_segment", n_bins=20)
