"""Backtest metric queries (A16-A26, J6, P4, P5) and their DuckDB twins."""

from __future__ import annotations

from ..operators import metrics as M
from ..sources.fixtures import backtest_facts
from .oracle_views import with_backtest
from .registry import register

PAIRS = [("actual_payment", "predicted_payment"), ("actual_eos", "predicted_eos")]


def _keys(extra, segs):
    return ["target", "scope", *extra, *segs]


def metrics_sql(pairs, segs=(), extra=(), source="backtest", level="both", rank=True,
                n_accounts: str | None = None, seg_types: dict | None = None) -> str:
    """SQL CTE chain ending in a SELECT of the same columns as ``M.backtest_metrics``."""
    seg_types = seg_types or {}
    segs, extra = list(segs), list(extra)
    keep = extra + segs + ([n_accounts] if n_accounts else [])
    keep_sql = "".join(f"{c}, " for c in keep)
    longs = " UNION ALL ".join(
        f"SELECT '{a}' AS target, {keep_sql}CAST({a} AS DECIMAL(18,4)) AS actual, "
        f"CAST({p} AS DECIMAL(18,4)) AS predicted FROM {source} WHERE {a} IS NOT NULL AND {p} IS NOT NULL"
        for a, p in pairs)
    ex = "".join(f"{c}, " for c in extra)
    na = f", {n_accounts}" if n_accounts else ""
    if segs:
        nulls = "".join(f"CAST(NULL AS {seg_types.get(c, 'VARCHAR')}) AS {c}, " for c in segs)
        segsel = "".join(f"{c}, " for c in segs)
        nn = " AND ".join(f"{c} IS NOT NULL" for c in segs)
        scoped = (f"SELECT target, 'overall' AS scope, {ex}{nulls}actual, predicted{na} FROM m_long "
                  f"UNION ALL SELECT target, 'segment' AS scope, {ex}{segsel}actual, predicted{na} FROM m_long WHERE {nn}")
    else:
        scoped = f"SELECT target, 'overall' AS scope, {ex}actual, predicted{na} FROM m_long"
    keys = _keys(extra, segs)
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in keys)
    ctes = [f"m_long AS ({longs})", f"m_scoped AS ({scoped})"]
    parts = []
    if level in ("account", "both"):
        ctes.append(f"""m_acc AS (
  SELECT {k}, count(*) AS n_rows,
    CAST(CAST(sum(CAST(CASE WHEN actual <> 0 THEN abs(CAST(predicted - actual AS DOUBLE)) / abs(CAST(actual AS DOUBLE)) END
                  AS DECIMAL(38,12))) AS VARCHAR) AS DOUBLE) / count(CASE WHEN actual <> 0 THEN 1 END) * 100 AS AMPE_pct,
    CAST(CAST(sum(CAST(CASE WHEN actual <> 0 THEN CAST(predicted - actual AS DOUBLE) / CAST(actual AS DOUBLE) END
                  AS DECIMAL(38,12))) AS VARCHAR) AS DOUBLE) / count(CASE WHEN actual <> 0 THEN 1 END) * 100 AS MPE_pct,
    CAST(CAST(sum(abs(predicted - actual)) AS VARCHAR) AS DOUBLE) / count(*) AS MAE,
    CAST(CAST(sum(predicted - actual) AS VARCHAR) AS DOUBLE) / count(*) AS bias,
    sqrt(CAST(CAST(sum(CAST(predicted - actual AS DECIMAL(38,4)) * CAST(predicted - actual AS DECIMAL(38,4))) AS VARCHAR) AS DOUBLE) / count(*)) AS RMSE,
    CASE WHEN max(actual) > min(actual)
          AND CAST(CAST(sum(CAST(actual AS DECIMAL(38,4)) * CAST(actual AS DECIMAL(38,4))) AS VARCHAR) AS DOUBLE) - CAST(CAST(sum(actual) AS VARCHAR) AS DOUBLE) * CAST(CAST(sum(actual) AS VARCHAR) AS DOUBLE) / count(*) > 0
         THEN 1.0 - CAST(CAST(sum(CAST(predicted - actual AS DECIMAL(38,4)) * CAST(predicted - actual AS DECIMAL(38,4))) AS VARCHAR) AS DOUBLE)
              / (CAST(CAST(sum(CAST(actual AS DECIMAL(38,4)) * CAST(actual AS DECIMAL(38,4))) AS VARCHAR) AS DOUBLE) - CAST(CAST(sum(actual) AS VARCHAR) AS DOUBLE) * CAST(CAST(sum(actual) AS VARCHAR) AS DOUBLE) / count(*))
    END AS R2
  FROM m_scoped GROUP BY {k})""")
        parts.append("m_acc")
        if rank:
            ctes.append(f"""m_gs AS (SELECT {k}, sum(actual) AS sa, count(*) AS n FROM m_scoped GROUP BY {k}),
m_glab AS (SELECT {", ".join("s." + c for c in keys)}, s.predicted AS score,
                  CASE WHEN CAST(s.actual AS DECIMAL(38,4)) * g.n > g.sa THEN 1 ELSE 0 END AS pos
           FROM m_scoped s JOIN m_gs g ON {on("s", "g")}),
m_gt AS (SELECT {k}, score, sum(pos) AS cp, sum(1 - pos) AS cn FROM m_glab GROUP BY {k}, score),
m_gw AS (SELECT *, coalesce(sum(cn) OVER (PARTITION BY {k} ORDER BY score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_cn FROM m_gt),
m_gini AS (SELECT {k}, CASE WHEN sum(cp) > 0 AND sum(cn) > 0 THEN
             CAST(CAST(sum(cp * (2 * cum_cn + cn)) AS VARCHAR) AS DOUBLE) / (CAST(CAST(sum(cp) AS VARCHAR) AS DOUBLE) * CAST(CAST(sum(cn) AS VARCHAR) AS DOUBLE)) - 1 END AS Gini
           FROM m_gw GROUP BY {k}),
m_med AS (SELECT {k}, quantile_cont(CAST(actual AS DOUBLE), 0.5) AS med FROM m_scoped GROUP BY {k}),
m_klab AS (SELECT {", ".join("s." + c for c in keys)}, s.predicted AS score,
                  CASE WHEN CAST(s.actual AS DOUBLE) > g.med THEN 1 ELSE 0 END AS pos
           FROM m_scoped s JOIN m_med g ON {on("s", "g")}),
m_kt AS (SELECT {k}, score, sum(pos) AS cp, sum(1 - pos) AS cn FROM m_klab GROUP BY {k}, score),
m_kw AS (SELECT *, sum(cp) OVER (PARTITION BY {k} ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_cp,
                   sum(cn) OVER (PARTITION BY {k} ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_cn,
                   sum(cp) OVER (PARTITION BY {k}) AS np, sum(cn) OVER (PARTITION BY {k}) AS nn FROM m_kt),
m_ks AS (SELECT {k}, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN
           max(abs(CAST(cum_cp AS DOUBLE) / np - CAST(cum_cn AS DOUBLE) / nn)) END AS KS
         FROM m_kw GROUP BY {k})""")
            parts += ["m_gini", "m_ks"]
    if level in ("portfolio", "both"):
        nacc = ""
        if n_accounts:
            nacc = f""", n_accounts,
    CASE WHEN n_accounts > 0 THEN total_actual / n_accounts END AS per_account_actual,
    CASE WHEN n_accounts > 0 THEN total_predicted / n_accounts END AS per_account_predicted,
    CASE WHEN n_accounts > 0 THEN portfolio_abs_error / n_accounts END AS per_account_abs_error,
    CASE WHEN n_accounts > 0 THEN portfolio_error / n_accounts END AS per_account_error"""
        ctes.append(f"""m_port0 AS (
  SELECT {k}, count(*) AS n_rows, CAST(CAST(sum(actual) AS VARCHAR) AS DOUBLE) AS total_actual,
         CAST(CAST(sum(predicted) AS VARCHAR) AS DOUBLE) AS total_predicted,
         CAST(CAST(sum(predicted) - sum(actual) AS VARCHAR) AS DOUBLE) AS portfolio_error{", sum(" + n_accounts + ") AS n_accounts" if n_accounts else ""}
  FROM m_scoped GROUP BY {k}),
m_port AS (SELECT {k}{"" if parts else ", n_rows"}, total_actual, total_predicted,
    CASE WHEN total_actual <> 0 THEN abs(portfolio_error) / abs(total_actual) * 100 END AS portfolio_AMPE_pct,
    CASE WHEN total_actual <> 0 THEN portfolio_error / total_actual * 100 END AS portfolio_MPE_pct,
    abs(portfolio_error) AS portfolio_abs_error, portfolio_error{nacc}
  FROM m_port0)""")
        parts.append("m_port")
    sel = [f"{parts[0]}.*"] + [f"{p}.* EXCLUDE ({k})" for p in parts[1:]]
    body = f"SELECT {', '.join(sel)} FROM {parts[0]}"
    for p in parts[1:]:
        body += f" JOIN {p} ON {on(parts[0], p)}"
    return ",\n".join(ctes), body


def metrics_query(pairs, segs=(), extra=(), source="backtest", **kw) -> str:
    ctes, body = metrics_sql(pairs, segs, extra, source, **kw)
    return with_backtest(body, ",\n" + ctes)


# --- A16-A23 ----------------------------------------------------------------

@register("A23_metrics_overall_and_by_risk_segment",
          metrics_query(PAIRS, segs=["risk_segment"]))
def metrics_by_segment(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["risk_segment", *[c for p in PAIRS for c in p]])
    return M.backtest_metrics(facts, "actual_payment:predicted_payment, actual_eos:predicted_eos",
                              segment_cols=["risk_segment"], level="both")


@register("P5_metrics_over_rows_with_null_targets",
          metrics_query([("actual_payment", "predicted_payment")], segs=["risk_segment"], level="account", rank=False,
                        source="(SELECT * REPLACE (CASE WHEN horizon % 3 = 0 THEN NULL ELSE predicted_payment END AS "
                               "predicted_payment, CASE WHEN horizon % 4 = 0 THEN NULL ELSE actual_payment END AS "
                               "actual_payment) FROM backtest)"))
def metrics_with_nulls(spark, sf_dir):
    from pyspark.sql import functions as F
    facts = backtest_facts(spark, sf_dir, ["risk_segment", "horizon", "actual_payment", "predicted_payment"])
    facts = (facts.withColumn("predicted_payment", F.when(F.col("horizon") % 3 != 0, F.col("predicted_payment")))
             .withColumn("actual_payment", F.when(F.col("horizon") % 4 != 0, F.col("actual_payment"))))
    return M.backtest_metrics(facts, "actual_payment:predicted_payment", segment_cols=["risk_segment"], level="account",
                              rank_metrics=False)


@register("A16_account_metrics_purchase_by_geography",
          metrics_query([("actual_purchase_volume", "predicted_purchase_volume")], segs=["geography"],
                        level="account", rank=False))
def account_metrics_geo(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["geography", "actual_purchase_volume", "predicted_purchase_volume"])
    return M.backtest_metrics(facts, [("actual_purchase_volume", "predicted_purchase_volume")],
                              segment_cols=["geography"], level="account", rank_metrics=False)


@register("A19_A20_gini_ks_payment_by_horizon",
          metrics_query([("actual_payment", "predicted_payment")], segs=["horizon"], level="account",
                        seg_types={"horizon": "INTEGER"}))
def gini_ks_by_horizon(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["horizon", "actual_payment", "predicted_payment"])
    return M.backtest_metrics(facts, [("actual_payment", "predicted_payment")],
                              segment_cols=["horizon"], level="account")


ACCOUNT_SEGMENT_SQL = """,
acct_seg AS (
  SELECT statement_month, risk_segment, sum(actual_payment) AS actual_payment,
         sum(predicted_payment) AS predicted_payment, count(DISTINCT account_id) AS n_accounts
  FROM backtest GROUP BY statement_month, risk_segment
)"""


@register("A21_A22_portfolio_metrics_with_accounts",
          with_backtest(metrics_sql([("actual_payment", "predicted_payment")], segs=["risk_segment"],
                                    source="acct_seg", level="portfolio", n_accounts="n_accounts")[1],
                        ACCOUNT_SEGMENT_SQL + ",\n" + metrics_sql(
                            [("actual_payment", "predicted_payment")], segs=["risk_segment"],
                            source="acct_seg", level="portfolio", n_accounts="n_accounts")[0]))
def portfolio_metrics(spark, sf_dir):
    from pyspark.sql import functions as F
    facts = backtest_facts(spark, sf_dir, ["account_id", "statement_month", "risk_segment",
                                           "actual_payment", "predicted_payment"])
    seg = facts.groupBy("statement_month", "risk_segment").agg(
        F.sum("actual_payment").alias("actual_payment"),
        F.sum("predicted_payment").alias("predicted_payment"),
        F.count_distinct("account_id").alias("n_accounts"))
    return M.backtest_metrics(seg, [("actual_payment", "predicted_payment")], segment_cols=["risk_segment"],
                              level="portfolio", n_accounts_col="n_accounts")


# --- A24-A26, J6: rounds ----------------------------------------------------------

def _compare_sql(segs=()):
    ctes, body = metrics_sql([("actual_payment", "predicted_payment")], segs=segs, extra=["round"],
                             source="backtest_rounds", level="account")
    scope = "segment" if segs else "overall"
    sg = "".join(f"{c}, " for c in segs)
    longm = " UNION ALL ".join(
        f"SELECT {sg}round, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM m_res WHERE scope = '{scope}'"
        for m in M.COMPARE_METRICS)
    return with_backtest(f"""
SELECT {sg}metric, max(CASE WHEN round = 1 THEN value END) AS round_1,
       max(CASE WHEN round = 2 THEN value END) AS round_2,
       max(CASE WHEN round = 2 THEN value END) - max(CASE WHEN round = 1 THEN value END) AS delta
FROM ({longm}) x GROUP BY {sg}metric""", ",\n" + ctes + f",\nm_res AS ({body})")


@register("A24_compare_rounds_overall", _compare_sql())
def compare_rounds(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["actual_payment", "predicted_payment"], rounds=True)
    return M.compare_rounds(facts, "actual_payment", "predicted_payment")


@register("A25_compare_rounds_by_risk_segment", _compare_sql(["risk_segment"]))
def compare_rounds_seg(spark, sf_dir):
    facts = backtest_facts(spark, sf_dir, ["risk_segment", "actual_payment", "predicted_payment"], rounds=True)
    return M.compare_rounds(facts, "actual_payment", "predicted_payment", segment_cols=["risk_segment"])


@register("A26_rows_per_round",
          with_backtest("SELECT round, count(*) AS n_rows FROM backtest_rounds GROUP BY round"))
def rows_per_round(spark, sf_dir):
    return M.rows_per_round(backtest_facts(spark, sf_dir, ["horizon"], rounds=True))


@register("J6_segment_alignment_rounds",
          with_backtest("""
SELECT product_type, CASE WHEN max(CASE WHEN round = 1 THEN 1 ELSE 0 END) = 1
                           AND max(CASE WHEN round = 2 THEN 1 ELSE 0 END) = 1 THEN 'both'
                          WHEN max(CASE WHEN round = 1 THEN 1 ELSE 0 END) = 1 THEN 'only_round_1'
                          ELSE 'only_round_2' END AS presence
FROM (SELECT round, product_type FROM backtest_rounds WHERE round = 1 OR product_type NOT LIKE '%BRASS%') r
GROUP BY product_type"""))
def segment_alignment(spark, sf_dir):
    from pyspark.sql import functions as F
    facts = backtest_facts(spark, sf_dir, ["product_type"], rounds=True)
    # round 2 of this fixture drops the BRASS products so the alignment has one-sided segments
    facts = facts.where((F.col("round") == 1) | ~F.col("product_type").like("%BRASS%"))
    return M.align_segments(facts, ["product_type"])


@register("U2_segment_intersection_and_difference",
          with_backtest("""
SELECT product_type, 'both' AS part FROM (
  SELECT product_type FROM r1 INTERSECT SELECT product_type FROM r2)
UNION ALL SELECT product_type, 'only_round_1' FROM (SELECT product_type FROM r1 EXCEPT SELECT product_type FROM r2)
UNION ALL SELECT product_type, 'only_round_2' FROM (SELECT product_type FROM r2 EXCEPT SELECT product_type FROM r1)""", """,
r1 AS (SELECT product_type FROM backtest_rounds WHERE round = 1 AND product_type NOT LIKE '%TIN%'),
r2 AS (SELECT product_type FROM backtest_rounds WHERE round = 2 AND product_type NOT LIKE '%BRASS%')"""))
def segment_sets(spark, sf_dir):
    from pyspark.sql import functions as F
    facts = backtest_facts(spark, sf_dir, ["product_type"], rounds=True)
    # each round lacks products that the other has
    r1 = facts.where((F.col("round") == 1) & ~F.col("product_type").like("%TIN%")).select("product_type")
    r2 = facts.where((F.col("round") == 2) & ~F.col("product_type").like("%BRASS%")).select("product_type")
    return M.segment_sets(r1, r2)
