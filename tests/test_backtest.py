"""Backtest aggregation semantics on literal rows."""

import datetime as dt

from tessera.operators import backtest as bt
from tessera.operators import metrics as M


def _facts(spark):
    d = dt.date
    rows = [(d(2020, 1, 1), 1, 1.0, 100.0, 110.0), (d(2020, 1, 1), 2, 2.0, 50.0, 40.0),
            (d(2020, 2, 1), 1, 3.0, 0.0, 5.0), (d(2020, 2, 1), 2, None, 10.0, 10.0),
            (d(2020, 2, 1), 2, 5.0, 20.0, 30.0)]
    return spark.createDataFrame(rows, "statement_month date, horizon int, x double, a double, p double")


def test_flow_stock_and_metrics(spark):
    f = _facts(spark)
    flow = {r["statement_month"]: r for r in bt.aggregate(f, "a", "p").collect()}
    assert flow[dt.date(2020, 1, 1)]["total_actual"] == 150.0 and flow[dt.date(2020, 1, 1)]["n_rows"] == 2
    assert abs(flow[dt.date(2020, 1, 1)]["MPE"] - 0.0) < 1e-12
    stock = {r["statement_month"]: r["total_actual"] for r in bt.aggregate(f, "a", "p", metric_type="stock").collect()}
    assert stock == {dt.date(2020, 1, 1): 50.0, dt.date(2020, 2, 1): 30.0}


def test_bins_null_and_thresholds(spark):
    f = _facts(spark)
    out = {r["bin_idx"]: r["n_rows"] for r in bt.aggregate(
        f, "a", "p", dimension="feature_bins", feature="x", thresholds=[2.0, 4.0]).collect()}
    assert out == {1: 2, 2: 1, 3: 1, None: 1}
    q = {r["bin_idx"]: r["n_rows"] for r in bt.aggregate(
        f, "a", "p", dimension="feature_bins", feature="x", bin_method="quantile", n_bins=2).collect()}
    assert sum(v for k, v in q.items() if k is not None) == 4


def test_gini_perfect_ranking(spark):
    rows = [(float(i), float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "a double, p double")
    m = M.backtest_metrics(df, [("a", "p")], level="account").first()
    assert abs(m["Gini"] - 1.0) < 1e-12 and abs(m["KS"] - 1.0) < 1e-12 and m["RMSE"] == 0.0
