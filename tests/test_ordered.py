"""Range-partitioned ordered helpers equal plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ordered import lag_values, prefix_sum


def test_prefix_sum_and_lag_match_windows(spark):
    rnd = random.Random(7)
    # one hot key with most rows, several small ones
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 5), i, rnd.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    w = Window.partitionBy("k").orderBy("o")
    want = {r["o"]: (r["c"], r["p"]) for r in df.select(
        "o", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
        F.lag("v").over(w).alias("p")).collect()}
    got_c = {r["o"]: r["cum_v"] for r in prefix_sum(df, ["k"], "o", ["v"], ranges=8).collect()}
    got_p = {r["o"]: r["prev_v"] for r in lag_values(df, ["k"], "o", ["v"], ranges=8).collect()}
    assert got_c == {o: c for o, (c, _) in want.items()}
    assert got_p == {o: p for o, (_, p) in want.items()}


def test_exact_quantiles_match_percentile(spark):
    from tessera.operators.ordered import exact_quantiles
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), float(rnd.randint(0, 50)) if rnd.random() > 0.1 else None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g long, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {r["g"]: list(r["q"]) for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = {r["g"]: list(r["quantiles"]) for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g]))


def test_nulls_totals_and_no_keys(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), i, rnd.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    for keys in (["k"], []):
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        want = {r["o"]: tuple(r)[1:] for r in df.select(
            "o", F.coalesce(F.sum("v").over(w.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
            F.sum("v").over(w), F.lag("v").over(w.orderBy("o"))).collect()}
        sums = {r["o"]: (r["cum_v"], r["tot_v"]) for r in prefix_sum(df, keys, "o", ["v"], with_totals=True, ranges=6).collect()}
        lags = {r["o"]: r["prev_v"] for r in lag_values(df, keys, "o", ["v"], ranges=6).collect()}
        assert sums == {o: x[:2] for o, x in want.items()}
        assert lags == {o: x[2] for o, x in want.items()}


def test_pair_counts_beyond_64_bits(spark):
    from tessera.operators.metrics import _COUNTS, _POINTS, gini_ks
    n = 4_000_000_000
    items = [("g", 1, False, 0, n, 0, n, 0, 0, 0, 0, n), ("g", 2, False, n, 0, n, 0, 0, n, 0, 0, 0)]
    df = spark.createDataFrame(items, "k string, first long, edge boolean, " + ", ".join(f"{c} long" for c in (*_COUNTS, *_POINTS)))
    r = gini_ks(df, ["k"]).first()
    assert n * 2 * n > 9.3e18 and (r["Gini"], r["KS"]) == (1.0, 1.0)


def test_quantiles_from_bands_and_from_ranges(spark):
    from tessera.operators.ordered import exact_quantiles
    rnd = random.Random(9)
    rows = [(None if i % 3 else "a", rnd.choice([7.0, rnd.lognormvariate(0, 4), -rnd.random()])) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.33, 0.5, 0.999, 1.0]
    for keys in (["g"], []):
        want = {tuple(r[k] for k in keys): list(r["q"]) for r in df.groupBy(*keys).agg(
            F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
        for window_rows in (10**6, 0):  # a coarse sketch, so bands matter; one window or ranges
            got = exact_quantiles(df, keys, "v", probs, accuracy=200, window_rows=window_rows).collect()
            assert {tuple(r[k] for k in keys) for r in got} == set(want)
            for r in got:
                key = tuple(r[k] for k in keys)
                assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(r["quantiles"], want[key]))
                values = [x for g, x in rows if not keys or g == key[0]]
                assert list(r["above"]) == [sum(x > q for x in values) for q in r["quantiles"]]
    assert exact_quantiles(df.where("v is null"), [], "v", probs).collect() == []


def test_rank_metrics_with_hot_scores_over_many_ranges(spark):
    """Most rows have one of two scores; each range holds part of them."""
    from tessera.operators.metrics import backtest_metrics
    rnd = random.Random(2)
    rows = [("s" if i % 3 else None, rnd.choice([1.0, 5.0, 9.0]), rnd.choice([2.0, 2.0, 2.0, 4.0, 4.0, rnd.randint(0, 6) / 2])) for i in range(800)]
    df = spark.createDataFrame(rows, "seg string, a double, p double")
    got = {r["scope"]: r for r in backtest_metrics(df, "a:p", ["seg"], level="account").collect()}
    for scope, mine in (("overall", rows), ("segment", [r for r in rows if r[0]])):
        a = sorted(r[1] for r in mine)
        mean, med = sum(a) / len(a), (a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2
        up, down = [p for _, x, p in mine if x > mean], [p for _, x, p in mine if x <= mean]
        gini = 2 * sum((x > y) + (x == y) / 2 for x in up for y in down) / (len(up) * len(down)) - 1
        high, low = [p for _, x, p in mine if x > med], [p for _, x, p in mine if x <= med]
        ks = max(abs(sum(x <= c for x in high) / len(high) - sum(x <= c for x in low) / len(low)) for c in {r[2] for r in mine})
        assert abs(got[scope]["Gini"] - gini) < 1e-12 and abs(got[scope]["KS"] - ks) < 1e-12


def test_quantile_bands_sent_to_the_values_or_joined(spark):
    """A group's values stay where they are; with too many groups the bands are joined as before."""
    from tessera.operators.ordered import exact_quantiles
    rnd = random.Random(8)
    rows = [(rnd.choice([None, "a", "a", "b"]), rnd.choice([None, rnd.randint(0, 500) / 4])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    few, many = (sorted(map(str, exact_quantiles(df, ["g"], "v", [0.25, 0.5], accuracy=200, broadcast_groups=n).collect()))
                 for n in (100, 0))
    assert few == many and len(few) == 3


def test_rows_are_summed_once_and_only_the_scopes_asked_for(spark, monkeypatch):
    """Sums per segment and rank stretches are tables: each scope and branch reads them, not the rows."""
    from tessera.operators import metrics as M
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2]), rnd.choice(["x", "y", None]), float(rnd.randint(0, 9)), rnd.randint(0, 30) / 2) for _ in range(600)]
    df = spark.createDataFrame(rows, "round int, seg string, a double, p double")
    both = M.backtest_metrics(df, [("a", "p")], ["seg"], level="account", extra_keys=["round"])
    written, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda t: (written.append(set(t.columns)), cut(t))[1])
    one = M.backtest_metrics(df, [("a", "p")], ["seg"], level="account", extra_keys=["round"], overall=False)
    assert sum({"__sa", "n_rows"} <= c for c in written) == 1 and sum({"edge", "pairs"} <= c for c in written) == 1
    want = sorted(map(str, both.where("scope = 'segment'").collect()))
    assert sorted(map(str, one.collect())) == want and len(want) == 4


def test_r2_keeps_its_digits(spark):
    from decimal import Decimal

    from tessera.operators.metrics import backtest_metrics
    rows = [(Decimal("1000000000000.000") + Decimal(i % 2) / 1000, Decimal("1000000000000.5") + Decimal(i % 2) / 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "a decimal(18,4), p decimal(18,4)")
    r = backtest_metrics(df, "a:p", level="account", rank_metrics=False).first()
    assert abs(r["R2"] - (1 - 0.25 * 1000 / (1000 * 0.0005 ** 2))) < 1e-3
    odd = [(Decimal(x), Decimal(0)) for x in ("-7.0001", "3.0002", "11.5", "-0.0001")]
    r = backtest_metrics(spark.createDataFrame(odd, "a decimal(18,4), p decimal(18,4)"), "a:p", level="account", rank_metrics=False).first()
    mean = sum(float(a) for a, _ in odd) / 4
    assert abs(r["R2"] - (1 - sum(float(a) ** 2 for a, _ in odd) / sum((float(a) - mean) ** 2 for a, _ in odd))) < 1e-12


def test_as_of_finds_the_neighbours_of_hot_and_null_keys(spark):
    from tessera.operators.ordered import as_of
    rnd = random.Random(11)
    key = lambda: rnd.choice([0, 0, 0, 0, 1, 2, None])
    asks = [(key(), i, rnd.choice([None, *range(60)])) for i in range(400)]
    own = [(key(), rnd.choice([None, *range(0, 60, 3)]), rnd.randint(0, 3)) for _ in range(90)] + [(5, 1, 1)]
    asks += [(7, 400, 10), asks[0]]  # a key without others, and a repeated row
    rows = spark.createDataFrame(asks, "k long, before long, t long").withColumnRenamed("before", "id")
    others = spark.createDataFrame(own, "k long, ts long, v long")

    def near(k, t):
        timed = [(s, v) for q, s, v in own if q == k and s is not None and t is not None]
        return (max([x for x in timed if x[0] <= t], default=None), min([x for x in timed if x[0] > t], default=None))

    want = sorted(((i, *near(k, t)) for k, i, t in asks), key=repr)
    for ranges in (1, 2, 13, 64):
        got = as_of(rows, "t", others, "ts", ["k"], ["v"], ranges=ranges).collect()
        assert sorted(((r["id"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in got),
                      key=repr) == want
    all_own = as_of(rows, "t", others, "ts", [], ranges=9).where("id = 400").first()
    assert all_own["before"][0] == max(s for _, s, _ in own if s is not None and s <= 10)
    assert as_of(rows, "t", others.limit(0), "ts", ["k"]).where("before is null and after is null").count() == len(asks)
    assert as_of(rows.limit(0), "t", others, "ts", ["k"]).count() == 0


def test_nearest_snapshot_takes_the_closer_side_then_the_earlier(spark):
    from tessera.operators.corpus import nearest_snapshot
    stamp = lambda m: f"2024-01-01 00:{m:02d}:00"
    snaps = spark.createDataFrame([("a", stamp(1)), ("a", stamp(5)), ("a", stamp(9)), ("b", stamp(2)), ("b", stamp(3)),
                                   ("c", stamp(4)), (None, stamp(6))], "u string, s string").selectExpr("u", "timestamp(s) AS ts")
    wanted = spark.createDataFrame([("a", stamp(3)), ("b", None), ("d", stamp(1)), ("c", stamp(0))],
                                   "u string, s string").selectExpr("u", "timestamp(s) AS w")
    got = {r["u"]: r["snapshot_ts"].minute for r in nearest_snapshot(snaps, "u", "ts", wanted, "w").collect()}
    assert got == {"a": 1, "b": 3, "c": 4, None: 6}
