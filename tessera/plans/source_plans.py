"""Source, sink, catalog and inspection queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..session import ensure_checkpoint_dir
from ..sources import catalog as CAT
from ..sources.fixtures import answers, backtest_facts, receipts, waiters
from ..sources.tables import read_table, table_path
from .oracle_views import with_answers, with_backtest, with_receipts
from .registry import register


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


TYPE_SQL = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
  ELSE lower(column_type) END"""


@register("S1_S8_inspect_lineitem",
          f"""SELECT CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name, {TYPE_SQL} AS data_type,
  (SELECT count(*) FROM lineitem) AS n_rows FROM (DESCRIBE lineitem)""")
def inspect(spark, sf_dir):
    schema, n, _ = CAT.inspect_parquet(spark, table_path(sf_dir, "lineitem"))
    return schema.withColumn("n_rows", F.lit(n).cast("long"))


@register("S8_first_rows_orders",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders LIMIT 5")
def first_rows(spark, sf_dir):
    head = CAT.inspect_parquet(spark, table_path(sf_dir, "orders"))[2]
    return head.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _profile_sql(table: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(DISTINCT {c}) AS n_distinct, "
        f"count(*) - count({c}) AS n_null FROM {table}" for c, t in cols)


ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("S9_column_profile_orders", _profile_sql("orders", ORDERS_COLS))
def profile(spark, sf_dir):
    return CAT.column_profile(read_table(spark, sf_dir, "orders"))


def _stored_profile_sql(table: str, cols: list[tuple[str, str]]) -> str:
    ends = lambda c, t: ", ".join(f"CAST({f}({c}) AS DOUBLE)" if t in ("bigint", "double") else "CAST(NULL AS DOUBLE)"
                                  for f in ("min", "max"))
    return "SELECT *, TRUE AS distinct_within FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, {ends(c, t)} "
        f"FROM {table}" for c, t in cols) + ") AS p(column_name, data_type, n_rows, n_null, low, high)"


# the summaries of every month of orders are stored, read back and merged; the distinct
# values are estimates, so what is returned of them is whether they are within 3 % (four
# standard errors) of the exact number
@register("S9_S10_profile_from_stored_sketches", _stored_profile_sql("orders", ORDERS_COLS))
def stored_profile(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    path = scratch_path(spark, "sketches")
    CAT.sketch_columns(orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"]).write.parquet(path)
    found = CAT.profile_from_sketches(spark.read.parquet(path))
    exact = CAT.column_profile(orders).select("column_name", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return found.join(exact, "column_name").select(
        "column_name", "data_type", "n_rows", "n_null", "low", "high", near.alias("distinct_within"))


@register("S10_describe_customer",
          """SELECT column_name, count, mean, std, min, q25, q50, q75, max,
       CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM (
  SELECT 'c_custkey' AS column_name, count(c_custkey) AS count, avg(c_custkey) AS mean, stddev_samp(c_custkey) AS std,
         CAST(min(c_custkey) AS DOUBLE) AS min, quantile_cont(CAST(c_custkey AS DOUBLE), 0.25) AS q25,
         quantile_cont(CAST(c_custkey AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(c_custkey AS DOUBLE), 0.75) AS q75,
         CAST(max(c_custkey) AS DOUBLE) AS max FROM customer
  UNION ALL
  SELECT 'c_nationkey', count(c_nationkey), avg(c_nationkey), stddev_samp(c_nationkey), CAST(min(c_nationkey) AS DOUBLE),
         quantile_cont(CAST(c_nationkey AS DOUBLE), 0.25), quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5),
         quantile_cont(CAST(c_nationkey AS DOUBLE), 0.75), CAST(max(c_nationkey) AS DOUBLE) FROM customer
  UNION ALL
  SELECT 'c_acctbal', count(c_acctbal), avg(c_acctbal), stddev_samp(c_acctbal), min(c_acctbal),
         quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75), max(c_acctbal)
  FROM customer)
UNION ALL
SELECT column_name, count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, "unique", top, freq FROM (
  SELECT 'c_name' AS column_name, sum(n) AS count, count(*) AS "unique",
         arg_min(v, (-n, v)) AS top, max(n) AS freq
  FROM (SELECT c_name AS v, count(*) AS n FROM customer WHERE c_name IS NOT NULL GROUP BY 1)
  UNION ALL
  SELECT 'c_mktsegment', sum(n), count(*), arg_min(v, (-n, v)), max(n)
  FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1))""")
def describe_customer(spark, sf_dir):
    return CAT.describe(read_table(spark, sf_dir, "customer"))


def _register_receipts(spark, sf_dir):
    receipts(spark, sf_dir).createOrReplaceTempView("receipts")
    waiters(spark, sf_dir).createOrReplaceTempView("waiters")


@register("S13_A52_sql_highest_receipt",
          with_receipts("SELECT customer_name, price FROM receipts ORDER BY price DESC, receipt_id LIMIT 1"))
def highest_receipt(spark, sf_dir):
    _register_receipts(spark, sf_dir)
    return CAT.run_sql(spark, "SELECT customer_name, price FROM receipts ORDER BY price DESC, receipt_id LIMIT 1")


@register("J7_tips_by_waiter",
          with_receipts("""SELECT w.waiter_name, sum(r.tip) AS total_tip FROM receipts r
JOIN waiters w ON r.receipt_id = w.receipt_id GROUP BY w.waiter_name"""))
def tips_by_waiter(spark, sf_dir):
    _register_receipts(spark, sf_dir)
    return CAT.run_sql(spark, """SELECT w.waiter_name, sum(r.tip) AS total_tip FROM receipts r
JOIN waiters w ON r.receipt_id = w.receipt_id GROUP BY w.waiter_name""")


@register("A52_max_by_receipt_and_top_waiter",
          with_receipts("""SELECT (SELECT arg_max(customer_name, (price, -receipt_id)) FROM receipts) AS top_customer,
  (SELECT waiter_name FROM (SELECT w.waiter_name, sum(r.tip) AS t FROM receipts r JOIN waiters w
     ON r.receipt_id = w.receipt_id GROUP BY 1) ORDER BY t DESC, waiter_name LIMIT 1) AS top_waiter"""))
def top_receipt_and_waiter(spark, sf_dir):
    r, w = receipts(spark, sf_dir), waiters(spark, sf_dir)
    top_c = r.agg(F.max_by("customer_name", F.struct("price", (-F.col("receipt_id")).alias("i"))).alias("top_customer"))
    per_w = r.join(w, "receipt_id").groupBy("waiter_name").agg(F.sum("tip").alias("t"))
    top_w = per_w.agg(F.min_by("waiter_name", F.struct((-F.col("t")).alias("a"), F.col("waiter_name").alias("b")))
                      .alias("top_waiter"))
    # two one-row aggregates: stack and fold instead of joining them
    return (top_c.select("top_customer", F.lit(None).cast("string").alias("top_waiter"))
            .unionByName(top_w.select(F.lit(None).cast("string").alias("top_customer"), "top_waiter"))
            .agg(F.max("top_customer").alias("top_customer"), F.max("top_waiter").alias("top_waiter")))


@register("S4_S5_catalog_roundtrip_flow_by_market",
          with_backtest("""SELECT regexp_replace(trim(geography), ' ', '_') AS market,
  regexp_replace(trim(risk_segment), ' ', '_') AS segment, statement_month,
  CAST(sum(actual_payment) AS DOUBLE) AS total_actual, CAST(sum(predicted_payment) AS DOUBLE) AS total_predicted,
  count(*) AS n_rows
FROM backtest GROUP BY 1, 2, 3"""))
def catalog_roundtrip(spark, sf_dir):
    # Write one folder per (market, segment); S4: read the catalog back and stack it
    facts = backtest_facts(spark, sf_dir, ["geography", "risk_segment", "statement_month",
                                           "actual_payment", "predicted_payment"])
    facts = facts.withColumnRenamed("geography", "market").withColumnRenamed("risk_segment", "segment")
    path = scratch_path(spark, "backtest_catalog")
    CAT.write_partitioned(facts, path)
    return CAT.read_catalog(spark, path).groupBy("market", "segment", "statement_month").agg(
        F.sum("actual_payment").cast("double").alias("total_actual"),
        F.sum("predicted_payment").cast("double").alias("total_predicted"),
        F.count(F.lit(1)).alias("n_rows"))


# every priority's orders in a folder of its own name, some with a column that others lack
@register("S4_flat_catalog_entries",
          """SELECT lower(o_orderstatus) AS market, o_orderpriority AS segment, count(*) AS n_rows,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS with_customer
FROM orders GROUP BY 1, 2""")
def flat_catalog(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    orders = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    base, entries = scratch_path(spark, "flat_catalog"), []
    for r in sorted(map(tuple, orders.select("o_orderstatus", "o_orderpriority").distinct().collect())):  # some 15 pairs
        status, priority = r
        path = f"{base}/{status} of {priority}/data+{len(entries)}"
        own = orders.where((F.col("o_orderstatus") == status) & (F.col("o_orderpriority") == priority))
        own.select(*(["o_custkey"] if status != "F" else []), "o_totalprice").write.parquet(path)
        entries.append((status.lower(), priority, path))
    return CAT.union_catalog(spark, entries).groupBy("market", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").cast("double").alias("total"),
        F.count("o_custkey").alias("with_customer"))


@register("S2_S5_csv_summary_roundtrip",
          with_backtest("""SELECT regexp_replace(trim(geography), ' ', '_') AS market, statement_month,
  sum(actual_payment) AS actual, count(*) AS n_rows FROM backtest GROUP BY 1, 2"""))
def csv_roundtrip(spark, sf_dir):
    # The summary of each market as CSV files; S2: the files loaded by a declared schema
    facts = backtest_facts(spark, sf_dir, ["geography", "statement_month", "actual_payment"])
    summary = facts.groupBy(F.col("geography").alias("market"), "statement_month").agg(
        F.sum("actual_payment").alias("actual"), F.count(F.lit(1)).alias("n_rows"))
    path = scratch_path(spark, "summary_csv")
    CAT.write_partitioned(summary, path, keys=("market",), fmt="csv")
    return CAT.load_dataset(spark, path, "summaries", fmt="csv",
                            schema="statement_month date, actual decimal(28,2), n_rows long, market string")


@register("S2_S3_S6_S7_jsonl_runs_roundtrip",
          with_answers("""SELECT agent_name, count(*) AS n_answers,
  sum(CASE WHEN prediction IS NULL THEN 1 ELSE 0 END) AS n_no_prediction FROM answers GROUP BY agent_name"""))
def jsonl_roundtrip(spark, sf_dir):
    # Append answers as JSON lines, a folder named after each agent's file; S3: read
    # them back (agent from that name), S7: export a submission and re-read it
    a = answers(spark, sf_dir).select("agent_name", "task_id", "question", "prediction", "true_answer")
    path = scratch_path(spark, "answers_jsonl")
    CAT.append_jsonl(a.withColumn("file", F.concat("agent_name", F.lit(".v1.jsonl"))).drop("agent_name"), path, by="file")
    runs = CAT.read_run_files(spark, path, "task_id long, question string, prediction string, true_answer string")
    CAT.export_submission(runs, f"{path}_submission", {"agent_name": "agent_name", "task_id": "task_id",
                                                              "prediction": "model_answer"})
    back = CAT.load_dataset(spark, f"{path}_submission", "submission", fmt="json",
                            schema="agent_name string, task_id long, model_answer string")
    return back.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.sum(F.when(F.col("model_answer") == "No prediction", 1).otherwise(0)).alias("n_no_prediction"))


@register("S12_schema_guard_missing_columns",
          """SELECT 'l_orderkey' AS column_name, true AS available, count(l_orderkey) AS n_values, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'l_shipdate', true, count(l_shipdate), count(*) FROM lineitem
UNION ALL SELECT 'l_missing_column', false, NULL, count(*) FROM lineitem""")
def schema_guard(spark, sf_dir):
    return bt.column_check(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_shipdate", "l_missing_column"])
