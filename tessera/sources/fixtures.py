"""Fact tables the operators work on, derived by Spark from the driver tables.

The backtest fact table (one row per account x statement month x horizon) is
built from lineitem/orders and their dimensions. Only the joins needed for
the requested columns are planned: dimension lookups are LEFT joins on unique
keys, so leaving one out never changes the row set, and the scans keep only
the columns that are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

MONEY = "decimal(18,2)"
PRED = "decimal(18,4)"
FACTOR = "decimal(4,2)"

BACKTEST_COLUMNS = (
    "account_id", "statement_month", "performance_month", "horizon",
    "product_type", "risk_segment", "geography", "credit_limit", "origination_date",
    "actual_payment", "predicted_payment",
    "actual_purchase_volume", "predicted_purchase_volume",
    "actual_eos", "predicted_eos",
)

# Complete history in the fixture: horizons 1..7 (the reference's is 28).
FULL_HORIZON = 7


def _factor(c: str) -> Column:
    return F.col(c).cast(FACTOR)


def _round1_payment() -> Column:
    return (F.col("l_extendedprice").cast(MONEY)
            * (F.lit(1) + _factor("l_tax") - _factor("l_discount"))).cast(PRED)


def _round2_payment() -> Column:
    # half the bias of round 1
    return (F.col("l_extendedprice").cast(MONEY)
            * (F.lit(1) + (_factor("l_tax") - _factor("l_discount")) * F.lit(0.5).cast("decimal(2,1)"))
            ).cast(PRED)


def _column_exprs() -> dict[str, Column]:
    stmt = F.trunc(F.col("o_orderdate"), "MONTH")
    return {
        "account_id": F.col("o_custkey"),
        "statement_month": stmt,
        "performance_month": F.add_months(stmt, F.col("l_linenumber").cast("int")),
        "horizon": F.col("l_linenumber").cast("int"),
        "product_type": F.col("p_type"),
        "risk_segment": F.col("o_orderpriority"),
        "geography": F.col("r_name"),
        "credit_limit": F.col("c_acctbal"),
        "origination_date": F.col("origination_date"),
        "actual_payment": F.col("l_extendedprice").cast(MONEY),
        "predicted_payment": _round1_payment(),
        "actual_purchase_volume": F.col("l_quantity").cast(MONEY),
        "predicted_purchase_volume": (
            F.col("l_quantity").cast(MONEY)
            * (F.lit(1) + (F.col("l_linenumber") - F.lit(4)) * F.lit(0.01).cast("decimal(3,2)"))
        ).cast(PRED),
        "actual_eos": F.col("o_totalprice").cast(MONEY),
        "predicted_eos": (F.col("o_totalprice").cast(MONEY)
                          * (F.lit(1) + _factor("l_tax") - F.lit(0.04).cast(FACTOR))).cast(PRED),
    }


def customer_dim(spark: SparkSession, sf_dir: str, with_geography: bool = True) -> DataFrame:
    """customer -> nation -> region. nation/region are fixed-size (25/5 rows) and broadcast."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    if not with_geography:
        return cust.drop("c_nationkey")
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
    return (cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left")
            .select("c_custkey", "c_acctbal", "r_name"))


def backtest_facts(spark: SparkSession, sf_dir: str, columns=None,
                   rounds: bool = False) -> DataFrame:
    """Backtest fact rows with the requested columns.

    ``rounds=True`` adds a ``round`` column (1, 2): the same actuals appear once
    per round, only ``predicted_payment`` differs. Both rounds come from one
    scan through a generator (``inline``), not from two scans and a union.
    """
    cols = list(columns or BACKTEST_COLUMNS)
    unknown = [c for c in cols if c not in BACKTEST_COLUMNS]
    if unknown:
        raise ValueError(f"unknown backtest columns {unknown}; available: {list(BACKTEST_COLUMNS)}")

    li_cols = ["l_orderkey", "l_linenumber"]
    if "product_type" in cols:
        li_cols.append("l_partkey")
    if {"actual_payment", "predicted_payment"} & set(cols) or rounds:
        li_cols += ["l_extendedprice", "l_tax", "l_discount"]
    if {"actual_purchase_volume", "predicted_purchase_volume"} & set(cols):
        li_cols.append("l_quantity")
    if "predicted_eos" in cols and "l_tax" not in li_cols:
        li_cols.append("l_tax")
    li = read_table(spark, sf_dir, "lineitem", sorted(set(li_cols), key=li_cols.index))

    o_cols = ["o_orderkey", "o_custkey", "o_orderdate"]
    if "risk_segment" in cols:
        o_cols.append("o_orderpriority")
    if {"actual_eos", "predicted_eos"} & set(cols):
        o_cols.append("o_totalprice")
    orders = read_table(spark, sf_dir, "orders", o_cols)

    # Per-customer attributes are joined to orders (4x smaller than lineitem)
    # before the big lineitem x orders join on the order key.
    if "geography" in cols or "credit_limit" in cols:
        cust = customer_dim(spark, sf_dir, with_geography="geography" in cols)
        orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "left").drop("c_custkey")
    if "origination_date" in cols:
        orig = (read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
                .groupBy("o_custkey")
                .agg(F.min("o_orderdate").cast("date").alias("origination_date"))
                .withColumnRenamed("o_custkey", "orig_custkey"))
        orders = orders.join(orig, orders.o_custkey == orig.orig_custkey, "left").drop("orig_custkey")

    facts = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    if "product_type" in cols:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
        facts = facts.join(part, facts.l_partkey == part.p_partkey, "left")

    exprs = _column_exprs()
    if not rounds:
        return facts.select(*[exprs[c].alias(c) for c in cols])
    rest = [c for c in cols if c != "predicted_payment"]
    gen = F.inline(F.array(
        F.struct(F.lit(1).alias("round"), _round1_payment().alias("predicted_payment")),
        F.struct(F.lit(2).alias("round"), _round2_payment().alias("predicted_payment")),
    ))
    out = facts.select(*[exprs[c].alias(c) for c in rest], gen)
    return out.select("round", *cols)


# ------------------------------------------------------------------ answers
# An evaluation run log derived from ``events``: one answer per event. The
# agent is the event type, the question the user, the item kind (number,
# text, list, decimal) and the answer style (exact, reformatted, wrong,
# missing, refusal, near miss) follow from the user id and the payload k.

def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    kind = F.col("user_id") % 4
    uid = F.col("user_id").cast("string")
    number = (F.col("user_id") * 37 + 1000).cast("string")
    truth = (F.when(kind == 0, number)
             .when(kind == 1, F.concat(F.lit("Blue sky-"), uid))
             .when(kind == 2, F.concat(uid, F.lit(", red; "), (F.col("user_id") * 2).cast("string")))
             .otherwise(F.concat(uid, F.lit(".5"))))
    style = F.col("k") % 6
    t = F.col("true_answer")
    reformatted = (F.when(kind == 0, F.concat(F.lit("We get "),
                                              F.expr("substring(true_answer, 1, length(true_answer) - 3)"),
                                              F.lit(","), F.expr("substring(true_answer, length(true_answer) - 2)"),
                                              F.lit(".")))
                   .when(kind == 1, F.upper(t))
                   .when(kind == 2, F.replace(t, F.lit(", "), F.lit(" ,")))
                   .otherwise(F.concat(F.lit("$"), t)))
    prediction = (F.when(style == 0, t)
                  .when(style == 1, reformatted)
                  .when(style == 2, F.concat(t, F.lit("7")))
                  .when(style == 3, F.lit(None).cast("string"))
                  .when(style == 4, F.lit("Unable to determine"))
                  .otherwise(F.expr("substring(true_answer, 1, length(true_answer) - 1)")))
    n_steps = F.col("k") % 5 + 1
    step = lambda i: F.struct(
        i.alias("step_number"),
        F.when((F.col("k") + i) % 4 == 0, F.lit("AgentParsingError"))
         .when((F.col("k") + i) % 7 == 0, F.lit("AgentExecutionError")).alias("error_type"),
        F.concat(F.lit("r = "),
                 F.when((F.col("k") + i) % 3 == 0, F.lit("web_search"))
                  .when((F.col("k") + i) % 3 == 1, F.lit("visit_page")).otherwise(F.lit("Inspect")),
                 F.lit("(q"), i.cast("string"), F.lit(")\nprint(r)")).alias("llm_output"))
    start_s = F.unix_seconds(F.col("ts").cast("timestamp"))
    base = ev.select(
        "event_id", "ts", "user_id", "event_type", "value", _k().alias("k"))
    out = base.select(
        F.col("user_id"),
        F.col("event_id").alias("task_id"),
        F.concat(F.lit("agent_"), F.col("event_type")).alias("agent_name"),
        F.concat(F.lit("org"), (F.col("user_id") % 2).cast("string"), F.lit("/model-"),
                 (F.col("k") % 3).cast("string")).alias("model_id"),
        F.when(F.col("event_type").isin("view", "click", "error"), F.lit("code"))
         .otherwise(F.lit("tool-calling")).alias("agent_action_type"),
        F.when(kind == 0, F.lit("MATH")).when(kind == 1, F.lit("SimpleQA")).otherwise(F.lit("GAIA")).alias("source"),
        F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string")).alias("task"),
        F.concat(F.lit("Q"), uid).alias("question"),
        truth.alias("true_answer"),
        F.col("k"),
        F.transform(F.sequence(F.lit(1), n_steps), step).alias("intermediate_steps"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.timestamp_seconds(start_s + (F.col("value") * 10).cast("bigint")),
                      "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("doc"), F.col("k").cast("string"), F.lit(".pdf")))
         .when(F.col("k") % 4 == 2, F.concat(F.lit("img"), F.col("k").cast("string"), F.lit(".png")))
         .when(F.col("k") % 4 == 3, F.concat(F.lit("audio"), F.col("k").cast("string"), F.lit(".mp3")))
         .otherwise(F.lit("")).alias("file_name"),
        F.struct((F.col("value") * 100).cast("bigint").alias("input_tokens"),
                 F.col("k").cast("bigint").alias("output_tokens")).alias("token_counts"),
    )
    return out.withColumn("prediction", prediction).drop("k", "user_id")


def with_answer_scores(df: DataFrame) -> DataFrame:
    """S3 read rule + scoring: null prediction -> "No prediction", then
    is_correct (F5/F7 by source) and is_near_correct (F8)."""
    from ..functions.scoring import answer_correct, close_call
    df = df.withColumn("prediction", F.coalesce(F.col("prediction"), F.lit("No prediction")))
    df = df.withColumn("is_correct", answer_correct("prediction", "true_answer", "source"))
    return df.withColumn("is_near_correct", close_call("prediction", "true_answer", "is_correct"))


def eval_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task list of the evaluation (one per question, in user order) with
    its attachment file name, derived from ``events``."""
    ev = read_table(spark, sf_dir, "events", ["user_id"])
    u = ev.select("user_id").distinct()
    ext = F.element_at(F.array(F.lit(""), F.lit(".pdf"), F.lit(".png"), F.lit(".mp3"), F.lit(".xlsx"),
                               F.lit(".jpg"), F.lit(".zip")), (F.col("user_id") % 7 + 1).cast("int"))
    return u.select(
        F.col("user_id").alias("task_order"),
        F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("question"),
        F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("file"), F.col("user_id").cast("string"), ext))
         .alias("file_name"))


# ------------------------------------------------------------------ run steps
# Agent run traces derived from ``events``: run = user, order = (ts, event_id),
# step type from the event type ("error" = failed action step), token usage
# from value and the payload k.

def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return steps_from_events(ev)


def steps_from_events(ev: DataFrame) -> DataFrame:
    """The step derivation as a per-row projection (works on streams too)."""
    k = F.col("k")
    step_type = (F.when(F.col("event_type").isin("view", "click", "error"), F.lit("action"))
                 .when(F.col("event_type") == "purchase", F.lit("planning")).otherwise(F.lit("task")))
    has_usage = F.col("step_type").isin("action", "planning") & (k % 10 != 0)
    code_body = F.concat(
        F.when(k % 5 == 0, F.lit("import math\n")).when(k % 7 == 0, F.lit("import os.path\n"))
         .when(k % 11 == 0, F.lit("from collections import Counter\n")).otherwise(F.lit("")),
        F.lit("result = "), F.col("event_type"), F.lit("_tool("), k.cast("string"), F.lit(")\nprint(result)"))
    model_output = (F.when(k % 4 == 0, F.concat(F.lit("Thought: check "), F.col("event_type"), F.lit("\n<code>\n"),
                                               code_body, F.lit("\n</code>")))
                    .when(k % 4 == 1, F.concat(F.lit("Thought: fenced\n```python\n"), code_body, F.lit("\n```")))
                    .when(k % 4 == 2, F.concat(F.lit('Action: {"name": "'), F.col("event_type"),
                                               F.lit('_tool", "arguments": {"k": '), k.cast("string"), F.lit("}}")))
                    .otherwise(F.concat(F.lit("final answer pending for "), F.col("event_type"))))
    tool_call = lambda i: F.struct(
        F.concat(F.lit("call_"), ((k * 7 + i) % 10).cast("string")).alias("id"),
        F.concat(F.col("event_type"), F.lit("_tool")).alias("name"),
        F.concat(F.lit("{'q': "), i.cast("string"), F.lit("}")).alias("arguments"),
        F.concat(F.lit("out "), i.cast("string"), F.lit("  ")).alias("output"))
    err = (F.when(k % 3 == 0, F.lit("AgentMaxStepsError")).when(k % 3 == 1, F.lit("AgentExecutionError"))
           .otherwise(F.lit("AgentParsingError")))
    base = ev.select("event_id", "ts", "user_id", "event_type", "value", _k().alias("k")) \
             .withColumn("step_type", step_type)
    return base.select(
        F.col("user_id").alias("run_id"),
        (F.col("user_id") / 5).cast("bigint").alias("root_run_id"),
        "event_id", "ts", "step_type",
        F.col("value").alias("duration"),
        F.when(has_usage, (F.col("value") * 100).cast("bigint")).alias("input_tokens"),
        F.when(has_usage, k.cast("bigint")).alias("output_tokens"),
        F.when(F.col("step_type") == "action", model_output).alias("model_output"),
        F.when((F.col("step_type") == "action") & (k % 4 < 2), code_body).alias("code_action"),
        F.when(F.col("step_type") == "action", F.concat(
            F.lit("Observed k="), k.cast("string"),
            F.when(k % 9 == 0, F.lit("\nAgent stopped due to iteration limit or time limit.")).otherwise(F.lit(""))))
         .alias("observations"),
        F.when((F.col("step_type") == "action") & (k % 6 == 0), F.transform(
            F.sequence(F.lit(1), k % 2 + 1), lambda i: F.concat(F.lit("shot"), i.cast("string"), F.lit(".png"))))
         .alias("observation_images"),
        F.when(F.col("event_type") == "error", err).alias("error_type"),
        F.when(F.col("event_type") == "error",
               F.concat(err, F.lit(": step "), F.col("event_id").cast("string"), F.lit(" failed"))).alias("error_message"),
        F.when(F.col("step_type") == "action",
               F.transform(F.sequence(F.lit(1), k % 3 + 1), tool_call)).alias("tool_calls"),
        F.when(F.col("step_type") == "planning", F.concat(F.lit("Plan: "), F.lit("buy "), k.cast("string"), F.lit(" items ")))
         .alias("plan"),
        F.when(F.col("step_type") == "task", F.concat(F.lit("Sign up user "), F.col("user_id").cast("string")))
         .alias("task"),
        (k % 13 == 0).alias("is_final_answer"),
    )


# ------------------------------------------------------------------ receipts / waiters
# The relational demo tables of the text-to-SQL example, derived from orders,
# lineitem, customer and supplier.

def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_tax"])
    tips = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY) * _factor("l_tax")).cast(MONEY).alias("tip"))
    return (o.join(c, o.o_custkey == c.c_custkey, "left").join(tips, o.o_orderkey == tips.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("receipt_id"), F.col("c_name").alias("customer_name"),
                    F.col("o_totalprice").alias("price"), F.coalesce("tip", F.lit(0).cast(MONEY)).alias("tip")))


def waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    first = li.where(F.col("l_linenumber") == 1)
    return (first.join(s, first.l_suppkey == s.s_suppkey, "left")
            .groupBy(F.col("l_orderkey").alias("receipt_id"))
            .agg(F.min("s_name").alias("waiter_name")))


# ------------------------------------------------------------------ search payloads
# JSON search responses built from ``pages``: ten consecutive pages per
# response (a bounded group), title from the page's <title>.

def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    item = F.struct(F.col("page_id"),
                    F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"),
                    F.col("url"),
                    F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" in "),
                             F.regexp_extract("url", r"/([a-z]{2})/", 1)).alias("description"))
    g = p.groupBy((F.col("page_id") / 10).cast("long").alias("payload_id")).agg(
        F.sort_array(F.collect_list(item)).alias("__items"))
    results = F.transform("__items", lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"),
                                                         r["description"].alias("description")))
    return g.select("payload_id", F.to_json(F.struct(F.struct(results.alias("results")).alias("web"))).alias("payload"))


def rss_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents of ten pages each (values in CDATA sections)."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    cdata = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    item = F.concat(F.lit("<item><title>"), cdata(F.regexp_extract("html", r"<title>(.*?)</title>", 1)),
                    F.lit("</title><link>"), cdata(F.col("url")), F.lit("</link><description>"),
                    cdata(F.concat(F.lit("Page "), F.col("page_id").cast("string"))), F.lit("</description></item>"))
    g = p.groupBy((F.col("page_id") / 10).cast("long").alias("payload_id")).agg(
        F.sort_array(F.collect_list(F.struct("page_id", item.alias("xml")))).alias("__items"))
    return g.select("payload_id", F.concat(F.lit("<rss><channel>"),
                                           F.array_join(F.transform("__items", lambda r: r["xml"]), ""),
                                           F.lit("</channel></rss>")).alias("rss"))
