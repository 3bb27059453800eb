"""Run trace and conversation analytics.

Per-run ordering uses (ts, event_id). Run-level picks (last step, totals)
are aggregates with partial combination; running values use the two-level
ordered helpers so a very long run is not sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .ordered import join_on_keys, lag_values, prefix_sum

# Fixed values that must equal the reference's for the same results.
MESSAGE_ROLES = ("user", "assistant", "system", "tool-call", "tool-response")
ROLE_CONVERSIONS = {"tool-call": "assistant", "tool-response": "user"}
PLAN_FOLLOW_UP = "Now proceed and carry out this plan."
RETRY_NOTE = ("\nNow let's retry: take care not to repeat previous errors! "
              "If you have retried several times, try a completely different approach.\n")
MAX_STEPS_ERROR = "AgentMaxStepsError"
ITERATION_LIMIT_NOTE = "Agent stopped due to iteration limit or time limit."

ORDER = ("ts", "event_id")


def _msg(i: int, role: str, text: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(i).alias("msg_ord"), F.lit(role).alias("role"), text.alias("text")))


def _tool_calls_repr(tc: Column) -> Column:
    one = lambda t: F.concat(
        F.lit("{'id': '"), t["id"], F.lit("', 'type': 'function', 'function': {'name': '"), t["name"],
        F.lit("', 'arguments': "), t["arguments"], F.lit("}}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tc, one), ", "), F.lit("]"))


def step_messages(steps: DataFrame, summary_mode: bool = False) -> DataFrame:
    """one row per chat message produced by each step, in order.

    Action: model output (not in summary mode), tool calls, observed images (a
    user message whose text lists their references), observation, error with
    retry note; planning: plan + follow-up (not in summary mode);
    task: "New task:" text; system prompt (not in summary mode).
    """
    st = F.col("step_type")
    not_summary = F.lit(not summary_mode)
    action = st == "action"
    err_text = F.concat(
        F.when(F.col("tool_calls").isNotNull() & (F.size("tool_calls") > 0),
               F.concat(F.lit("Call id: "), F.col("tool_calls")[0]["id"], F.lit("\n"))).otherwise(F.lit("")),
        F.lit("Error:\n"), F.col("error_message"), F.lit(RETRY_NOTE))
    seen = F.col("observation_images") if "observation_images" in steps.columns else F.lit(None).cast("array<string>")
    images = [_msg(2, "user", F.array_join(seen, "\n"), action & seen.isNotNull() & (F.size(seen) > 0))]
    msgs = F.array_compact(F.array(
        _msg(0, "assistant", strip_ws("model_output"), action & not_summary & F.col("model_output").isNotNull()),
        _msg(1, "tool-call", F.concat(F.lit("Calling tools:\n"), _tool_calls_repr(F.col("tool_calls"))),
             action & F.col("tool_calls").isNotNull()),
        *images,
        _msg(3, "tool-response", F.concat(F.lit("Observation:\n"), F.col("observations")),
             action & F.col("observations").isNotNull()),
        _msg(4, "tool-response", err_text, action & F.col("error_message").isNotNull()),
        _msg(5, "assistant", strip_ws("plan"), (st == "planning") & not_summary),
        _msg(6, "user", F.lit(PLAN_FOLLOW_UP), (st == "planning") & not_summary),
        _msg(7, "user", F.concat(F.lit("New task:\n"), F.col("task")), st == "task"),
        _msg(8, "system", F.col("system_prompt") if "system_prompt" in steps.columns else F.lit(None).cast("string"),
             (st == "system") & not_summary),
    ))
    return steps.select("run_id", *ORDER, F.inline(msgs))


def succinct_steps(steps: DataFrame) -> DataFrame:
    """steps without the model input messages."""
    return steps.drop("model_input_messages")


def cumulative_tokens(steps: DataFrame) -> DataFrame:
    """Step index and running input/output token totals per run
    (a step without usage adds nothing, as the monitor does)."""
    t = steps.select("run_id", *ORDER, "duration",
                     F.coalesce("input_tokens", F.lit(0)).alias("i"),
                     F.coalesce("output_tokens", F.lit(0)).alias("o"), F.lit(1).cast("long").alias("n"))
    r = prefix_sum(t, ["run_id"], list(ORDER), ["i", "o", "n"])
    return r.select("run_id", "event_id", F.col("cum_n").alias("step_index"), "duration",
                    F.col("cum_i").alias("total_input_tokens"), F.col("cum_o").alias("total_output_tokens"))


def run_monitor(steps: DataFrame) -> DataFrame:
    """ST2 (batch form): per run the step count, token totals and durations."""
    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.sum("duration").alias("total_duration"))


def run_token_usage(steps: DataFrame) -> DataFrame:
    """input/output totals over action and planning steps; null when any of
    those steps lacks usage, 0 for a run without such steps."""
    counted = F.col("step_type").isin("action", "planning")
    complete = F.count_if(counted) == F.count_if(counted & F.col("input_tokens").isNotNull())
    total = lambda c: F.when(complete, F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)))
    return steps.groupBy("run_id").agg(total("input_tokens").alias("input_tokens"),
                                       total("output_tokens").alias("output_tokens"))


def run_state(steps: DataFrame, output_col: str = "observations") -> DataFrame:
    """A47 (+A49): max_steps_error when the last step failed with the max-steps
    error, else success; a parsing-error flag; and whether the output of the last
    step says that the iteration or time limit was met."""
    order = F.struct(*[F.col(c) for c in ORDER])
    last = lambda c: F.max_by(F.struct(c), order)[c]  # noqa: E731  a struct keeps a null of the last step
    has_output = output_col in steps.columns
    limit = F.coalesce(last(output_col).contains(ITERATION_LIMIT_NOTE), F.lit(False)) if has_output else F.lit(False)
    return steps.groupBy("run_id").agg(
        F.when(F.coalesce(last("error_type") == MAX_STEPS_ERROR, F.lit(False)), F.lit("max_steps_error"))
         .otherwise(F.lit("success")).alias("state"),
        F.coalesce(F.bool_or(F.col("error_type") == "AgentParsingError"), F.lit(False)).alias("parsing_error"),
        limit.alias("iteration_limit_exceeded"))


def team_token_rollup(steps: DataFrame, root_col: str = "root_run_id") -> DataFrame:
    """Manager + sub-agent token totals per root run, as the monitors add
    them up: a step without usage adds nothing."""
    return steps.groupBy(root_col).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
                                       F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
                                       F.countDistinct("run_id").alias("n_runs"))


def run_full_code(steps: DataFrame) -> DataFrame:
    """Non-null code actions of a run in step order, joined by a blank line."""
    s = steps.where(F.col("code_action").isNotNull())
    return s.groupBy("run_id").agg(
        F.expr("listagg(code_action, '\\n\\n') WITHIN GROUP (ORDER BY ts, event_id)").alias("code"))


def step_tool_outputs(steps: DataFrame) -> DataFrame:
    """Outputs of one step's tool calls sorted by call id, joined by
    newlines, trailing newlines removed."""
    tc = F.col("tool_calls")
    joined = F.array_join(F.transform(F.array_sort(tc, lambda a, b: F.when(a["id"] < b["id"], -1)
                                                   .when(a["id"] > b["id"], 1).otherwise(0)),
                                      lambda t: F.concat(t["output"], F.lit("\n"))), "")
    return steps.where(tc.isNotNull()).select("run_id", "event_id",
                                              F.regexp_replace(joined, "\n+$", "").alias("observations"))


def final_answer_checks(df: DataFrame, answer_col: str, checks) -> DataFrame:
    """``checks`` = [(name, predicate Column)]; all must hold. Adds
    ``failed_check``: the first failing check's name, null when all pass."""
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(False)).alias("ok")) for n, p in checks])
    first_bad = F.filter(arr, lambda c: ~c["ok"])
    return df.withColumn("failed_check", F.when(F.size(first_bad) > 0, first_bad[0]["name"]))


def merge_consecutive_messages(messages: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                               role_col: str = "role", text_col: str = "text",
                               role_conversions: dict | None = None) -> DataFrame:
    """Convert roles, reject unknown ones, and merge consecutive messages
    of the same role (texts joined by a newline). Islands come from a running
    count of role changes over (conversation, turn), which identify a message."""
    conv = ROLE_CONVERSIONS if role_conversions is None else role_conversions
    role = F.col(role_col)
    checked = F.when(~role.isin(*MESSAGE_ROLES) | role.isNull(),
                     F.raise_error(F.concat(F.lit("Incorrect role "), F.coalesce(role, F.lit("null")))))
    mapped = role
    for src, dst in conv.items():
        mapped = F.when(role == src, F.lit(dst)).otherwise(mapped)
    m = messages.select(F.col(conv_col), F.col(order_col), F.coalesce(checked, mapped).alias("_role"))
    lagged = lag_values(m, [conv_col], [order_col], ["_role"])
    changes = lagged.withColumn("_chg", F.when(F.col("prev__role").isNull() | (F.col("prev__role") != F.col("_role")), 1)
                                .otherwise(0).cast("long"))
    islands = prefix_sum(changes, [conv_col], [order_col], ["_chg"]).select(
        conv_col, order_col, "_role", F.col("cum__chg").alias("message_index"))
    # the texts join once, at the end
    texts = messages.select(conv_col, order_col, F.col(text_col).alias("_text"))
    return join_on_keys(texts, islands, [conv_col, order_col]).groupBy(conv_col, "message_index").agg(
        F.min_by("_role", F.col(order_col)).alias("role"),
        F.expr(f"listagg(_text, '\\n') WITHIN GROUP (ORDER BY {order_col})").alias("content"),
        F.count(F.lit(1)).alias("n_parts"),
        F.min(order_col).alias("first_turn"))


def previous_visits(visits: DataFrame, session_col: str = "session_id", url_col: str = "url",
                    ts_col: str = "ts", tie_col: str = "event_id") -> DataFrame:
    """For each visit, seconds since the same session's latest earlier
    visit of the same URL (null when first)."""
    lagged = lag_values(visits, [session_col, url_col], [ts_col, tie_col], [ts_col])
    secs = (F.unix_micros(F.col(ts_col).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts_col}").cast("timestamp"))) / 1e6
    return lagged.select(session_col, url_col, tie_col, ts_col, secs.alias("seconds_since_previous_visit"))
