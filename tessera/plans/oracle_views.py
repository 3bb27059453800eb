"""DuckDB (ANSI) definitions of the derived fact tables, used by oracle SQL.

They restate ``tessera.sources.fixtures`` in SQL so the driver can check every
Spark query against an independent engine on the same parquet tables.
"""

BACKTEST_CTE = """
bt_cust AS (
  SELECT c.c_custkey, c.c_acctbal, r.r_name
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
bt_orig AS (
  SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS origination_date
  FROM orders GROUP BY o_custkey
),
backtest_base AS (
  SELECT
    o.o_custkey AS account_id,
    CAST(date_trunc('month', o.o_orderdate) AS DATE) AS statement_month,
    CAST(CAST(date_trunc('month', o.o_orderdate) AS DATE) + to_months(CAST(l.l_linenumber AS INTEGER)) AS DATE) AS performance_month,
    CAST(l.l_linenumber AS INTEGER) AS horizon,
    p.p_type AS product_type,
    o.o_orderpriority AS risk_segment,
    bc.r_name AS geography,
    bc.c_acctbal AS credit_limit,
    bo.origination_date,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS actual_payment,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
         * (1 + CAST(l.l_tax AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS predicted_payment,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
         * (1 + (CAST(l.l_tax AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) * CAST(0.5 AS DECIMAL(2,1))) AS DECIMAL(18,4)) AS predicted_payment_r2,
    CAST(l.l_quantity AS DECIMAL(18,2)) AS actual_purchase_volume,
    CAST(CAST(l.l_quantity AS DECIMAL(18,2))
         * (1 + (l.l_linenumber - 4) * CAST(0.01 AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS predicted_purchase_volume,
    CAST(o.o_totalprice AS DECIMAL(18,2)) AS actual_eos,
    CAST(CAST(o.o_totalprice AS DECIMAL(18,2))
         * (1 + CAST(l.l_tax AS DECIMAL(4,2)) - CAST(0.04 AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS predicted_eos
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN bt_cust bc ON o.o_custkey = bc.c_custkey
  LEFT JOIN bt_orig bo ON o.o_custkey = bo.o_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
backtest AS (
  SELECT * EXCLUDE (predicted_payment_r2) FROM backtest_base
),
backtest_rounds AS (
  SELECT 1 AS round, * EXCLUDE (predicted_payment_r2) FROM backtest_base
  UNION ALL BY NAME
  SELECT 2 AS round, * EXCLUDE (predicted_payment, predicted_payment_r2),
         predicted_payment_r2 AS predicted_payment FROM backtest_base
)
"""


def with_backtest(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the backtest CTEs (plus more CTEs if given,
    each starting with a comma)."""
    return "WITH " + BACKTEST_CTE.strip() + extra_ctes.rstrip() + "\n" + body


# ---- answers (SQL twin of tessera.sources.fixtures.answers) ----------------------
ANSWERS_CTE = """
ans_base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE user_id % 4
      WHEN 0 THEN CAST(user_id * 37 + 1000 AS VARCHAR)
      WHEN 1 THEN 'Blue sky-' || CAST(user_id AS VARCHAR)
      WHEN 2 THEN CAST(user_id AS VARCHAR) || ', red; ' || CAST(user_id * 2 AS VARCHAR)
      ELSE CAST(user_id AS VARCHAR) || '.5' END AS true_answer
  FROM events
),
answers AS (
  SELECT
    event_id AS task_id,
    'agent_' || event_type AS agent_name,
    'org' || CAST(user_id % 2 AS VARCHAR) || '/model-' || CAST(k % 3 AS VARCHAR) AS model_id,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 'code' ELSE 'tool-calling' END AS agent_action_type,
    CASE user_id % 4 WHEN 0 THEN 'MATH' WHEN 1 THEN 'SimpleQA' ELSE 'GAIA' END AS source,
    'L' || CAST(user_id % 3 + 1 AS VARCHAR) AS task,
    'Q' || CAST(user_id AS VARCHAR) AS question,
    true_answer,
    list_transform(range(1, k % 5 + 2), lambda i: {
      'step_number': CAST(i AS INTEGER),
      'error_type': CASE WHEN (k + i) % 4 = 0 THEN 'AgentParsingError'
                         WHEN (k + i) % 7 = 0 THEN 'AgentExecutionError' END,
      'llm_output': 'r = ' || CASE WHEN (k + i) % 3 = 0 THEN 'web_search' WHEN (k + i) % 3 = 1 THEN 'visit_page'
                                   ELSE 'Inspect' END || '(q' || CAST(i AS VARCHAR) || ')' || chr(10) || 'print(r)'
    }) AS intermediate_steps,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_time,
    strftime(make_timestamp((epoch_us(ts) // 1000000 + CAST(trunc(value * 10) AS BIGINT)) * 1000000),
             '%Y-%m-%d %H:%M:%S') AS end_time,
    CASE k % 4 WHEN 1 THEN 'doc' || CAST(k AS VARCHAR) || '.pdf'
               WHEN 2 THEN 'img' || CAST(k AS VARCHAR) || '.png'
               WHEN 3 THEN 'audio' || CAST(k AS VARCHAR) || '.mp3' ELSE '' END AS file_name,
    {'input_tokens': CAST(trunc(value * 100) AS BIGINT), 'output_tokens': CAST(k AS BIGINT)} AS token_counts,
    CASE k % 6
      WHEN 0 THEN true_answer
      WHEN 1 THEN CASE user_id % 4
                    WHEN 0 THEN 'We get ' || substring(true_answer, 1, length(true_answer) - 3) || ','
                                || substring(true_answer, length(true_answer) - 2) || '.'
                    WHEN 1 THEN upper(true_answer)
                    WHEN 2 THEN replace(true_answer, ', ', ' ,')
                    ELSE '$' || true_answer END
      WHEN 2 THEN true_answer || '7'
      WHEN 3 THEN NULL
      WHEN 4 THEN 'Unable to determine'
      ELSE substring(true_answer, 1, length(true_answer) - 1) END AS prediction
  FROM ans_base
),
eval_tasks AS (
  SELECT user_id AS task_order, 'Q' || CAST(user_id AS VARCHAR) AS question,
         CASE WHEN ext = '' THEN '' ELSE 'file' || CAST(user_id AS VARCHAR) || ext END AS file_name
  FROM (SELECT DISTINCT user_id, (['', '.pdf', '.png', '.mp3', '.xlsx', '.jpg', '.zip'])[user_id % 7 + 1] AS ext FROM events)
)
"""

# Column expressions of the scorer in DuckDB SQL, mirroring tessera.functions.scoring.
# White space of Python's str methods, spelt out (RE2's \\s is ASCII only).
WS_SQL = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_D = r"\d(?:_?\d)*"
FLOAT_RE = (rf"^{WS_SQL}*[+-]?(?:(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?"
            rf"|(?i:inf|infinity|nan)){WS_SQL}*$")


def sql_is_float(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{FLOAT_RE}'), false)"


def sql_to_float(x: str) -> str:
    return f"CASE WHEN {sql_is_float(x)} THEN TRY_CAST(regexp_replace({x}, '_|{WS_SQL}', '', 'g') AS DOUBLE) END"


def sql_norm_number(x: str) -> str:
    return f"coalesce({sql_to_float(f'translate({x}, {chr(39)}$%,{chr(39)}, {chr(39)}{chr(39)})')}, CAST('inf' AS DOUBLE))"


PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def sql_norm_str(x: str, remove_punct: bool = True) -> str:
    out = f"lower(regexp_replace({x}, '{WS_SQL}', '', 'g'))"
    return f"translate({out}, {PUNCT_SQL}, '')" if remove_punct else out


def sql_question_scorer(ma: str, gt: str) -> str:
    g, m = f"regexp_split_to_array({gt}, '[,;]')", f"regexp_split_to_array({ma}, '[,;]')"
    elem = (f"list_bool_and(list_transform(range(1, len({g}) + 1), lambda i: coalesce(CASE WHEN {sql_is_float(f'{g}[i]')} "
            f"THEN {sql_norm_number(f'{m}[i]')} = {sql_to_float(f'{g}[i]')} "
            f"ELSE {sql_norm_str(f'{m}[i]', False)} = {sql_norm_str(f'{g}[i]', False)} END, false)))")
    return (f"CASE WHEN {sql_is_float(gt)} THEN {sql_norm_number(ma)} = {sql_to_float(gt)} "
            f"WHEN regexp_matches({gt}, '[,;]') THEN (len({g}) = len({m}) AND {elem}) "
            f"ELSE {sql_norm_str(ma)} = {sql_norm_str(gt)} END")


NUMBER_RE = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def sql_math_scorer(ans: str, truth: str) -> str:
    nums = f"list_transform(regexp_extract_all({ans}, '{NUMBER_RE}'), lambda x: replace(x, ',', ''))"
    last = f"TRY_CAST(({nums})[-1] AS DOUBLE)"
    b = sql_to_float(truth)
    return (f"CASE WHEN len({nums}) = 0 THEN false ELSE coalesce(abs({last} - {b}) <= 1e-7 + 1e-5 * abs({b}), false) END")


def sql_close_call(p: str, t: str, ok: str) -> str:
    pos = (f"list_reduce(string_split(lower({t}), ''), lambda acc, ch: CASE WHEN acc = 0 THEN 0 "
           f"ELSE CASE WHEN strpos(substring(lower({p}), acc), ch) = 0 THEN 0 "
           f"ELSE acc + strpos(substring(lower({p}), acc), ch) - 1 END END, 1)")
    near = (f"(length({p}) <= length({t}) * 3 AND (length({t}) = 0 OR {pos} > 0) "
            f"AND length({p}) >= length({t}) * 0.5 AND length({p}) <= length({t}) * 2)")
    return f"CASE WHEN {ok} THEN true WHEN {sql_is_float(t)} THEN false ELSE {near} END"


SCORED_CTE = f"""
scored0 AS (SELECT * REPLACE (coalesce(prediction, 'No prediction') AS prediction) FROM answers),
scored1 AS (SELECT *, CASE WHEN source = 'MATH' THEN {sql_math_scorer('prediction', 'true_answer')}
                           ELSE {sql_question_scorer('prediction', 'true_answer')} END AS is_correct FROM scored0),
scored AS (SELECT *, {sql_close_call('prediction', 'true_answer', 'is_correct')} AS is_near_correct FROM scored1)
"""


def with_answers(body: str, extra_ctes: str = "") -> str:
    return "WITH " + ANSWERS_CTE.strip() + ",\n" + SCORED_CTE.strip() + extra_ctes.rstrip() + "\n" + body


STEPS_CTE = """
st_base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type IN ('view', 'click', 'error') THEN 'action'
              WHEN event_type = 'purchase' THEN 'planning' ELSE 'task' END AS step_type
  FROM events
),
st_base2 AS (
  SELECT *,
    CASE WHEN k % 5 = 0 THEN 'import math' || chr(10) WHEN k % 7 = 0 THEN 'import os.path' || chr(10)
         WHEN k % 11 = 0 THEN 'from collections import Counter' || chr(10) ELSE '' END
      || 'result = ' || event_type || '_tool(' || CAST(k AS VARCHAR) || ')' || chr(10) || 'print(result)' AS code_body,
    CASE k % 3 WHEN 0 THEN 'AgentMaxStepsError' WHEN 1 THEN 'AgentExecutionError' ELSE 'AgentParsingError' END AS err,
    step_type IN ('action', 'planning') AND k % 10 <> 0 AS has_usage
  FROM st_base
),
steps AS (
  SELECT user_id AS run_id, CAST(trunc(user_id / 5) AS BIGINT) AS root_run_id, event_id, ts, step_type,
    value AS duration,
    CASE WHEN has_usage THEN CAST(trunc(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN has_usage THEN CAST(k AS BIGINT) END AS output_tokens,
    CASE WHEN step_type = 'action' THEN
      CASE k % 4 WHEN 0 THEN 'Thought: check ' || event_type || chr(10) || '<code>' || chr(10) || code_body || chr(10) || '</code>'
                 WHEN 1 THEN 'Thought: fenced' || chr(10) || '```python' || chr(10) || code_body || chr(10) || '```'
                 WHEN 2 THEN 'Action: {"name": "' || event_type || '_tool", "arguments": {"k": ' || CAST(k AS VARCHAR) || '}}'
                 ELSE 'final answer pending for ' || event_type END END AS model_output,
    CASE WHEN step_type = 'action' AND k % 4 < 2 THEN code_body END AS code_action,
    CASE WHEN step_type = 'action' THEN 'Observed k=' || CAST(k AS VARCHAR) || CASE WHEN k % 9 = 0
      THEN chr(10) || 'Agent stopped due to iteration limit or time limit.' ELSE '' END END AS observations,
    CASE WHEN step_type = 'action' AND k % 6 = 0
      THEN list_transform(range(1, k % 2 + 2), lambda i: 'shot' || CAST(i AS VARCHAR) || '.png') END AS observation_images,
    CASE WHEN event_type = 'error' THEN err END AS error_type,
    CASE WHEN event_type = 'error' THEN err || ': step ' || CAST(event_id AS VARCHAR) || ' failed' END AS error_message,
    CASE WHEN step_type = 'action' THEN list_transform(range(1, k % 3 + 2), lambda i: {
        'id': 'call_' || CAST((k * 7 + i) % 10 AS VARCHAR), 'name': event_type || '_tool',
        'arguments': '{''q'': ' || CAST(i AS VARCHAR) || '}', 'output': 'out ' || CAST(i AS VARCHAR) || '  '}) END AS tool_calls,
    CASE WHEN step_type = 'planning' THEN 'Plan: buy ' || CAST(k AS VARCHAR) || ' items ' END AS plan,
    CASE WHEN step_type = 'task' THEN 'Sign up user ' || CAST(user_id AS VARCHAR) END AS task,
    k % 13 = 0 AS is_final_answer
  FROM st_base2
)
"""


def with_steps(body: str, extra_ctes: str = "") -> str:
    return "WITH " + STEPS_CTE.strip() + extra_ctes.rstrip() + "\n" + body


RECEIPTS_CTE = """
receipts AS (
  SELECT o.o_orderkey AS receipt_id, c.c_name AS customer_name, o.o_totalprice AS price,
         coalesce(t.tip, CAST(0 AS DECIMAL(18,2))) AS tip
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS tip
             FROM lineitem GROUP BY l_orderkey) t ON o.o_orderkey = t.l_orderkey
),
waiters AS (
  SELECT l.l_orderkey AS receipt_id, min(s.s_name) AS waiter_name
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE l.l_linenumber = 1 GROUP BY l.l_orderkey
)
"""


def with_receipts(body: str) -> str:
    return "WITH " + RECEIPTS_CTE.strip() + "\n" + body
