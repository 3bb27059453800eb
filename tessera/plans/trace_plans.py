"""Run trace, message and text-function queries (family C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import traces as TR
from ..sources.fixtures import answers, steps
from ..sources.tables import read_table
from .oracle_views import WS_SQL, with_answers, with_steps
from .registry import register

W_RUN = "PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"


@register("W4_cumulative_tokens_per_run",
          with_steps(f"""SELECT run_id, event_id, count(*) OVER w AS step_index, duration,
  sum(coalesce(input_tokens, 0)) OVER w AS total_input_tokens,
  sum(coalesce(output_tokens, 0)) OVER w AS total_output_tokens
FROM steps WINDOW w AS ({W_RUN})"""))
def cumulative(spark, sf_dir):
    return TR.cumulative_tokens(steps(spark, sf_dir))


@register("ST2_run_monitor_batch",
          with_steps("""SELECT run_id, count(*) AS n_steps, coalesce(sum(input_tokens), 0) AS total_input_tokens,
  coalesce(sum(output_tokens), 0) AS total_output_tokens, sum(duration) AS total_duration FROM steps GROUP BY run_id"""))
def monitor(spark, sf_dir):
    return TR.run_monitor(steps(spark, sf_dir))


RUN_TOKENS_SQL = """SELECT r.run_id,
  CASE WHEN bool_and(s.event_id IS NULL OR s.input_tokens IS NOT NULL) THEN coalesce(sum(s.input_tokens), 0) END AS input_tokens,
  CASE WHEN bool_and(s.event_id IS NULL OR s.input_tokens IS NOT NULL) THEN coalesce(sum(s.output_tokens), 0) END AS output_tokens
FROM (SELECT DISTINCT run_id FROM steps) r
LEFT JOIN (SELECT * FROM steps WHERE step_type IN ('action', 'planning')) s ON r.run_id = s.run_id GROUP BY r.run_id"""


@register("A46_run_token_totals", with_steps(RUN_TOKENS_SQL))
def run_tokens(spark, sf_dir):
    return TR.run_token_usage(steps(spark, sf_dir))


@register("A47_A49_run_state",
          with_steps("""SELECT run_id,
  CASE WHEN max(CASE WHEN rn = 1 AND error_type = 'AgentMaxStepsError' THEN 1 ELSE 0 END) = 1
       THEN 'max_steps_error' ELSE 'success' END AS state,
  coalesce(bool_or(error_type = 'AgentParsingError'), false) AS parsing_error,
  coalesce(bool_or(rn = 1 AND contains(observations, 'iteration limit or time limit')), false) AS iteration_limit_exceeded
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM steps)
GROUP BY run_id"""))
def state(spark, sf_dir):
    return TR.run_state(steps(spark, sf_dir))


@register("A48_team_token_rollup",
          with_steps("""SELECT root_run_id, sum(coalesce(input_tokens, 0)) AS input_tokens,
  sum(coalesce(output_tokens, 0)) AS output_tokens, count(DISTINCT run_id) AS n_runs FROM steps GROUP BY root_run_id"""))
def team(spark, sf_dir):
    return TR.team_token_rollup(steps(spark, sf_dir))


@register("A50_full_code_per_run",
          with_steps("""SELECT run_id, string_agg(code_action, chr(10) || chr(10) ORDER BY ts, event_id) AS code
FROM steps WHERE code_action IS NOT NULL GROUP BY run_id"""))
def full_code(spark, sf_dir):
    return TR.run_full_code(steps(spark, sf_dir))


@register("A51_step_tool_outputs",
          with_steps("""SELECT run_id, event_id,
  regexp_replace(array_to_string(list_transform(list_sort(tool_calls), lambda t: t.output || chr(10)), ''),
                 '\\n+$', '') AS observations
FROM steps WHERE tool_calls IS NOT NULL"""))
def tool_outputs(spark, sf_dir):
    return TR.step_tool_outputs(steps(spark, sf_dir))


def _messages_sql(summary: bool) -> str:
    ns = "false" if summary else "true"
    retry = TR.RETRY_NOTE.replace("'", "''").replace("\n", "' || chr(10) || '")
    return with_steps(f"""SELECT run_id, ts, event_id, m.msg_ord, m.role, m.text FROM (
  SELECT run_id, ts, event_id, unnest(list_filter([
    CASE WHEN step_type = 'action' AND {ns} AND model_output IS NOT NULL
         THEN {{'msg_ord': 0, 'role': 'assistant', 'text': regexp_replace(model_output, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')}} END,
    CASE WHEN step_type = 'action' AND tool_calls IS NOT NULL
         THEN {{'msg_ord': 1, 'role': 'tool-call', 'text': 'Calling tools:' || chr(10) || '[' || array_to_string(
           list_transform(tool_calls, lambda t: '{{''id'': ''' || t.id || ''', ''type'': ''function'', ''function'': {{''name'': '''
             || t.name || ''', ''arguments'': ' || t.arguments || '}}}}'), ', ') || ']'}} END,
    CASE WHEN step_type = 'action' AND observation_images IS NOT NULL AND len(observation_images) > 0
         THEN {{'msg_ord': 2, 'role': 'user', 'text': array_to_string(observation_images, chr(10))}} END,
    CASE WHEN step_type = 'action' AND observations IS NOT NULL
         THEN {{'msg_ord': 3, 'role': 'tool-response', 'text': 'Observation:' || chr(10) || observations}} END,
    CASE WHEN step_type = 'action' AND error_message IS NOT NULL
         THEN {{'msg_ord': 4, 'role': 'tool-response', 'text':
           CASE WHEN tool_calls IS NOT NULL AND len(tool_calls) > 0 THEN 'Call id: ' || tool_calls[1].id || chr(10) ELSE '' END
           || 'Error:' || chr(10) || error_message || '{retry}'}} END,
    CASE WHEN step_type = 'planning' AND {ns} THEN {{'msg_ord': 5, 'role': 'assistant', 'text': regexp_replace(plan, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')}} END,
    CASE WHEN step_type = 'planning' AND {ns} THEN {{'msg_ord': 6, 'role': 'user', 'text': '{TR.PLAN_FOLLOW_UP}'}} END,
    CASE WHEN step_type = 'task' THEN {{'msg_ord': 7, 'role': 'user', 'text': 'New task:' || chr(10) || task}} END
  ], lambda x: x IS NOT NULL)) AS m FROM steps) s""")


@register("F23_step_messages", _messages_sql(False))
def messages(spark, sf_dir):
    return TR.step_messages(steps(spark, sf_dir))


@register("F23_step_messages_summary_mode", _messages_sql(True))
def messages_summary(spark, sf_dir):
    return TR.step_messages(steps(spark, sf_dir), summary_mode=True)


@register("F24_succinct_steps",
          with_steps("SELECT run_id, event_id, step_type, input_tokens, output_tokens FROM steps"))
def succinct(spark, sf_dir):
    # the model's input messages: what the run's steps said before, here their own outputs
    full = steps(spark, sf_dir).withColumn("model_input_messages", F.array("model_output", "observations"))
    return TR.succinct_steps(full).select("run_id", "event_id", "step_type", "input_tokens", "output_tokens")


@register("W3_merge_consecutive_messages",
          """SELECT conv_id, message_index, any_value(role) AS role,
  string_agg(text, chr(10) ORDER BY turn) AS content, count(*) AS n_parts, min(turn) AS first_turn
FROM (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS message_index
      FROM (SELECT conv_id, turn, text, r AS role,
                   CASE WHEN lag(r) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL
                          OR lag(r) OVER (PARTITION BY conv_id ORDER BY turn) <> r THEN 1 ELSE 0 END AS chg
            FROM (SELECT *, CASE role WHEN 'tool-call' THEN 'assistant' WHEN 'tool-response' THEN 'user' ELSE role END AS r
                  FROM conversations)))
GROUP BY conv_id, message_index""")
def merge_messages(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return TR.merge_consecutive_messages(conv)


def _visits(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    n_pages = pages.count()  # one number; visits map event_id onto a page by pmod
    return ev.join(pages, F.pmod(ev.event_id, F.lit(n_pages)) == pages.page_id).select(
        F.col("user_id").alias("session_id"), "url", "ts", "event_id")


@register("W5_previous_visit_seconds",
          """SELECT session_id, url, event_id, ts,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id, url ORDER BY ts, event_id))) / 1e6
    AS seconds_since_previous_visit
FROM (SELECT e.user_id AS session_id, p.url, e.ts, e.event_id FROM events e
      JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)) v""")
def previous_visit(spark, sf_dir):
    return TR.previous_visits(_visits(spark, sf_dir))


@register("A53_final_answer_checks",
          with_answers("""SELECT task_id, prediction, CASE
  WHEN NOT coalesce(prediction IS NOT NULL AND length(prediction) > 0, false) THEN 'non_empty'
  WHEN NOT coalesce(NOT contains(prediction, 'Unable'), false) THEN 'not_a_refusal'
  WHEN NOT coalesce(length(prediction) <= 12, false) THEN 'short_enough' END AS failed_check FROM answers"""))
def answer_checks(spark, sf_dir):
    p = F.col("prediction")
    checks = [("non_empty", p.isNotNull() & (F.length(p) > 0)),
              ("not_a_refusal", ~p.contains("Unable")),
              ("short_enough", F.length(p) <= 12)]
    return TR.final_answer_checks(answers(spark, sf_dir).select("task_id", "prediction"), "prediction", checks)


# ---- text functions -------------------------------------------------------------------

def _blob_sql(x: str) -> dict:
    first = f"strpos({x}, '{{')"
    last = f"CASE WHEN strpos(reverse({x}), '}}') > 0 THEN length({x}) - strpos(reverse({x}), '}}') + 1 ELSE 0 END"
    blob = f"CASE WHEN ({last}) >= {first} THEN substring({x}, {first}, ({last}) - {first} + 1) ELSE '' END"
    status = (f"CASE WHEN {x} IS NULL THEN NULL WHEN {first} = 0 OR ({last}) = 0 THEN 'no_blob' "
              f"WHEN json_valid({blob}) THEN 'ok' ELSE 'invalid_json' END")
    return {"blob": blob, "status": status, "prefix": f"CASE WHEN {first} > 0 THEN substring({x}, 1, {first} - 1) END"}


_B = _blob_sql("model_output")


@register("F15_parse_json_blobs",
          with_steps(f"""SELECT event_id, CASE WHEN ({_B['status']}) = 'ok' THEN {_B['blob']} END AS json,
  {_B['prefix']} AS prefix, {_B['status']} AS status FROM steps WHERE model_output IS NOT NULL"""))
def json_blobs(spark, sf_dir):
    st = steps(spark, sf_dir).where(F.col("model_output").isNotNull())
    return st.select("event_id", TX.parse_json_blob("model_output").alias("p")).select("event_id", "p.*")


@register("F16_tool_calls_from_text",
          with_steps(f"""SELECT event_id, json_extract_string(j, '$.name') AS name,
  CAST(json_extract(j, '$.arguments') AS VARCHAR) AS arguments,
  CASE WHEN s <> 'ok' THEN s WHEN json_extract_string(j, '$.name') IS NULL THEN 'missing_name' ELSE 'ok' END AS status
FROM (SELECT event_id, CASE WHEN ({_B['status']}) = 'ok' THEN {_B['blob']} END AS j, {_B['status']} AS s
      FROM steps WHERE model_output IS NOT NULL) x"""))
def tool_calls(spark, sf_dir):
    st = steps(spark, sf_dir).where(F.col("model_output").isNotNull())
    return st.select("event_id", TX.tool_call_from_text("model_output").alias("t")).select("event_id", "t.*")


# one text for each event: repeated keys and a raw escape character; two calls in one
# text; NaN and a run of 2 x event_id % 29 backslashes; quotes that JSON does not have
@register("F15_F16_lenient_tool_calls",
          """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || chr(27) WHEN 2 THEN 'pad' END AS name,
  CASE event_id % 4 WHEN 0 THEN '{"id":' || event_id || '}' WHEN 2 THEN 'NaN' END AS arguments,
  CASE event_id % 4 WHEN 1 THEN 'multiple_tool_calls' WHEN 3 THEN 'invalid_json' ELSE 'ok' END AS status FROM events""")
def lenient_calls(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    k, escape = F.col("event_id") % 4, F.lit("\x1b")
    text = (F.when(k == 0, F.concat(F.lit('Call {"name": "'), F.lower("event_type"), F.lit('", "arguments": 1, "name": "'), "event_type", escape,
                                    F.lit('",\n "arguments": {"id": '), "event_id", F.lit("}}")))
            .when(k == 1, F.concat(F.lit('{"name": "'), "event_type", F.lit('"},\n{"name": "'), "event_type", F.lit('"}')))
            .when(k == 2, F.concat(F.lit('{"x": "'), F.repeat(F.lit("\\\\"), (F.col("event_id") % 29).cast("int")),
                                   F.lit('", "name": "pad", "arguments": NaN}')))
            .otherwise(F.concat(F.lit("{'name': '"), "event_type", F.lit("'}"))))
    return ev.select("event_id", TX.tool_call_from_text(text).alias("t")).select("event_id", "t.*")


def _blocks_sql(pattern: str) -> str:
    found = f"list_transform(regexp_extract_all(model_output, '{pattern}', 1), lambda b: regexp_replace(b, '^{WS_SQL}+|{WS_SQL}+$', '', 'g'))"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, chr(10) || chr(10)) END"


_BLOCKS = f"coalesce({_blocks_sql('(?s)<code>(.*?)</code>')}, {_blocks_sql('(?s)```(?:python|py)(.*?)' + chr(10) + '```')})"


# without a block, a text of these steps is an annotated name (it parses as Python) or prose
@register("F17_extract_code",
          with_steps(f"""SELECT event_id,
  CASE WHEN b IS NOT NULL AND b <> '' THEN b WHEN starts_with(model_output, 'Action: {{') THEN model_output END AS code,
  CASE WHEN (b IS NOT NULL AND b <> '') OR starts_with(model_output, 'Action: {{') THEN 'ok'
       WHEN contains(model_output, 'final') AND contains(model_output, 'answer') THEN 'final_answer_hint' ELSE 'no_code' END AS status
FROM (SELECT event_id, model_output, {_BLOCKS} AS b FROM steps WHERE model_output IS NOT NULL) x"""))
def extract_code(spark, sf_dir):
    st = steps(spark, sf_dir).where(F.col("model_output").isNotNull())
    return st.select("event_id", TX.extract_code("model_output").alias("c")).select("event_id", "c.*")


MIDDLE_N = 2000
MARK = TX.TRUNCATION_MARKER.format(n=MIDDLE_N).replace("\n", "' || chr(10) || '")


@register("F18_truncate_documents_middle",
          f"""SELECT doc_id, CASE WHEN length(text) <= {MIDDLE_N} THEN text
  ELSE substring(text, 1, {MIDDLE_N // 2}) || '{MARK}' || right(text, {-(-MIDDLE_N // 2)}) END AS text FROM documents""")
def truncate_middle(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", TX.truncate_middle("text", MIDDLE_N).alias("text"))


TAIL_N = 500
TMARK = TX.TRUNCATION_MARKER.format(n=TAIL_N).replace("\n", "' || chr(10) || '")


@register("F19_truncate_pages_tail",
          f"""SELECT page_id, CASE WHEN length(html) <= {TAIL_N} THEN html
  ELSE substring(html, 1, {TAIL_N}) || '{TMARK}' END AS html FROM pages""")
def truncate_tail(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return p.select("page_id", TX.truncate_tail("html", TAIL_N).alias("html"))


STOPS = [". ", "\n"]


@register("F20_cut_at_stop_sequences",
          "SELECT conv_id, turn, split_part(split_part(text, '. ', 1), chr(10), 1) AS text FROM conversations")
def stop_sequences(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", TX.cut_at_stop_sequences("text", STOPS).alias("text"))


_IMPORTS_SQL = (f"list_distinct(list_transform(list_filter(regexp_extract_all(c, '{TX.IMPORT_PATTERN}', 1) || "
                f"regexp_extract_all(c, '{TX.FROM_IMPORT_PATTERN}', 1), lambda n: NOT starts_with(n, '.')), "
                f"lambda n: CASE WHEN split_part(n, '.', 1) = 'wikipediaapi' THEN 'wikipedia-api' ELSE split_part(n, '.', 1) END))")


@register("F21_import_usage_counts",
          with_steps(f"""SELECT package, count(*) AS n_code_actions FROM (
  SELECT unnest({_IMPORTS_SQL}) AS package FROM (
    SELECT regexp_replace(code_action, '{TX.TRY_BLOCK_PATTERN}', '', 'g') AS c FROM steps WHERE code_action IS NOT NULL))
GROUP BY package"""))
def import_usage(spark, sf_dir):
    st = steps(spark, sf_dir).where(F.col("code_action").isNotNull())
    return st.select(F.explode(TX.code_imports("code_action")).alias("package")).groupBy("package").agg(
        F.count(F.lit(1)).alias("n_code_actions"))


AUTHORIZED = ["math", "collections.*", "os"]


@register("F22_import_policy_audit",
          with_steps(f"""SELECT module, count(*) AS n_uses,
  list_contains(['math', 'collections.*', 'os'], '*')
  OR len(list_filter(range(1, len(string_split(module, '.'))), lambda i:
       list_contains(['math', 'collections.*', 'os'], array_to_string(string_split(module, '.')[1:i], '.') || '.*'))) > 0
  OR len(list_filter(['math', 'collections.*', 'os'], lambda a: a = module OR starts_with(a, module || '.'))) > 0
    AS authorized
FROM (SELECT unnest(list_distinct(regexp_extract_all(c, '{TX.IMPORT_PATTERN}', 1) ||
                                  regexp_extract_all(c, '{TX.FROM_IMPORT_PATTERN}', 1))) AS module
      FROM (SELECT regexp_replace(code_action, '{TX.TRY_BLOCK_PATTERN}', '', 'g') AS c FROM steps
            WHERE code_action IS NOT NULL))
GROUP BY module"""))
def import_audit(spark, sf_dir):
    st = steps(spark, sf_dir).where(F.col("code_action").isNotNull())
    mods = st.select(F.explode(TX.code_import_paths("code_action")).alias("module"))
    return mods.groupBy("module").agg(F.count(F.lit(1)).alias("n_uses")).withColumn(
        "authorized", TX.import_authorized("module", AUTHORIZED))
