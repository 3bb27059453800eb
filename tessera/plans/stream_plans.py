"""Streaming queries (ST1-ST5) run to completion with availableNow triggers,
and the UDF-surface queries (X1-X3). Stream results land in parquet under
the shared checkpoint folder and are read back as the query result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.udf import batch_apply, register_typed, validate_calls
from ..sources.fixtures import answers, eval_tasks, steps
from ..sources.tables import read_table
from ..streaming import deltas as DL
from ..streaming import monitor as MON
from ..streaming import resume as RS
from ..streaming.source import run_available_now, stream_dirs, stream_table
from .oracle_views import with_answers, with_steps
from .registry import register
from ..functions.stubs import answer_chars, stub_answer
from .trace_plans import _messages_sql

DELTAS_SQL = """
WITH d AS (
  SELECT user_id AS run_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('view', 'click') THEN event_type || ' ' END AS content,
    CASE WHEN event_type IN ('purchase', 'error') THEN {
      'index': CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 2 AS INTEGER) END,
      'id': CASE WHEN k % 5 = 0 THEN 'call_' || CAST(k AS VARCHAR) END,
      'type': CASE WHEN k % 5 = 0 THEN 'function' END,
      'name': CASE WHEN k % 3 = 0 THEN event_type || '_tool' ELSE '' END,
      'arguments': '{' || CAST(k AS VARCHAR) || '}'} END AS tool_call,
    CASE WHEN event_type = 'signup' THEN CAST(k AS BIGINT) END AS input_tokens,
    CASE WHEN event_type = 'signup' THEN CAST(k % 7 AS BIGINT) END AS output_tokens
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
runs AS (SELECT run_id, coalesce(string_agg(content, '' ORDER BY seq), '') AS content,
                coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens,
                bool_or(tool_call IS NOT NULL AND tool_call['index'] IS NULL) AS bad
         FROM d GROUP BY run_id),
tc AS (SELECT run_id, seq, tool_call['index'] AS idx, tool_call['id'] AS id, tool_call['name'] AS name,
              tool_call['arguments'] AS arguments FROM d WHERE tool_call['index'] IS NOT NULL),
per_index AS (SELECT run_id, idx, min(seq) AS first_seq,
                     arg_max(id, seq) FILTER (WHERE id IS NOT NULL AND id <> '') AS id,
                     arg_max(name, seq) FILTER (WHERE name IS NOT NULL AND name <> '') AS name,
                     coalesce(string_agg(arguments, '' ORDER BY seq), '') AS arguments
              FROM tc GROUP BY run_id, idx),
calls AS (SELECT run_id, list({'index': idx, 'id': coalesce(id, ''), 'type': 'function', 'name': coalesce(name, ''),
                               'arguments': arguments} ORDER BY first_seq) AS tool_calls
          FROM per_index GROUP BY run_id)
SELECT r.run_id, r.content, coalesce(c.tool_calls, []) AS tool_calls, r.input_tokens, r.output_tokens,
       CASE WHEN r.bad THEN 'Tool call index is not provided in tool delta' END AS error
FROM runs r LEFT JOIN calls c USING (run_id)"""


@register("ST1_assemble_deltas_batch", DELTAS_SQL)
def deltas_batch(spark, sf_dir):
    return DL.assemble_batch(DL.deltas(spark, sf_dir))


def _latest_per_key(df, key: str, order: str = "batch_id"):
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", order)


def _to_parquet_by_batch(sink: str):
    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink)
    return write


@register("ST1_assemble_deltas_stream", DELTAS_SQL)
def deltas_stream(spark, sf_dir):
    # events arrive in several files, not in the order of their pieces, one file per batch
    events = read_table(spark, sf_dir, "events")
    folder, ckpt = stream_dirs(spark, "deltas")
    events.repartition(4, F.xxhash64("event_id") % 4).write.parquet(f"{folder}_inbox")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}_inbox")
    run_available_now(DL.start_assembly(DL.deltas_from_events(src), folder).option("checkpointLocation", ckpt))
    return DL.latest_messages(spark, folder)


def _steps_from(events_df):
    # the steps derivation of the fixture applied to a (streaming) events frame
    from ..sources import fixtures as FX
    return FX.steps_from_events(events_df)


@register("ST2_run_monitor_stream",
          with_steps("""SELECT run_id, count(*) AS n_steps, coalesce(sum(input_tokens), 0) AS total_input_tokens,
  coalesce(sum(output_tokens), 0) AS total_output_tokens, sum(duration) AS total_duration FROM steps GROUP BY run_id"""))
def monitor_stream(spark, sf_dir):
    st = _steps_from(stream_table(spark, sf_dir, "events"))
    sink, ckpt = stream_dirs(spark, "monitor")
    run_available_now(MON.monitor_stream(st).writeStream.outputMode("update")
                      .foreachBatch(_to_parquet_by_batch(sink)).option("checkpointLocation", ckpt))
    return _latest_per_key(spark.read.parquet(sink), "run_id")


@register("ST3_step_messages_stream", _messages_sql(False))
def display_stream(spark, sf_dir):
    st = _steps_from(stream_table(spark, sf_dir, "events"))
    sink, ckpt = stream_dirs(spark, "display")
    run_available_now(MON.display_stream(st).writeStream.outputMode("append").format("parquet")
                      .option("path", sink).option("checkpointLocation", ckpt))
    return spark.read.parquet(sink)


@register("ST5_X3_restartable_answering",
          with_answers("""SELECT question, CASE WHEN NOT ends_with(question, '7') THEN 'A:' || reverse(question) END AS answer,
  CASE WHEN ends_with(question, '7') THEN 'ValueError: agent gave up' END AS error FROM eval_tasks"""))
def restartable(spark, sf_dir):
    tasks = eval_tasks(spark, sf_dir)
    base, ckpt = stream_dirs(spark, "answering")
    inbox, sink = base + "_inbox", base + "_answers"
    # first run sees the first part of the task list, then the job "restarts"
    # with the same checkpoint and sink after the rest (and some repeats) arrive
    first = tasks.where(F.col("task_order") % 2 == 0)
    RS.write_question_files(first, inbox)
    src = spark.readStream.schema(RS.question_schema()).parquet(inbox)
    run_available_now(RS.start_answering(src, sink, ckpt, stub_answer))
    RS.write_question_files(tasks, inbox)  # everything again: repeats must be skipped
    src = spark.readStream.schema(RS.question_schema()).parquet(inbox)
    run_available_now(RS.start_answering(src, sink, ckpt, stub_answer))
    return spark.read.schema(RS.ANSWER_SCHEMA).parquet(sink)


@register("X1_registered_typed_udf",
          with_answers("SELECT task_id, length(prediction) AS n_chars FROM answers WHERE prediction IS NOT NULL"))
def typed_udf(spark, sf_dir):
    register_typed(spark, answer_chars, "answer_chars", vectorized=True)
    answers(spark, sf_dir).createOrReplaceTempView("answers_log")
    return spark.sql("SELECT task_id, answer_chars(prediction) AS n_chars FROM answers_log WHERE prediction IS NOT NULL")


# Declared tool arguments (a small parameter table).
TOOL_SPECS = [("view_tool", "k", "integer", False), ("click_tool", "k", "integer", False),
              ("click_tool", "page", "string", False), ("error_tool", "q", "string", False),
              ("error_tool", "k", "number", True)]


@register("X2_validate_tool_call_arguments",
          with_steps("""
, calls AS (SELECT event_id AS call_id, json_extract_string(j, '$.name') AS tool_name,
                   CAST(json_extract(j, '$.arguments') AS VARCHAR) AS arguments
            FROM (SELECT event_id, model_output AS j FROM steps WHERE starts_with(model_output, 'Action: {')) x),
calls2 AS (SELECT call_id, tool_name, arguments FROM (
             SELECT call_id, json_extract_string(substring(j2, strpos(j2, '{')), '$.name') AS tool_name,
                    CAST(json_extract(substring(j2, strpos(j2, '{')), '$.arguments') AS VARCHAR) AS arguments
             FROM (SELECT event_id AS call_id, model_output AS j2 FROM steps WHERE starts_with(model_output, 'Action: {')))),
spec AS (SELECT * FROM (VALUES ('view_tool', 'k', 'integer', false), ('click_tool', 'k', 'integer', false),
                               ('click_tool', 'page', 'string', false), ('error_tool', 'q', 'string', false),
                               ('error_tool', 'k', 'number', true)) t(tool_name, arg_name, arg_type, nullable)),
kinds AS (SELECT c.call_id, c.tool_name, s.arg_name, s.arg_type, s.nullable,
                 json_exists(c.arguments, '$.' || s.arg_name) AS present,
                 CASE json_type(c.arguments, '$.' || s.arg_name)
                   WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
                   WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
                   WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind
          FROM calls2 c JOIN spec s ON c.tool_name = s.tool_name)
SELECT call_id, tool_name, arg_name,
  CASE WHEN NOT present THEN CASE WHEN nullable THEN 'ok' ELSE 'missing' END
       WHEN kind = 'null' THEN CASE WHEN nullable THEN 'ok' ELSE 'null_not_allowed' END
       WHEN kind = arg_type OR arg_type = 'any' OR (arg_type = 'number' AND kind = 'integer') THEN 'ok'
       ELSE 'wrong_type' END AS status
FROM kinds
UNION ALL
SELECT c.call_id, c.tool_name, k.arg_name, 'unknown' AS status
FROM calls2 c, LATERAL (SELECT unnest(json_keys(c.arguments)) AS arg_name) k
WHERE NOT EXISTS (SELECT 1 FROM spec s WHERE s.tool_name = c.tool_name AND s.arg_name = k.arg_name)"""
                     .replace("\n, calls AS", "\n, calls_unused AS", 1)))
def validate(spark, sf_dir):
    from ..functions.text import tool_call_from_text
    st = steps(spark, sf_dir).where(F.col("model_output").startswith("Action: {"))
    calls = st.select(F.col("event_id").alias("call_id"), tool_call_from_text("model_output").alias("t")) \
              .select("call_id", F.col("t.name").alias("tool_name"), F.col("t.arguments").alias("arguments"))
    spec = spark.createDataFrame(TOOL_SPECS, "tool_name string, arg_name string, arg_type string, nullable boolean")
    return validate_calls(calls, spec)


@register("X3_batch_apply_answering_function",
          with_answers("""SELECT question, CASE WHEN NOT ends_with(question, '7') THEN 'A:' || reverse(question) END AS answer,
  CASE WHEN ends_with(question, '7') THEN 'ValueError: agent gave up' END AS error FROM (SELECT DISTINCT question FROM answers)"""))
def batch_answer(spark, sf_dir):
    qs = answers(spark, sf_dir).select("question").distinct()
    return batch_apply(qs, stub_answer, "question")
