"""Run, message and stream-delta operators on literal rows."""

import datetime as dt

from tessera.operators import traces as TR
from tessera.streaming import deltas as DL


def test_merge_messages_with_role_conversion(spark):
    rows = [(1, 0, "tool-call", "call"), (1, 1, "tool-response", "resp"), (1, 2, "user", "more"),
            (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted((r["message_index"], r["role"], r["content"]) for r in TR.merge_consecutive_messages(df).collect())
    assert out == [(1, "assistant", "call"), (2, "user", "resp\nmore"), (3, "assistant", "a1\na2")]


def _steps(spark, rows):
    schema = ("run_id long, root_run_id long, event_id long, ts timestamp, step_type string, duration double, "
              "input_tokens long, output_tokens long, error_type string, code_action string")
    return spark.createDataFrame(rows, schema)


def test_run_tokens_and_state(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 1, t, "action", 1.0, 10, 20, None, "a = 1"),
            (1, 0, 2, t + dt.timedelta(seconds=1), "action", 1.0, 10, 20, "AgentMaxStepsError", "b = 2"),
            (2, 0, 3, t, "action", 1.0, None, None, None, None)]
    st = _steps(spark, rows)
    tok = {r["run_id"]: (r["input_tokens"], r["output_tokens"]) for r in TR.run_token_usage(st).collect()}
    assert tok == {1: (20, 40), 2: (None, None)}
    state = {r["run_id"]: r["state"] for r in TR.run_state(st).collect()}
    assert state == {1: "max_steps_error", 2: "success"}
    code = {r["run_id"]: r["code"] for r in TR.run_full_code(st).collect()}
    assert code == {1: "a = 1\n\nb = 2"}
    cum = sorted((r["event_id"], r["step_index"], r["total_input_tokens"]) for r in TR.cumulative_tokens(st).collect())
    assert cum == [(1, 1, 10), (2, 2, 20), (3, 1, 0)]


def test_delta_assembly_example(spark):
    tc = lambda args: {"index": 0, "id": None, "type": "function", "name": "web_search", "arguments": args}
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t, "Hi", tc(""), None, None), (1, 2, t, " everyone", tc(' {"'), None, None),
            (1, 3, t, ", it's", tc('query": "current pope name and date of birth"}'), None, None),
            (1, 4, t, "", None, 1348, 24)]
    df = spark.createDataFrame(rows, DL.DELTA_SCHEMA)
    out = DL.assemble_batch(df).first()
    assert out["content"] == "Hi everyone, it's"
    assert out["tool_calls"][0]["arguments"] == ' {"query": "current pope name and date of birth"}'
    assert out["input_tokens"] + out["output_tokens"] == 1372
    assert out["error"] is None


def test_step_messages_roles(spark):
    t = dt.datetime(2024, 1, 1)
    schema = ("run_id long, ts timestamp, event_id long, step_type string, model_output string, "
              "tool_calls array<struct<id:string,name:string,arguments:string,output:string>>, observations string, "
              "error_message string, plan string, task string")
    rows = [(1, t, 1, "task", None, None, None, None, None, "Do it"),
            (1, t, 2, "planning", None, None, None, None, " plan ", None),
            (1, t, 3, "action", " out ", [{"id": "c1", "name": "f", "arguments": "{'a': 1}", "output": "o"}],
             "seen", "boom", None, None)]
    df = spark.createDataFrame(rows, schema)
    msgs = [(r["event_id"], r["msg_ord"], r["role"], r["text"]) for r in TR.step_messages(df).orderBy("event_id", "msg_ord").collect()]
    assert [m[2] for m in msgs] == ["user", "assistant", "user", "assistant", "tool-call", "tool-response", "tool-response"]
    assert msgs[0][3] == "New task:\nDo it" and msgs[3][3] == "out"
    assert msgs[6][3].startswith("Call id: c1\nError:\nboom")
    summary = TR.step_messages(df, summary_mode=True).collect()
    assert sorted(r["role"] for r in summary) == ["tool-call", "tool-response", "tool-response", "user"]


def test_stream_assembly_loses_nothing(spark, tmp_path):
    """Pieces of runs arrive in files hours apart and out of order, one file per
    batch; after each batch the messages equal the batch assembly of what came."""
    from pyspark.sql import functions as F

    from tessera.streaming.source import run_available_now
    t = dt.datetime(2024, 1, 1)
    rows = [(s % 3, s, t + dt.timedelta(hours=7 * (s % 5)), f"p{s} ",
             {"index": s % 2, "id": f"id{s}" if s == 3 else None, "type": None, "name": "f" if s == 2 else "",
              "arguments": str(s)}, s, 1) for s in range(1, 19)]
    df = spark.createDataFrame(rows, DL.DELTA_SCHEMA)
    src, folder, ckpt = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in (1, 0, 3, 2):
        df.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DL.DELTA_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run_available_now(DL.start_assembly(stream, folder).option("checkpointLocation", ckpt))
        want = DL.assemble_batch(spark.read.parquet(src))
        key = lambda d: sorted(map(str, d.collect()))
        assert key(DL.latest_messages(spark, folder)) == key(want)
    assert spark.read.parquet(f"{folder}/messages").select("batch_id").distinct().count() == 4


def test_a_batch_assembles_the_runs_it_touches_alone(spark, tmp_path):
    """Each file has one old run (hot) and one new one; what a batch writes does not grow with the others."""
    from pyspark.sql import functions as F

    from tessera.streaming.source import run_available_now
    src, folder, ckpt = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = lambda k: [(0, 2 * k, None, f"a\\n\"{k}\u2028", None, None, None), (0, 2 * k + 1, None, None, (None,) * 5, 1, None),
                      (k, k, None, "x", (0, "i", "function", "n", "{}"), 2, 3)]
    for k in range(1, 5):
        spark.createDataFrame(rows(k), DL.DELTA_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DL.DELTA_SCHEMA).parquet(src)
        run_available_now(DL.start_assembly(stream, folder).option("checkpointLocation", ckpt))
    written = spark.read.parquet(f"{folder}/messages").groupBy("batch_id").agg(F.sort_array(F.collect_list("run_id")).alias("r"))
    assert sorted(tuple(x["r"]) for x in written.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    key = lambda d: sorted(map(str, d.collect()))
    assert key(DL.latest_messages(spark, folder)) == key(DL.assemble_batch(spark.read.parquet(src)))


def test_runs_without_usage_or_steps(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 9, 1, t, "action", 1.0, 10, 2, None, None), (1, 9, 2, t, "planning", 1.0, None, None, None, None),
            (2, 9, 3, t, "task", 1.0, None, None, None, None), (3, 8, 4, t, "action", 1.0, 5, 6, None, None)]
    st = _steps(spark, rows)
    usage = {r["run_id"]: (r["input_tokens"], r["output_tokens"]) for r in TR.run_token_usage(st).collect()}
    assert usage == {1: (None, None), 2: (0, 0), 3: (5, 6)}
    team = {r["root_run_id"]: tuple(r)[1:] for r in TR.team_token_rollup(st).collect()}
    assert team == {9: (10, 2, 2), 8: (5, 6, 1)}


def test_iteration_limit_is_that_of_the_last_step(spark):
    t = dt.datetime(2024, 1, 1)
    note = TR.ITERATION_LIMIT_NOTE
    rows = [(1, t, 1, None, f"x {note}"), (1, t, 2, None, "done"), (2, t, 1, None, "go"), (2, t, 2, "AgentParsingError", note),
            (3, t, 1, None, note), (3, t, 2, None, None)]
    st = spark.createDataFrame(rows, "run_id long, ts timestamp, event_id long, error_type string, observations string")
    got = {r["run_id"]: (r["iteration_limit_exceeded"], r["parsing_error"]) for r in TR.run_state(st).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False)}


def test_image_message_and_succinct_steps(spark):
    t = dt.datetime(2024, 1, 1)
    schema = ("run_id long, ts timestamp, event_id long, step_type string, model_output string, "
              "tool_calls array<struct<id:string,name:string,arguments:string,output:string>>, observations string, "
              "observation_images array<string>, error_message string, plan string, task string, model_input_messages string")
    df = spark.createDataFrame([(1, t, 1, "action", "out", None, "seen", ["a.png", "b.png"], None, None, None, "m"),
                                (1, t, 2, "action", None, None, None, [], None, None, None, "m")], schema)
    got = [(r["role"], r["text"]) for r in TR.step_messages(df).orderBy("event_id", "msg_ord").collect()]
    assert got == [("assistant", "out"), ("user", "a.png\nb.png"), ("tool-response", "Observation:\nseen")]
    assert TR.succinct_steps(df).columns == [c for c in df.columns if c != "model_input_messages"]
