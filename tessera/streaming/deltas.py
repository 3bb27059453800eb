"""Stream-delta assembly.

Deltas of a model response arrive as rows (run_id, seq, content, tool call
piece, token usage). A run's message is: its content pieces concatenated in
``seq`` order; per tool-call index the last non-empty id/type/name and the
concatenated argument pieces (indices in first-seen order); summed tokens; a
tool piece without an index is an error.

``assemble_batch`` is the batch form (grouped aggregates, no Python). The
streaming form loses nothing however late a piece is: the pieces of a run are its
keyed state, kept in the state store with the checkpoint, and a batch assembles
the runs it touched from all their pieces. So a batch costs its own pieces and
those of its runs, not the history of the stream, and a batch that runs again
starts from the same state. On a cluster use the RocksDB state store
(``session.cluster_conf``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from ..sources.tables import read_table

TOOL_CALL = "struct<index:int,id:string,type:string,name:string,arguments:string>"
DELTA_SCHEMA = (f"run_id bigint, seq bigint, ts timestamp, content string, tool_call {TOOL_CALL}, "
                "input_tokens bigint, output_tokens bigint")


def deltas_from_events(events: DataFrame) -> DataFrame:
    """Stream deltas derived from ``events`` (run = user, seq = event_id)."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    k = F.col("k")
    tool = F.struct(F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise((k % 2).cast("int")).alias("index"),
                    F.when(k % 5 == 0, F.concat(F.lit("call_"), k.cast("string"))).alias("id"),
                    F.when(k % 5 == 0, F.lit("function")).alias("type"),
                    F.when(k % 3 == 0, F.concat(F.col("event_type"), F.lit("_tool"))).otherwise(F.lit("")).alias("name"),
                    F.concat(F.lit("{"), k.cast("string"), F.lit("}")).alias("arguments"))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),  # event time for the watermark
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.col("event_type"), F.lit(" "))).alias("content"),
        F.when(F.col("event_type").isin("purchase", "error"), tool).alias("tool_call"),
        F.when(F.col("event_type") == "signup", k.cast("bigint")).alias("input_tokens"),
        F.when(F.col("event_type") == "signup", (k % 7).cast("bigint")).alias("output_tokens"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas_from_events(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"]))


def assemble_batch(d: DataFrame) -> DataFrame:
    """ST1 batch: one assembled message per run."""
    runs = d.groupBy("run_id").agg(
        F.coalesce(F.expr("listagg(content, '') WITHIN GROUP (ORDER BY seq)"), F.lit("")).alias("content"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.max(F.col("tool_call").isNotNull() & F.col("tool_call.index").isNull()).alias("_bad"))
    tc = d.where(F.col("tool_call.index").isNotNull()).select("run_id", "seq", "tool_call.*")
    nonempty = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))
    per_index = tc.groupBy("run_id", "index").agg(
        F.min("seq").alias("first_seq"),
        F.max_by(nonempty("id"), F.when(nonempty("id").isNotNull(), F.col("seq"))).alias("id"),
        F.max_by(nonempty("type"), F.when(nonempty("type").isNotNull(), F.col("seq"))).alias("type"),
        F.coalesce(F.max_by(nonempty("name"), F.when(nonempty("name").isNotNull(), F.col("seq"))), F.lit("")).alias("name"),
        F.coalesce(F.expr("listagg(arguments, '') WITHIN GROUP (ORDER BY seq)"), F.lit("")).alias("arguments"))
    calls = per_index.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(
        "first_seq", "index", F.coalesce("id", F.lit("")).alias("id"), F.lit("function").alias("type"),
        "name", "arguments"))).alias("_calls"))
    out = runs.join(calls, "run_id", "left")
    return out.select(
        "run_id", "content",
        F.coalesce(F.transform("_calls", lambda c: F.struct(c["index"].alias("index"), c["id"].alias("id"),
                                                            c["type"].alias("type"), c["name"].alias("name"),
                                                            c["arguments"].alias("arguments"))),
                   F.array().cast(f"array<{TOOL_CALL}>")).alias("tool_calls"),
        "input_tokens", "output_tokens",
        F.when(F.col("_bad"), F.lit("Tool call index is not provided in tool delta")).alias("error"))


#: What is kept of a piece: one line of JSON (which has no line breaks) for each.
PIECE = f"seq bigint, content string, tool_call {TOOL_CALL}, input_tokens bigint, output_tokens bigint"


def _with_earlier(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A run's pieces so far, with those of this batch."""
    lines = [state.get[0]] if state.exists else []
    for batch in batches:
        lines += batch["piece"].tolist()
    whole = "\n".join(lines)
    state.update((whole,))
    yield pd.DataFrame({"run_id": [key[0]], "pieces": [whole]})


def touched_runs(d: DataFrame) -> DataFrame:
    """The runs that a batch of the stream ``d`` touches, each with all its pieces."""
    piece = F.to_json(F.struct("seq", "content", "tool_call", "input_tokens", "output_tokens"))
    return d.select("run_id", piece.alias("piece")).groupBy("run_id").applyInPandasWithState(
        _with_earlier, "run_id bigint, pieces string", "pieces string", "update", "NoTimeout")


def start_assembly(d: DataFrame, folder: str) -> DataStreamWriter:
    """ST1 streaming: a writer that leaves, for each batch of the stream ``d``, the
    messages of the runs it touched under ``folder``; a repeated batch replaces its own."""
    def step(batch: DataFrame, batch_id: int) -> None:
        runs = batch.persist()  # read twice: texts and tool calls
        pieces = runs.select("run_id", F.explode(F.split("pieces", "\n")).alias("p")).select("run_id", F.from_json("p", PIECE).alias("p"))
        assemble_batch(pieces.select("run_id", "p.*")).write.mode("overwrite").parquet(f"{folder}/messages/batch_id={batch_id}")
        runs.unpersist()

    return touched_runs(d).writeStream.outputMode("update").foreachBatch(step)


def latest_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last message written for each run."""
    m = spark.read.parquet(f"{folder}/messages")
    cols = [c for c in m.columns if c != "batch_id"]
    return m.groupBy("run_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("m")).select("m.*")
