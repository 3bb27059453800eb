"""Restartable answering.

Questions arrive as files; each micro-batch drops questions already answered
(left anti join against the answers sink), answers the rest with an
injected function (errors captured per row) and appends them to the sink.
The checkpoint makes a restarted query skip files it has already consumed,
the anti join skips questions answered by any earlier run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import batch_apply

ANSWER_SCHEMA = "question string, answer string, error string"


def answered(spark: SparkSession, sink: str) -> DataFrame:
    """The answers in the sink; none if the sink is not there yet. Any other
    error of the storage is raised: it does not mean that nothing is answered."""
    try:
        return spark.read.schema(ANSWER_SCHEMA).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWER_SCHEMA)


def answer_batch(spark: SparkSession, sink: str, fn: Callable[[str], str]):
    def run(batch: DataFrame, batch_id: int) -> None:
        todo = batch.select("question").distinct().join(answered(spark, sink).select("question"), "question",
                                                         "left_anti")
        out = batch_apply(todo, fn, "question")
        out.write.mode("append").parquet(sink)
    return run


def start_answering(questions: DataFrame, sink: str, checkpoint: str, fn: Callable[[str], str]):
    spark = questions.sparkSession
    return (questions.writeStream.foreachBatch(answer_batch(spark, sink, fn))
            .option("checkpointLocation", checkpoint))


def question_schema():
    return "task_order long, question string, file_name string"


def write_question_files(df: DataFrame, folder: str) -> None:
    df.select(F.col("task_order").cast("long"), "question", "file_name").write.mode("append").parquet(folder)
