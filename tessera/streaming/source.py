"""Structured Streaming sources over the driver tables and the sink helper
used by the streaming operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.tables import table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a table. A table stored as one file is watched
    through a one-file glob (the file source needs a folder or a pattern)."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema  # declared schema: no inference per batch
    src = path[:-1] + "[" + path[-1] + "]" if os.path.isfile(path) else path
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(src)


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink folder, checkpoint folder) under the shared checkpoint location."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return os.path.join(base, "sink"), os.path.join(base, "checkpoint")


def run_available_now(stream_writer) -> None:
    """Start with an availableNow trigger and wait until all input is processed."""
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination()  # raises what stopped the query
