"""Questions of slices of a corpus, answered by bucket.

A corpus is written once as slices of some MB. A slice's questions (hashes, word
pairs) are dealt into buckets by their key, so that a bucket sees a key of all
slices; its answers go back by the number of the slice and are written as a file
of the shared folder, which the next pass over that slice reads. The texts
themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_shared, table, text_slices, utf8, worker_memo, write_shared


def slices(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` as rows of slices: number, bytes of text, rows (Arrow, compressed)."""
    names = [("slice", pa.int64()), ("n_bytes", pa.int64()), ("rows", pa.binary())]

    def run(batches):
        worker_memo("slices", dict)  # lets go of what an operator before has kept
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, max_bytes=size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield table(names, [[number], [sum(map(len, utf8(part)))], [sink.getvalue().to_pybytes()]])
            number += 1

    return docs.mapInArrow(run, "slice long, n_bytes long, rows binary")


def slice_rows(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The slices of a partition: number and rows."""
    for b in batches:
        for number, raw in zip(b.column("slice").to_pylist(), b.column("rows")):
            yield number, pa.ipc.open_stream(raw.as_buffer()).read_next_batch()


def by_key(batches, key: str, *columns: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Groups of the rows of a sorted partition, as (key, rows)."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (key, *columns))))
    for k, group in groupby(rows, lambda r: r[0]):
        yield k, (r[1:] for r in group)


def deal(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` dealt out by ``key``, each partition sorted by it and ``order``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, *order)


def write_by_slice(df: DataFrame, folder: str, *order: str) -> None:
    """Write what ``df`` (slice, data) has for each slice, in the order of the
    columns ``order``, as a compressed file of the shared folder."""
    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for number, rows in by_key(batches, "slice", "data"):
            write_shared(f"{folder}/{number}", press.compress(b"".join(d for d, in rows)))
            yield table([("slice", pa.int64())], [[number]])

    deal(df, "slice", *order).mapInArrow(run, "slice long").write.format("noop").mode("overwrite").save()


def read_slice(folder: str, number: int, dtype) -> np.ndarray:
    """What was written for a slice; nothing if there was no answer for it."""
    try:
        packed = map_shared(f"{folder}/{number}", np.uint8)
    except FileNotFoundError:
        return np.empty(0, dtype)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype)
