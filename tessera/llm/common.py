"""Helpers shared by the operators: document columns, byte-bounded slices of
Arrow batches, word and shingle hashes, hash splits and shared files."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import cuts_dir, ensure_checkpoint_dir
from ..sources.tables import read_table

#: Bytes of text an operator turns into Python objects at once.
SLICE_BYTES = 4 << 20
#: Entries a memo of encoded words may hold before it starts anew, and one of hashes.
MEMO_ENTRIES, HASH_ENTRIES = 500_000, 200_000
#: Characters of all parts that a memo keeps, and of the longest: text without spaces makes parts of whole paragraphs.
MEMO_CHARS, MEMO_PART = 8_000_000, 256

_MUL = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table; Python workers get this package on their path."""
    ensure_checkpoint_dir(spark)
    return read_table(spark, sf_dir, "documents", list(columns) or None)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{cuts_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``max_bytes`` of text each (at
    least one row, so a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a slice; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a slice; null reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def table(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, names_types, strict=True)],
        names=[n for n, _ in names_types])


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts, runs without ASCII white space: distinct
    words, for each word its place among them, and where each text's words begin
    (one more than texts). ``lower`` lower-cases A-Z. Null reads as empty."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # before leading and after trailing white space
        full = index != empty
        begins = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[begins]
        index = index[full]
    return words, index, begins


def expanded(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ``size`` numbers stand in ``flat``; those at the places ``index``
    one after another, and where each begins (one more than places)."""
    first = (np.cumsum(size) - size)[index]
    size = size[index]
    begins = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(first - begins[:-1], size) + np.arange(begins[-1])], begins


def gathered(values: list[bytes], index: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """``expanded`` for lists packed as bytes."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    return expanded(np.frombuffer(b"".join(values), dtype), size, index)


def id_remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


_memo: dict = {}


def worker_memo(key, make):
    """What ``make`` returns, kept for the next tasks of this Python worker. A
    worker keeps one such object: asking for another lets the last one go, so the
    memos of several operators do not add up."""
    if key not in _memo:
        _memo.clear()
        _memo[key] = make()
    return _memo[key]


def word_hashes() -> WordHashes:
    """The worker's memo of word hashes."""
    return worker_memo("word hashes", WordHashes)


class Memo(dict):
    """What parts of texts encode to, bounded in entries and characters. A slice
    may add all parts it has; ``settle`` then lets go of the long ones among those
    it added, which seldom come again, and of everything once a bound is passed."""

    chars = 0

    def settle(self, added: Iterable[str]) -> None:
        for part in added:
            if len(part) > MEMO_PART:
                self.pop(part, None)
            else:
                self.chars += len(part)
        if len(self) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0


class WordHashes(dict):
    """Memo of the 64-bit hashes of words, long ones left out."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_PART:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HASH_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows of one text, given its word
    hashes. A text of 1 to k-1 words has one shingle of all its words; a text
    without words has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(k, n)
    acc = words[: n - width + 1].copy()
    for j in range(1, width):
        acc *= _MUL
        acc += words[j: n - width + 1 + j]
    if width < k:
        acc += np.uint64(width)
    return np.unique(mix(acc))


def is_local(path: str) -> bool:
    """Whether the shared folder is mounted (on the driver and all executors)."""
    return "://" not in path or path.startswith("file:")


def local_path(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def write_shared(path: str, data: bytes | memoryview) -> None:
    """Write a file in the shared folder. The name appears only when the file is
    whole, so a task that runs twice, or is lost half-way, does no harm."""
    if is_local(path):
        path = local_path(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, at)


def map_shared(path: str, dtype) -> np.ndarray:
    """A file of the shared folder as an array: memory-mapped where the folder is
    mounted, else read through its store."""
    if is_local(path):
        path = local_path(path)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)
