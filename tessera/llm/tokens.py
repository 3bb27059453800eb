"""Token counts (operator 2): batch encoding in Arrow functions that return
lengths only, with batches balanced by bytes and texts split at safe boundaries.

A byte-level BPE cuts a text into pre-tokens first, and no pre-token reaches
from a non-space into a space. So a text may be split before every plain white
space that follows a non-space, and the counts of the parts add up to the count
of the text, special strings included (they hold no white space). The parts of
a slice are made distinct, encoded in batches of about equal bytes, and only
their lengths are kept, in a memo of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, documents, strings, table, text_slices

#: Tokens above which a document is over the limit.
LIMIT = 1024
#: Bytes handed to the tokenizer at once.
ENCODE_BYTES = 1 << 20
#: Where a text may be split: after a character that is no white space in any
#: definition, before a plain white space.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")

COLUMNS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library without truncation or padding,
    on one thread (Spark gives each task its core)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def by_bytes(parts: Iterable[str], limit: int = ENCODE_BYTES) -> Iterator[list[str]]:
    """Lists of parts of about ``limit`` bytes each."""
    batch, size = [], 0
    for p in parts:
        batch.append(p)
        size += len(p) if p.isascii() else len(p.encode())
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Special strings in a text count as the tokenizer's default has it; none is
    added. A null or empty text has no bytes and no tokens; a null id stays
    null; repeated rows give repeated results; an empty table gives none. Other
    columns are not read, whatever their names. ``path`` must be readable by
    the executors.
    """
    def run(batches):
        encode, known = tokenizer(path).encode_batch_fast, Memo()
        for part in text_slices(batches):
            texts = strings(part)
            cuts = [SAFE.split(x) for x in texts]
            new = set().union(*cuts).difference(known)
            for some in by_bytes(new):
                known.update(zip(some, map(len, encode(some, add_special_tokens=False))))
            n = [sum(map(known.__getitem__, c)) for c in cuts]
            known.settle(new)
            yield table(COLUMNS, [part.column("doc_id"), [len(x.encode()) for x in texts], n, [x > limit for x in n]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
