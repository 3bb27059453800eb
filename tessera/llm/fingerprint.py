"""Document fingerprints (operator 10): threshold-scaled sketches.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the
hash range. Sketches of any two texts can be merged (union) and compared, and a
short text's containment in a long one is estimated as well as a likeness of
equals, since both keep the same part of the hash range.

The query also compares a text with an edited one made from the next document
in descending doc_id. Texts move once: documents are dealt into ranges of
doc_id, the highest document of each range is dealt into the range above it as
well, and a pass over each sorted range sees neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, shingles, table, text_slices, word_hashes

#: One in so many shingle hashes is kept.
SCALE = 8
#: Documents to a range of doc_id.
RANGE_ROWS = 4000

COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
           ("contained_in_next", pa.float64())]


class Sketch:
    """The kept hashes of a text, its number of shingles and a hash of the text."""

    def __init__(self, raw: bytes, hashes: WordHashes, scale: int = SCALE):
        all_ = shingles(hashes.of(raw.lower().split()))
        self.n = len(all_)
        self.kept = all_[: int(np.searchsorted(all_, np.uint64(((1 << 64) - 1) // scale), "right"))]
        self.exact = xxhash.xxh64_intdigest(raw)

    def text(self) -> str:
        """As a string: hash of the text, number of shingles, kept hashes, in hex."""
        kept = self.kept.astype(">u8").tobytes().hex(" ", 8) if len(self.kept) else ""
        return f"{self.exact:016x}:{self.n}:{kept}"

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; texts too short to leave a kept hash are
        alike only if equal."""
        if self.exact == other.exact:
            return 1.0
        both = len(np.intersect1d(self.kept, other.kept, assume_unique=True))
        return both / (len(self.kept) + len(other.kept) - both) if both else 0.0

    def containment(self, other: Sketch) -> float:
        """Estimated part of this text's shingles that the other has."""
        if self.exact == other.exact:
            return 1.0
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True)) / len(self.kept) if len(self.kept) else 0.0


def fingerprint(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id and the sketch of each text as string; mergeable by union of hashes."""
    names = [("doc_id", pa.int64()), ("fingerprint", pa.string())]

    def run(batches):
        hashes = word_hashes()
        for part in text_slices(batches):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            yield table(names, [part.column("doc_id"), [Sketch(x or b"", hashes, scale).text() for x in raw]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited
    text, and their likeness to each other and to the next document's.

    The next document is the one with the next smaller doc_id; null ids come
    last, rows with one id in the order of their texts, and the last row's next
    is the first. A single row is its own next. A null text is empty. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("id"))
    ranges = max(1, ids.count() // RANGE_ROWS)
    cuts = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    low = np.array(sorted({int(x) for x in cuts}), np.int64)  # a number for each range

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(low, x.to_numpy(), "right").astype(np.int32))

    # the highest id of each range; it is the next one of the lowest in the range above
    tops = sorted((r["part"], r["id"]) for r in
                  ids.groupBy(range_of("id").alias("part")).agg(F.max("id").alias("id")).collect())
    lend = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    lend = spark.createDataFrame(lend, "id long, above int")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("id"))
    dealt = (own.join(F.broadcast(lend), "id", "left")  # a row for each range
             .withColumn("part", range_of("id"))
             .withColumn("to", F.array(F.struct("part", F.lit(False).alias("lent")),
                                       F.struct(F.col("above").alias("part"), F.lit(True).alias("lent"))))
             .select("doc_id", "text", "id", F.explode(F.expr("filter(to, x -> x.part is not null)")).alias("to"))
             .select("doc_id", "text", "id", "to.part", "to.lent")
             .repartitionById(len(low) + 1, F.col("part"))
             .sortWithinPartitions("part", "lent", F.desc("id"), "text"))

    def run(batches):
        hashes, last = word_hashes(), None
        for rows in text_slices(batches):
            out = [[] for _ in COLUMNS]
            for doc_id, text, part, lent in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "part", "lent"))):
                this = (doc_id, text, Sketch(text.encode(), hashes, scale), part, lent)
                if last is not None and last[3] == part and not last[4]:
                    for c, v in zip(out, _compared(last, this, hashes, scale)):
                        c.append(v)
                last = this
            yield table(COLUMNS, out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, contained_in_next double")


def _compared(this: tuple, after: tuple, hashes: WordHashes, scale: int) -> tuple:
    doc_id, text, sketch = this[:3]
    k = len(text) // 3
    edited = (text[: len(text) - k] + after[1][:k]).encode()
    changed = Sketch(edited, hashes, scale)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), sketch.text(), changed.text(),
            sketch.likeness(changed), sketch.likeness(after[2]), sketch.containment(after[2]))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir, "doc_id", "text"))
