"""Substring ("contains") joins: which needles occur inside which texts.

Spark has no index for substring predicates, so a plain join would be a nested
loop over all pairs. Here each needle is anchored on one of its grams (runs of
``GRAM`` bytes, or the whole of a shorter needle). Texts are scanned for grams
that may be an anchor, by a bitmap of fixed size; what is left, a text's key and
the hash of a gram, is joined with the anchors, and the pairs that meet are
verified on the text once, at the end. Work is linear in the text and nothing is
collected but the bitmap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an anchor.
GRAM = 16
#: Bits of the bitmap of anchors (2 MB).
BITS = 1 << 24
#: Bytes of text that are scanned at once.
WINDOW = 1 << 20


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 63-bit hash of the ``size`` bytes from each position on."""
    n = len(data) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        h = h * np.uint64(0x100000001B3) + data[j: j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h & np.uint64((1 << 63) - 1)


def _anchors(needles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, size, gram) of each needle: its gram with the least hash."""
    @F.pandas_udf("size int, gram long")
    def anchor(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            size = min(GRAM, len(data))
            out.append((size, int(_gram_hashes(data, size).min())))
        return pd.DataFrame(out, columns=["size", "gram"])

    n = needles.select(F.col(key).alias("needle"), F.col(text).alias("needle_text")).where(F.length("needle_text") > 0)
    return n.withColumn("a", anchor("needle_text")).select("needle", "needle_text", "a.size", "a.gram")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """Which values modulo BITS the anchors' hashes take, as bytes of bits."""
    bit = F.pmod("gram", F.lit(BITS))
    out = np.zeros(BITS // 8, np.uint8)
    # bits 0 to 32,767 are those of bucket 1, as Spark numbers them
    for r in (anchors.select(F.bitmap_bucket_number(bit + 1).alias("bucket"), F.bitmap_bit_position(bit + 1).alias("at"))
              .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()):  # BITS / 32,768 rows at most
        at = (r["bucket"] - 1) * 4096
        out[at: at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def substring_matches(hay: DataFrame, hay_key: str, hay_text: str, needles: DataFrame,
                      needle_key: str, needle_text: str) -> DataFrame:
    """All (hay_key, needle_key, match_pos) where a non-empty needle text
    occurs in the hay text (match_pos = 1-based first occurrence). Empty
    needles, which occur in every text, are handled by the callers below
    without producing all pairs; null texts match nothing."""
    spark = hay.sparkSession
    anchors = _anchors(needles, needle_key, needle_text)
    sizes = sorted(r[0] for r in anchors.select("size").distinct().collect())  # GRAM values at most
    shared = spark.sparkContext.broadcast(_bitmap(anchors))
    schema = T.StructType([T.StructField("hay", hay.schema[hay_key].dataType), T.StructField("size", T.IntegerType()),
                           T.StructField("gram", T.LongType())])

    def scan(batches):
        bits = shared.value
        for pdf in batches:
            keys, widths, grams = [], [], []
            for key, text in zip(pdf[hay_key], pdf[hay_text]):
                data = np.frombuffer((text or "").encode(), np.uint8)
                for size in sizes:
                    met = []
                    for at in range(0, len(data), WINDOW):
                        h = _gram_hashes(data[at: at + WINDOW + size - 1], size)
                        low = h & np.uint64(BITS - 1)
                        met.append(h[bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1 == 1])
                    found = np.unique(np.concatenate(met)).astype(np.int64) if met else ()
                    keys.extend([key] * len(found))
                    widths.extend([size] * len(found))
                    grams.extend(found)
            yield pd.DataFrame({"hay": pd.Series(keys, dtype=pdf[hay_key].dtype), "size": widths, "gram": grams})

    met = hay.select(hay_key, hay_text).mapInPandas(scan, schema)
    pairs = met.join(anchors, ["size", "gram"]).select("hay", "needle", "needle_text").distinct()
    texts = hay.select(F.col(hay_key).alias("hay"), F.col(hay_text).alias("hay_text"))
    place = F.expr("instr(hay_text, needle_text)")
    return (pairs.join(texts, "hay").withColumn("match_pos", place).where("match_pos > 0")
            .select(F.col("hay").alias(hay_key), F.col("needle").alias(needle_key), "match_pos"))


def contains_any(hay: DataFrame, hay_key: str, hay_text: str, needles: DataFrame,
                 needle_key: str, needle_text: str) -> DataFrame:
    """Rows of ``hay`` whose text contains at least one needle (left semi)."""
    if needles.where(F.col(needle_text) == "").limit(1).count():
        return hay.where(F.col(hay_text).isNotNull())
    m = substring_matches(hay, hay_key, hay_text, needles, needle_key, needle_text)
    return hay.join(m.select(hay_key).distinct(), hay_key, "left_semi")


def first_contained(hay: DataFrame, hay_key: str, hay_text: str, needles: DataFrame,
                    needle_key: str, needle_text: str, needle_order: str) -> DataFrame:
    """For each hay row, the needle row (first in ``needle_order``) whose
    text occurs in the hay text; hay rows without a match keep nulls."""
    m = substring_matches(hay, hay_key, hay_text, needles, needle_key, needle_text)
    ranked = m.join(needles.select(needle_key, needle_order), needle_key).select(hay_key, needle_key, needle_order)
    # the first empty needle (if any) matches every text: one row, read back
    first_empty = (needles.where(F.col(needle_text) == "").orderBy(needle_order)
                   .select(needle_key, needle_order).limit(1).collect())
    if first_empty:
        ek, eo = first_empty[0][0], first_empty[0][1]
        ranked = ranked.unionByName(hay.where(F.col(hay_text).isNotNull()).select(
            hay_key, F.lit(ek).cast(needles.schema[needle_key].dataType).alias(needle_key),
            F.lit(eo).cast(needles.schema[needle_order].dataType).alias(needle_order)))
    best = ranked.groupBy(hay_key).agg(F.min_by(F.col(needle_key), F.col(needle_order)).alias(needle_key))
    other = [c for c in needles.columns if c != needle_key]
    return (hay.join(best, hay_key, "left")
            .join(needles.select(needle_key, *[F.col(c).alias(f"matched_{c}") for c in other]), needle_key, "left"))
