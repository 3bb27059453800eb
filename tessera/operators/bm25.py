"""BM25 ranking over an inverted index.

The index is a table of shards. A shard holds the postings of some thousand
neighbouring units: its distinct terms and, term after term, the units that hold
it and how often. It is built in one pass over the texts, which are neither
shuffled nor read again: the document counts of the terms are sums over shards,
and a query looks up its terms in a shard and adds up their postings alone, all
queries of a block at once. A shard passes on at most ``k`` units of a query.

Skipping postings by bounds was tried and does not pay with this scorer: words in
most units get a quarter of the mean idf, so the k-th best score of a passage of
some 35 words is about a twentieth of what its words could add up to (18 of 357 at
sf0.1), and 3.9 of 4.7 million units with a telling word stayed candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITESPACE
from ..session import cut_lineage

# Defaults of the public BM25Okapi scorer the reference uses.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SCORE_SCALE = 1e9  # per-term contributions are summed as integers of 1e-9
#: Units of a shard, bytes of text it is cut at, and scores that a task holds at once.
SHARD_UNITS, SHARD_BYTES, SCORES = 4096, 2 << 20, 1 << 20
#: A shard is one row of some MB: the writer looks at its buffer after every few rows, not every
#: hundred, and a reader holds a small row group at a time.
SHARD_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "4"}


def tokenize(text) -> Column:
    """Whitespace tokens (the scorer's default preprocessing: ``str.split()``)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, f"{WHITESPACE}+"), lambda x: x != "")


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` rows and about SHARD_BYTES of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SHARD_BYTES, "right")))
            stop = min(stop, start + most)
            yield batch.slice(start, stop - start)
            start = stop


def _postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, how many units each is in, those units and the occurrences in
    each (term after term), and the number of words of every unit."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    term = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # before leading and after trailing white space
        row, term = row[term != empty], term[term != empty]
    length = np.bincount(row, minlength=len(texts))
    pairs, n = np.unique(term.astype(np.int64) * len(texts) + row, return_counts=True)
    terms, units = np.divmod(pairs, max(1, len(texts)))
    present, counts = np.unique(terms, return_counts=True)
    return coded.dictionary.take(pa.array(present)), counts, units, n, length


def _steps(postings: np.ndarray, units: int, at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries to add up together in a shard of ``units``: as many as have at
    most ``at_once`` scores and postings to add (one query has no more than the shard)."""
    upto = np.r_[0, np.cumsum(postings)]
    most, low = max(1, at_once // max(1, units)), 0
    while low < len(postings):
        high = int(np.searchsorted(upto, upto[low] + at_once, "right")) - 1
        high = min(max(high, low + 1), low + most, len(postings))
        yield low, high
        low = high


class Bm25Index:
    """Shards of ``units``, a table in the shared folder, with the idf of their terms."""

    def __init__(self, units: DataFrame, unit_keys, text_col: str, k1: float = BM25_K1, b: float = BM25_B,
                 epsilon: float = BM25_EPSILON, shard_units: int = SHARD_UNITS, scores: int = SCORES):
        self.unit_keys, self.k1, self.b, self.scores = list(unit_keys), k1, b, scores
        self._keys = T.StructType([units.schema[c] for c in self.unit_keys])
        schema = T.StructType([T.StructField("keys", T.ArrayType(self._keys)), *(
            T.StructField(c, T.ArrayType(T.StringType() if c == "terms" else T.IntegerType()))
            for c in ("lengths", "terms", "counts", "rows", "n"))])
        names = schema.names

        def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in text_slices(batches, "__text", shard_units):
                terms, counts, units, n, length = _postings(rows.column("__text"))
                keys = pa.StructArray.from_arrays([rows.column(k) for k in range(len(self.unit_keys))], names=self.unit_keys)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                whole = lambda x: one(pa.array(x, pa.int32()))
                yield pa.RecordBatch.from_arrays([one(keys), whole(length), one(terms.cast(pa.string())), whole(counts),
                                                  whole(units), whole(n)], names=names)

        self.shards = cut_lineage(units.select(*self.unit_keys, F.col(text_col).alias("__text")).mapInArrow(build, schema), **SHARD_FILES)
        whole = self.shards.agg(F.sum(F.size("lengths")).alias("units"), F.sum(
            F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)).alias("words")).first()
        self.units = whole["units"] or 0
        self.mean_length = float(whole["words"]) / self.units if self.units else 0.0
        self.idf = self._idf(epsilon)

    def _idf(self, epsilon: float) -> DataFrame:
        """ln(N - n + 0.5) - ln(n + 0.5), a negative one replaced by epsilon times the
        mean over the vocabulary (an exact decimal sum, so order does not matter)."""
        df = cut_lineage(self.shards.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy(F.col("terms").alias("term")).agg(
            F.sum("counts").alias("units")))
        raw = F.log(F.lit(self.units) - F.col("units") + 0.5) - F.log(F.col("units") + 0.5)
        mean = df.agg((F.sum(raw.cast("decimal(38,18)")).cast("double") / F.count(F.lit(1))).alias("m")).first()["m"] or 0.0
        return df.select("term", F.when(raw < 0, F.lit(epsilon * mean)).otherwise(raw).alias("idf"))

    def asked(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """Each query with its terms in the index: (query, [(term, n, idf)])."""
        terms = (queries.select(query_key, F.explode(tokenize(query_text)).alias("term"))
                 .groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("n")).join(self.idf, "term"))
        return terms.groupBy(query_key).agg(F.collect_list(F.struct("term", "n", "idf")).alias("terms"))  # of one text

    def best(self, query_field: T.StructField, block: list, k: int) -> DataFrame:
        """The ``k`` best units of each shard for each query of a block: (query, keys, score)."""
        number: dict[str, int] = {}
        term = np.array([number.setdefault(t["term"], len(number)) for _, terms in block for t in terms], np.int64)
        weight = np.array([t["n"] * t["idf"] for _, terms in block for t in terms], np.float64)
        ends = np.cumsum([0, *(len(terms) for _, terms in block)])
        shared = self.shards.sparkSession.sparkContext.broadcast(  # of a block of queries
            ([x[0] for x in block], list(number), ends, term, weight))
        schema = T.StructType([query_field, *self._keys, T.StructField("score", T.DoubleType())])
        k1, b, mean_length, n_keys, at_once = self.k1, self.b, self.mean_length, len(self.unit_keys), self.scores

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted, ends, term, weight = shared.value
            names, wanted = pa.array(names), pa.array(wanted, pa.string())
            for batch in batches:
                for at in range(batch.num_rows):
                    shard = {c: batch.column(c)[at].values for c in batch.schema.names}
                    part = lambda c: shard[c].to_numpy(zero_copy_only=False)
                    found = pc.fill_null(pc.index_in(shard["terms"], wanted), -1).to_numpy(zero_copy_only=False)
                    first, count = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
                    counts = part("counts").astype(np.int64)
                    first[found[found >= 0]] = (np.cumsum(counts) - counts)[found >= 0]
                    count[found[found >= 0]] = counts[found >= 0]
                    rows, n = part("rows"), part("n").astype(np.float64)
                    shape = n * (k1 + 1), n + k1 * ((1 - b) + b * part("lengths") / mean_length)[rows]
                    rank = pc.sort_indices(shard["keys"].flatten()[0] if n_keys == 1 else pa.Table.from_arrays(
                        shard["keys"].flatten(), names=[str(i) for i in range(n_keys)]),
                        **({} if n_keys == 1 else {"sort_keys": [(str(i), "ascending") for i in range(n_keys)]}))
                    place = np.empty(len(rank), np.int64)
                    place[rank.to_numpy()] = np.arange(len(rank))
                    yield from picked(names, shard["keys"], place, ends, first[term], count[term], weight, rows, *shape)

        def picked(names, keys, place, ends, first, width, weight, rows, top, bottom):
            """Adds up one shard, some queries at a time, and keeps the best of each."""
            for low, high in _steps(np.diff(np.r_[0, np.cumsum(width)][ends]), len(place), at_once):
                here = slice(ends[low], ends[high])
                wide = width[here]
                p = np.repeat(first[here] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
                part = np.floor(np.repeat(weight[here], wide) * top[p] / bottom[p] * SCORE_SCALE + 0.5)
                q = np.repeat(np.arange(high - low), np.diff(ends[low: high + 1]))
                shape = high - low, len(place)
                pair = np.repeat(q, wide) * len(place) + rows[p]
                score = np.bincount(pair, part, shape[0] * shape[1]).astype(np.float64).reshape(shape)  # whole numbers far below 2^53
                score[np.bincount(pair, minlength=score.size).reshape(shape) == 0] = -np.inf  # no term in common
                bar = np.partition(score, max(0, shape[1] - k), axis=1)[:, max(0, shape[1] - k), None]
                query, row = np.nonzero((score >= bar) & (score > -np.inf))
                score = score[query, row]
                order = np.lexsort((place[row], -score, query))
                query, row, score = query[order], row[order], score[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                taken = keys.take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query[keep] + low)), *taken.flatten(),
                                                  pa.array(score[keep] / SCORE_SCALE)], names=schema.names)

        return self.shards.mapInArrow(run, schema)
