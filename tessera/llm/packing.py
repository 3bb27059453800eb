"""Best-fit packing (operator 3) by the best-two-fit rule.

A bin is filled greedily with the longest pieces that still fit; then its
smallest piece gives way to the two unpacked pieces that fit its expanded gap
most tightly, if they fill more than it did. Pieces of one length are alike, so
the rule runs on the histogram of lengths (at most ``capacity`` numbers,
whatever the input): a pattern found once holds for as many bins as the counts
allow. Spark then deals the pieces out: the rank of a piece among those of its
length tells its bin and its place there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, cut, documents, gathered, split_words, table, text_slices, worker_memo
from .tokens import by_bytes, tokenizer

#: Tokens of a sequence.
CAPACITY = 2048
#: The id that ends each document.
END_ID = 0

_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
           ("ids_crc32", pa.int64()), ("slice", pa.int32()), ("nth", pa.int64())]
_PLACES = _PIECES[:5] + [("sequence_id", pa.int64()), ("offset", pa.int64())]


class WordIds:
    """Ids of the parts of texts between white space.

    A part that is a run of letters and closing punctuation is two pre-tokens,
    whose ids stand one after the other. The new runs of letters of a slice are
    encoded together: each is one pre-token, and its last id closes a word.
    """

    #: Punctuation that may close a part.
    CLOSING = ".,;:!?"

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Memo()

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, runs: list[str], at_once: int = 500) -> None:
        lists = [runs[i: i + at_once] for i in range(0, len(runs), at_once)]
        for some, e in zip(lists, self.tokenizer.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            raw = ids.tobytes()
            if len(ends) == len(some) and ends[-1] == len(raw):
                found = [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:  # a letter that is more than a letter once it is normalised
                found = self._encode(some)
            self.known.update(zip(some, found))

    def of(self, parts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """(ids of pre-tokens, two places in them for each part): those of its
        letters and of its closing punctuation, or of the whole and of nothing."""
        letters = pc.utf8_rtrim(parts, self.CLOSING)
        plain = pc.utf8_is_alpha(letters)
        closing = pc.struct_field(pc.extract_regex(parts, f"(?P<end>[{self.CLOSING}]*)$"), "end")
        first = pc.if_else(plain, pc.ascii_lower(letters), parts).dictionary_encode()
        second = pc.if_else(plain, closing, "").dictionary_encode()
        firsts, seconds = first.dictionary.to_pylist(), second.dictionary.to_pylist()
        alpha = pc.utf8_is_alpha(first.dictionary).to_pylist()
        new = [(x, a) for x, a in zip(firsts, alpha) if x not in self.known]
        self._encode_letters([x for x, a in new if a])
        for some in by_bytes(x for x, a in new if not a):
            self.known.update(zip(some, self._encode(some)))
        ids = [self.known[x] for x in firsts] + self._encode(seconds)
        self.known.settle(x for x, _ in new)
        places = np.column_stack([first.indices.to_numpy(zero_copy_only=False),
                                  second.indices.to_numpy(zero_copy_only=False) + len(firsts)])
        return ids, places


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and cut: a row for each piece with its token checksum, the task
    (``slice``) that made it and its number among that task's pieces of its length.

    The tokenizer drops white space, so the ids of a text are those of its parts
    between white space, one after another.
    """
    end = np.uint32(END_ID).tobytes()

    def run(batches):
        known = worker_memo(("word ids", path), lambda: WordIds(path))
        slice_id, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in text_slices(batches):
            parts, index, begins = split_words(part.column("text"), lower=False)
            found, places = known.of(parts)
            ids, starts = gathered(found, places[index].ravel(), "<u4")
            bounds = starts[2 * begins]
            out = [[] for _ in _PIECES]
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = ids[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    piece = own[at: at + 4 * capacity]
                    n = len(piece) // 4
                    for c, v in zip(out, (doc_id, k, at // 4, n, zlib.crc32(piece), slice_id, int(seen[n]))):
                        c.append(v)
                    seen[n] += 1
            yield table(_PIECES, out)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, nth long")


def plan_bins(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit on a histogram: ``counts[n]`` pieces of length n, capacity
    ``len(counts) - 1``. Returns (number of bins, pieces of each length in one)."""
    counts = counts.astype(np.int64).copy()
    capacity, plan = len(counts) - 1, []
    counts[0] = 0
    while counts.any():
        left, gap, use = counts.copy(), capacity, {}
        while len(fits := np.flatnonzero(left[: gap + 1])):
            n = int(fits[-1])
            k = int(min(left[n], gap // n))
            use[n] = use.get(n, 0) + k
            left[n] -= k
            gap -= k * n
        greedy = dict(use)
        if sum(use.values()) > 1:
            small = min(use)
            room = gap + small
            there = np.flatnonzero(left[: room + 1])
            first = np.searchsorted(there, np.minimum(there, room - there), "right") - 1
            ok = first >= 0
            ok[ok] &= (there[first[ok]] != there[ok]) | (left[there[ok]] > 1)
            # where a length has one piece only, its partner is the next shorter one
            alone = (first >= 0) & ~ok & (first > 0)
            first[alone] -= 1
            ok |= alone
            if ok.any():
                total = np.where(ok, there + there[np.maximum(first, 0)], 0)
                best = int(len(total) - 1 - np.argmax(total[::-1]))
                if total[best] > small:
                    use[small] -= 1
                    for n in (int(there[best]), int(there[first[best]])):
                        use[n] = use.get(n, 0) + 1
        most = {n: max(use.get(n, 0), greedy.get(n, 0)) for n in {**use, **greedy}}
        times = max(1, min(int(counts[n]) // k for n, k in most.items()))
        use = {n: k for n, k in use.items() if k}
        for n, k in use.items():
            counts[n] -= times * k
        plan.append((times, use))
    return plan


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null or empty text is the end id alone; a null id
    stays null; repeated rows are packed as often as they come; an empty table
    gives no rows. Other columns are not read. Ranks are counted by task and
    added up over tasks, so no length, however common, meets in one task.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, path, capacity), "pieces")
    by_slice = made.groupBy("length", "slice").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_slice.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = made.join(offsets, ["length", "slice"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    places = spark.sparkContext.broadcast(_places(plan_bins(counts)))  # its size depends on the capacity alone

    def run(batches):
        lengths, low, bins, each, at = places.value
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.empty(len(n), np.int64)
            for x in np.unique(n):  # the rows of a length are sorted by rank
                lo, hi = np.searchsorted(lengths, (x, x + 1))
                own = n == x
                row[own] = lo + np.searchsorted(low[lo:hi], rank[own], "right") - 1
            nth = rank - low[row]
            yield table(_PLACES, [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                  bins[row] + nth // each[row], at[row] + nth % each[row] * n])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")


def _places(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Of each run of ranks of a length: the length, its first rank, the first
    bin, the pieces in a bin and the place of the first of them."""
    rows, used, bins = [], {}, 0
    for times, use in plan:
        at = 0
        for n in sorted(use, reverse=True):
            rows.append((n, used.get(n, 0), bins, use[n], at))
            used[n] = used.get(n, 0) + times * use[n]
            at += n * use[n]
        bins += times
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(rows[:, i].copy() for i in range(5))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
