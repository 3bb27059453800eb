"""LM scoring (operator 4): a smoothed bigram model in Elias-Fano tries.

Words and word pairs are counted over all training rows. A pair's probability is
smoothed by the Dirichlet rule,

    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V + 1),

so it is normalised whatever v is, and needs counts only. The first term, in a
byte on a scale of logarithms, is the code that the tries hold; the second is
known from the counts of single words.

The model is as large as the corpus, so it is never in one place: pairs are
dealt into shards by a hash of both words (no word, however frequent, fills a
shard). The task of a shard counts, builds its trie, writes it to the shared
folder, maps it, and answers the pairs that each slice of the corpus asked for,
training rows or not. Slices read their answers and add up the logarithms.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_shared, mix, shared_dir, split_words, table, write_shared
from .elias_fano import BigramTrie
from .exchange import by_key, deal, read_slice, slice_rows, slices, write_by_slice

#: Weight of the single words against a context's own counts.
MU = 10.0
#: Lowest logarithm (base 10) of the scale of codes; 0 stands for no such pair.
LOWEST = -10.0
#: Bytes of text in a slice, and of text for each bucket of words and shard of pairs.
SLICE, BUCKET = 8 << 20, 8 << 20
#: Fold that is held out of training: crc32(doc_id) mod FOLDS == HELD_OUT.
FOLDS, HELD_OUT = 7, 2

_END = xxhash.xxh64_intdigest(b"")  # the end of a text; no word is empty
_WORD = np.dtype([("place", "<i4"), ("n", "<i8")])
_SCALE = np.concatenate([[0.0], 10.0 ** np.linspace(LOWEST, 0, 255)])
_COLUMNS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities, nearest on the scale of logarithms."""
    step = (np.log10(p) - LOWEST) / -LOWEST * 254
    return (1 + np.clip(np.rint(step), 0, 254)).astype(np.uint8)


class _Slice:
    """The tokens of a slice: words and an end of each text."""

    def __init__(self, part: pa.RecordBatch):
        words, index, begins = split_words(part.column("text"))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
        self.hashes, place = np.unique(np.append(hashes, np.uint64(_END)), return_inverse=True)
        self.tokens = np.insert(place[index], begins[1:], place[-1])
        self.begins = begins[:-1] + np.arange(len(begins) - 1)
        self.size = np.diff(np.append(self.begins, len(self.tokens)))
        self.held_out = np.array(part.column("held_out").to_pylist(), bool)
        self.train = np.repeat(~self.held_out, self.size)
        self.end = int(place[-1])

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.hashes))

    def learn(self, folder: str, number: int, offsets: np.ndarray) -> None:
        """Read the ids and counts of the words (a place of -1: not in training)."""
        known = read_slice(folder, number, _WORD)
        self.n = known["n"].astype(np.int64)
        first = offsets[_range_of(self.hashes, len(offsets))]
        self.ids = np.where(known["place"] >= 0, first + known["place"], -1)

    def pairs(self, start_id: int) -> tuple[np.ndarray, ...]:
        """Distinct pairs of known words: context id, word id, count in training,
        count of the context, and for each token the place of its pair (or -1).
        The context of a first word is the start, as frequent as the end."""
        start = len(self.hashes)
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.begins] = start
        ids, n = np.append(self.ids, start_id), np.append(self.n, self.n[self.end])
        known = (ids[context] >= 0) & (ids[self.tokens] >= 0) & (n[context] > 0)
        code = context[known] * (start + 1) + self.tokens[known]
        distinct, place = np.unique(code, return_inverse=True)
        count = np.bincount(place[self.train[known]], minlength=len(distinct))
        of_token = np.full(len(self.tokens), -1)
        of_token[known] = place
        left, right = distinct // (start + 1), distinct % (start + 1)
        self.rest = MU / (n[context] + MU)
        return ids[left], ids[right], count, n[left], of_token


def _range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash, by its range: buckets are in the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _shard_of(left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
    return (mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _count_words(made: DataFrame, buckets: int, folder: str) -> tuple[np.ndarray, int]:
    """Write for each slice the places and counts of its words; first id of each
    bucket with the number of words at the end, and the number of tokens."""
    names = [("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())]
    asked_type = np.dtype([("hash", "<u8"), ("n", "<u4")])

    def ask(batches):
        for number, part in slice_rows(batches):
            own = _Slice(part)
            data = np.zeros(len(own.hashes), asked_type)
            data["hash"], data["n"] = own.hashes, own.counts()
            of = _range_of(own.hashes, buckets)
            for one in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                yield table(names, [[int(of[one[0]])], [number], [data[one].tobytes()]])

    more = [("words", pa.int64()), ("tokens", pa.int64())]

    def answer(batches):
        for bucket, rows in by_key(batches, "bucket", "slice", "data"):
            asked = [(number, np.frombuffer(d, asked_type)) for number, d in rows]
            every = np.concatenate([a for _, a in asked])
            hashes, place = np.unique(every["hash"], return_inverse=True)
            n = np.zeros(len(hashes), np.int64)
            np.add.at(n, place, every["n"].astype(np.int64))
            rank = np.where(n > 0, np.cumsum(n > 0) - 1, -1)
            for number, own in asked:
                at = np.searchsorted(hashes, own["hash"])
                data = np.zeros(len(own), _WORD)
                data["place"], data["n"] = rank[at], n[at]
                yield table(names + more, [[bucket], [number], [data.tobytes()], [int((n > 0).sum())], [int(n.sum())]])

    asked = made.mapInArrow(ask, "bucket int, slice long, data binary")
    answers = cut(deal(asked, "bucket").mapInArrow(answer, "bucket int, slice long, data binary, words long, tokens long"), "words")
    sizes = {r["bucket"]: r for r in answers.groupBy("bucket").agg(  # a row for each bucket
        F.first("words").alias("words"), F.first("tokens").alias("tokens")).collect()}
    words = [sizes[b]["words"] if b in sizes else 0 for b in range(buckets)]
    write_by_slice(answers.select("slice", "bucket", "data"), folder, "bucket")
    return np.concatenate([[0], np.cumsum(words)]).astype(np.int64), sum(r["tokens"] for r in sizes.values())


def _write_trie(path: str, trie: BigramTrie) -> None:
    """All arrays of a trie in one file, each at a multiple of eight bytes."""
    arrays, at, index = trie.arrays(), 0, {}
    for name, a in arrays.items():
        index[name] = (at, a.nbytes)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    write_shared(path, len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values()))


def open_trie(path: str) -> BigramTrie:
    """A written trie, memory-mapped where the shared folder is mounted."""
    raw = map_shared(path, np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    index = json.loads(raw[8: 8 + size].tobytes())

    def read(name, dtype):
        at, n = index[name]
        return raw[8 + size + at: 8 + size + at + n].view(dtype)

    return BigramTrie.open(read)


def _build_tries(made: DataFrame, words: str, offsets: np.ndarray, shards: int, tries: str, folder: str) -> None:
    """Count the pairs, write a trie for each shard and, for each slice, the codes
    of the pairs it has."""
    names = [("shard", pa.int64()), ("slice", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]

    def ask(batches):
        press = zstandard.ZstdCompressor(1)
        for number, part in slice_rows(batches):
            own = _Slice(part)
            own.learn(words, number, offsets[:-1])
            left, right, count, total, _ = own.pairs(int(offsets[-1]))
            of = _shard_of(left, right, shards)
            order = np.argsort(of, kind="stable")
            for one in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
                data = b"".join(c[one].astype(t).tobytes() for c, t in ((left, "<u4"), (right, "<u4"), (count, "<u4"), (total, "<u8")))
                yield table(names, [[int(of[one[0]])], [number], [len(one)], [press.compress(data)]])

    def answer(batches):
        unpack = zstandard.ZstdDecompressor()
        for shard, rows in by_key(batches, "shard", "slice", "n", "data"):
            asked = []
            for number, n, data in rows:
                raw = unpack.decompress(data)
                asked.append((number, [np.frombuffer(raw, t, n, at * n) for t, at in (("<u4", 0), ("<u4", 4), ("<u4", 8), ("<u8", 12))]))
            left, right, count, total = (np.concatenate([a[i] for _, a in asked]) for i in range(4))
            some = count > 0
            key = (left[some].astype(np.uint64) << np.uint64(32)) | right[some]
            pair, first, place = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(place, count[some], len(pair))
            codes = quantised(n / (total[some][first] + MU)) if len(pair) else np.empty(0, np.uint8)
            path = f"{tries}/{shard}.trie"
            _write_trie(path, BigramTrie.build(pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), codes))
            trie = open_trie(path)
            for number, (left, right, _, _) in asked:
                yield table([names[1], names[0], names[3]], [[number], [shard], [trie.find(left, right).tobytes()]])

    asked = made.mapInArrow(ask, "shard long, slice long, n long, data binary")
    answers = deal(asked, "shard").mapInArrow(answer, "slice long, shard long, data binary")
    write_by_slice(answers, folder, "shard")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) where ``held_out`` is false
    and score all rows.

    Tokens are runs without ASCII white space, A-Z lower-cased, and an end of
    each text. Per row: doc_id, held_out, n_tokens, n_known (tokens met in
    training), train_tokens, base_score (sum of log10 of the add-one probability
    of each token), score (log10 probability of the text in the model). A null
    text is empty: its end is scored. A null ``held_out`` counts as true. Null
    ids stay null, repeated rows count as often as they come, an empty table
    gives none, and without training rows every token has probability 1. Other
    columns are not read. 32-bit numbers name the words, so there may be 2^32.
    """
    spark = docs.sparkSession
    made = cut(slices(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out")), SLICE), "slices")
    buckets = max(1, (made.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET)
    words, tries, codes = (shared_dir(spark, x) for x in ("words", "tries", "codes"))
    offsets, tokens = _count_words(made, buckets, words)
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    _build_tries(made, words, offsets, buckets, tries, codes)

    def run(batches):
        for number, part in slice_rows(batches):
            own = _Slice(part)
            own.learn(words, number, offsets[:-1])
            left, right, _, _, of_token = own.pairs(int(offsets[-1]))
            order = np.argsort(_shard_of(left, right, buckets), kind="stable")
            seen = np.zeros(len(left) + 1)  # the last place is that of tokens without a pair
            seen[order] = _SCALE[read_slice(codes, number, np.uint8)]
            n = own.n[own.tokens]
            single = (n + 1) / (tokens + int(offsets[-1]) + 1)
            add = lambda x: np.add.reduceat(x, own.begins)
            yield table(_COLUMNS, [part.column("doc_id"), own.held_out, own.size, add((n > 0).astype(np.int64)),
                                   np.full(len(own.size), tokens), add(np.log10(single)),
                                   add(np.log10(seen[of_token] + own.rest * single))])

    return made.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    return score(documents(spark, sf_dir, "doc_id", "text"), fold == HELD_OUT)
