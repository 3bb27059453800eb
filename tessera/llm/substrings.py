"""Suffix-array dedup (operator 6): bytes covered by a string of ``LENGTH`` bytes
that also starts earlier, in an earlier document or before in the same one.

Sorting all suffixes of a corpus in one order is not possible, and not needed:
what repeats is found first, and suffix arrays are built of that alone.

1. The texts are written once as slices of some MB (rows of a table in the
   shared folder); their number, not their keys, is what later steps join on.
2. Of each window of ``LENGTH`` bytes the leftmost of the k-grams with the least
   hash is its anchor. Equal windows have equal anchors, so a window can repeat
   only if its anchor does. Anchor hashes are dealt into buckets, and each slice
   learns which of its own are met twice or more anywhere.
3. Neighbouring windows with one such anchor make a context: their bytes. Equal
   contexts of a slice are reduced to the earliest before anything is shuffled,
   those of a bucket before anything is sorted. Later ones repeat as a whole.
4. The distinct contexts of a bucket are the shards: Larsson-Sadakane suffix
   arrays and Kasai's common prefixes show which windows are equal. An anchor
   whose contexts go on in the next shard is merged there by binary search. The
   contexts of an anchor that is met ``HOT`` times or more are dealt over all
   buckets, and the distinct windows of those shards, as digests, are merged in
   buckets of their own: no anchor meets in one task.
5. The repeated windows go back to their slices, as numbers.

Buckets, slices and shards have sizes of their own, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, mix, shared_dir, table, utf8
from .exchange import by_key, deal, read_slice, slice_rows, slices, write_by_slice
from .suffix_array import common_prefixes, suffix_array

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of an anchor.
GRAM = 24
#: Bytes of text in a slice, of text for each bucket, and of a shard.
SLICE, BUCKET, SHARD = 8 << 20, 8 << 20, 1 << 20
#: Occurrences from which on an anchor is dealt over all buckets.
HOT = 10_000
#: Positions whose anchors are sought at once (arrays of this size stay in cache).
BLOCK = 1 << 16

_ANY = np.dtype([("doc", "<u4"), ("start", "<u8"), ("n", "<u4")])
_COUNT = np.dtype([("hash", "<u8"), ("n", "<u4")])
_ANCHOR = np.dtype([("hash", "<u8"), ("hot", "?")])
_WINDOW = np.dtype([("digest", "S16"), ("id", "<i8"), ("slice", "<i8"), ("doc", "<u4"), ("start", "<u8")])
_CONTEXT = np.dtype([("id", "<i8"), ("doc", "<u4"), ("start", "<u8"), ("n", "u1"), ("anchor", "u1")])
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """Hash of the k-gram at each position of ``buffer`` that has one."""
    n = len(buffer) - GRAM + 1
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    h = words[:n] * _FACTORS[0]
    for i in range(1, GRAM // 8):
        h += words[8 * i: 8 * i + n] * _FACTORS[i]
    return mix(h)


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one text with one anchor: hash of the
    anchor, its position, text, first window and number of windows, positions
    being those in the texts put together."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    grams, low = LENGTH - GRAM + 1, np.uint64((1 << 20) - 1)
    runs, before = [], (-1, -1)
    for begin in range(0, len(buffer) - LENGTH + 1, BLOCK):
        h = gram_hashes(buffer[begin: begin + BLOCK + LENGTH - 1])
        # the position in the low bits: of equal hashes the leftmost is the least
        least, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width:])
        at = (least & low).astype(np.int64)
        start = np.arange(begin, begin + len(at))
        doc = np.searchsorted(ends, start, "right")
        fits = np.flatnonzero(start + LENGTH <= ends[doc])
        if not len(fits):
            continue
        at, start, doc = at[fits], start[fits], doc[fits]
        new = np.empty(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        new[0] = (at[0] + begin, doc[0]) != before
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        if not new[0]:  # the last run of the block before goes on
            runs[-1][4][-1] += first[0] if len(first) else len(at)
        before = (at[-1] + begin, doc[-1])
        if len(first):
            runs.append((h[at[first]], at[first] + begin, doc[first], start[first], n))
    if not runs:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*runs))


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the keys that fall into each bucket."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(keys) else ():
        yield int(of[own[0]]), own


def _repeated_anchors(made: DataFrame, buckets: int, folder: str, hot: int) -> None:
    """Write for each slice its anchor hashes that are met twice or more, and
    whether they are met ``hot`` times or more."""
    names = [("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())]

    def ask(batches):
        for number, part in slice_rows(batches):
            h, n = np.unique(anchor_runs(utf8(part))[0], return_counts=True)
            data = np.zeros(len(h), _COUNT)
            data["hash"], data["n"] = h, n
            for bucket, own in _dealt(h, buckets):
                yield table(names, [[bucket], [number], [data[own].tobytes()]])

    def answer(batches):
        for _, rows in by_key(batches, "bucket", "slice", "data"):
            asked = [(number, np.frombuffer(d, _COUNT)) for number, d in rows]
            every = np.concatenate([a for _, a in asked])
            h, place = np.unique(every["hash"], return_inverse=True)
            n = np.bincount(place, every["n"], len(h))
            for number, own in asked:
                met = n[np.searchsorted(h, own["hash"])]
                data = np.zeros(int((met > 1).sum()), _ANCHOR)
                data["hash"], data["hot"] = own["hash"][met > 1], met[met > 1] >= hot
                if len(data):
                    yield table(names[1:], [[number], [data.tobytes()]])

    asked = made.mapInArrow(ask, "bucket int, slice long, data binary")
    write_by_slice(deal(asked, "bucket").mapInArrow(answer, "slice long, data binary"), folder)


def _contexts(made: DataFrame, buckets: int, folder: str) -> DataFrame:
    """The contexts of repeated anchors, the earliest of equal ones in a slice, in
    the bucket of their anchor or, for a hot one, in one by their bytes, numbered
    from ``buckets`` on; the windows of later ones come as rows of a negative bucket."""
    names = [("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary()), ("text", pa.binary())]

    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for number, part in slice_rows(batches):
            texts = utf8(part)
            h, at, doc, start, n = anchor_runs(texts)
            known = np.sort(read_slice(folder, number, _ANCHOR), order="hash")
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known["hash"], h), len(known) - 1)
            own = np.flatnonzero(known["hash"][place] == h)
            ids = part.column("doc_id").fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
            own = own[np.lexsort((start[own], doc[own], ids[doc[own]]))]
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            h, anchor, doc, start, n = h[own], (at - start)[own], doc[own], (start - begin[doc])[own], n[own]
            hot = known["hot"][place[own]]
            seen, first, later, cuts = set(), [], [], []
            for i, (d, s, k) in enumerate(zip(doc.tolist(), start.tolist(), n.tolist())):
                text = texts[d][s: s + k + LENGTH - 1]
                if text in seen:
                    later.append(i)
                else:
                    seen.add(text)
                    first.append(i)
                    cuts.append(text)
            if later:
                again = np.zeros(len(later), _ANY)
                again["doc"], again["start"], again["n"] = doc[later], start[later], n[later]
                yield table(names, [[-1 - number % buckets], [number], [again.tobytes()], [None]])
            data = np.zeros(len(first), _CONTEXT)
            data["id"], data["doc"], data["start"] = ids[doc[first]], doc[first], start[first]
            data["n"], data["anchor"] = n[first], anchor[first]
            key, hot = h[first], hot[first]
            key[hot] = [xxhash.xxh64_intdigest(cuts[i]) for i in np.flatnonzero(hot).tolist()]
            for kind, base in ((np.flatnonzero(~hot), 0), (np.flatnonzero(hot), buckets)):
                for bucket, group in _dealt(key[kind], buckets):
                    group = kind[group]
                    yield table(names, [[base + bucket], [number], [data[group].tobytes()],
                                        [press.compress(b"".join([cuts[i] for i in group.tolist()]))]])

    return made.mapInArrow(run, "bucket int, slice long, data binary, text binary")


class _Bucket:
    """The distinct contexts of a bucket, each with its earliest place, and the
    windows found to repeat so far: (slice, doc, start, number of windows)."""

    def __init__(self):
        self.earliest: dict[bytes, tuple] = {}  # text: (id, slice, doc, start, n, anchor)
        self.copies: list[tuple] = []
        self.windows: list[np.ndarray] = []

    def add(self, number: int, data: bytes, packed: bytes) -> None:
        raw, at = zstandard.ZstdDecompressor().decompress(packed), 0
        for id_, doc, start, n, anchor in np.frombuffer(data, _CONTEXT).tolist():
            text = raw[at: at + n + LENGTH - 1]
            at += n + LENGTH - 1
            new = (id_, number, doc, start, n, anchor)
            if (old := self.earliest.setdefault(text, new)) is not new:
                if new[:4] < old[:4]:
                    self.earliest[text], new = new, old
                self.copies.append((new[1], new[2], new[3], n))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(slice, packed windows) of what was found, which is then forgotten."""
        found = np.concatenate([np.array(self.copies, np.int64).reshape(-1, 4), *self.windows])
        self.copies, self.windows = [], []
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        for own in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else ():
            # neighbouring windows become one row
            apart = np.concatenate([[True], (own[1:, 1] != own[:-1, 1]) | (own[1:, 2] != own[:-1, 2] + own[:-1, 3])])
            first = np.flatnonzero(apart)
            data = np.zeros(len(first), _ANY)
            data["doc"], data["start"], data["n"] = own[first, 1], own[first, 2], np.add.reduceat(own[:, 3], first)
            yield int(own[0, 0]), data.tobytes()

    def _shards(self, shard_bytes: int) -> Iterator[tuple]:
        """The shards in the order of their anchors: places of the contexts, their
        anchors, and the distinct windows (``_windows``)."""
        texts = list(self.earliest)
        self.place = place = np.array(list(self.earliest.values()), np.int64).reshape(-1, 6)
        # documents in order, so that a window's place is one number
        by_doc = np.lexsort((place[:, 2], place[:, 1], place[:, 0]))
        new = np.any(place[by_doc][1:, :3] != place[by_doc][:-1, :3], axis=1)
        self.rank = np.empty(len(texts), np.int64)
        self.rank[by_doc] = np.concatenate([[0], np.cumsum(new)])
        anchor = _anchor_hashes(texts, place[:, 5])
        order = np.argsort(anchor, kind="stable")
        size = np.cumsum([len(texts[k]) for k in order.tolist()])
        for shard in np.split(order, np.flatnonzero(np.diff(size // shard_bytes)) + 1):
            windows, repeats = _windows([texts[k] for k in shard.tolist()], place[shard], self.rank[shard])
            self.windows.append(repeats)
            yield shard, anchor[shard], windows

    def compare(self, shard_bytes: int = SHARD) -> None:
        """Find the equal windows of the distinct contexts; an anchor that goes on
        in the next shard is merged there."""
        carried = None
        for _, h, windows in self._shards(shard_bytes) if self.earliest else ():
            if carried is not None and carried[0] == h[0]:
                strings, key, _ = windows(h == h[0])
                carried, late = _merge(carried, strings, key)
                self._late(late)
                if h[-1] == h[0]:
                    continue
            strings, key, _ = windows(h == h[-1])
            carried = (h[-1], strings, key)

    def digests(self, shard_bytes: int = SHARD) -> Iterator[np.ndarray]:
        """Find the equal windows within each shard, and give the distinct ones to
        be merged with those of all other shards."""
        for shard, h, windows in self._shards(shard_bytes) if self.earliest else ():
            strings, key, who = windows(np.ones(len(h), bool))
            out = np.zeros(len(strings), _WINDOW)
            out["digest"] = [hashlib.blake2b(x, digest_size=16).digest() for x in strings.tolist()]
            out["id"], out["slice"], out["doc"] = self.place[shard[who]][:, :3].T
            out["start"] = key & ((1 << 40) - 1)
            yield out

    def _late(self, keys: np.ndarray) -> None:
        """Note the windows of these keys as repeats."""
        doc = np.empty(int(self.rank.max()) + 1, np.int64)
        doc[self.rank] = np.arange(len(self.rank))
        own = self.place[doc[keys >> 40]]
        self.windows.append(np.column_stack([own[:, 1], own[:, 2], keys & ((1 << 40) - 1), np.ones(len(keys), np.int64)]))


def _anchor_hashes(texts: list[bytes], at: np.ndarray) -> np.ndarray:
    """Hash of the anchor of each context, which stands at ``at``."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    at = at + np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    h = words[at] * _FACTORS[0]
    for i in range(1, GRAM // 8):
        h += words[at + 8 * i] * _FACTORS[i]
    return mix(h)


def _windows(texts: list[bytes], place: np.ndarray, rank: np.ndarray) -> tuple:
    """The windows of a shard that are equal to an earlier one, and a function that
    gives the distinct windows of chosen contexts in the order of their bytes:
    strings, keys (rank of the document, start) of the earliest, its context."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    array, ranks = suffix_array(buffer, LENGTH)
    shared = common_prefixes(buffer, array, ranks, LENGTH)
    of = np.empty(len(buffer), np.int64)
    of[array] = np.cumsum(shared < LENGTH)
    begin, n = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]), place[:, 4]
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at, key = begin[owner] + nth, (rank[owner] << 40) + place[owner, 3] + nth
    order = np.lexsort((key, of[at]))
    of = of[at[order]]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    late, early = order[~first], order[first]
    repeats = np.column_stack([place[owner[late], 1], place[owner[late], 2], place[owner[late], 3] + nth[late],
                               np.ones(len(late), np.int64)])
    rows = np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)

    def distinct(chosen: np.ndarray) -> tuple:
        some = early[chosen[owner[early]]]
        return rows[at[some]].view(f"S{LENGTH}").ravel(), key[some], owner[some]

    return distinct, repeats


def _merge(carried: tuple, strings: np.ndarray, key: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The windows of one anchor in two shards, merged by binary search, and the
    keys of those that repeat one of the other shard."""
    anchor, theirs, key_there = carried
    spot = np.minimum(np.searchsorted(theirs, strings), len(theirs) - 1)
    met = theirs[spot] == strings
    late = np.maximum(key[met], key_there[spot[met]])
    key_there = key_there.copy()
    key_there[spot[met]] = np.minimum(key[met], key_there[spot[met]])
    both, keys = np.concatenate([theirs, strings[~met]]), np.concatenate([key_there, key[~met]])
    order = np.argsort(both)
    return (anchor, both[order], keys[order]), late


def _repeated_windows(contexts: DataFrame, buckets: int, folder: str) -> None:
    """Write for each slice its windows that start earlier as well."""
    names = [("slice", pa.int64()), ("data", pa.binary()), ("bucket", pa.int32())]

    def run(batches):
        for bucket, rows in by_key(batches, "bucket", "slice", "data", "text"):
            found = _Bucket()
            for number, data, text in rows:
                if bucket < 0:
                    yield table(names, [[number], [data], [None]])
                    continue
                found.add(number, data, text)
                if len(found.copies) > 1 << 17:
                    yield from (table(names, [[s], [d], [None]]) for s, d in found.rows())
            if 0 <= bucket < buckets:
                found.compare()
            elif bucket >= buckets:
                for windows in found.digests():
                    key = np.frombuffer(windows["digest"].tobytes(), "<u8")[::2]
                    for to, own in _dealt(key, buckets):
                        yield table(names, [[None], [windows[own].tobytes()], [to]])
            yield from (table(names, [[s], [d], [None]]) for s, d in found.rows())

    def merge(batches):
        for _, rows in by_key(batches, "bucket", "data"):
            w = np.concatenate([np.frombuffer(d, _WINDOW) for d, in rows])
            w = w[np.lexsort((w["start"], w["doc"], w["slice"], w["id"], w["digest"]))]
            late = w[1:][w["digest"][1:] == w["digest"][:-1]]
            found = _Bucket()
            found.windows.append(np.column_stack([late["slice"], late["doc"], late["start"].astype(np.int64),
                                                  np.ones(len(late), np.int64)]).astype(np.int64))
            yield from (table(names[:2], [[s], [d]]) for s, d in found.rows())

    found = cut(deal(contexts, "bucket", "slice").mapInArrow(run, "slice long, data binary, bucket int"), "found")
    merged = deal(found.where("bucket is not null"), "bucket").mapInArrow(merge, "slice long, data binary")
    write_by_slice(found.where("bucket is null").select("slice", "data").unionByName(merged), folder)


def _removed(texts: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
    """Of each text, which bytes a repeated window covers."""
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    step = np.zeros(begin[-1] + 1, np.int32)
    start = begin[windows["doc"]] + windows["start"].astype(np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + windows["n"].astype(np.int64) + (LENGTH - 1), -1)
    covered = np.cumsum(step[:-1]) > 0
    return [covered[a:b] for a, b in zip(begin[:-1], begin[1:])]


def find_repeats(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, str]:
    """The slices of ``docs`` and the folder that has the repeated windows of each."""
    made = cut(slices(docs, SLICE), "slices")
    size = made.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, size // BUCKET)
    anchors, windows = (shared_dir(docs.sparkSession, x) for x in ("anchors", "windows"))
    _repeated_anchors(made, buckets, anchors, hot)
    _repeated_windows(_contexts(made, buckets, anchors), buckets, windows)
    return made, windows


def repeated_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 of the bytes that no string of ``LENGTH`` bytes covers that also
    starts earlier: in a row with a smaller doc_id or, in the same row, before.

    Overlapping places count. Null ids come last; rows with one id are taken in
    the order they are read, so a repeated row is removed as a copy. Null texts
    are empty, and texts of fewer than ``LENGTH`` bytes keep all. An empty table
    gives no rows; other columns are not read.
    """
    made, windows = find_repeats(docs.select("doc_id", "text"), hot)
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
             ("kept_sha256", pa.string())]

    def run(batches):
        for number, part in slice_rows(batches):
            texts, out = utf8(part), [[] for _ in names]
            for doc_id, text, gone in zip(part.column("doc_id").to_pylist(), texts,
                                          _removed(texts, read_slice(windows, number, _ANY))):
                spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                for c, v in zip(out, (doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())):
                    c.append(v)
            yield table(names, out)

    return made.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts and n_chars counted
    anew. A character that would lose a part of its bytes is kept whole. A row
    whose whole text repeats stays, with an empty text."""
    made, windows = find_repeats(docs)

    def run(batches):
        for number, part in slice_rows(batches):
            texts = utf8(part)
            kept = []
            for text, gone in zip(texts, _removed(texts, read_slice(windows, number, _ANY))):
                if gone.any():
                    raw = np.frombuffer(text, np.uint8)
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1
                    stays = np.bincount(char, ~gone) > 0
                    text = raw[stays[char]].tobytes()
                kept.append(text.decode())
            columns = {n: c for n, c in zip(part.schema.names, part.columns)}
            nulls = columns["text"].is_null().to_pylist()
            columns["text"] = pa.array([None if z else t for z, t in zip(nulls, kept)], part.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if z else len(t) for z, t in zip(nulls, kept)],
                                              part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in part.schema.names], schema=part.schema)

    return made.mapInArrow(run, docs.schema)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir, "doc_id", "text"))
