"""Operators that compare rows with all others, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from llm_helpers import key, rows_of
from pyspark.sql import functions as F

from tessera.llm import language_model, near_duplicates, substrings
from tessera.llm.elias_fano import BigramTrie, EliasFano
from tessera.llm.suffix_array import common_prefixes, suffix_array

# -- near duplicates


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows):
    """(doc_id, class_id, copy_id, n_links) by comparing all sets."""
    sets = [_shingles(t) for _, t in rows]
    ids = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        ids[s].append(i)
    nodes = [s for s in ids if s]
    links = {s: [o for o in nodes if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in nodes}
    least = lambda many: min((i for i in many if i is not None), default=None)
    out = []
    for (i, _), s in zip(rows, sets):
        if not s:
            out.append((i, i, i, 0))
            continue
        seen, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out.append((i, least(x for o in seen for x in ids[o]), least(ids[s]), len(links[s])))
    return sorted(out, key=key)


CLASS = ["doc_id", "class_id", "copy_id", "n_links"]


def test_classes(odd, small, nothing, odd_rows, small_rows):
    assert rows_of(near_duplicates.classes(odd), *CLASS) == _classes([r[:2] for r in odd_rows])
    assert rows_of(near_duplicates.classes(small), *CLASS) == _classes([r[:2] for r in small_rows])
    assert near_duplicates.classes(nothing).count() == 0


@pytest.fixture(scope="module")
def near_groups():
    """A chain of texts, each near the next only, a large group of near copies, and others."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, text = [], [word() for _ in range(200)]
    for k in range(12):
        rows.append((100 + k, " ".join(text)))
        text = text[6:] + [word() for _ in range(6)]
    base = [word() for _ in range(120)]
    for k in range(70):
        own = list(base)
        for _ in range(k % 4):
            own[rnd.randrange(120)] = word()
        rows.append((500 - k, " ".join(own)))
    rows += [(1000 + k, " ".join(word() for _ in range(40))) for k in range(30)]
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_blocks_and_chains(spark, near_groups, block):
    docs = spark.createDataFrame(near_groups, "doc_id long, text string").repartition(4)
    assert rows_of(near_duplicates.classes(docs, block=block), *CLASS) == _classes(near_groups)


def test_blocks_follow_the_shingles_of_long_texts(spark, near_groups, monkeypatch):
    docs = spark.createDataFrame(near_groups, "doc_id long, text string")
    assert rows_of(near_duplicates.classes(docs, block_shingles=40), *CLASS) == _classes(near_groups)
    # long near copies that all differ: no block has much more than its shingles
    words = [f"w{i}" for i in range(3_000)]
    rows = [(i, " ".join(words[:i * 9] + [f"x{i}"] + words[i * 9:])) for i in range(24)]
    sets = [near_duplicates.shingles(near_duplicates.word_hashes().of(t.encode().split())) for _, t in rows]
    whole = near_duplicates._links(sets, 0.8, 0)
    monkeypatch.setattr(near_duplicates, "LOOKUP", 100)
    assert all((x == y).all() for x, y in zip(near_duplicates._links(sets, 0.8, 0), whole)) and len(whole[0]) == 276
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=9_000)
    assert rows_of(got, *CLASS) == [(i, 0, i, 23) for i in range(24)]


def test_one_row_of_a_class_stays(odd, small, odd_rows, small_rows):
    kept = near_duplicates.without_near_duplicates(small)
    want = [i for i, c, *_ in _classes([r[:2] for r in small_rows]) if i == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == small.columns
    got = near_duplicates.without_near_duplicates(odd)
    assert got.columns == odd.columns
    texts = [r["text"] for r in got.collect()]
    assert len({_shingles(t) for t in texts if _shingles(t)}) == sum(bool(_shingles(t)) for t in texts)
    assert {i for i, c, *_ in _classes([r[:2] for r in odd_rows]) if i == c} == {r["doc_id"] for r in got.collect()}


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = near_duplicates.choose_bands(threshold)
        assert bands * rows <= near_duplicates.MAX_HASHES
        assert 1 - (1 - threshold ** rows) ** bands >= near_duplicates.RECALL


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = dict(map(tuple, near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    while True:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == {x: r for x, r in root.items() if x != r}


# -- repeated bytes

def _repeats(rows):
    """Per row, which bytes go; rows in the order of ids, nulls last."""
    seen, gone = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        b = (rows[k][1] or "").encode()
        own = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s: s + 100]
            if w in seen:
                own[s: s + 100] = True
            seen.add(w)
        gone[k] = own
    return [gone[k] for k in range(len(rows))]


def _digest(rows):
    out = []
    for (i, t), g in zip(rows, _repeats(rows)):
        b = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((g[1:] & ~g[:-1]).sum()) + int(g[:1].sum())
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(b[~g].tobytes()).hexdigest()))
    return sorted(out, key=key)


DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("hot", [2, 5, substrings.HOT])
def test_repeated_bytes(odd, small, nothing, odd_rows, small_rows, hot):
    for df, rows in ((small, [r[:2] for r in small_rows]), (odd, [r[:2] for r in odd_rows])):
        assert rows_of(substrings.repeated_bytes(df, hot), *DIGEST) == _digest(rows)
    assert substrings.repeated_bytes(nothing).count() == 0


def test_texts_without_repeats_are_whole_characters(odd, odd_rows):
    got = substrings.without_repeats(odd)
    assert got.columns == odd.columns and got.schema == odd.schema
    out = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
    want = []
    for (i, t, *_), g in zip(odd_rows, _repeats([r[:2] for r in odd_rows])):
        at, kept = 0, ""
        for c in t or "":
            n = len(c.encode())
            kept += "" if g[at: at + n].all() else c
            at += n
        want.append((i, None if t is None else kept))
    assert out == sorted(want, key=key)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


@pytest.mark.parametrize("shard", [300, 3000, 1 << 20])
def test_shards_of_a_bucket_are_merged(shard):
    rng = np.random.default_rng(3)
    base = [bytes(rng.integers(97, 100, 400).astype(np.uint8)) for _ in range(6)]
    docs = []
    for _ in range(60):
        t = bytearray(base[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            t[rng.integers(400)] = 120
        docs.append(bytes(t[: rng.integers(50, 401)]))
    _, at, doc, start, n = substrings.anchor_runs(docs)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in docs])])
    ids = rng.permutation(len(docs))
    data = np.zeros(len(at), substrings._CONTEXT)
    data["id"], data["doc"], data["start"], data["n"], data["anchor"] = ids[doc], doc, start - begin[doc], n, at - start
    texts = [docs[k][s: s + m + 99] for k, s, m in zip(doc, start - begin[doc], n)]
    bucket = substrings._Bucket()
    bucket.add(7, data.tobytes(), zstandard.compress(b"".join(texts)))
    bucket.compare(shard)
    got = [np.zeros(len(t), bool) for t in docs]
    for number, found in bucket.rows():
        assert number == 7
        for d, s, m in np.frombuffer(found, substrings._ANY).tolist():
            got[d][s: s + m + 99] = True
    want = _repeats([(int(i), t.decode()) for i, t in zip(ids, docs)])
    assert all((a == b).all() for a, b in zip(got, want)) and any(w.any() for w in want)


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2000])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(n, letters):
    b = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    b[n // 2: n // 2 + n // 3] = b[: n // 3]
    raw, depth = b.tobytes(), 100
    array, rank = suffix_array(b, depth)
    assert sorted(array.tolist()) == list(range(n))
    assert all(raw[array[i]: array[i] + depth] <= raw[array[i + 1]: array[i + 1] + depth] for i in range(n - 1))
    for i, shared in enumerate(common_prefixes(b, array, rank, depth).tolist()):
        if i:
            x, y = raw[array[i - 1]:][:depth], raw[array[i]:][:depth]
            assert shared == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


# -- language model

@pytest.mark.parametrize("n", [1, 2, 100, 5000])
@pytest.mark.parametrize("top", [1, 1000, 1 << 45])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    e = EliasFano.encode(v)
    assert (e[np.arange(n)] == v).all()
    q = np.concatenate([rng.integers(0, top + 5, 300), v[:50], v[:50] + np.uint64(1)]).astype(np.uint64)
    assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 20_000):
        pair = np.unique(rng.integers(0, 300, n) << 32 | rng.integers(0, 500, n))
        left, right, code = pair >> 32, pair & 0xFFFFFFFF, rng.integers(1, 256, len(pair)).astype(np.uint8)
        arrays = BigramTrie.build(left, right, code).arrays()
        trie = BigramTrie.open(lambda name, dtype: arrays[name].view(dtype))
        a, b = rng.integers(0, 320, 3000), rng.integers(0, 520, 3000)
        there = {x: c for x, c in zip(zip(left.tolist(), right.tolist()), code.tolist())}
        assert trie.find(a, b).tolist() == [there.get(x, 0) for x in zip(a.tolist(), b.tolist())]


def _scores(rows, held_out):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    single, pair = Counter(), Counter()
    for t, out in zip(tokens, held_out):
        if not out:
            single.update(t)
            pair.update(zip([0, *t[:-1]], t))
    total, distinct = sum(single.values()), len(single)
    for (i, _), t, out in zip(rows, tokens, held_out):
        p = [(single[w] + 1) / (total + distinct + 1) for w in t]
        model = [(pair[v, w] + language_model.MU * q) / ((single[None] if v == 0 else single[v]) + language_model.MU)
                 for v, w, q in zip([0, *t[:-1]], t, p)]
        yield i, out, len(t), sum(single[w] > 0 for w in t), total, sum(map(math.log10, p)), sum(map(math.log10, model))


def test_scores(odd, small, nothing, odd_rows, small_rows):
    for df, rows in ((odd, [r[:2] for r in odd_rows]), (small, [r[:2] for r in small_rows])):
        out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
        got = sorted(map(tuple, language_model.score(df, fold).collect()), key=key)
        want = sorted(_scores(rows, out), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for g, w in zip(got, want):
            assert math.isclose(g[5], w[5], rel_tol=1e-9)
            assert abs(g[6] - w[6]) <= 0.02 * w[2]  # the codes' step is 10 / 254
    assert language_model.score(nothing, F.lit(False)).count() == 0
    assert {r["score"] for r in language_model.score(odd, F.lit(True)).collect()} == {0.0}


def test_model_predicts_held_out_text_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_model.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert docs.count() and r[0] > r[1]
