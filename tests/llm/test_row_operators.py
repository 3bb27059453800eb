"""Operators that judge one row at a time, against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import key, rows_of
from tokenizers import Tokenizer

from tessera.llm import fingerprint, language, licenses, packing, pieces, quality, tokens
from tessera.llm.common import gathered, split_words

from llm_helpers import key, rows_of

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def both(odd_rows, small_rows, odd, small):
    return [(odd, [(r[0], r[1]) for r in odd_rows]), (small, [(r[0], r[1]) for r in small_rows])]


# -- token counts

def test_token_counts(odd, small, nothing, odd_rows, small_rows):
    t = Tokenizer.from_file(BYTE_BPE)
    for df, rows in both(odd_rows, small_rows, odd, small):
        n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
        want = sorted(((i, len((x or "").encode()), k, k > 1024) for (i, x), k in zip(rows, n)), key=key)
        assert rows_of(tokens.count_tokens(df, BYTE_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.count_tokens(nothing, BYTE_BPE).count() == 0


def test_texts_split_at_safe_places_only():
    t = Tokenizer.from_file(BYTE_BPE)
    for text in ["a  b\n\n c\t d ", "a  b", "x\x1c y \x85 z", " lead", "<|endoftext|>  a <|endoftext|>", "it's  'll"]:
        parts = tokens.SAFE.split(text)
        assert "".join(parts) == text
        assert sum(len(t.encode(p).ids) for p in parts) == len(t.encode(text).ids)


# -- packing

def _pieces(rows, capacity):
    t, out = Tokenizer.from_file(WORD_BPE), []
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(i, k, a, len(ids[a: a + capacity]), zlib.crc32(ids[a: a + capacity].tobytes()))
                for k, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=key)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(odd, small, nothing, odd_rows, small_rows, capacity):
    for df, rows in both(odd_rows, small_rows, odd, small):
        got = packing.pack(df, WORD_BPE, capacity).collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == _pieces(rows, capacity)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in sequences.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(sequences) <= math.ceil(1.02 * sum(r["length"] for r in got) / capacity) + 1
    assert packing.pack(nothing, WORD_BPE, capacity).count() == 0


def _one_at_a_time(lengths, capacity):
    """Best-two-fit, a bin at a time."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            own.append(max(fits))
            left.remove(max(fits))
            gap -= max(fits)
        if len(own) > 1:
            small = min(own)
            pairs = [(a + b, a, b) for a, b in itertools.combinations(left, 2) if small < a + b <= gap + small]
            if pairs:
                _, a, b = max((s, max(a, b), min(a, b)) for s, a, b in pairs)
                own.remove(small)
                own += [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small])
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_a_histogram_is_that_of_the_pieces(seed):
    rng = np.random.default_rng(seed)
    capacity = 40
    lengths = rng.integers(1, capacity + 1, 120) if seed % 2 else rng.choice([7, 11, 13, 20, 39], 200)
    got = [sorted(n for n, k in use.items() for _ in range(k))
           for times, use in packing.plan_bins(np.bincount(lengths, minlength=capacity + 1)) for _ in range(times)]
    assert sorted(got) == _one_at_a_time(lengths.tolist(), capacity)


def test_word_ids_with_letters_that_normalise():
    t, odd = Tokenizer.from_file(WORD_BPE), ["İstanbul. ΟΔΟΣ. ﬁne² Ⅷ.", "é́x ́y", "ǅ. ŉ, ß! ẞ", "it's 'll. a\x1cb <|STARTOFTEXT|>.", None]
    parts, index, begins = split_words(pa.array(odd), lower=False)
    found, places = packing.WordIds(WORD_BPE).of(parts)
    ids, starts = gathered(found, places[index].ravel(), "<u4")
    for k, text in enumerate(odd):
        assert ids[starts[2 * begins[k]]: starts[2 * begins[k + 1]]].tolist() == t.encode(text or "", add_special_tokens=False).ids


# -- quality rules

def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_base_counts(odd, small, nothing, odd_rows, small_rows):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df, rows in both(odd_rows, small_rows, odd, small):
        got = quality.judge(df, quality.references(df))
        assert rows_of(got, *columns) == sorted(((i, *_base(x or "")) for i, x in rows), key=key)
        assert got.where("base_failed and kept").count() == 0
    assert quality.judge(nothing, quality.references(nothing)).count() == 0
    assert quality.judge(odd, quality.references(nothing)).where("not base_failed and not kept").count() == 0


def test_references_count_all_rows(small, small_rows):
    refs = quality.references(small)
    for i, lang in enumerate(refs.langs):
        texts = [t for _, t, own in small_rows if own == lang]
        count = Counter(w for t in texts for w in t.encode().lower().split())
        top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
        assert refs.words[i] == {w: k for k, (w, _) in enumerate(top)}
        assert refs.counts[i].tolist() == [n for _, n in top] + [sum(count.values()) - sum(n for _, n in top)]
        assert refs.chars[i].sum() == sum(map(len, texts))


def test_js_distance():
    p, q = np.array([1.0, 1.0, 0.0]), np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 5.0], [2.0, 1.0, 1.0]])
    d = quality.js_distance(p, q)
    assert d[0] == 0 and d[1] == 1 and 0 < d[2] < 1
    assert quality.js_distance(np.zeros(3), q).tolist() == [1, 1, 1]


def test_quality_agrees_with_labels(spark):
    """Rows labelled bad that the base rules let pass are rejected, good ones are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs, quality.references(docs)).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, False), 0) >= 2 * n.get((0, True), 0)


def test_quality_compares_words_of_all_that_the_base_rules_admit(spark):
    """Junk of 50 to 99 words whose character classes look like prose is rejected by its words."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 9)))
    rows = [(n, " | ".join(f"{word()} {word()} {word()}" for _ in range(n // 4 + 1))) for n in (50, 60, 75, 98)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = quality.references(docs)
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), refs).collect()
    assert all(50 <= r["n_words"] < 100 and not r["base_failed"] and r["char_distance"] <= quality.MAX_CHAR_DISTANCE for r in got)
    assert all(r["word_distance"] > quality.MAX_WORD_DISTANCE and not r["kept"] for r in got)
    admitted = quality.judge(docs, refs).where("not base_failed")
    assert admitted.count() and not admitted.where("word_distance is null").count()


# -- language

def _marginal(word, vocab, log_p):
    """Sum over all segmentations, listed."""
    word = "▁" + word
    total = np.zeros(log_p.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        p, a = np.ones(log_p.shape[1]), 0
        for b in ends:
            s = word[a:b]
            if s in vocab.id:
                p = p * np.exp(log_p[vocab.id[s]])
            elif b - a == 1:
                p = p * np.exp(log_p[[vocab.byte[x] for x in s.encode()]].sum(axis=0))
            else:
                p = p * 0
            a = b
        total += p
    return np.log(total)


def test_forward_sum_is_that_of_all_segmentations():
    vocab = language.Vocabulary(PIECES)
    log_p = np.log(np.random.default_rng(0).dirichlet(np.ones(vocab.size), 3).T + 1e-12)
    words = ["the", "and", "hello", "straße", "𝔘x", "中文字", "a", "ation"]
    got = language.word_log_probs(words, vocab, log_p)
    for w, own in zip(words, got):
        assert np.allclose(own, _marginal(w, vocab, log_p), rtol=1e-9)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, PIECES, *language.piece_log_probs(docs, PIECES, language.in_training_fold()))
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


#: Rows of the odd table whose letters are no words: a run of one letter that the other rows do not have.
STRANGE = {23}


def test_language_of_odd_rows(odd, nothing, odd_rows):
    model = language.piece_log_probs(odd, PIECES)
    assert model[0] == ["de", "en"]
    got = language.identify(odd, PIECES, *model).collect()
    assert len(got) == len(odd_rows)
    letterless = sorted((i for i, t, *_ in odd_rows if not any(c.isalpha() for c in t or "")), key=lambda i: (i is None, i))
    assert sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"), key=lambda i: (i is None, i)) == letterless
    assert language.identify(nothing, PIECES, *model).count() == 0
    empty = language.piece_log_probs(nothing, PIECES)
    assert {r["lang_pred"] for r in language.identify(odd, PIECES, *empty).collect()} == {"und"}
    assert rows_of(language.identified(odd, PIECES, *model), *odd.columns) == sorted(
        (r for r in odd_rows if any(c.isalpha() for c in r[1] or "") and r[0] not in STRANGE), key=key)


def _runs(text):
    """Runs of letters in lower case, cut at WORD_CHARS."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [r[k: k + language.WORD_CHARS] for r in runs for k in range(0, len(r), language.WORD_CHARS)]


def test_language_query_against_plain_counts_and_sums(odd, small, odd_rows, small_rows):
    """Counts, smoothing, forward sums, posterior, fold and ties, recomputed row by row."""
    vocab = language.Vocabulary(PIECES)
    for df, rows in ((odd, [r[:3] for r in odd_rows]), (small.where("doc_id % 2 = 0"), [r for r in small_rows if r[0] % 2 == 0])):
        fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4
        counts = {}
        for i, text, lang in rows:
            if fold(i) != 2 and lang is not None:
                for w in _runs(text):
                    counts.setdefault(lang, Counter()).update(vocab.model.encode(w))
        langs = sorted(counts)
        p = {lang: (language.SMOOTHING + np.array([c[k] for k in range(vocab.size)])) for lang, c in counts.items()}
        p = [p[lang] / p[lang].sum() for lang in langs]
        memo = {}

        def log_probs(word):
            if word not in memo:
                w, sums = "▁" + word, [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in range(len(word) + 1)]
                for e in range(1, len(w) + 1):
                    for b in range(max(0, e - vocab.longest), e):
                        k = vocab.id.get(w[b:e])
                        if k is not None:
                            sums[e] = sums[e] + sums[b] * np.array([x[k] for x in p])
                    if w[e - 1] not in vocab.id:
                        sums[e] = sums[e] + sums[e - 1] * np.prod([[x[vocab.byte[c]] for x in p] for c in w[e - 1].encode()], axis=0)
                memo[word] = np.log(sums[-1])
            return memo[word]

        got = {(r["doc_id"], r["lang_pred"]): r for r in language.identify(
            df, PIECES, *language.piece_log_probs(df, PIECES, language.in_training_fold())).collect()}
        for i, text, _ in rows:
            total = sum((log_probs(w) for w in _runs(text)), np.zeros(len(langs)))
            if not _runs(text):
                assert got[i, "und"]["score"] == 0
                continue
            r = got[i, langs[int(np.argmax(total))]]
            assert r["held_out"] == (fold(i) == 2)
            assert abs(r["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_texts_in_no_learned_language_go(spark, small):
    rnd = random.Random(3)
    noise = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(n))
    strange = [noise(60), "ქართული ენა ქართველური ენების ოჯახის ენაა " * 4, noise(400) + " the"]
    short = ["qzx vkj", "ქართული ენა"]
    rows = [(10_000 + k, t) for k, t in enumerate(strange + short)]
    df = small.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"] for r in language.identified(df, PIECES, *language.piece_log_probs(small, PIECES)).collect()}
    letters = {r["doc_id"] for r in small.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == letters | {10_003, 10_004}


# -- pieces

def _best_score(text, coder, pieces_):
    """Viterbi by all pieces at every place."""
    score = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        if text[e - 1] not in coder.single:
            score[e] = score[e - 1] + coder.unknown
        for s in range(max(0, e - 16), e):
            if text[s:e] in pieces_:
                score[e] = max(score[e], score[s] + pieces_[text[s:e]])
    return score[-1]


def test_pieces_round_trip_and_best_path(odd, small, nothing, odd_rows, small_rows):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = pieces.PieceCoder(PIECES)
    scores = {m.id_to_piece(i).replace("▁", " "): m.get_score(i) for i in range(m.get_piece_size())
              if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    for df, rows in both(odd_rows, small_rows, odd, small):
        got = pieces.encode_documents(df, PIECES, with_ids=True).collect()
        assert all(r["round_trip"] for r in got)
        assert sorted(((r["doc_id"], coder.decode(r["ids"]).decode()) for r in got), key=key) == sorted(
            ((i, t or "") for i, t in rows), key=key)
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            assert r["decoded_sha256"] == hashlib.sha256(coder.decode(r["ids"])).hexdigest()
            assert r["n_pieces"] == len(r["ids"])
    for text in ["", "the cat  sat\non ▁ it", "naïve 日本", "aaaa bbbb", " lead", "x" * 50]:
        assert math.isclose(sum(coder.best(p)[1] for p in coder.parts(text)), _best_score(" " + text, coder, scores) if text else 0)
    assert pieces.encode_documents(nothing, PIECES).count() == 0


# -- fingerprints

def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        yield i, t, t[: len(t) - len(t) // 3] + after[: len(t) // 3], after


@pytest.mark.parametrize("range_rows", [4000, 7])
def test_fingerprints(odd, small, nothing, odd_rows, small_rows, range_rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    for df, rows in both(odd_rows, small_rows, odd, small):
        got = fingerprint.compare_with_next(df).collect()
        want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in _edited(rows)]
        assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
        by_text = {}
        for r, (_, t, e, _) in zip(sorted(got, key=lambda r: key(tuple(r)[:3])), sorted(_edited(rows), key=lambda x: key(
                (x[0], len(x[1]), hashlib.sha256(x[2].encode()).hexdigest())))):
            for text, print_ in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
                assert by_text.setdefault(text, print_) == print_
            assert int(r["fingerprint"].split(":")[1]) == len(_shingles(t))
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprint.compare_with_next(nothing).count() == 0


def test_sketch_estimates():
    from tessera.llm.common import WordHashes

    h, words = WordHashes(), [str(i).encode() for i in range(12_000)]
    long_, short = fingerprint.Sketch(b" ".join(words), h), fingerprint.Sketch(b" ".join(words[:2000]), h)
    assert abs(short.containment(long_) - 1) < 1e-9 and abs(long_.containment(short) - 1 / 6) < 0.05
    assert abs(short.likeness(long_) - 1 / 6) < 0.05
    other = fingerprint.Sketch(b" ".join(words[1000:3000]), h)
    assert abs(short.likeness(other) - 996 / 2996) < 0.1


# -- licenses

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def _scan(text, templates=licenses.TEMPLATES):
    w, places, labels = _WORDS.findall(text.translate(_LOW)), [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k: k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    more, best, step = set(labels), 0.0, licenses.step_for(templates)
    for s in range(0, max(1, len(w) - step), step):
        block = set(w[s: s + 2 * step])
        for label, template in templates:
            own = set(_WORDS.findall(template.translate(_LOW)))
            telling = licenses.TELLING.get(label, set()) & own
            if len(block & own) >= math.ceil(len(own) * licenses.THRESHOLD - 1e-9) and telling <= block:
                more.add(label)
                best = max(best, len(block & own) / len(own))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(more)), best)


def test_licenses_are_told_apart(spark):
    texts = {"Released under the BSD License": "bsd", "released under the Apache License": "apache", "Licensed under CC BY 4.0": "",
             "under the terms of the GNU General Public License": "gpl", "under the terms of the GNU Lesser General Public License": "gpl,lgpl",
             "Released under the MIT License.": "mit", "licensed under CC BY-NC 4.0": "cc-by-nc", "Released under the terms of a license": ""}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_long_templates_and_many_words(spark):
    """A template of 400 words, whole, in part and over blocks; more template words than 16 bits hold."""
    body = [f"w{i}" for i in range(400)]
    many = [(f"m{k}", " ".join(f"x{k}y{i}" for i in range(350))) for k in range(100)]
    templates = [("body", " ".join(body)), *many]
    fill = ["f"] * 333
    rows = [(0, body), (1, fill + body + fill), (2, body[:320]), (3, body[:319]), (4, fill * 3 + body[50:380] + fill), (5, many[99][1].split())]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = rows_of(licenses.scan_licenses(df, templates), "doc_id", "labels", "score")
    want = [(i, *_scan(" ".join(t), templates)[5:]) for i, t in rows]
    assert got == want and [r[1] for r in want] == ["body", "body", "body", "", "body", "m99"]


def test_license_scan(odd, small, nothing, odd_rows, small_rows):
    for df, rows in both(odd_rows, small_rows, odd, small):
        got = rows_of(licenses.scan_licenses(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                      "labels", "score")
        assert got == sorted(((i, *_scan(x or "")) for i, x in rows), key=key)
        assert any(r[6] for r in got)
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_containment_join_drops_no_pair(spark, threshold):
    rng = np.random.default_rng(1)
    some = lambda n: sorted(rng.choice(40, n, replace=False).tolist())
    blocks = [(i, some(rng.integers(0, 30))) for i in range(200)]
    templates = [(f"t{i}", some(rng.integers(1, 12))) for i in range(25)]
    got = licenses.containment_join(spark.createDataFrame(blocks, "row long, words array<int>"),
                                    spark.createDataFrame(templates, "label string, words array<int>"), threshold).collect()
    want = [(i, t, len(set(b) & set(w)) / len(w)) for i, b in blocks for t, w in templates
            if len(set(b) & set(w)) >= math.ceil(len(w) * threshold - 1e-9)]
    assert sorted(map(tuple, got)) == sorted(want)




def test_memos_are_bounded_in_characters(monkeypatch):
    from tessera.llm import common
    memo = common.Memo()
    long_part = "x" * (common.MEMO_PART + 1)
    memo.update({"ab": 1, long_part: 2})
    memo.settle(["ab", long_part])
    assert memo == {"ab": 1} and memo.chars == 2
    monkeypatch.setattr(common, "MEMO_CHARS", 4)
    memo.update({"cde": 1})
    memo.settle(["cde"])
    assert memo == {} and memo.chars == 0
    hashes = common.WordHashes()
    assert len(hashes.of([b"a", b"b" * 1000, b"a"])) == 3 and list(hashes) == [b"a"]


def test_texts_without_spaces_count_alike_in_a_slice_and_after(spark):
    # parts longer than the memo keeps, met twice and in several slices
    rows = [(i, ("\u8a9e\u6587" * (400 + i % 3)) + " ab\n" * (i % 2)) for i in range(12)] + [(12, "a" * 5000), (13, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = tokens.tokenizer(path)
    want = [(i, len(coder.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs, path).collect()) == want
    found = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(found) == 14 and all(r.round_trip for r in found)
