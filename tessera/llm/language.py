"""Language ID (operator 7): segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
text is its words, runs of letters in lower case; digits and signs say little of
a language. A word's probability is the sum over all its segmentations into
pieces, computed by the forward algorithm, and a text's the product over its
words; each distinct word is summed once, all words of a length at a time.

The probabilities come from one pass of Spark over the training rows: counts of
pieces in the library's own segmentation, summed by task before they are
shuffled, then smoothed.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, documents, expanded, id_remainder, split_words, table, text_slices, worker_memo

#: Added to each piece's count in each language.
SMOOTHING = 0.1
#: Longer runs of letters are cut into words of this many.
WORD_CHARS = 48
#: Fold that is held out of training: crc32(doc_id) mod FOLDS == HELD_OUT.
FOLDS, HELD_OUT = 4, 2
#: Label of texts without any letter.
UNDETERMINED = "und"
#: Signs that may stand before and after a word.
SIGNS = string.punctuation

#: Log probability per letter (and word mark) below which a text of so many letters is in none of the languages.
LEAST_LOG_PROB, MIN_LETTERS = -4.0, 100

COLUMNS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]


class Vocabulary:
    """The normal pieces of a SentencePiece model by text; byte pieces stand for
    characters that no piece has."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in range(n)]
        self.size = n
        self.id = {self.model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))


def word_log_probs(words: list[str], vocab: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """Log probability of each word (with a leading space mark) in each language:
    the forward sum over all segmentations into pieces. ``log_p`` is pieces x
    languages. Returns words x languages."""
    out = np.empty((len(words), log_p.shape[1]))
    marked = ["▁" + w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        texts = [marked[i] for i in own]
        forward = np.full((n + 1, len(own), log_p.shape[1]), -np.inf)
        forward[0] = 0
        for end in range(1, n + 1):
            ways = []
            for start in range(max(0, end - vocab.longest), end):
                ids = np.fromiter((vocab.id.get(t[start:end], -1) for t in texts), np.int64, len(texts))
                if end - start > 1 and (ids < 0).all():
                    continue
                step = np.where(ids[:, None] >= 0, log_p[ids], -np.inf)
                if end - start == 1:  # characters that are no piece: their bytes
                    for k in np.flatnonzero(ids < 0):
                        step[k] = log_p[[vocab.byte[b] for b in texts[k][start].encode()]].sum(axis=0)
                ways.append(forward[start] + step)
            forward[end] = np.logaddexp.reduce(ways, axis=0) if len(ways) > 1 else ways[0]
        out[own] = forward[n]
    return out


def letter_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The runs of letters of a column of texts in lower case: distinct words, for
    each word its place among them, where each text's words begin (one more than
    texts)."""
    raw, index, begins = split_words(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
    trimmed = pc.utf8_trim(raw, SIGNS)
    plain = pc.and_(pc.utf8_is_alpha(trimmed), pc.less_equal(pc.utf8_length(trimmed), WORD_CHARS))
    coded = pc.if_else(plain, trimmed, "").dictionary_encode()
    words = coded.dictionary.to_pylist()
    place = {w: i for i, w in enumerate(words)}
    first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.ones(len(first), np.int64)
    others: dict[int, list[int]] = {}
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
        runs = "".join([c if c.isalpha() else " " for c in raw[i].as_py()]).split()
        others[i] = [place.setdefault(w, len(place)) for r in runs
                     for w in (r[k: k + WORD_CHARS] for k in range(0, len(r), WORD_CHARS))]
        size[i] = len(others[i])
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int64)
    flat[at[size == 1]] = first[size == 1]
    for i, own in others.items():
        flat[at[i]: at[i] + len(own)] = own
    found, starts = expanded(flat, size, index)
    return list(place), found, starts[begins]


def piece_log_probs(docs: DataFrame, path: str, train: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities (pieces x languages) learned from the
    rows of ``docs`` (text, lang) where ``train`` holds and lang is not null.

    What reaches the driver is a number for each piece and language.
    """
    names = [("lang", pa.string()), ("piece", pa.int32()), ("n", pa.int64())]

    def run(batches):
        vocab, counts = worker_memo(("vocabulary", path), lambda: Vocabulary(path)), {}

        def counted():
            for lang, own in counts.items():
                n = np.zeros(vocab.size, np.int64)
                words = list(own)
                for at in range(0, len(words), 10_000):
                    some = words[at: at + 10_000]
                    ids = vocab.model.encode(some, num_threads=1)
                    size = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
                    n += np.bincount(flat, np.repeat([own[w] for w in some], size), vocab.size).astype(np.int64)
                used = np.flatnonzero(n)
                yield table(names, [[lang] * len(used), used, n[used]])

        for part in text_slices(batches):
            words, index, begins = letter_words(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(langs)), np.diff(begins))
            for lang in set(langs.tolist()):
                n = np.bincount(index[(langs == lang)[of]], minlength=len(words))
                own = counts.setdefault(lang, Counter())
                for i in np.flatnonzero(n).tolist():
                    own[words[i]] += int(n[i])
            if sum(map(len, counts.values())) > MEMO_ENTRIES:
                yield from counted()
                counts.clear()
        yield from counted()

    rows = docs.where(F.col("lang").isNotNull())
    if train is not None:
        rows = rows.where(train)
    counts = (rows.select("text", "lang").mapInArrow(run, "lang string, piece int, n long")
              .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect())
    size, langs = Vocabulary(path).size, sorted({r["lang"] for r in counts})
    if len(langs) * size > 1 << 25:
        raise ValueError(f"{len(langs)} languages are too many for one table of piece probabilities")
    n = np.full((size, len(langs)), SMOOTHING)
    place = {x: i for i, x in enumerate(langs)}
    for r in counts:
        n[r["piece"], place[r["lang"]]] += r["n"]
    return langs, np.log(n / n.sum(axis=0)) if langs else n


class _Predictor:
    """Languages and posterior probabilities of texts; one memo of words for all
    tasks that a Python worker runs with one model."""

    def __init__(self, path: str, langs: list[str], log_p: np.ndarray):
        self.vocab, self.langs, self.log_p = Vocabulary(path), langs, log_p
        self.place: dict[str, int] = {}
        self.sums = np.empty((1 << 16, len(langs)))

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MEMO_ENTRIES:
            self.place = {}
        new = [w for w in words if w not in self.place]
        begin = len(self.place)
        while begin + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
        for at in range(0, len(new), 50_000):  # bounds the tables of the forward sums
            some = new[at: at + 50_000]
            self.sums[begin + at: begin + at + len(some)] = word_log_probs(some, self.vocab, self.log_p)
        self.place.update(zip(new, range(begin, begin + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: pa.Array) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Language and posterior of each text, its log probability in that language,
        and the letters and word marks that this is the probability of."""
        words, index, begins = letter_words(texts)
        n = len(begins) - 1
        pred, score, log_prob, letters = [UNDETERMINED] * n, [0.0] * n, np.zeros(n), np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(begins)) if self.langs else []
        if len(full):
            places = self._places(words)
            total = np.add.reduceat(self.sums[places[index]], begins[full], axis=0)
            best = np.argmax(total, axis=1)
            top = total[np.arange(len(full)), best]
            posterior = 1 / np.exp(total - top[:, None]).sum(axis=1)
            for i, k, p in zip(full.tolist(), best.tolist(), posterior.tolist()):
                pred[i], score[i] = self.langs[k], p
            sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
            log_prob[full], letters[full] = top, np.add.reduceat(sizes[index], begins[full])
        return pred, score, log_prob, letters


def identify(docs: DataFrame, path: str, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    The prediction reads the text alone; score is the posterior probability of
    the language, all languages being equally likely before. A null text, or one
    without a letter, or any text when nothing was learned, is ``und`` with
    score 0. Equal posteriors go to the language first in the alphabet. A null
    id stays null; repeated rows give repeated results; other columns are not read.
    """
    model, name = docs.sparkSession.sparkContext.broadcast(log_p), uuid.uuid4().hex  # pieces x languages, bounded above

    def run(batches):
        predict = worker_memo(name, lambda: _Predictor(path, langs, model.value))
        for part in text_slices(batches):
            ids = part.column("doc_id")
            held_out = [id_remainder(i, FOLDS) == HELD_OUT for i in ids.to_pylist()]
            yield table(COLUMNS, [ids, held_out, *predict(part.column("text"))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, path: str, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages, all columns as they
    are. A text without a letter goes, and one of at least ``MIN_LETTERS`` whose log
    probability per letter, in its best language, is below ``LEAST_LOG_PROB``: text in
    a language that was not learned, or letters that are no words."""
    model, name = docs.sparkSession.sparkContext.broadcast(log_p), uuid.uuid4().hex

    def run(batches):
        predict = worker_memo(name, lambda: _Predictor(path, langs, model.value))
        for part in text_slices(batches):
            pred, _, log_prob, letters = predict.judge(part.column("text"))
            strange = (letters >= MIN_LETTERS) & (log_prob < LEAST_LOG_PROB * letters)
            yield part.filter(pa.array(np.array([x != UNDETERMINED for x in pred], bool) & ~strange, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_training_fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != HELD_OUT


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(docs, path, *piece_log_probs(docs, path, in_training_fold()))
