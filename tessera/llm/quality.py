"""Quality rules (operator 5): distribution divergence from language references.

Two histograms of a document, its character classes and its common words, are
compared with those of each language by Jensen-Shannon distance (base 2, 0 to
1); a document is judged by the language it is nearest to. Short texts have
noisy histograms, so each comparison is made from a least length on. The
references are counts over all rows with a language: character classes, and the
words that are most frequent in it, summed by Spark from counts by batch.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, documents, strings, table, text_slices, word_hashes, worker_memo

#: Words of a language that its reference names; all others count as one.
COMMON_WORDS = 100
#: Largest distance of the character classes, and least characters to compare.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.28, 200
#: Base rules: least words, and largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Largest distance of the common words, and least words to compare: every text
#: that the base rules admit is long enough.
MAX_WORD_DISTANCE, MIN_WORDS = 0.48, LEAST_WORDS

SYMBOLS = frozenset("#*$%&|<>")
#: Character classes by the first letter of the Unicode category, letters by case.
CLASSES = ("upper", "lower", "letter", "digit", "punctuation", "symbol", "space", "mark", "other")
_CLASS_OF = {"Lu": 0, "Ll": 1, "L": 2, "N": 3, "P": 4, "S": 5, "Z": 6, "M": 7, "C": 8}

COLUMNS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
           ("nearest_lang", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())]


def _char_class(c: str) -> int:
    if c in "\t\n\v\f\r":
        return 6
    kind = unicodedata.category(c)
    return _CLASS_OF.get(kind, _CLASS_OF[kind[0]] if kind[0] in _CLASS_OF else 2)


class CharClasses:
    """Histograms of character classes; the class table is made on first use."""

    def __init__(self):
        self.of_code = np.fromiter((_char_class(chr(i)) for i in range(1 << 16)), np.uint8, 1 << 16)

    def histogram(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = codes < 1 << 16
        counts = np.bincount(self.of_code[codes[low]], minlength=len(CLASSES))
        for c in codes[~low].tolist():
            counts[_char_class(chr(c))] += 1
        return counts


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of histogram ``p`` from each row of ``q``;
    an empty histogram is at distance 1."""
    if not p.sum():
        return np.ones(len(q))
    p, q = (p / p.sum())[None, :], q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


@dataclass
class References:
    """Of each language: histogram of character classes, its common words and
    their histogram with a last place for all others."""

    langs: list[str]
    chars: np.ndarray
    words: list[dict[bytes, int]]
    counts: np.ndarray


def references(docs: DataFrame, common: int = COMMON_WORDS) -> References:
    """References from all rows of ``docs`` (text, lang) with a language. The
    driver gets ``common`` words and the classes of each language, no more."""
    names = [("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]

    def run(batches):
        classes = worker_memo("classes", CharClasses)
        for part in text_slices(batches, max_bytes=8 << 20):
            words: dict[str, Counter] = {}
            chars: dict[str, np.ndarray] = {}
            for text, lang in zip(strings(part), part.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(text.encode().lower().split())
                chars[lang] = chars.get(lang, 0) + classes.histogram(text)
            for lang, c in words.items():
                yield table(names, [[lang] * len(c), list(c), list(c.values())])
                # no word holds a space: rows of the classes, and of all words
                own = chars[lang].tolist() + [sum(c.values())]
                yield table(names, [[lang] * len(own), [b" %d" % i for i in range(len(own))], own])

    counts = (docs.where(F.col("lang").isNotNull()).select("text", "lang")
              .mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    of_class = F.col("word").startswith(F.lit(b" "))
    top = Window.partitionBy("lang", of_class).orderBy(F.desc("n"), "word")
    rows = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max(common, len(CLASSES) + 1)).collect()
    langs = sorted({r["lang"] for r in rows})
    chars, total = np.zeros((len(langs), len(CLASSES))), np.zeros(len(langs))
    ranked: list[dict[bytes, tuple[int, int]]] = [{} for _ in langs]
    for r in rows:
        i, word = langs.index(r["lang"]), bytes(r["word"])
        if not word.startswith(b" "):
            if r["rank"] <= common:
                ranked[i][word] = (r["rank"] - 1, r["n"])
        elif int(word) == len(CLASSES):
            total[i] = r["n"]
        else:
            chars[i, int(word)] = r["n"]
    hist = np.zeros((len(langs), common + 1))
    for i, own in enumerate(ranked):
        for place, n in own.values():
            hist[i, place] = n
        hist[i, common] = total[i] - hist[i].sum()
    return References(langs, chars, [{w: p for w, (p, _) in own.items()} for own in ranked], hist)


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Number of words in windows of ``width`` words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    local = np.unique(ids, return_inverse=True)[1].astype(np.uint64)
    base, code = np.uint64(int(local.max()) + 1), local[:n].copy()
    for j in range(1, width):
        if int(base) ** (j + 1) >= 1 << 64:  # codes of the windows so far, made small again
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = code * base + local[j: j + n]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids), bool)
    for j in range(width):
        covered[j: j + n] |= count[inverse] > 1
    return int(covered.sum())


def judge(docs: DataFrame, refs: References) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts and the verdict.

    Distances are rounded to 1e-9, so they do not depend on the order of sums.
    ``kept`` is false if a base rule fails, or if the text is long enough to be
    compared and lies too far from every language. A null or empty text has no
    words and fails the base rules. Without references nothing is compared. A
    null id stays null; repeated rows give repeated results; other columns,
    ``lang`` among them, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs)  # languages x (common words + classes)

    def run(batches):
        refs, classes, hashes = shared.value, CharClasses(), word_hashes()
        for part in text_slices(batches):
            out = [[] for _ in COLUMNS]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part)):
                for c, v in zip(out, (doc_id, *_judged(text, refs, classes, hashes))):
                    c.append(v)
            yield table(COLUMNS, out)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, nearest_lang string, char_distance double, word_distance double")


def kept(docs: DataFrame, refs: References) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        refs, classes, hashes = shared.value, CharClasses(), word_hashes()
        for part in text_slices(batches):
            yield part.filter(pa.array([_judged(x, refs, classes, hashes)[6] for x in strings(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judged(text: str, refs: References, classes: CharClasses, hashes: WordHashes) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeats = repeated_words(hashes.of(words))
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    # bytes that begin a character, without the white space between words
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    near, char_d, word_d = None, None, None
    if refs.langs:
        if len(text) >= MIN_CHARS:
            by_char = js_distance(classes.histogram(text), refs.chars)
            char_d = round(float(by_char.min()), 9)
            near = refs.langs[int(np.argmin(by_char))]
        if n >= MIN_WORDS:
            seen = Counter(raw.lower().split())
            by_word = np.empty(len(refs.langs))
            for i, places in enumerate(refs.words):
                own = np.zeros(refs.counts.shape[1])
                for w in places.keys() & seen.keys():
                    own[places[w]] = seen[w]
                own[-1] = n - own.sum()
                by_word[i] = js_distance(own, refs.counts[i: i + 1])[0]
            word_d = round(float(by_word.min()), 9)
            near = refs.langs[int(np.argmin(by_word))]
    kept = not failed and (char_d is None or char_d <= MAX_CHAR_DISTANCE) and (word_d is None or word_d <= MAX_WORD_DISTANCE)
    return (n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, kept,
            near, char_d, word_d)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return judge(docs, references(docs))
