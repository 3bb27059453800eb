"""License scans (operator 1): an exact set-similarity join of text blocks with
license templates.

A template is found in a block if the block has at least ``THRESHOLD`` of the
template's distinct words. Words are put in one global order, rarest in the
corpus first. A block that has enough words of a template shares at least one
word between the two prefixes (the rarest words, as many as may be missing and
one more), so only blocks that meet a template there are looked at (prefix
filter), if they have enough words at all (length filter) and enough words are
left in both after the word they share (positional filter). What remains is
verified on the whole sets, and on the telling words: a part of a short template
is not enough if it lacks the word that tells the license from another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, table, text_slices, utf8

#: Phrases of the base scan and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of public licenses and notices, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Words that tell a license from others, by label. A block must have those of them that are in the template.
TELLING = {"mit": {"mit"}, "apache": {"apache"}, "gpl": {"gnu", "general"}, "lgpl": {"lesser"}, "cc-by-nc": {"cc", "nc"},
           "bsd": {"bsd"}, "mpl": {"mozilla"}, "unlicense": {"unencumbered"}}
#: Part of a template's words that a block must have.
THRESHOLD = 0.8
#: Words from one block to the next, at least; a block has twice as many, and a passage
#: of up to so many words is whole in some block. A longer template makes longer blocks.
STEP = 32

#: Prefix words of all templates up to which they are sent to all tasks.
MAX_BROADCAST_WORDS = 100_000

#: Bytes of words, A-Z lower-cased, and spaces for all others.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                    for b in range(256))

_COLUMNS = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
            ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
            ("blocks", pa.list_(pa.list_(pa.int32())))]


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def phrase_places(own: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand consecutively."""
    places, at = [], -1
    while True:
        try:
            at = own.index(phrase[-1], at + 1)
        except ValueError:
            return places
        start = at - len(phrase) + 1
        if start >= 0 and own[start: at + 1] == phrase:
            places.append(start)


def step_for(templates: list[tuple[str, str]]) -> int:
    """Words from one block to the next, so that every template fits in some block."""
    return max([STEP, *(len(words(text.encode())) for _, text in templates)])


def scan(docs: DataFrame, vocabulary: list[str], least: int, step: int = STEP) -> DataFrame:
    """The base scan of each row of ``docs`` (doc_id, text), and its blocks as the
    places in ``vocabulary`` of their distinct words; blocks with fewer than
    ``least`` such words are left out (length filter)."""
    number = {w.encode(): i for i, w in enumerate(vocabulary)}
    phrases = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for part in text_slices(batches):
            out = [[] for _ in _COLUMNS]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part)):
                own = words(text)
                found = [(at, label) for p, label in phrases for at in phrase_places(own, p)]
                places = [at for at, _ in found]
                known = np.fromiter((number.get(w, -1) for w in own), np.int32, len(own))
                hits = np.flatnonzero(known >= 0)
                starts = np.arange(0, max(1, len(own) - step), step)
                low, high = np.searchsorted(hits, starts), np.searchsorted(hits, starts + 2 * step)
                blocks = [np.unique(known[hits[a:b]]).tolist() for a, b in zip(low, high) if b - a >= least]
                for c, v in zip(out, (row, doc_id, len(own), len(places), min(places, default=None),
                                      max(places, default=None), sorted({x for _, x in found}),
                                      [b for b in blocks if len(b) >= least])):
                    c.append(v)
                row += 1
            yield table(_COLUMNS, out)

    return docs.select("doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, "
             "base_labels array<string>, blocks array<array<int>>")


def containment_join(blocks: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of ``blocks`` (row, words) and ``templates`` (template, label, words)
    whose block has at least ``threshold`` of the template's words.

    ``words`` are distinct numbers in the global order, rarest first, sorted; a
    block may leave out what is in no template. A column ``telling`` of templates
    names words that a block must have. Returns row, label, containment.
    Exact: the filters drop no pair that meets the threshold. Null or empty word
    lists match nothing.
    """
    if "telling" not in templates.columns:
        templates = templates.withColumn("telling", F.array().cast("array<int>"))
    need = F.ceil(F.size("words") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    t = (templates.where(F.size("words") > 0).withColumn("need", need)
         .select("label", F.col("words").alias("t_words"), "telling", "need",
                 F.posexplode(F.expr("slice(words, 1, size(words) - need + 1)")).alias("t_at", "word")))
    least = t.agg(F.min("need")).first()[0]
    if least is None:
        return blocks.select("row", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    b = (blocks.where(F.size("words") >= least)
         .select("row", F.col("words").alias("b_words"),
                 F.posexplode(F.expr(f"slice(words, 1, size(words) - {least} + 1)")).alias("b_at", "word")))
    if t.count() <= MAX_BROADCAST_WORDS:  # else Spark shuffles, and splits the keys that are skewed
        t = F.broadcast(t)
    left = F.least(F.size("b_words") - F.col("b_at"), F.size("t_words") - F.col("t_at"))  # from the shared word on
    both = F.array_intersect("b_words", "t_words")
    return (b.join(t, "word").where((F.size("b_words") >= F.col("need")) & (left >= F.col("need")))
            .withColumn("both", both)
            # a pair is verified at the first word it shares only
            .where((F.size("both") >= F.col("need")) & (F.element_at("both", 1) == F.col("word")))
            .where(F.size(F.array_except("telling", "both")) == 0)
            .select("row", "label", (F.size("both") / F.size("t_words")).alias("containment")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  telling: dict[str, set[str]] = TELLING) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (highest containment of a template
    found, 0 if none).

    A null or empty text has no words, no places and empty labels; a null id
    stays null; repeated rows give repeated results; an empty table gives none.
    Other columns are not read. What the driver gets is a number for each word
    of the templates.
    """
    spark = docs.sparkSession
    sets = [(label, {w.decode() for w in words(text.encode())}) for label, text in templates]
    vocabulary = sorted(set().union(*(s for _, s in sets)))
    least = min((math.ceil(len(s) * threshold - 1e-9) for _, s in sets), default=1)
    made = cut(scan(docs, vocabulary, least, step_for(templates)), "licenses")
    blocks = made.select("row", F.explode("blocks").alias("words"))
    counts = dict(blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect())
    rarest = sorted(range(len(vocabulary)), key=lambda i: (counts.get(i, 0), i))
    order = [0] * len(vocabulary)
    for place, i in enumerate(rarest):
        order[i] = place
    number = {w: order[i] for i, w in enumerate(vocabulary)}
    known = spark.createDataFrame([(label, sorted(number[w] for w in s), [number[w] for w in s & telling.get(label, set())])
                                   for label, s in sets], "label string, words array<int>, telling array<int>")
    places = F.array(*map(F.lit, order))
    ordered = blocks.withColumn("words", F.array_sort(F.transform("words", lambda i: F.element_at(places, i + 1))))
    found = (containment_join(ordered, known, threshold).groupBy("row")
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("score")))  # labels of the templates
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return made.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
