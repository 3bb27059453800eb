"""The pipeline, stage by stage, against plain versions, and the registration."""

from collections import Counter

import numpy as np
import public_tokenizers
from llm_helpers import rows_of
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, texts = [docs], []
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF))
    for f in frames[1:-1]:
        assert f.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:-1]]
    # language: texts with letters stay (none of these is in a strange language)
    assert texts[1] == {i: t for i, t in texts[0].items() if any(c.isalpha() for c in t)}
    # quality: what the base rules keep and the divergence does not reject
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(frames[1], quality.references(frames[1])).collect()}
    assert texts[2] == {i: t for i, t in texts[1].items() if verdict[i]}
    assert all(len(t.split()) >= 50 for t in texts[2].values())
    # near duplicates: no two left are alike, and each that went is alike to a chain that ends at one that stays
    sets = {i: {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts[2].items()
            for w in [t.encode().lower().split()]}
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and group[i] != group[j] and like(i, j):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert texts[3] == {i: t for i, t in texts[2].items() if group[i] == i}
    # repeated bytes: whole characters that earlier texts cover are gone
    seen, want = set(), {}
    for i in sorted(texts[3]):
        b = texts[3][i].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s: s + 100] in seen:
                gone[s: s + 100] = True
            seen.add(b[s: s + 100])
        at, kept = 0, []
        for c in texts[3][i]:
            n = len(c.encode())
            kept += [] if gone[at: at + n].all() else [c]
            at += n
        want[i] = "".join(kept)
    assert texts[4] == want
    # packing: the tokens of all that is left
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = Counter()
    for r in frames[-1].collect():
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts[4].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == rows_of(
        frames[-1], "doc_id", "piece", "length", "ids_crc32")


def test_stages_of_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() <= max(n, 1) * 100
            assert n or not docs.count()


def test_registered_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
