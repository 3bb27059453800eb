"""N-gram Jaccard join (operator 8) by MinHash banding.

Texts are sets of five-word shingles. Band and row counts are chosen for a
target recall at the threshold; texts that agree in a band share a bucket, and
candidates are verified on their full shingle sets.

* Texts with one shingle set are one node, so copies meet as numbers only.
* The least node of a bucket leads it. All buckets with one leader make one
  group, in which each text comes once, whatever the number of bands it agrees
  in; a pair of texts in a bucket is in the group of the bucket's leader.
* A group is dealt into blocks of bounded size in texts and shingles, and a task
  verifies the pairs of two blocks. What it returns is linear in the block: for each text its
  number of links and the least text it is connected with there.
* Classes are the connected components of the verified links, found by rounds
  of large-star and small-star steps over narrow edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, documents, mix, shingles, table, text_slices, utf8, word_hashes

#: Words of a shingle and the least similarity of a link.
NGRAM, THRESHOLD = 5, 0.8
#: Recall of the bands at the threshold, and most hash functions.
RECALL, MAX_HASHES = 0.999, 192
#: Texts of a group, and their shingles, that one side of a verification holds (one longer text comes alone).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Places of shingles that are looked up at once.
LOOKUP = 1 << 22


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows of a band): the most rows, so the fewest chance candidates,
    for which bands within ``most`` hash functions find a pair at the threshold
    with the wanted probability; of those, the fewest bands."""
    for rows in range(most, 0, -1):
        p = threshold ** rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-p)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no bands within {most} hash functions reach recall {recall}")


def row_key() -> list[Column]:
    """What tells rows apart: the id (null as the least number) and a hash of the
    text. Rows alike in both are repeated rows."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"),
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")]


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Texts x bands: a hash of the minima of the band's functions, for non-empty sets."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, scratch = np.empty((len(sets), bands), np.uint64), np.empty_like(x)
    for band in range(bands):
        h = np.full(len(sets), band + 1, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            np.multiply(x, a[j], out=scratch)
            np.add(scratch, b[j], out=scratch)
            h = mix(h ^ np.minimum.reduceat(scratch, starts).astype(np.uint64))
        out[:, band] = h
    return out


def node_of(shingle_set: np.ndarray) -> int:
    """A 64-bit id of a shingle set (signed, as Spark has it)."""
    folded = mix(np.bitwise_xor.reduce(mix(shingle_set), keepdims=True) + np.add.reduce(shingle_set, keepdims=True))
    return int(folded.view(np.int64)[0])


def features(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, th, doc_id, node (null without words), number of shingles and band hashes of each row."""
    names = [("doc_id", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int32()),
             ("bands", pa.list_(pa.int64()))]

    def run(batches):
        hashes = word_hashes()
        for part in text_slices(batches):
            sets = [shingles(hashes.of(x.lower().split()), NGRAM) for x in utf8(part)]
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes, found = [None] * len(sets), [[]] * len(sets)
            if full:
                for i, h in zip(full, band_hashes([sets[i] for i in full], bands, rows).view(np.int64).tolist()):
                    nodes[i], found[i] = node_of(sets[i]), h
            yield table(names, [part.column("doc_id"), part.column("id"), part.column("th"), nodes, list(map(len, sets)), found])

    return docs.select("doc_id", *row_key(), "text").mapInArrow(
        run, "doc_id long, id long, th long, node long, n int, bands array<long>")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, n, leader) of all buckets with two nodes or more; the leader is a
    member of its own group. ``nodes``: node, n, bands."""
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    leads = (member.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
             .where("leader < last").select("bucket", "leader"))
    return member.join(leads, "bucket").select("node", "n", "leader").distinct()


def _links(sets: list[np.ndarray], threshold: float, cross: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets alike to the threshold; if ``cross``, only
    those of one of the first ``cross`` sets with one of the others."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    by_token, ends = owner[order], np.cumsum(np.bincount(token))
    begins = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(size)])
    left, right = [], []
    for i in range(cross or len(sets) - 1):
        own = token[at[i]: at[i + 1]]
        first, n = begins[own], ends[own] - begins[own]
        upto, both, a = np.cumsum(n), np.zeros(len(sets), np.int64), 0
        while a < len(own):  # the sets that have each shingle, a bounded number of places at once
            before = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + LOOKUP, "right")))
            spots = np.repeat(first[a:b] - (upto[a:b] - n[a:b] - before), n[a:b]) + np.arange(int(upto[b - 1]) - before)
            both += np.bincount(by_token[spots], minlength=len(sets))
            a = b
        # the least number of common shingles, in whole numbers of a millionth
        like = both * 1_000_000 >= round(threshold * 1_000_000) * (size[i] + size - both)
        like[: max(i + 1, cross)] = False
        js = np.flatnonzero(like)
        left.append(np.full(len(js), i))
        right.append(js)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int),) * 2


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index connected with each of ``n`` places."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(key: tuple, rows: list[tuple], hashes: WordHashes, threshold: float) -> Iterator[tuple]:
    """(node, links, least connected node) of the texts of one or two blocks."""
    leader, low, high = key
    rows.sort()  # by block, then node
    first = sum(r[0] == low for r in rows) if low != high else 0
    sets = [shingles(hashes.of(r[3].lower().split()), NGRAM) for r in rows]
    left, right = _links(sets, threshold, first) if low == high or 0 < first < len(rows) else ((), ())
    if not len(left):
        return
    node = np.array([r[1] for r in rows])
    # a pair that shares several leaders counts in the group of the least one
    least = np.array([r[2][0] for r in rows])
    counts = (least[left] == leader) & (least[right] == leader)
    for k in np.flatnonzero(~counts & (least[left] != least[right])):
        counts[k] = min(set(rows[left[k]][2]) & set(rows[right[k]][2])) == leader
    n = np.bincount(left[counts], minlength=len(rows)) + np.bincount(right[counts], minlength=len(rows))
    by_node = np.argsort(node)
    place = np.empty_like(by_node)
    place[by_node] = np.arange(len(node))
    root = node[by_node][_roots(len(rows), place[left], place[right])][place]
    for i in np.unique(np.concatenate([left, right])):
        yield int(node[i]), int(n[i]), int(root[i])


def verified_links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK,
                   block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, n_links, root) rows from the verification of all candidates; the
    links of a node are the sum over its rows. ``nodes``: node, n, id, th, bands."""
    spark = docs.sparkSession
    member = cut(candidate_groups(nodes), "members")
    blocks = member.groupBy("leader").agg(F.greatest(
        F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    shipped = (member.join(blocks, "leader").groupBy("node")
               .agg(F.sort_array(F.collect_list(F.struct("leader", "blocks"))).alias("groups"))  # one of each band at most
               .join(nodes.select("node", "id", "th"), "node"))
    texts = docs.select(*row_key(), "text").join(shipped, ["id", "th"]).dropDuplicates(["id", "th"])
    g = F.col("group")
    own = F.pmod(F.xxhash64("node", "group.leader"), "group.blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), g["blocks"] - 1))
    dealt = (texts.withColumn("leaders", F.col("groups.leader")).withColumn("group", F.explode("groups"))
             .select("node", "leaders", "text", g["leader"].alias("leader"), own.alias("own"), other.alias("other"))
             .select("node", "leaders", "text", "leader", "own", F.least("own", "other").alias("low"),
                     F.greatest("own", "other").alias("high")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    names = [("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())]

    def run(batches):
        hashes, key, rows = word_hashes(), None, []
        for part in text_slices(batches):
            found = []
            columns = [part.column(c).to_pylist() for c in ("leader", "low", "high", "own", "node", "leaders")]
            for leader, low, high, own, node, leaders, text in zip(*columns, utf8(part)):
                if (leader, low, high) != key:
                    found.extend(_verified(key, rows, hashes, threshold) if len(rows) > 1 else ())
                    key, rows = (leader, low, high), []
                rows.append((own, node, leaders, text))
            yield table(names, list(zip(*found)) if found else [[], [], []])
        found = list(_verified(key, rows, hashes, threshold)) if len(rows) > 1 else []
        yield table(names, list(zip(*found)) if found else [[], [], []])

    return dealt.mapInArrow(run, "node long, n_links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of ``edges`` (a, b): each node that
    is not the least of its component, and the least. Large-star and small-star
    rounds; each ends with a written table, and their number grows with the
    logarithm of the longest path."""
    stars, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                        "edges"), None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the least neighbour of a node that has none greater still points at it
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = (large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .unionByName(small.select("a", F.col("m").alias("b"))))
        stars = cut(linked.distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
            block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The class of each row of ``docs`` (doc_id, text): id, th, doc_id, class_id,
    copy_id, n_links, and the key (class_row_id, class_row_th) of the class's first row.

    A class is a connected component of links, a link two texts whose shingle
    sets have Jaccard similarity ``threshold`` or more. class_id and copy_id are
    the smallest doc_id of the class and of the rows with the same shingles;
    n_links counts the different shingle sets a text is linked with. Texts
    without words (null, empty) are in a class of their own, without links. Null
    ids come after all others; repeated rows are copies of each other; an empty
    table gives none; other columns are not read.
    """
    made = cut(features(docs, *choose_bands(threshold, recall)), "features")
    last = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    nodes = made.where("node is not null").groupBy("node").agg(
        F.min(F.struct(last.alias("last"), "id", "th")).alias("k"), F.min("doc_id").alias("copy_id"),
        F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select("node", "k.last", "k.id", "k.th", "copy_id", "n", "bands"), "nodes")
    links = cut(verified_links(docs, nodes, threshold, block, block_shingles), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    rooted = nodes.drop("n", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_class = rooted.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min(F.struct("last", "id", "th")).alias("k"))
    of_node = (rooted.join(of_class, "root").join(counts, "node", "left")
               .select("node", "class_id", "copy_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       F.col("k.id").alias("class_row_id"), F.col("k.th").alias("class_row_th")))
    alone = F.col("node").isNull()
    return made.select("doc_id", "id", "th", "node").join(of_node, "node", "left").select(
        "doc_id", "id", "th",
        *(F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "copy_id")),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("class_row_id")).alias("class_row_id"),
        F.when(alone, F.col("th")).otherwise(F.col("class_row_th")).alias("class_row_th"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class, all columns as they are."""
    kept = classes(docs, threshold).where("id = class_row_id and th = class_row_th").select("id", "th").distinct()
    id_, th = row_key()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_, th)
    return keyed.join(kept, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "class_id", "copy_id", "n_links")
