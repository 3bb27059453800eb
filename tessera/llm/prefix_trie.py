"""Operator 13: the prefix trie of conversations, by adaptive radix trees.

A turn is known by a fixed-width id, the 16 bytes of the MD5 of its role and
text, and a conversation by its turns' ids one after another, read as one
big-endian key. Conversations are dealt into ranges of (key, conv_id), so equal
keys may go over several ranges and no first turn is too common. Each range
builds one adaptive radix tree: nodes hold 4, 16, 48 or 256 children and grow
from one layout to the next, and bytes that all keys below a node share are one
compressed path. A tree node is emitted for each multiple of 16 bytes that its
path reaches; all other depths are within a turn.

Members of a node are neighbours in key order, so only nodes on the path that
two neighbouring ranges share have members in both. Their counts are sums over
ranges, made so that nothing is counted twice: a node belongs to the range where
it comes first, a childless one to the range where it comes last. All other
nodes are whole within their range.

Texts are not shuffled; a turn moves as its id and its number of words.

Null role or text reads as empty; rows without conv_id are no conversation; null
turns come first, and equal turns of a conversation are ordered by role, then by
id. An empty table has no nodes. Repeated rows are repeated turns. The key of a
conversation is one value: 16 bytes a turn. Digests tell up to some 10^18 turns
apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from .common import cut

#: Bytes of a turn id, turns a range holds at most (about), and turns that are worth a task of their own.
WIDTH, RANGE_TURNS, TASK_TURNS = 16, 200_000, 5_000
#: Nodes that several ranges share up to which they are broadcast; more are joined.
MOST_BROADCAST = 500_000
#: A conversation of every so many lends its first turns to the others; at most three.
BASE_OF, MOST_LENT = 20, 3

WORD = r"[^\x20\x09-\x0D]+"


class Small:
    """Up to 16 children: their bytes one after another, found by scanning (layouts
    4 and 16 of the tree)."""

    def __init__(self, room: int):
        self.room, self.labels, self.below = room, bytearray(), []

    def get(self, byte: int):
        k = self.labels.find(byte)
        return self.below[k] if k >= 0 else None

    def put(self, byte: int, node: Node):
        k = self.labels.find(byte)
        if k >= 0:
            self.below[k] = node
            return self
        if len(self.below) == self.room:
            grown = Small(16) if self.room == 4 else Indexed()
            for label, child in zip(self.labels, self.below, strict=True):
                grown = grown.put(label, child)
            return grown.put(byte, node)
        self.labels.append(byte)
        self.below.append(node)
        return self

    def all(self) -> list[Node]:
        return self.below


class Indexed:
    """Up to 48 children behind an index of 256 places."""

    def __init__(self):
        self.index, self.below = bytearray(256), []

    def get(self, byte: int):
        k = self.index[byte]
        return self.below[k - 1] if k else None

    def put(self, byte: int, node: Node):
        if k := self.index[byte]:
            self.below[k - 1] = node
            return self
        if len(self.below) == 48:
            grown = Full()
            for label, k in enumerate(self.index):
                if k:
                    grown.put(label, self.below[k - 1])
            return grown.put(byte, node)
        self.below.append(node)
        self.index[byte] = len(self.below)
        return self

    def all(self) -> list[Node]:
        return self.below


class Full:
    """A place for each of 256 children."""

    def __init__(self):
        self.below = [None] * 256

    def get(self, byte: int):
        return self.below[byte]

    def put(self, byte: int, node: Node):
        self.below[byte] = node
        return self

    def all(self) -> list[Node]:
        return [x for x in self.below if x is not None]


class Node:
    """Keys that share their first ``end`` bytes, the last of them in ``path``;
    ``ends`` are the members that end here and ``sample`` is any member."""

    __slots__ = ("path", "end", "ends", "sample", "children")

    def __init__(self, path: bytes, end: int, sample: int):
        self.path, self.end, self.sample = path, end, sample
        self.ends: list[int] = []
        self.children = Small(4)


class RadixTree:
    def __init__(self):
        self.root = Node(b"", 0, 0)

    def insert(self, key: bytes, member: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            if not key.startswith(node.path, at):
                node = self._split(node, above, key, at)
            at += len(node.path)
            if at == len(key):
                node.ends.append(member)
                return
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at + 1:], len(key), member)
                child.ends.append(member)
                node.children = node.children.put(key[at], child)
                return
            node, above, at = child, node, at + 1

    @staticmethod
    def _split(node: Node, above: Node, key: bytes, at: int) -> Node:
        """A new node over ``node`` for the bytes that its path shares with the key."""
        same = 0
        for x, y in zip(node.path, memoryview(key)[at:]):
            if x != y:
                break
            same += 1
        upper = Node(node.path[:same], node.end - len(node.path) + same, node.sample)
        upper.children = upper.children.put(node.path[same], node)
        above.children = above.children.put(key[at - 1], upper)
        node.path = node.path[same + 1:]
        return upper


class _Below:
    """What the part of a tree below a node adds up to."""

    __slots__ = ("count", "least", "tops", "leaves", "saved")

    def __init__(self, count: int, least: int | None):
        self.count, self.least = count, least
        self.tops = self.leaves = self.saved = 0

    def add(self, other: _Below) -> None:
        self.count += other.count
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.tops += other.tops
        self.leaves += other.leaves
        self.saved += other.saved


def range_nodes(keys: list[bytes], convs: list[int], words: list[list[int]], shared_before: int,
                shared_after: int) -> Iterator[tuple]:
    """The trie nodes of one range, whose rows are in order of (key, conv_id).

    ``shared_before`` and ``shared_after`` are the turns that its first key shares
    with the key before it and its last key with the key after it (-1: there is
    none). Yields (node, parent, conv_id, depth, parent's conv_id, n_convs,
    n_children, n_leaves, saved_tokens, conv_ids of the members that end here);
    node is a digest for nodes that other ranges have too, else null, parent is
    set where the parent is such a node.
    """
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    first, last = keys[0], keys[-1]
    # nodes before their children, with the number of bytes above each
    order, todo = [], [(tree.root, -1)]
    while todo:
        node, begin = todo.pop()
        order.append((node, begin))
        todo += [(child, node.end) for child in node.children.all()]

    def place(node: Node, depth: int) -> tuple[bool, bool, bool]:
        """Whether the node at this depth is also in an earlier range, in a later one,
        and whether it is the whole last key."""
        key = keys[node.sample]
        size = depth * WIDTH
        before = depth <= shared_before and first[:size] == key[:size]
        after = depth <= shared_after and last[:size] == key[:size]
        return before, after, after and len(last) == size

    below: dict[int, _Below] = {}
    rows = []  # one for each node, children first: what it is, and its place for the parent's conv_id
    for node, begin in reversed(order):
        own = _Below(len(node.ends), min((convs[k] for k in node.ends), default=None))
        children = node.children.all()
        for child in children:
            own.add(below.pop(id(child)))
        deepest, highest = node.end // WIDTH, begin // WIDTH + 1
        for depth in range(deepest, highest - 1, -1):
            ends = node.ends if depth == deepest and depth * WIDTH == node.end else []
            before, after, whole = place(node, depth)
            n_children = own.tops
            if depth == deepest and not children and not whole:
                own.leaves = 1
            w = words[node.sample][depth - 1] if depth else 0
            own.saved += own.count * w - (0 if before else w)
            rows.append((node, depth, before or after, own.least, own.count, n_children, own.leaves, own.saved, ends))
            own.tops = 0 if before else 1
        below[id(node)] = own

    # parents come after their children in rows: hand down conv_id and digest from the end
    least_at: dict[tuple[int, int], tuple[int, bytes | None]] = {}
    holder = {}  # the tree node that emits the next depth above a tree node
    for node, begin in order:
        emits = node.end // WIDTH >= begin // WIDTH + 1
        for child in node.children.all():
            holder[id(child)] = node if emits else holder.get(id(node), node)
    for node, depth, shared, least, count, n_children, leaves, saved, ends in reversed(rows):
        digest = hashlib.md5(keys[node.sample][: depth * WIDTH]).digest() if shared else None
        least_at[id(node), depth] = (least, digest)
        up = least_at.get((id(node), depth - 1)) or least_at.get((id(holder.get(id(node))), depth - 1), (None, None))
        yield (digest, up[1], least, depth, None if up[1] else up[0], count, n_children, leaves, saved,
               sorted(convs[k] for k in ends))


NODES = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), *(
    T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    T.StructField("ends_sha256", T.StringType()), T.StructField("ends", T.StringType()), T.StructField("range", T.IntegerType())])
_ARROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *(
    (c, pa.int64()) for c in NODES.names[2:9]), ("ends_sha256", pa.string()), ("ends", pa.string()), ("range", pa.int32())])


def _nodes_of_range(rows: pa.Table, edge: pa.Table) -> pa.Table:
    rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")])
    number = edge.column("range")[0].as_py()
    out = []
    for *row, ends in range_nodes(rows.column("key").to_pylist(), rows.column("conv_id").to_pylist(),
                                  rows.column("words").to_pylist(), edge.column("shared_before")[0].as_py(),
                                  edge.column("shared_after")[0].as_py()):
        text = ",".join(map(str, ends))
        own = row[0] is None
        out.append((*row, hashlib.sha256(text.encode()).hexdigest() if own else None, None if own or not ends else text, number))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _joined_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, comma-joined; rows in order of node and range."""
    node, sha, done = None, None, []
    for batch in batches:
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key == node:
                sha.update(b"," + piece.encode())
            else:
                if sha:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(piece.encode())
        yield from _digests(done)
        done = []
    if sha:
        yield from _digests([(node, sha.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
    if rows:
        nodes, shas = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], names=["shared", "sha"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations as (conv_id, key, words): the first h turns of conversation
    c - c % 20, then the own turns after the first h; h = crc32(c) % 4."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(
        "turn", role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = cut(own.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("t")), "turns")
    lent = own.where(F.col("conv_id") % BASE_OF == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, MOST_LENT).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_LENT + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % BASE_OF
    all_turns = F.concat(F.coalesce(F.slice("first", F.lit(1), h), F.array().cast(own.schema["t"].dataType)),
                         F.slice("t", h + 1, F.greatest(F.size("t"), F.lit(1))))
    return own.withColumn("base", base).join(lent, "base", "left").select("conv_id", all_turns.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.col("t.id"), "")).alias("key"), F.col("t.words").alias("words"))


def _turn_ids(key) -> F.Column:
    at = F.sequence(F.lit(0), (F.length(key) / WIDTH).cast("int") - 1)
    ids = F.transform(at, lambda k: F.substring(key, k * WIDTH + 1, F.lit(WIDTH)))
    return F.when(F.length(key) == 0, F.array().cast("array<binary>")).otherwise(ids)


def _shared_turns(x, y) -> F.Column:
    """Leading turns that two keys share; -1 if one is missing."""
    same = F.zip_with(_turn_ids(x), _turn_ids(y), lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)
    shared = F.when(differs > 0, differs - 1).otherwise(F.size(same))
    return F.when(x.isNull() | y.isNull(), -1).otherwise(shared).cast("int")


def trie(keyed: DataFrame, range_turns: int = RANGE_TURNS, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of the trie over (conv_id, key, words): conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256."""
    spark = keyed.sparkSession
    turns = keyed.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, math.ceil(turns / range_turns), min(tasks, math.ceil(turns / task_turns)))
    dealt = cut(keyed.repartitionByRange(ranges, "key", "conv_id").withColumn("range", F.spark_partition_id()), "keys")
    in_order = Window.orderBy("range")  # a row for each range
    ends = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(in_order)).withColumn("after", F.lead("first").over(in_order))
    edges = ends.select("range", _shared_turns(F.col("before"), F.col("first")).alias("shared_before"),
                        _shared_turns(F.col("last"), F.col("after")).alias("shared_after"))
    nodes = cut(dealt.groupBy("range").cogroup(edges.groupBy("range")).applyInArrow(_nodes_of_range, NODES), "nodes")

    shared = nodes.where("node IS NOT NULL")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = shared.groupBy(F.col("node").alias("shared")).agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in sums))
    digests = shared.where("ends IS NOT NULL").select("node", "range", "ends").repartition("node").sortWithinPartitions(
        "node", "range").mapInArrow(_joined_digests, "shared binary, sha string")
    parents = merged.select(F.col("shared").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    if shared.count() <= MOST_BROADCAST:  # few nodes have many children, the root most of all
        parents = F.broadcast(parents)
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    across = merged.join(digests, "shared", "left").join(parents, "parent", "left").withColumn(
        "ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    own = nodes.where("node IS NULL")
    under = own.where("parent IS NOT NULL").drop("parent_conv_id").join(parents, "parent")
    return own.where("parent IS NULL").select(columns).union(under.select(columns)).union(across.select(columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    ensure_checkpoint_dir(spark)
    return trie(rebuilt(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])))
