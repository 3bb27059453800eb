"""The prefix trie against nodes found by comparing whole prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_helpers import rows_of
from pyspark.sql import types as T

from tessera.llm import prefix_trie
from tessera.llm.prefix_trie import RadixTree, op13_prefix_trie, rebuilt, trie

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *(
    T.StructField(c, T.StringType()) for c in ("role", "text", "id", "key", "words", "depth"))])


def plainly(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in convs.items()}
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(int(c / 20) * 20, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append((c, d == len(whole)))
            if d:
                kids[whole[: d - 1]].add(whole[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(nodes[p]) - 1) * w
        ends = ",".join(str(c) for c in sorted(c for c, end in nodes[p] if end))
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in nodes[p]), len(p), parent, len(nodes[p]), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r[:7]) + r[7:])


def same(df, rows):
    assert sorted(rows_of(df, *COLUMNS), key=lambda r: tuple((x is None, x or 0) for x in r[:7]) + r[7:]) == plainly(rows)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op13_prefix_trie(spark, SF), rows)


def odd_rows(seed=3, convs=400):
    """Copies of whole conversations, one first turn for most, nulls everywhere, a long one."""
    rnd = random.Random(seed)
    rows = []
    for c in range(-20, convs):
        if c % 7 == 0:
            rows += [(c, t, "user", "the same  hot one") for t in range(3)]
            continue
        n = rnd.randrange(1, 6)
        for t in range(n):
            text = "hello all" if t == 0 and rnd.random() < 0.7 else rnd.choice(["a", "b c", "", None, "d\te\n f", "é\x00z"])
            rows.append((c, None if rnd.random() < 0.05 else t, rnd.choice(["user", "assistant", None, ""]), text))
    rows += [(7_000, t, "user", f"turn {t}") for t in range(700)] + [(7_001, t, "user", f"turn {t}") for t in range(600)]
    rows += [(9_000, 0, "user", "x")] * 2 + [(None, 1, "user", "x"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize(("range_turns", "task_turns"), [(10, 1), (60, 60), (100_000, 100_000)])
def test_odd_rows_in_few_and_many_ranges(spark, range_turns, task_turns):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], SCHEMA).repartition(3)
    same(trie(rebuilt(df), range_turns, task_turns), rows)


def test_no_rows(spark):
    assert trie(rebuilt(spark.createDataFrame([], SCHEMA))).collect() == []


def test_layouts_grow_and_paths_split():
    rnd = random.Random(1)
    keys = [bytes(rnd.choices(range(k), k=2)) + bytes(14) for k in (3, 12, 40, 256) for _ in range(400)]
    keys += [b"", bytes(16), bytes(32), bytes(31) + b"\1"]
    tree = RadixTree()
    for n, key in enumerate(keys):
        tree.insert(key, n)
    kinds, found, todo = set(), defaultdict(list), [(tree.root, b"")]
    while todo:
        node, prefix = todo.pop()
        kinds.add((type(node.children).__name__, getattr(node.children, "room", 0)))
        prefix += node.path
        assert node.end == len(prefix)
        found[prefix] += node.ends
        for byte in range(256):
            if (child := node.children.get(byte)) is not None:
                todo.append((child, prefix + bytes([byte])))
        assert len(node.children.all()) == sum(node.children.get(b) is not None for b in range(256))
    want = defaultdict(list)
    for n, key in enumerate(keys):
        want[key].append(n)
    assert {k: v for k, v in found.items() if v} == want
    assert kinds == {("Small", 4), ("Small", 16), ("Indexed", 0), ("Full", 0)}


def test_production_sizes_are_whole_numbers_of_turns():
    assert prefix_trie.WIDTH == 16 and prefix_trie.TASK_TURNS < prefix_trie.RANGE_TURNS
