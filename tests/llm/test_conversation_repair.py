"""Repaired conversations against a plain search over whole audits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from llm_helpers import rows_of
from pyspark.sql import types as T

from tessera.llm import conversation_repair as cr
from tessera.llm.conversation_repair import Lattice, damaged, op11_conversation_repair, repair

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *(
    T.StructField(c, T.StringType()) for c in ("role", "text", "part", "words", "audit", "c"))])
INK = r"[^\x20\x09-\x0D]"


def harmed(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, t)).encode()) % 20
        convs[c]  # every original id
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for c, rs in convs.items()}


def plain_repair(rows, must_go, extra):
    """Least (cost, audit) by trying every edit, from the back; two insertions in a
    row are enough, since more only lengthen a dialogue."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        for role in ("user", "assistant"):
            to = step.get((state, role[0]))
            if to and inserted < 2 and (w := best(i, to, inserted + 1)):
                ways.append((w[0] + 5, "I" + w[1], ((role, ""),) + w[2]))
        if i < len(rows):
            _, role, text = rows[i]
            if w := best(i + 1, state, 0):
                ways.append((w[0] + 2, "D" + w[1], w[2]))
            if not must_go[i]:
                to = step.get((state, role[:1]))
                if to and (w := best(i + 1, to, 0)):
                    ways.append((w[0] + extra[i], "K" + w[1], ((role, text),) + w[2]))
                for new in ("user", "assistant"):
                    to = step.get((state, new[0]))
                    if to and (w := best(i + 1, to, 0)):
                        ways.append((w[0] + 1 + extra[i], "R" + w[1], ((new, text),) + w[2]))
        return min(ways, default=None)

    return best(0, "", 0)


def plainly(rows):
    out = []
    for c, rs in harmed(rows).items():
        seen, must_go, extra, n = set(), [], [], [0, 0, 0]
        for _, role, text in rs:
            ink = re.findall(INK, text)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            must_go.append(fault in (0, 1))
            extra.append(5 * (fault == 2))
        turns = {t for t, _, _ in rs if t is not None}
        initials = [role[:1] for _, role, _ in rs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, kept = plain_repair(tuple(rs), must_go, extra)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def same(df, rows):
    assert sorted(rows_of(df, *cr.RESULT.names), key=lambda r: (r[0] is None, r[0] or 0)) == plainly(rows)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op11_conversation_repair(spark, SF), rows)


def odd_rows():
    rnd = random.Random(11)
    texts = ["Yes.", "No!", "what", " \t", "", None, "a.b ", "end? \n", "Yes.", "é"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "u", "super"]
    rows = [(c, None if rnd.random() < 0.1 else rnd.choice([t, t, t + 3]), rnd.choice(roles), rnd.choice(texts))
            for c in range(-3, 120) for t in range(rnd.randrange(1, 8))]
    rows += [(500, t // 2, "user" if t % 2 else "assistant", f"Line {t % 90}{rnd.choice(['.', '', '?'])}") for t in range(300)]
    rows += [(None, t, rnd.choice(roles), rnd.choice(texts)) for t in range(40)] + [(None, None, None, None)] * 3
    rows += [(501, 0, "user", "same.")] * 60 + [(502, None, "assistant", f"x{t}") for t in range(30)]
    return rows


@pytest.mark.parametrize(("range_rows", "task_rows"), [(7, 1), (25, 25), (100_000, 100_000)])
def test_odd_rows_in_one_piece_and_in_many(spark, range_rows, task_rows):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], SCHEMA).repartition(3)
    same(repair(damaged(df), range_rows, task_rows), rows)


def test_no_rows_and_rows_that_all_drop(spark):
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    dropped = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = rows_of(repair(damaged(spark.createDataFrame([(*r, "", "", "", "") for r in dropped], SCHEMA))), *cr.RESULT.names)
    assert [r[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * len(dropped)


@pytest.mark.parametrize("seed", range(6))
def test_search_from_any_state_to_any(seed):
    """Against all paths, found by relaxing whole audits until nothing changes."""
    rnd = random.Random(seed)
    for _ in range(60):
        rows = [(rnd.choice("suat "), rnd.random() < 0.2, rnd.choice([0, 5])) for _ in range(rnd.randrange(0, 5))]
        for closing in (True, False):
            lattice = Lattice(rows, closing)
            for exits in [(x,) for x in cr.STATES] + [cr.ACCEPTED]:
                best = {4 * len(rows) + x: (0, "") for x in exits}
                for _ in range(4 * len(rows) + 8):
                    for node in range(4 * len(rows) + 4):
                        for edit, w, to in lattice.ahead(node):
                            if to in best:
                                way = (best[to][0] + w, edit + best[to][1])
                                best[node] = min(best.get(node, way), way)
                for entry in cr.STATES:
                    assert lattice.cheapest(entry, exits) == best.get(entry)
                for node in range(4 * len(rows) + 4):
                    ahead = sorted((node, w, to) for _, w, to in lattice.ahead(node))
                    assert ahead == sorted((p, w, to) for to in range(4 * len(rows) + 4) for w, p in lattice.back(to) if p == node)


def test_long_conversation_is_searched_in_time():
    rows = [("ua"[k % 2], k % 11 == 0, 5 * (k % 5 == 0)) for k in range(20_000)]
    cost, audit = Lattice(rows).cheapest(cr.START, cr.ACCEPTED)
    assert sum(c != "I" for c in audit) == len(rows) and cost > 0
