"""Operator 11: the cheapest repair of damaged conversations, by bidirectional
Dijkstra over the edit lattice.

A lattice node is (rows done, state), the state what the repaired roles so far
may be followed by. Edges: Keep 0, Rerole 1, Delete 2, Insert 5; a truncated row
that is not deleted adds 5; blank and repeated rows are deleted. Two heaps, one
from each end, are emptied until no unsettled pair can be as cheap as the best
meeting; then every node of every cheapest path is settled from one side at
least, and the ASCII-least audit is read off by always taking the least edit that
stays on a cheapest path.

Rows are dealt into ranges of (conv_id, turn), so that a conversation of any
length is spread over several. Nearly all conversations lie within one range and
are searched there. A longer one is searched piece by piece, from each state to
each, and its pieces are put together by their costs alone: equally cheap ways
through a piece are told apart by the order of their audits, and no audit of a
piece begins another, since all end with the edit of the piece's last row.
Searches see turn, role initial and faults only; texts pass by once more, in
order, for the digest, and no conversation's text is held.

Null conv_id is a conversation of its own; null turn, role and text read as one
space (turns of null come first). Equal turns are ordered by a digest of role and
text; repeated rows stand side by side and all but the first are duplicates. An
empty table has no rows. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from .common import cut

#: Rows a range holds at most (about), and rows that are worth a task of their own.
RANGE_ROWS, TASK_ROWS = 20_000, 4_000

SPACE = r"\x20\x09-\x0D"

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ACCEPTED = (START, ASSISTANT)
#: The state after an edit that chooses the role itself, and the states before it.
CHOSEN = (USER, USER, ASSISTANT, USER)
BEFORE_CHOSEN = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state, role initial) to the state after the row is kept.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BEFORE_KEPT = {("s", SYSTEM): (START,), ("u", USER): (START, SYSTEM, ASSISTANT), ("a", ASSISTANT): (USER,)}
LEGAL = {"su", "ua", "au"}
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5

#: A row of the lattice: its role initial, whether it must go, what staying costs.
Row = tuple[str, bool, int]


class Lattice:
    """The edits of ``rows``; ``closing`` allows insertions after the last row."""

    def __init__(self, rows: list[Row], closing: bool = True):
        self.rows, self.last, self.closing = rows, len(rows), closing

    def ahead(self, node: int) -> Iterator[tuple[str, int, int]]:
        """Edit, its cost and the node it leads to; in ASCII order of the edits."""
        i, state = divmod(node, 4)
        if i < self.last:
            initial, must_go, extra = self.rows[i]
            yield "D", DELETE, node + 4
        if i < self.last or self.closing:
            yield "I", INSERT, 4 * i + CHOSEN[state]
        if i < self.last and not must_go:
            kept = KEPT.get((state, initial))
            if kept is not None:
                yield "K", extra, 4 * (i + 1) + kept
            yield "R", REROLE + extra, 4 * (i + 1) + CHOSEN[state]

    def back(self, node: int) -> Iterator[tuple[int, int]]:
        """Cost and the node before, for every edge that leads to ``node``."""
        i, state = divmod(node, 4)
        if i < self.last or self.closing:
            for before in BEFORE_CHOSEN[state]:
                yield INSERT, 4 * i + before
        if i:
            initial, must_go, extra = self.rows[i - 1]
            yield DELETE, node - 4
            if not must_go:
                for before in BEFORE_KEPT.get((initial, state), ()):
                    yield extra, 4 * (i - 1) + before
                for before in BEFORE_CHOSEN[state]:
                    yield REROLE + extra, 4 * (i - 1) + before

    def cheapest(self, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and ASCII-least audit of the cheapest ways from ``entry`` to one of
        ``exits``; None if there is no way."""
        goals = [4 * self.last + x for x in exits]
        there, back = {entry: 0}, dict.fromkeys(goals, 0)
        settled_there, settled_back = set(), set()
        heap_there, heap_back = [(0, entry)], [(0, g) for g in goals]
        best = 0 if entry in back else math.inf
        while heap_there and heap_back and heap_there[0][0] + heap_back[0][0] <= best:
            forward = heap_there[0][0] <= heap_back[0][0]
            cost, node = heapq.heappop(heap_there if forward else heap_back)
            mine, settled, heap, other = ((there, settled_there, heap_there, back) if forward
                                          else (back, settled_back, heap_back, there))
            if node in settled:
                continue
            settled.add(node)
            for step, to in ((w, v) for _, w, v in self.ahead(node)) if forward else self.back(node):
                if cost + step < mine.get(to, math.inf):
                    mine[to] = cost + step
                    heapq.heappush(heap, (cost + step, to))
                    if to in other:
                        best = min(best, cost + step + other[to])
        if best == math.inf:
            return None
        known = dict.fromkeys(goals, 0) | {v: back[v] for v in settled_back}
        rest = self._rest(best, there, settled_there, known)
        audit, node, left = [], entry, best
        while left or node not in goals:
            for edit, step, to in self.ahead(node):
                if rest.get(to, math.inf) + step == left:
                    audit.append(edit)
                    node, left = to, left - step
                    break
            else:
                raise AssertionError("no edit stays on a cheapest path")
        return best, "".join(audit)

    def _rest(self, best: int, there: dict[int, int], settled_there: set[int], rest: dict[int, int]) -> dict[int, int]:
        """What is left to pay at each node of a cheapest path: ``rest`` behind the
        crossings, from the reverse search, and what the forward one leaves before."""
        todo = [u for u in settled_there
                if any(there[u] + w + rest.get(v, math.inf) == best for _, w, v in self.ahead(u))]
        while todo:
            u = todo.pop()
            if rest.setdefault(u, best - there[u]) != best - there[u]:
                continue
            todo += [p for w, p in self.back(u) if p in settled_there and p not in rest and there[p] + w == there[u]]
        return rest


def damaged(conversations: DataFrame) -> DataFrame:
    """Every row after damage by crc32(conv_id:turn) % 20, as (conv_id, turn, role,
    text, copy, gone, initial, blank, truncated, words); dropped rows stay with
    ``gone`` set, so their conversation is known."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"),
                                as_text("text").alias("text"),
                                (F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn"))) % 20).alias("harm"))
    harm = F.col("harm")
    rows = rows.select(
        "conv_id", "turn", (harm == 0).alias("gone"), F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm <= 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    return rows.select(
        "*", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("words"))


ORDER = ("conv_id", "turn", "words", "copy")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PART = [("part", pa.int32()), ("conv_id", pa.int64()), ("crossing", pa.bool_()), ("first_turn", pa.int64()),
         ("last_turn", pa.int64()), ("n_turns", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("first", pa.string()),
         ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())),
         ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
_PART_SQL = ("part int, conv_id long, crossing boolean, first_turn long, last_turn long, n_turns long, blank long, "
             "duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, "
             "costs array<long>, ranks array<long>, audits array<string>")


def _ways(rows: list[Row], closing: bool) -> tuple[list, list, list]:
    """Costs, order of audits and audits from each state to each (to the end, in
    the place of the first, if ``closing``), four for each entry."""
    lattice, costs, ranks, audits = Lattice(rows, closing), [], [], []
    for entry in STATES:
        found = [lattice.cheapest(entry, ACCEPTED)] + [None] * 3 if closing else [lattice.cheapest(entry, (x,)) for x in STATES]
        order = sorted(x[1] for x in found if x)
        costs += [x and x[0] for x in found]
        audits += [x and x[1] for x in found]
        ranks += [x and order.index(x[1]) for x in found]
    return costs, ranks, audits


def _searched(rows: pa.Table) -> pa.Table:
    """The conversations of one range, or their pieces in it."""
    from pyarrow import compute as pc

    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ORDER], null_placement="at_start"))
    columns = [rows.column(c).to_pylist() for c in ("conv_id", "turn", "words", "gone", "initial", "blank", "truncated",
                                                    "seen", "crossing", "goes_on")]
    convs, part, out, at = columns[0], rows.column("part")[0].as_py(), [], 0
    while at < len(convs):
        end = at
        while end < len(convs) and convs[end] == convs[at]:
            end += 1
        crossing, goes_on = columns[8][at], columns[9][at]
        seen, turns, path, counts = set(), [], [], dict.fromkeys(COUNTS, 0)
        for _, turn, words, gone, initial, blank, truncated, before, *_ in zip(*(c[at:end] for c in columns), strict=True):
            if gone:
                continue
            duplicate = not blank and (before or words in seen)
            truncated = truncated and not duplicate
            seen.add(words)
            for fault, is_so in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
                counts[fault] += is_so
            if path:
                counts["illegal"] += path[-1][0] + initial not in LEGAL
            path.append((initial, blank or duplicate, TRUNCATED * truncated))
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
        whole = (None, None) if crossing else Lattice(path).cheapest(START, ACCEPTED)
        ways = _ways(path, not goes_on) if crossing else (None, None, None)
        out.append((part, convs[at], crossing, turns[0] if turns else None, turns[-1] if turns else None, len(turns),
                    *counts.values(), path[0][0] if path else None, path[-1][0] if path else None, *whole, *ways))
        at = end
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _PART, strict=True)],
                                names=[n for n, _ in _PART])


def _joined(pieces: pa.Table) -> pa.Table:
    """A crossing conversation: which way through each of its pieces, and its
    counts (on the row of the first piece)."""
    pieces = pieces.sort_by("part").to_pylist()
    least = [0]  # what is left to pay from each state before a piece; after the last piece there is one end
    behind = []
    for p in reversed(pieces):
        costs = [[p["costs"][4 * s + x] for x in range(4)] for s in STATES]
        behind.append(least)
        least = [min((c + l for c, l in zip(costs[s], least, strict=False) if c is not None and l is not None), default=None)
                 for s in STATES]
    total, state, ways = least[START], START, []
    for p, after in zip(pieces, reversed(behind), strict=True):
        options = [(p["costs"][4 * state + x] + l, p["ranks"][4 * state + x], x) for x, l in enumerate(after)
                   if l is not None and p["costs"][4 * state + x] is not None]
        _, _, x = min(options)
        ways.append(4 * state + x)
        state = x
    full = [p for p in pieces if p["first"] is not None]
    timed = [p for p in full if p["n_turns"]]
    sums = {c: sum(p[c] for p in pieces) for c in COUNTS}
    sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
    distinct = sum(p["n_turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
    rows = [(p["part"], p["conv_id"], way, *((gaps, *sums.values(), total) if k == 0 else [None] * 6))
            for k, (p, way) in enumerate(zip(pieces, ways, strict=True))]
    types = [pa.int32(), pa.int64(), pa.int32()] + [pa.int64()] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                names=["part", "conv_id", "way", "gaps", *COUNTS, "cost"])


class _Repair:
    """A conversation that is being written: its counts, its audit so far, and a
    running digest of its lines."""

    def __init__(self, head: tuple):
        self.head, self.sha, self.state, self.empty = head, hashlib.sha256(), START, True
        self.audit: list[str] = []
        self.edits: Iterator[str] = iter(())

    def piece(self, audit: str) -> None:
        self.audit.append(audit)
        self.edits = iter(audit)

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self) -> None:
        self.state = CHOSEN[self.state]
        self._line(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        while (edit := next(self.edits)) == "I":
            self._insert()
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self._line(role, text)
        elif edit == "R":
            self.state = CHOSEN[self.state]
            self._line(ROLE[self.state], text)

    def done(self) -> tuple:
        for _ in self.edits:
            self._insert()
        return *self.head, "".join(self.audit), self.sha.hexdigest()


RESULT = T.StructType([T.StructField(c, T.LongType()) for c in ("conv_id", "gaps", *COUNTS, "cost")] + [
    T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")])


def _written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final rows from audits followed by the rows they are about, in order."""
    now: _Repair | None = None
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)],
                                          names=RESULT.names)

    for batch in batches:
        done = []
        for conv, audit, head, role, text in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "audit", "head", "role", "text")), strict=True):
            if audit is None:
                now.row(role, text)
                continue
            if head is not None:
                if now:
                    done.append(now.done())
                now = _Repair((conv, *head.values()))
            now.piece(audit)
        if done:
            yield rows(done)
    if now:
        yield rows([now.done()])


def repair(rows: DataFrame, range_rows: int = RANGE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Counts, cost, audit and digest of the repaired lines of each conversation of
    ``rows`` (as ``damaged`` returns them)."""
    spark = rows.sparkSession
    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, math.ceil(n / range_rows), min(tasks, math.ceil(n / task_rows)))
    dealt = cut(rows.repartitionByRange(ranges, *ORDER).withColumn("part", F.spark_partition_id()), "rows")

    # a range's first and last conversation may go on in its neighbours: a row for each range
    ends = dealt.select("part", F.struct("conv_id").alias("c")).groupBy("part").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    in_order = Window.orderBy("part")
    ends = ends.select("part", "low", "high", (F.lag("high").over(in_order) == F.col("low")).alias("from_before"),
                       (F.lead("low").over(in_order) == F.col("high")).alias("to_after"))
    conv = F.struct("conv_id")
    dealt = dealt.join(ends, "part").withColumn(
        "goes_on", F.coalesce(F.col("to_after") & (conv == F.col("high")), F.lit(False))).withColumn(
        "crossing", F.col("goes_on") | F.coalesce(F.col("from_before") & (conv == F.col("low")), F.lit(False)))
    dealt = dealt.drop("low", "high", "from_before", "to_after")

    narrow = dealt.drop("role", "text")
    place = F.struct("turn", "copy")
    firsts = narrow.where("crossing AND NOT gone").groupBy(F.col("conv_id").alias("c"), F.col("words").alias("w")).agg(F.min(place).alias("met"))
    apart = narrow.where("crossing").join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("words") == F.col("w")), "left")
    marked = narrow.where("NOT crossing").withColumn("seen", F.lit(False)).unionByName(
        apart.withColumn("seen", F.coalesce(F.col("met") < place, F.lit(False))).drop("c", "w", "met"))
    parts = cut(marked.groupBy("part").applyInArrow(_searched, _PART_SQL), "parts")

    gaps = F.when(F.col("n_turns") == 0, 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"))
    head = F.struct("gaps", *COUNTS, "cost")
    whole = parts.where("NOT crossing").withColumn("gaps", gaps).select("part", "conv_id", "crossing", "audit", head.alias("head"))
    crossing = parts.where("crossing")
    ways = crossing.drop("audit", "audits").groupBy("conv_id").applyInArrow(_joined, ", ".join(
        ["part int", "conv_id long", "way int", *(f"{c} long" for c in ("gaps", *COUNTS, "cost"))]))
    ways = ways.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "way",
                       F.when(F.col("cost").isNotNull(), head).alias("head"))
    chosen = crossing.join(ways, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "part", "conv_id", "crossing", F.col("audits")[F.col("way")].alias("audit"), "head")
    audits = whole.unionByName(chosen)

    texts = dealt.where("NOT gone").select(
        "part", "conv_id", "crossing", F.lit(None).cast("string").alias("audit"), F.lit(None).cast(audits.schema["head"].dataType).alias("head"),
        "turn", "words", "copy", "role", "text")
    stream = texts.unionByName(audits, allowMissingColumns=True).withColumn(
        "together", F.when(F.col("crossing"), F.xxhash64("conv_id")).otherwise(F.col("part").cast("long")))
    stream = stream.repartition("together").sortWithinPartitions(
        "together", "conv_id", "part", F.col("audit").isNull(), "turn", "words", "copy")
    return stream.select("conv_id", "audit", "head", "role", "text").mapInArrow(_written, RESULT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    ensure_checkpoint_dir(spark)
    return repair(damaged(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])))
