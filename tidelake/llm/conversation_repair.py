"""Repair of damaged conversations: the lightest derivation of a legal one, after Knuth.

An item (i, state) says that the first i rows have been edited into the beginning of a
legal conversation.  A deduction takes an item and an edit of the next row (keep, rerole,
delete), or an insertion, and gives an item; its value is (cost, audit), the sum of the
costs and the edits' initials one after another.  That function is superior: a value is
never below those it is made of, and better parts never give a worse whole.  So items are
popped from an agenda in the order of their values, each final when it is popped, until
the goal, a legal end after the last row, is.  Among the cheapest edits that is the one
whose audit is least in ASCII.

A conversation is read as a stream of its rows, in order (Spark deals conversations out
and sorts, and marks faults and repeats).  Rows come in blocks of ``BLOCK``; an agenda
ends with a block when all its last items are final, and they are the axioms of the next.
Whatever their audits have in common is decided: those rows go into the hash at once and
are let go.  Items that no continuation can win with go too: a conversation not begun is
worth no more than 3 above one at rest (the next system row deleted), one with a system
row only no more than one at rest, and a turn to come no more than the 2 of inserting it.
So a very long conversation is a stream in bounded memory, but for its audit, one
character a row.  Its hash is a chain over its whole repaired text, so one task has to
read it.

Defined results: a null role or text is one space, and so is a null turn where the damage
is drawn; ties in a turn go by role and text; rows without a conversation id are one
conversation of a null id; repeated rows are rows of their own; an empty table has no
conversations; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
)

# States of a legal conversation: not begun, after a system row, after a user's, at rest after an assistant's.
BEGIN, SYSTEM, USER, REST = range(4)
#: State after a role's initial, where it is legal.
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (REST, "u"): USER, (USER, "a"): REST}
#: The turn that may be inserted, or be made of a row, in each state.
DUE = {BEGIN: "user", SYSTEM: "user", REST: "user", USER: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1

Value = tuple[int, str]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``(c, t, r, x, was_r, was_x, copy, lost)`` after damage by the CRC of conversation and turn; lost ones stay, marked."""
    blank = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), blank), F.coalesce(F.col(turn).cast("string"), blank))) % 20
    rows = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), blank).alias("was_r"), F.coalesce(F.col(text), blank).alias("was_x"), code.alias("code"))
    text_now = F.when(F.col("code") == 0, "").when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("was_x", "[.!?]", "")).otherwise(F.col("was_x"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("c", "t", F.when(F.col("code") == 4, "user").otherwise(F.col("was_r")).alias("r"), text_now.alias("x"), "was_r", "was_x", F.explode(copies).alias("copy"), (F.col("code") == 0).alias("lost"))


def fault(repeated: Column, text: str = "x") -> Column:
    """A row's first fault: blank, duplicate, truncated, or none (empty)."""
    bare = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", "b").when(repeated, "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("")


def repair(rows: DataFrame) -> DataFrame:
    """``RESULT`` for each conversation of ``damaged`` rows."""
    order = [F.col("t").asc_nulls_first(), *map(F.col, ("was_r", "was_x", "copy"))]
    dealt = rows.repartition("c")  # the window below keeps this dealing
    again = F.row_number().over(Window.partitionBy("c", "lost", "r", "x").orderBy(*order)) > 1
    marked = dealt.withColumn("fault", fault(again))
    return marked.sortWithinPartitions(F.col("c").asc_nulls_first(), *order).select("c", "t", "r", "x", "fault", "lost").mapInArrow(_repaired, RESULT)


@dataclass
class Row:
    role: str
    text: str
    fault: str


def edits(state: int, row: Row) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of each edit of a row."""
    yield DELETE, "D", state
    if row.fault not in ("b", "d"):
        extra = CUT_OFF if row.fault == "t" else 0
        kept = NEXT.get((state, row.role[:1]))
        if kept is not None:
            yield extra, "K", kept
        yield REROLE + extra, "R", NEXT[state, DUE[state][0]]


def lightest(axioms: dict[int, Value], rows: list[Row], goal: bool) -> dict[int, Value]:
    """Least value of each state after ``rows``; with ``goal`` only that of the best legal end (at rest, or never begun)."""
    final: set[tuple[int, int]] = set()
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    heapify(agenda)
    ends: dict[int, Value] = {}
    n = len(rows)
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if goal and state in (BEGIN, REST):
                return {state: (cost, audit)}
            ends[state] = cost, audit
            if len(ends) == 4:
                break
        else:
            for more, initial, after in edits(state, rows[i]):
                if (i + 1, after) not in final:
                    heappush(agenda, (cost + more, audit + initial, i + 1, after))
        after = NEXT[state, DUE[state][0]]
        if (i, after) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return ends


def promising(ends: dict[int, Value]) -> dict[int, Value]:
    """Items that some continuation may yet win with."""
    most = {
        BEGIN: [(REST, DELETE)],
        SYSTEM: [(REST, 0), (USER, INSERT)],
        USER: [(REST, INSERT)],
        REST: [(USER, INSERT)],
    }
    return {s: v for s, v in ends.items() if not any(other in ends and v[0] > ends[other][0] + margin for other, margin in most[s])}


@dataclass
class Conversation:
    """What is known of a conversation when some of its rows have been read."""

    conv_id: int | None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    least: int | None = None
    most: int | None = None
    turns: int = 0
    before: str | None = None
    rows: list[Row] = field(default_factory=list)
    #: Rows whose edit is not decided, with those in ``rows``.
    open: deque[Row] = field(default_factory=deque)
    axioms: dict[int, Value] = field(default_factory=lambda: {BEGIN: (0, "")})
    audit: list[str] = field(default_factory=list)
    state: int = BEGIN
    digest: object = field(default_factory=hashlib.sha256)
    some: bool = False

    def read(self, turn: int | None, row: Row) -> None:
        self.blank += row.fault == "b"
        self.duplicate += row.fault == "d"
        self.truncated += row.fault == "t"
        initial = row.role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL_PAIRS
        self.before = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.rows.append(row)
        self.open.append(row)
        if len(self.rows) == BLOCK:
            self.axioms = promising(lightest(self.axioms, self.rows, False))
            self.rows = []
            sure = len(os.path.commonprefix([audit for _, audit in self.axioms.values()]))
            self.decide(next(iter(self.axioms.values()))[1][:sure])
            self.axioms = {s: (cost, audit[sure:]) for s, (cost, audit) in self.axioms.items()}

    def decide(self, audit: str) -> None:
        """Carries out edits that are certain."""
        self.audit.append(audit)
        for initial in audit:
            row = None if initial == "I" else self.open.popleft()
            if initial == "D":
                continue
            role = row.role if initial == "K" else DUE[self.state]
            self.state = NEXT[self.state, role[0]]
            self.digest.update(f"{chr(10) * self.some}{role}:{row.text if row else ''}".encode("utf-8", "surrogatepass"))
            self.some = True

    def end(self) -> tuple:
        ((cost, audit),) = lightest(self.axioms, self.rows, True).values()
        self.decide(audit)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([pa.field(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in RESULT])
    now: Conversation | None = None

    def table(rows: Iterable[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        done = []
        for conv_id, turn, role, text, fault_, lost in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.end())
                now = Conversation(conv_id)
            if not lost:
                now.read(turn, Row(role, text, fault_))
        yield table(done)
    if now is not None:
        yield table([now.end()])
