"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate as they should.

Roles may run ``(s?(ua)+)?``: nothing, or user and assistant in turn, ending with the
assistant, after a system row at most. A row's fault is that it is blank, a duplicate
(its role and text were seen earlier in the conversation) or truncated. Keeping a row
costs 0, another role 3, deleting it 4, inserting an empty row 3; an undeleted truncated
row adds 3; blank rows and duplicates must be deleted.

Nodes (rows consumed, grammar state) are searched by Dijkstra's method; a node's key is
its cost, then its audit, the initials of its edits (Keep, Rerole, Delete, Insert), and
the search stops at the first accepting end node that it takes off the heap. Audits of
equal cost never continue one another between the same two nodes, as what is longer has
more inserts, so the least audit of a node is part of the least audit through it.

A conversation is read as a stream in its order: Spark shuffles rows by conversation and
sorts them; a task holds WINDOW_ROWS rows, or WINDOW_CHARS of text and one row. At the end of
such a window the search goes on from the four states' least keys, each with a digest of
what it has repaired so far, and what their audits begin with alike is put aside. So one
conversation with a third of all rows takes one task's time (a digest is read in order),
not its memory; only its audit, a character an edit, is held as a whole. Where a role and
text were seen before is found by Spark without the texts, as rows that are merged into
the stream.

Null roles, texts, turns and ids are one space where they are hashed or written. Rows of
one turn are ordered by role, then text, null turns come first. A null conv_id is a
conversation of its own. Repeated rows are rows like others (so all but one are
duplicates). An empty table gives an empty result; only the four named columns are read,
so others may have any names. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import sliced

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of text that are held at a time.
WINDOW_ROWS = 512
WINDOW_CHARS = 4 << 20

#: Grammar states: nothing yet, after the system row, after a user, after an assistant; what each initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ACCEPTING = 0, (0, 3)
ROLE = {"u": "user", "a": "assistant"}
FOLLOWS = {"su", "ua", "au"}

SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
SCHEMA = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


class Row(NamedTuple):
    role: str
    text: str
    fault: str | None


def search(rows: list[Row], sources: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str, int, str]]:
    """Least cost and audit of each state after all rows, with the source it came from and the edits since; if last, of the first accepting one alone.

    sources: cost and audit of states before the first row. Inserts after the last row
    belong to what follows, so they are made only if nothing does.
    """
    n = len(rows)
    heap = [(cost, audit, 0, q, q, len(audit)) for q, (cost, audit) in sources.items()]
    heapq.heapify(heap)
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str, int, str]] = {}
    while heap:
        cost, audit, i, q, source, own = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and (q in ACCEPTING or not last):
            ends[q] = (cost, audit, source, audit[own:])
            if last:
                return ends
        if i < n or last:
            for to in {NEXT[q][x] for x in ROLE if x in NEXT[q]}:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to, source, own))
        if i < n:
            role, _, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, q, source, own))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                if (to := NEXT[q].get(role[:1])) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, source, own))
                for x in ROLE:
                    if (to := NEXT[q].get(x)) is not None:
                        heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, to, source, own))
    return ends


def repaired(rows: list[Row], q: int, edits: str) -> Iterator[str]:
    """role:text of the rows that edits leave, from grammar state q on."""
    at = iter(rows)
    for edit in edits:
        if edit == "D":
            next(at)
            continue
        x = next(i for i in ROLE if i in NEXT[q])
        role, text = ROLE[x], ""
        if edit != "I":
            row = next(at)
            text = row.text
            if edit == "K":
                role, x = row.role, row.role[:1]
        q = NEXT[q][x]
        yield f"{role}:{text}"


class _Conversation:
    """What is known of a conversation after the rows so far."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.any = False
        self.before: str | None = None  # the last row's initial
        self.audit: list[str] = []  # what all states' audits begin with
        self.states = {START: (0, "")}
        self.digests = {START: (hashlib.sha256(), False)}
        self.rows: list[Row] = []
        self.chars = 0
        self.here: tuple | None = None  # the last row's turn and role
        self.text: str | None = None
        self.marks: set[bytes] = set()  # texts of this turn and role that earlier turns have

    def place(self, turn: int | None, role: str) -> None:
        if (turn, role) != self.here:
            self.here, self.text, self.marks = (turn, role), None, set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.any = True
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.place(turn, role)
        body = text.rstrip(SPACE)
        seen = text == self.text or bool(self.marks) and hashlib.md5(text.encode("utf-8", "replace")).digest() in self.marks
        fault = "blank" if not body else "duplicate" if seen else None if body[-1] in ".!?" else "truncated"
        self.text = text
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in FOLLOWS:
            self.illegal += 1
        self.before = role[:1]
        self.rows.append(Row(role, text, fault))
        self.chars += len(text)
        if len(self.rows) >= WINDOW_ROWS or self.chars >= WINDOW_CHARS:
            self.advance(False)

    def advance(self, last: bool) -> None:
        ends = search(self.rows, self.states, last)
        digests = {}
        for q, (_, _, source, edits) in ends.items():
            digest, some = self.digests[source]
            digest = digest.copy()
            for line in repaired(self.rows, source, edits):
                digest.update((("\n" if some else "") + line).encode("utf-8", "replace"))
                some = True
            digests[q] = (digest, some)
        audits = [audit for _, audit, _, _ in ends.values()]
        low, high = min(audits), max(audits)
        alike = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), len(low))
        self.audit.append(low[:alike])
        self.states = {q: (cost, audit[alike:]) for q, (cost, audit, _, _) in ends.items()}
        self.digests = digests
        self.rows, self.chars = [], 0

    def result(self) -> tuple:
        self.advance(True)
        [(q, (cost, audit))] = self.states.items()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, cost, "".join([*self.audit, audit]), self.digests[q][0].hexdigest()


def mended(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Results of conversations, from their rows in order: conv_id, turn, role, text, mark, copies.

    A row with a mark (the MD5 of a text) says that an earlier turn has this role and
    text; it comes before the rows of its turn and role. A row without copies and mark
    only says that there is such a conversation.
    """
    for conv_id, own in itertools.groupby(rows, lambda r: r[0]):
        found = _Conversation()
        for _, turn, role, text, mark, copies in own:
            if mark is not None:
                found.place(turn, role)
                found.marks.add(mark)
            for _ in range(copies):
                found.add(turn, role, text)
        yield conv_id, *found.result()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row as it is damaged by the CRC-32 of its ids modulo 20; 0 copies if it is dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def seen_before(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark: a role and text (its MD5) of a turn that an earlier turn of the conversation has as well."""
    key = ["conv_id", "role", "mark"]
    turns = rows.where("copies > 0").select("conv_id", "turn", "role", _md5(F.col("text")).alias("mark")).distinct()
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn")))
    return turns.withColumn("nth", nth).where("nth > 1").select("conv_id", "turn", "role", "mark")


def repair(rows: DataFrame) -> DataFrame:
    """Per conv_id of rows (conv_id, turn, role, text, copies): gaps, faults, cost, audit and digest of the cheapest repair."""
    names = ["conv_id", "turn", "role", "text", "mark", "copies"]
    none = lambda kind: F.lit(None).cast(kind)
    there = F.col("copies") > 0
    full = rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], none("binary").alias("mark"), "copies")
    marks = seen_before(rows).select("conv_id", "turn", "role", none("string").alias("text"), "mark", F.lit(0).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in sliced(batches) for row in zip(*(batch[c].to_pylist() for c in names), strict=True))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        results = mended(stream)
        while some := list(itertools.islice(results, 1_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    dealt = full.unionByName(marks).repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    return ordered.select(*names).mapInArrow(run, SCHEMA)
