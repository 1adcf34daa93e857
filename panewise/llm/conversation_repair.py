"""Repair of conversations by iterative-deepening A* over edits.

A conversation is a list of turns whose role initials should read (s?(ua)+)?: an optional system
turn, then pairs of user and assistant. Edits go through it from the first turn to the last: Keep
(0), Rerole to user or assistant (3), Delete (4, the only edit of a blank or duplicate turn) and
Insert of an empty user or assistant turn (3). A truncated turn that is not deleted costs 3 more.

The search is depth first, tries the edits of a node in ASCII order of their initials (D, I, K, R),
and cuts a path as soon as its cost and a lower bound of the rest exceed the present bound. When
nothing is found the bound rises to the least sum that was cut. A table holds, for each place and
state of the pattern, the least cost from which the search failed under the present bound; a path
that comes there at the same or a greater cost fails too. The first accepting path under the least
bound is the cheapest one and, by the order of the edits, the ASCII-least of those.

The lower bound is the exact cost up to the end of the present block of turns, with any state
there, and the least costs of the later blocks by themselves. There are about BLOCKS blocks, so
the number of bounds that are tried does not grow with the conversation.

Spark does the damage, the order and the search for duplicates. One exchange by conversation
brings each conversation's turns twice and in order, first their marks of one byte, then their
texts, so a task holds the marks of one conversation only, never its texts: the digest of the
repaired conversation, which is sequential by its definition, is fed while the texts pass.

Cases: null roles and texts are one space, null ids and turns too in the damage's key; rows of a
null conv_id are one conversation; null turns come first; rows of one turn are ordered by role,
text and copy. An empty role has no initial, so it can be kept anywhere. A conversation without
rows after the damage has zeros, an empty audit and the digest of the empty string. Equal rows are
rows of their own, the later ones duplicates. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: The state that a turn of each initial leads to, from the states in which it may stand.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A mark is 3 * initial + fault.
INITIALS, OTHER, NONE = "sua", 3, 4
SOUND, CUT_SHORT, UNWANTED = range(3)
BLOCKS, LEAST_BLOCK = 8, 64
#: Searches of short conversations remembered in a worker.
REMEMBERED, SHORT = 1 << 16, 64
NEVER = 1 << 60

SPACES = "[^\\x20\\x09-\\x0D]"
MARKED = "conv_id, phase, pos, turn, role, text, mark, gone, blank, duplicate, truncated"
RESULT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def wanted_role(state: int) -> str:
    """The only role that an inserted or renamed turn can have in a state."""
    return "assistant" if state == USER else "user"


def _moves(mark: int | None, state: int) -> tuple[tuple[int, int, int, int], ...]:
    """(initial, cost, turns used, next state) of the edits in a state, by initial; a mark of None
    stands for the end of the conversation."""
    put = (ord("I"), INSERT, 0, NEXT[wanted_role(state)[0]][state])
    if mark is None:
        return (put,)
    initial, fault = divmod(mark, 3)
    out = [(ord("D"), DELETE, 1, state), put]
    if fault != UNWANTED:
        more = TRUNCATED if fault == CUT_SHORT else 0
        after = state if initial == NONE else None if initial == OTHER else NEXT[INITIALS[initial]].get(state)
        if after is not None:
            out.append((ord("K"), KEEP + more, 1, after))
        out.append((ord("R"), REROLE + more, 1, put[3]))
    return tuple(out)


MOVES = [[_moves(mark, state) for state in range(4)] for mark in range(15)]
AT_END = [_moves(None, state) for state in range(4)]


def lower_bounds(marks: bytes) -> list[int]:
    """For turn i and state q, at 4 * i + q, the least cost of the rest with free states between
    the blocks."""
    n = len(marks)
    size = max(LEAST_BLOCK, -(-n // BLOCKS))
    bounds = [0] * (4 * n + 4)
    for i in range(n, -1, -1):
        if i == n:
            direct = [0 if q in ACCEPTING else NEVER for q in range(4)]
        else:
            after = bounds[4 * i + 4 : 4 * i + 8]
            if (i + 1) % size == 0 and i + 1 < n:
                after = [min(after)] * 4
            direct = [min(cost + after[to] for _, cost, used, to in MOVES[marks[i]][q] if used) for q in range(4)]
        for q in range(4):
            best, state = direct[q], q
            for inserts in (1, 2, 3):
                state = AT_END[state][0][3]
                best = min(best, inserts * INSERT + direct[state])
            bounds[4 * i + q] = best
    return bounds


def search(marks: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of equally cheap ones the ASCII-least initials."""
    n, rest = len(marks), lower_bounds(marks)
    bound = rest[START]
    while True:
        failed = [NEVER] * (4 * n + 4)
        above, path = NEVER, bytearray()
        stack = [(0, START, 0, iter(MOVES[marks[0]][START] if n else AT_END[START]))]
        while stack:
            i, state, cost, edits = stack[-1]
            if i == n and state in ACCEPTING:
                return cost, path.decode()
            for letter, price, used, to in edits:
                j, spent = i + used, cost + price
                at = 4 * j + to
                if spent >= failed[at]:
                    continue
                if spent + rest[at] > bound:
                    above = min(above, spent + rest[at])
                    continue
                path.append(letter)
                stack.append((j, to, spent, iter(MOVES[marks[j]][to] if j < n else AT_END[to])))
                break
            else:
                failed[4 * i + state] = min(failed[4 * i + state], cost)
                stack.pop()
                del path[-1:]
        bound = above


remembered = lru_cache(REMEMBERED)(search)


class Conversation:
    """One conversation while its rows pass, marks first and texts after them."""

    def __init__(self, key):
        self.key = key
        self.marks = bytearray()
        self.counts = [0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = None
        self.found: tuple[int, str] | None = None
        self.digest, self.at, self.state, self.written = hashlib.sha256(), 0, START, 0

    def mark(self, turn: int | None, mark: int, faults: tuple[bool, bool, bool]) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.marks:
            pair = self.marks[-1] // 3, mark // 3
            self.illegal += pair not in ((0, 1), (1, 2), (2, 1))
        self.counts = [n + bool(f) for n, f in zip(self.counts, faults, strict=True)]
        self.marks.append(mark)

    def solve(self) -> tuple[int, str]:
        if self.found is None:
            marks = bytes(self.marks)
            self.found = remembered(marks) if len(marks) <= SHORT else search(marks)
        return self.found

    def put(self, role: str, text: str) -> None:
        start = "\n" if self.written else ""
        self.digest.update(f"{start}{role}:{text}".encode())
        self.written += 1
        self.state = NEXT.get(role[:1], {}).get(self.state, self.state)

    def inserts(self) -> None:
        audit = self.solve()[1]
        while self.at < len(audit) and audit[self.at] == "I":
            self.put(wanted_role(self.state), "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.solve()[1][self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else wanted_role(self.state), text)

    def row(self) -> tuple:
        cost, audit = self.solve()
        self.inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.key, gaps, *self.counts, self.illegal, cost, audit, self.digest.hexdigest()


def _first_character(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    at = F.instr(F.lit(INITIALS), initial) - 1
    return F.when(role == "", NONE).when(at < 0, OTHER).otherwise(at)


def damaged(rows: DataFrame) -> DataFrame:
    """The turns after the damage, copies as rows; dropped ones stay as gone, for their conv_id."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy"))


def repaired(turns: DataFrame) -> DataFrame:
    """One row of each conversation of (conv_id, turn, role, text, gone): its faults, the cost and
    initials of its cheapest edits, and the digest of what they give."""
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "seen", "gone")
    rows = turns.repartition("conv_id").withColumn("seen", F.row_number().over(same)).withColumn("pos", F.row_number().over(order))
    blank = ~F.col("text").rlike(SPACES)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    duplicate = ~blank & (F.col("seen") > 1)
    truncated = ~blank & ~duplicate & ~last.isin(*".!?")
    fault = F.when(blank | duplicate, UNWANTED).when(truncated, CUT_SHORT).otherwise(SOUND)
    rows = rows.select(
        "conv_id", "turn", "role", "text", "gone", "pos", (3 * _first_character(F.col("role")) + fault).cast("int").alias("mark"),
        blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"),
    )
    texts_only = F.col("phase") == 1
    rows = rows.withColumns({c: F.when(texts_only, F.col(c)) for c in ("role", "text")})
    rows = rows.select(*MARKED.split(", ")).sortWithinPartitions("conv_id", "phase", "pos")
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        done: list[tuple] = []
        for batch in batches:
            for key, phase, _, turn, role, text, mark, gone, *faults in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(key)
                if gone:
                    continue
                if phase:
                    now.text(role, text)
                else:
                    now.mark(turn, mark, tuple(faults))
            if done:
                yield out(done, batch.schema.field("conv_id").type)
                done = []
        if now is not None:
            yield out([now.row()], batch.schema.field("conv_id").type)

    def out(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key, *kinds[1:]], strict=True)], names=names)

    return rows.mapInArrow(run, RESULT.format(id=dict(turns.dtypes)["conv_id"]))
