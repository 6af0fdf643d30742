"""Repair of conversation structure by cheapest edits, streamed turn by turn.

A repaired conversation's role initials read ``(s?(ua)+)?``: nothing, or an optional system
turn and then user and assistant in turns, ending with the assistant. Edits and their costs:
Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate turns),
Insert a turn without text 5; a truncated turn that is not deleted adds 5.

The automaton has four states (start, after s, after u, after a) and every edit leads from a
state to one other, so a turn changes four costs. Rows are dealt out by conversation and
sorted by turn, last first; a task carries the four costs-to-go across Arrow batches and notes
two bytes a turn: the best edit in each state. At a conversation's first turn these notes are
walked forwards, which gives the cheapest edits and, of equally cheap ones, those with the
smallest initials. Notes of a giant conversation go to an unnamed file of the task beyond
``SPILL`` turns, like Spark's own spill, so memory holds a batch, the notes and the answer.
The texts themselves stay out of this pass: a turn is its role, a digest and three flags. A
second pass in order of turns applies the edits to the texts, one turn at a time.

Turns of a conversation are in order of turn (null first), then role, then SHA-256 of the text.

Defined cases: a null conversation id is a conversation of its own; null roles and texts are
empty; a role counts by its first character as written; repeated rows are duplicates of each
other; a conversation is in the result if it has a row; an empty table gives an empty result;
other columns are not read. A conversation meets in one task, as the method wants, but never in
memory: a very long text costs its own size, a long conversation two bytes a turn.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, out_rows, raw, tuned

SPILL = 8 << 20  # turns whose notes a task holds in memory
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5
LETTERS = "DIKR"  # in the order in which ties are settled
KINDS = {"s": 0, "u": 1, "a": 2}  # a role's initial; others are 3
# Faults are 0 none, 1 blank, 2 duplicate, 3 truncated.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a turn that Rerole or Insert makes, and that turn's role.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE = {START: b"user", AFTER_S: b"user", AFTER_U: b"assistant", AFTER_A: b"user"}
#: The state after a kept turn, by state and kind.
KEPT = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_A, 1): AFTER_U, (AFTER_U, 2): AFTER_A}
#: Costs-to-go after the last turn: what is missing is inserted.
END = (0, 2 * COSTS["I"], COSTS["I"], 0)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def step(later: tuple, kind: int, fault: int) -> tuple[tuple, int]:
    """Costs-to-go before a turn from those after it, and the best edit in each state (two bits each)."""
    extra = TRUNCATED * (fault == 3)
    stays = fault not in (1, 2)
    plain = []
    for state in range(4):
        options = {"D": COSTS["D"] + later[state]}
        if stays:
            options["R"] = COSTS["R"] + extra + later[NEXT[state]]
            if (state, kind) in KEPT:
                options["K"] = COSTS["K"] + extra + later[KEPT[state, kind]]
        plain.append(options)
    least = [min(o.values()) for o in plain]
    # Two inserts in a row are the most that can help.
    costs = tuple(min(least[s], COSTS["I"] + least[NEXT[s]], 2 * COSTS["I"] + least[NEXT[NEXT[s]]]) for s in range(4))
    note = 0
    for state in range(4):
        options = plain[state] | {"I": COSTS["I"] + costs[NEXT[state]]}
        best = next(i for i, letter in enumerate(LETTERS) if options.get(letter) == costs[state])
        note |= best << 2 * state
    return costs, note


class Notes:
    """Two bytes a turn, written last turn first and read first turn first."""

    def __init__(self, spill: int):
        self.spill, self.held, self.file = spill, array("H"), None

    def add(self, note: int) -> None:
        self.held.append(note)
        if len(self.held) >= self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            self.held = array("H")

    def read(self) -> Iterator[int]:
        yield from reversed(self.held)
        left = self.file.tell() if self.file else 0
        while left:
            size = min(left, 2 * self.spill)
            left -= size
            self.file.seek(left)
            part = array("H")
            part.fromfile(self.file, size // 2)
            yield from reversed(part)


def audit_of(notes: Iterator[int]) -> str:
    """The edits' initials, walked from the first turn."""
    out, state = bytearray(), START
    for note in notes:
        while True:
            edit = note >> 2 * state & 3
            out.append(ord(LETTERS[edit]))
            if edit != 1:
                break
            state = NEXT[state]
        if edit:
            state = NEXT[state] if edit == 3 else KEPT[state, note >> 8]
    out.extend(b"I" * (END[state] // COSTS["I"]))
    return out.decode()


class Conversation:
    """One conversation as it streams by, last turn first."""

    def __init__(self, key: tuple, spill: int):
        self.key, self.notes = key, Notes(spill)
        self.costs, self.spent = END, 0  # costs-to-go above the least of them, and that one
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.later = self.last = self.first = None

    def add(self, turn: int | None, initial: str, fault: int, known: dict) -> None:
        self.faults[fault] += 1
        self.illegal += self.later is not None and (initial, self.later) not in LEGAL
        self.later = initial
        if turn is not None:
            self.turns += turn != self.first
            self.first, self.last = turn, turn if self.last is None else self.last
        kind = KINDS.get(initial, 3)
        if (found := known.get((self.costs, kind, fault))) is None:
            costs, note = step(self.costs, kind, fault)
            low = min(costs)
            found = known[self.costs, kind, fault] = tuple(c - low for c in costs), low, note | kind << 8
        self.costs, low, note = found
        self.spent += low
        self.notes.add(note)

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        _, blank, duplicate, truncated = self.faults
        return (*self.key, gaps, blank, duplicate, truncated, self.illegal, self.costs[START] + self.spent, audit_of(self.notes.read()))


AUDIT = ("named", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
AUDIT_DDL = "named boolean, conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audited(spill: int):
    """Rows of (named, conv, numbered, turn, initial, fault), last turn first, to a row a conversation."""

    def mapper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        now = None
        for frame in frames:
            done = []
            for named, conv, numbered, turn, initial, fault in zip(*(frame[c].tolist() for c in frame)):
                if now is None or now.key != (named, conv):
                    if now:
                        done.append(now.row())
                    now = Conversation((named, conv), spill)
                now.add(turn if numbered else None, initial, fault, known)
            if done:
                yield pd.DataFrame(done, columns=AUDIT)
        if now:
            yield pd.DataFrame([now.row()], columns=AUDIT)

    return mapper


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, digest; null roles and texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def fault_of(nth: Column) -> Column:
    body = F.rtrim("text", F.lit(SPACE.decode()))
    ended = F.right(body, F.lit(1)).isin(".", "!", "?")
    return F.when(body == "", 1).when(nth > 1, 2).when(~ended, 3).otherwise(0)


def audit(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", spill: int = SPILL
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row a conversation.

    ``audit`` has the initials of the cheapest edits in order. No text is shuffled.
    """
    spark = tuned(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.col("nth")
    flagged = turns(rows, conv_col, turn_col, role_col, text_col).select(
        "conv", "turn", "role", "digest", fault_of(F.lit(1)).alias("alone")
    )
    seen = Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    judged = flagged.withColumn("nth", F.row_number().over(seen)).withColumn("fault", F.when((F.col("alone") != 1) & (nth > 1), 2).otherwise(F.col("alone")))
    last_first = [F.asc("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("nth")]
    in_order = judged.repartition(parts, "conv").sortWithinPartitions(*last_first)
    # pandas has no null integers: a flag goes beside each.
    plain = in_order.select(
        F.col("conv").isNotNull().alias("named"), F.coalesce("conv", F.lit(0).cast("long")).alias("conv"),
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"),
        F.left("role", F.lit(1)).alias("initial"), "fault",
    )
    return plain.mapInPandas(audited(spill), AUDIT_DDL).withColumn("conv_id", F.when(F.col("named"), F.col("conv_id"))).drop("named")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, role, text) of every repaired turn in order, and (conv, None, None) at the end of each conversation.

    A conversation's first row is its audit.
    """
    conv = edits = None
    at, state = 0, START

    def inserted():
        nonlocal at, state
        while edits[at : at + 1] == b"I":
            yield conv, ROLE[state], b""
            at, state = at + 1, NEXT[state]

    for batch in batches:
        roles, texts = raw(batch.column(2)), raw(batch.column(3))
        for row_conv, is_turn, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), roles, texts):
            if not is_turn:
                if edits is not None:
                    yield from inserted()
                    yield conv, None, None
                conv, edits, at, state = row_conv, text, 0, START
                continue
            yield from inserted()
            edit = edits[at : at + 1]
            at += 1
            if edit == b"K":
                yield conv, role, text
                state = KEPT[state, KINDS.get(role[:1].decode("ascii", "replace"), 3)]
            elif edit == b"R":
                yield conv, ROLE[state], text
                state = NEXT[state]
    if edits is not None:
        yield from inserted()
        yield conv, None, None


TURN = {"conv_id": pa.int64(), "position": pa.int64(), "role": pa.binary(), "text": pa.binary()}
DIGEST = {"conv_id": pa.int64(), "repaired_sha256": pa.string()}


def repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        position = 0
        for conv, role, text in edited(batches):
            if role is None:
                position = 0
            else:
                yield conv, position, role, text
                position += 1

    return out_rows(TURN, rows(), weight=lambda row: 64 + len(row[3]))


def repaired_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        running = None
        for conv, role, text in edited(batches):
            if role is None:
                yield conv, (running or hashlib.sha256()).hexdigest()
                running = None
                continue
            if running is None:
                running = hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(role + b":")
            running.update(text)

    return out_rows(DIGEST, rows())


def with_audits(rows: DataFrame, audits: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, is_turn, role, text: by conversation its audit, then its turns in order."""
    parts = int(tuned(rows.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    null = F.lit(None)
    all_turns = turns(rows, conv_col, turn_col, role_col, text_col).select("conv", F.lit(1).alias("is_turn"), "turn", "role", "digest", "text")
    marks = audits.select(
        F.col("conv_id").alias("conv"), F.lit(0).alias("is_turn"), null.cast("long").alias("turn"), F.lit("").alias("role"),
        null.cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    order = [F.asc("conv"), F.asc("is_turn"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return marks.unionByName(all_turns).repartition(parts, "conv").sortWithinPartitions(*order).select("conv", "is_turn", "role", "text")


def apply(
    rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, position, role, text: the repaired conversations, by their ``audit``. Texts are shuffled once."""
    stream = with_audits(rows, audits, conv_col, turn_col, role_col, text_col)
    fixed = stream.mapInArrow(repaired_turns, "conv_id bigint, position bigint, role binary, text binary")
    return fixed.select("conv_id", "position", F.decode("role", "UTF-8").alias("role"), F.decode("text", "UTF-8").alias("text"))


def digests(
    rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired turns as ``role:text`` lines. Texts are shuffled once."""
    return with_audits(rows, audits, conv_col, turn_col, role_col, text_col).mapInArrow(repaired_digests, "conv_id bigint, repaired_sha256 string")
