"""Repair of the turn structure of conversations by Four-Russians block tables.

A conversation is a word over nine symbols (a row that has to go, or one whose role begins with s, u, a or another sign, ended
or cut off), and the cheapest edits lead it through an automaton of four states: nothing yet, after system, after user, after
assistant. The cost still to pay from each state, less the least of the four, takes few different values; so a table holds for every
such vector and every block of ``BLOCK`` symbols which vector lies before the block and what it adds. A conversation is read from its
end by one lookup a block. Then each block is opened from its stored vector backwards, and the edits are read forwards: at every place
the least letter that still reaches the least cost, so ties end in the ASCII-least audit.

What is a repetition is found by a Spark aggregation over (conversation, role, digest of the text), so no task remembers the texts of a
conversation. Rows come to their task twice, in one sort: first the narrow ones, from which the edits follow (one byte a row is held),
then those with texts, which go through the digest one by one. The contract's digest runs over a whole conversation in order, so one
conversation is read by one task, in constant memory but for that byte.

Rows of a conversation are taken by turn (nulls first), then role, then digest of the text. Null turns, roles and texts are one space,
which makes such a text blank; null ids form one conversation. Equal rows are all damaged and kept, each is a row of its own. A conversation
whose rows are all dropped gives zeros. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of a block.
BLOCK = 4
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or renamed row, by the state before it.
TURNED = (USER, USER, ASSISTANT, USER)
#: States a kept row leads to, by its role's first letter.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 0 has to go; 1 to 4 are s, u, a, other; 5 to 8 the same, cut off.
INITIALS = "sua"
SYMBOLS = 9
DELETE, INSERT, RENAME, CUT_OFF = 2, 5, 1, 5
#: Cost after the last row: what has to be inserted for a legal end.
END_COST = (0, 2 * INSERT, INSERT, 0)

BLANK, TRUNCATED, REPEATED = 1, 2, 4
GAPS = "\x20\x09\x0a\x0b\x0c\x0d"


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, cost, state after it)`` of the edits that use up a row."""
    yield "D", DELETE, state
    if symbol:
        more = CUT_OFF if symbol > 4 else 0
        initial = "sua?"[(symbol - 1) % 4]
        if state in KEPT.get(initial, {}):
            yield "K", more, KEPT[initial][state]
        yield "R", RENAME + more, TURNED[state]


class Tables:
    """Vectors of costs, and what a symbol or a block does to them."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        known: dict[tuple[int, ...], int] = {}

        def number(vector: tuple[int, ...]) -> int:
            if vector not in known:
                known[vector] = len(self.vectors)
                self.vectors.append(vector)
            return known[vector]

        number(END_COST)
        before: list[list[int]] = []
        added: list[list[int]] = []
        #: letters and state after a row, by vector behind the row, symbol and state
        self.walk: list[list[list[tuple[str, int]]]] = []
        at = 0
        while at < len(self.vectors):
            behind = self.vectors[at]
            before.append([])
            added.append([])
            self.walk.append([])
            for symbol in range(SYMBOLS):
                plain = [min(c + behind[q] for _, c, q in _edits(symbol, s)) for s in range(4)]
                costs = list(plain)
                for s in range(4):
                    state, paid = s, 0
                    for _ in range(3):
                        state, paid = TURNED[state], paid + INSERT
                        costs[s] = min(costs[s], paid + plain[state])
                least = min(costs)
                before[at].append(number(tuple(c - least for c in costs)))
                added[at].append(least)
                self.walk[at].append([self._letters(symbol, s, costs, behind) for s in range(4)])
            at += 1
        self.before = np.array(before, np.int32)
        self.added = np.array(added, np.int64)
        # a block's code has its first symbol as the highest digit; its last symbol is read first
        self.block_before = np.arange(len(self.vectors), dtype=np.int32)[:, None]
        self.block_added = np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(BLOCK):
            ahead = self.block_before[:, None, :]
            symbols = np.arange(SYMBOLS)[None, :, None]
            self.block_added = (self.block_added[:, None, :] + self.added[ahead, symbols]).reshape(len(self.vectors), -1)
            self.block_before = self.before[ahead, symbols].reshape(len(self.vectors), -1)

    @staticmethod
    def _letters(symbol: int, state: int, costs: list[int], behind: tuple[int, ...]) -> tuple[str, int]:
        letters = ""
        while True:
            fits = {a: q for a, c, q in _edits(symbol, state) if c + behind[q] == costs[state]}
            if "D" in fits:
                return letters + "D", fits["D"]
            if INSERT + costs[TURNED[state]] == costs[state]:
                letters += "I"
                state = TURNED[state]
                continue
            letter = min(fits)
            return letters + letter, fits[letter]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


class Edits:
    """Least cost of a conversation's symbols, and its edits row by row."""

    def __init__(self, symbols: bytes):
        self.tables = t = tables()
        self.symbols = np.frombuffer(bytes(symbols), np.uint8)
        self.lead = len(symbols) % BLOCK
        codes = np.zeros(len(symbols) // BLOCK, np.int64)
        for k in range(BLOCK):
            codes = codes * SYMBOLS + self.symbols[self.lead + k :: BLOCK]
        vector, cost = 0, 0
        # the vector behind each block
        self.behind = np.zeros(len(codes), np.int32)
        for block in range(len(codes) - 1, -1, -1):
            self.behind[block] = vector
            cost += int(t.block_added[vector, codes[block]])
            vector = int(t.block_before[vector, codes[block]])
        self.first = vector
        for k in range(self.lead - 1, -1, -1):
            cost += int(t.added[vector, self.symbols[k]])
            vector = int(t.before[vector, self.symbols[k]])
        self.cost = cost + t.vectors[vector][START]

    def rows(self) -> Iterator[tuple[str, int]]:
        """Letters of each row (insertions before it come first) and the state before them."""
        t = self.tables
        state = START
        cuts = [0, *range(self.lead, len(self.symbols), BLOCK), len(self.symbols)]
        if not self.lead:
            cuts = cuts[1:] if len(self.symbols) else [0]
        for low, high in zip(cuts, cuts[1:]):
            block = (low - self.lead) // BLOCK
            vector = self.first if low < self.lead else int(self.behind[block])
            opened = []
            for k in range(high - 1, low - 1, -1):
                opened.append(vector)
                vector = int(t.before[vector, self.symbols[k]])
            for k in range(low, high):
                letters, after = t.walk[opened.pop()][self.symbols[k]][state]
                yield letters, state
                state = after
        yield "I" * (END_COST[state] // INSERT), state


class _Conversation:
    """One conversation as its sorted rows come by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = None
        self.last: tuple | None = None
        self.edits: Edits | None = None
        self.steps: Iterator[tuple[str, int]] = iter(())
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.written = False

    def note(self, turn: int | None, role: str, digest: bytes, marks: int) -> None:
        """A row without its text."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        row = (turn, role, digest)
        repeated = bool(marks & REPEATED) or self.last == row
        self.last = row
        if marks & BLANK:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif marks & TRUNCATED:
            self.truncated += 1
        if marks & BLANK or repeated:
            self.symbols.append(0)
        else:
            initial = INITIALS.find(role[:1]) if role else -1
            self.symbols.append((initial if initial >= 0 else 3) + 1 + (4 if marks & TRUNCATED else 0))

    def _plan(self) -> None:
        if self.edits is None:
            self.edits = Edits(self.symbols)
            self.steps = self.edits.rows()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.written else "").encode() + f"{role}:{text}".encode())
        self.written = True

    def _apply(self, letters: str, state: int, role: str, text: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            after = TURNED[state] if letter != "K" else KEPT[role[:1]][state]
            self._write(role if letter == "K" else ROLE[after], "" if letter == "I" else text)
            state = after

    def write(self, role: str, text: str) -> None:
        """The same row with its text."""
        self._plan()
        letters, state = next(self.steps)
        self._apply(letters, state, role, text)

    def result(self) -> tuple:
        self._plan()
        for letters, state in self.steps:
            self._apply(letters, state, "", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            self.edits.cost, "".join(self.audit), self.digest.hexdigest(),
        )


RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
_NAMES = [part.split()[0] for part in RESULT.split(", ")]
_TYPES = [pa.string() if " string" in part else pa.int64() for part in RESULT.split(", ")]
#: Rows of the sorted stream: without text, with text, and one that ends a conversation.
NOTE, WRITE, CLOSE = range(3)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, done = None, []
    for batch in batches:
        for conv_id, phase, turn, role, digest, marks, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None:
                held = _Conversation(conv_id)
            if phase == NOTE:
                held.note(turn, role, digest, marks)
            elif phase == WRITE:
                held.write(role, text)
            else:
                done.append(held.result())
                held = None
        if len(done) >= 1000:
            yield _table(done)
            done = []
    if done:
        yield _table(done)


def damage(conversations: DataFrame, sides: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the checksum of id and turn deals out."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % sides
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _marks() -> Column:
    last = F.right(F.rtrim("text", F.lit(GAPS)), F.lit(1))
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


def repair(damaged: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids``: faults, cost, audit and digest of what is left after the cheapest edits."""
    rows = damaged.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), _marks().alias("marks"), "text"
    )
    seen = (
        rows.where(F.col("marks") != BLANK)
        .groupBy("conv_id", "role", "digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("bare"))
        .where("n > 1")
        .select(
            F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
            F.when(~F.col("bare"), F.col("turn")).alias("first"), F.lit(True).alias("again"),
        )
    )
    notes = rows.drop("text").join(
        seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left"
    )
    later = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    stream = (
        notes.select(
            "conv_id", F.lit(NOTE).alias("phase"), "turn", "role", "digest",
            (F.col("marks") + F.when(later, REPEATED).otherwise(0)).alias("marks"), none("string", "text"),
        )
        .unionByName(rows.withColumn("phase", F.lit(WRITE)).select("conv_id", "phase", "turn", "role", "digest", "marks", "text"))
        .unionByName(
            ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
                "conv_id", F.lit(CLOSE).alias("phase"), none("long", "turn"), none("string", "role"),
                none("binary", "digest"), none("int", "marks"), none("string", "text"),
            )
        )
    )
    return (
        stream.repartition("conv_id")
        .sortWithinPartitions("conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "digest")
        .mapInArrow(_repair, RESULT)
    )


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations), conversations)
