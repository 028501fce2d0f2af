"""Conversation structure repair by Four-Russians block tables.

A conversation's turns are symbols: the role's initial (s, u, a or another), and whether the turn has to go
(blank, or said before by the same role) or breaks off. The cheapest edits lead to initials `(s?(ua)+)?`: an automaton of four states, so
what is left to pay after a turn is a vector of four costs. From any state any other continuation is a bounded
number of edits away; less its least entry such a vector takes few values (`Tables.vectors`, some dozens).

1. Tables hold, for every normalised vector and every block of `BLOCK` symbols, the vector before that block.
2. Turns of a conversation come from last to first as a stream, and each whole block is one lookup. Every turn gets
   the vector at the end of its block.
3. They come again from first to last. A block is expanded backward from the vector at its end, which gives the
   vectors inside; then its edits are read off forward: of the edits that keep to the least cost the one whose
   letter is least in ASCII (D < I < K < R). An edit's letter fixes the next state, so this is the least of all
   cheapest audits, ties inside blocks and across them alike.

One shuffle deals turns by conversation; both streams are sorts inside those partitions, so a task holds one block
of turns, however long a conversation is. (Its order and the digest of it are sequential: one task reads it through.)

Defined cases: a null role or text is one space; an empty role, or one with another initial, can't be kept as it is; null
turns stand first; turns of equal number are ordered by role, then text; null conv_ids are one conversation; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdara.llm.common import tidy
from verdara.session import ship

COST = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What a turn that breaks off costs if it stays.
BROKEN = 5
BLOCK = 4
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. By initial the state after each; what is due in each.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
DUE = "uuau"
ROLES = {"u": "user", "a": "assistant"}
#: Symbol 0 has to be deleted; the others are 1 + 2 * initial + (1 if it breaks off).
INITIALS = "sua?"
SYMBOLS = 1 + 2 * len(INITIALS)
#: Costs when no turn is left: nothing or whole pairs may end, others have to be completed.
END = (0, 2 * COST["I"], COST["I"], 0)


def _choices(symbol: int, state: int):
    """(letter, cost, next state) of the edits of one turn, other than insertions before it."""
    yield "D", COST["D"], state
    if symbol:
        extra = BROKEN if (symbol - 1) % 2 else 0
        kept = AFTER.get(INITIALS[(symbol - 1) // 2], (None,) * 4)[state]
        if kept is not None:
            yield "K", COST["K"] + extra, kept
        yield "R", COST["R"] + extra, AFTER[DUE[state]][state]


def _before(after: tuple, symbol: int) -> tuple:
    """Least costs from each state with one turn more to come."""
    costs = [min(c + after[n] for _, c, n in _choices(symbol, s)) for s in range(4)]
    for _ in range(2):  # an insertion, or two
        costs = [min(c, COST["I"] + costs[AFTER[DUE[s]][s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Normalised vectors and their transitions, by single symbols and by whole blocks."""

    def __init__(self) -> None:
        self.vectors = [END]
        number = {END: 0}
        one = []
        for v in self.vectors:  # grows until no transition leads to a new one
            one.append([])
            for symbol in range(SYMBOLS):
                raw = _before(v, symbol)
                low = tuple(c - min(raw) for c in raw)
                if low not in number:
                    number[low] = len(self.vectors)
                    self.vectors.append(low)
                one[-1].append(number[low])
        self.one = one
        step = np.array(one, np.int16)
        table = step
        for _ in range(BLOCK - 1):  # the last symbol of a block comes first, and is its code's first digit
            table = step[table].reshape(len(one), -1)
        self.block = table

    @lru_cache(maxsize=100_000)  # noqa: B019  one instance lives as long as its worker
    def expand(self, vector: int, symbols: tuple, state: int) -> tuple:
        """(letters of each turn, state after them) of a block, given the vector at its end and the state before it."""
        ends = [vector]
        for symbol in reversed(symbols):
            ends.append(self.one[ends[-1]][symbol])
        letters = []
        for symbol, end in zip(symbols, ends[-2::-1], strict=True):
            after, made = self.vectors[end], ""
            before = _before(after, symbol)
            while True:
                options = [(letter, to) for letter, c, to in _choices(symbol, state) if c + after[to] == before[state]]
                due = AFTER[DUE[state]][state]
                if COST["I"] + before[due] == before[state]:
                    options.append(("I", due))
                letter, state = min(options)
                made += letter
                if letter != "I":
                    break
            letters.append(made)
        return letters, state


@cache
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Insertions that complete a conversation."""
    return "I" * (END[state] // COST["I"])


def damage(turns: DataFrame) -> DataFrame:
    """The turns with faults by crc32(`conv_id:turn`) % 20: dropped, emptied, without `[.!?]`, repeated, or said by the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.crc32(key.cast("binary")) % 20
    role, text = _filled("role"), _filled("text")
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.explode(F.array_repeat(F.lit(1), F.when(how == 3, 2).otherwise(1)))
    rows = turns.where(how != 0).select("conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), times.alias("times"))
    return rows.drop("times")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated or empty) and nth, which tells equal turns apart; by conversation."""
    text = F.rtrim("text", F.lit(SPACE))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text")).repartition("conv_id")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    fault = F.when(text == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(text, F.lit(1)).isin(*".!?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault)


def _symbol() -> Column:
    """A turn's symbol, by role and fault."""
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS[:-1])) - 1
    initial = F.when((initial < 0) | (F.col("role") == ""), len(INITIALS) - 1).otherwise(initial)
    return F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * initial + (F.col("fault") == "truncated").cast("int"))


def _backward(batches):
    """Adds to turns that come from last to first the vector at their block's end and their block's number."""
    t = tables()
    key, begun, vector, code, n = None, False, 0, 0, 0
    for batch in batches:
        vectors, blocks = [], []
        for conv, symbol in zip(batch.column("conv_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True):
            if not begun or conv != key:
                key, begun, vector, code, n = conv, True, 0, 0, 0
            vectors.append(vector)
            blocks.append(n // BLOCK)
            code = code * SYMBOLS + symbol
            n += 1
            if n % BLOCK == 0:
                vector, code = int(t.block[vector, code]), 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.int32()), pa.array(blocks, pa.int64())], [*batch.schema.names, "vector", "block"])


class _Forward:
    """Reads the edits off turns that come from first to last."""

    def __init__(self, conv_type: pa.DataType) -> None:
        self.kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        self.out: list[tuple] = []
        self.turns: list[tuple] = []  # of the block that is open
        self.key, self.block, self.state, self.at, self.open = None, 0, 0, 0, False

    def edit(self, letter: str, cost: int, fault, turn, was, role, text) -> None:
        self.out.append((self.key, self.at, letter, fault, turn, was, role, text, cost))
        self.at += 1

    def insert(self, n: int) -> None:
        for _ in range(n):
            due = DUE[self.state]
            self.edit("I", COST["I"], None, None, None, ROLES[due], "")
            self.state = AFTER[due][self.state]

    def close_block(self) -> None:
        if not self.turns:
            return
        state = self.state
        letters, after = tables().expand(self.turns[0][5], tuple(t[4] for t in self.turns), state)
        for made, (turn, role, text, fault, symbol, _) in zip(letters, self.turns, strict=True):
            self.insert(len(made) - 1)
            letter = made[-1]
            extra = BROKEN if symbol and (symbol - 1) % 2 and letter != "D" else 0
            due = DUE[self.state]
            now = {"D": None, "K": role, "R": ROLES[due]}[letter]
            if letter != "D":
                self.state = AFTER[due if letter == "R" else role[0]][self.state]
            self.edit(letter, COST[letter] + extra, fault, turn, role, now, None if letter == "D" else text)
        assert self.state == after
        self.turns.clear()

    def close(self) -> None:
        self.close_block()
        if self.open:
            self.insert(len(closing(self.state)))

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.out, strict=True), self.kinds, strict=True)], EDITED)
        self.out.clear()
        return made

    def run(self, batches):
        for batch in batches:
            names = ("conv_id", "block", "turn", "role", "text", "fault", "symbol", "vector")
            for conv, block, *turn in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if not self.open or conv != self.key:
                    self.close()
                    self.key, self.state, self.at, self.open = conv, 0, 0, True
                elif block != self.block:
                    self.close_block()
                self.block = block
                self.turns.append(tuple(turn))
            if self.out:
                yield self.batch()
        self.close()
        if self.out:
            yield self.batch()


EDITED = ["conv_id", "position", "edit", "fault", "turn", "was", "role", "text", "cost"]


def repair(turns: DataFrame) -> DataFrame:
    """A row an edit, by conv_id and position: K, R, D or I, the turn's fault and number, its role before (`was`) and now, its text and the cost.

    Deleted turns have no role and text now; inserted ones no fault, turn and role before.
    """
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    arrow_id = to_arrow_type(turns.schema["conv_id"].dataType)
    rows = faults(turns)
    up = [F.asc_nulls_first(c) for c in ("turn", "role", "text", "nth")]
    down = [F.desc_nulls_last(c) for c in ("turn", "role", "text", "nth")]
    rows = rows.select("conv_id", "turn", "role", "text", "nth", "fault", _symbol().cast("int").alias("symbol"))
    back = rows.sortWithinPartitions("conv_id", *down).mapInArrow(tidy(_backward), f"conv_id {kind}, turn long, role string, text string, nth int, fault string, symbol int, vector int, block long")

    def forward(batches):
        yield from _Forward(arrow_id).run(batches)

    schema = f"conv_id {kind}, position long, edit string, fault string, turn long, was string, role string, text string, cost long"
    return back.sortWithinPartitions("conv_id", *up).mapInArrow(tidy(forward), schema)


def digest(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each repaired conversation."""
    kind = dict(edits.dtypes)["conv_id"]
    kinds = [to_arrow_type(edits.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    class Sum:
        def __init__(self, conv) -> None:
            self.conv, self.first, self.last, self.turns = conv, None, None, 0
            self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.illegal = self.cost = self.kept = 0
            self.before = None
            self.audit: list[str] = []
            self.whole = hashlib.sha256()

        def add(self, edit, fault, turn, was, role, text, cost) -> None:
            self.audit.append(edit)
            self.cost += cost
            if edit != "I":
                if turn is not None and turn != self.last:
                    self.first = turn if self.first is None else self.first
                    self.last, self.turns = turn, self.turns + 1
                if fault:
                    self.count[fault] += 1
                if self.before is not None and self.before[:1] + was[:1] not in ("su", "ua", "au"):
                    self.illegal += 1
                self.before = was
            if edit != "D":
                self.whole.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
                self.kept += 1

        def row(self) -> tuple:
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.whole.hexdigest())

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, *edit in zip(*[batch.column(c).to_pylist() for c in range(8)], strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row())
                    now = Sum(conv)
                now.add(*edit)
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([now.row()])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "edit", "fault", "turn", "was", "role", "text", "cost")
    return ordered.mapInArrow(tidy(run), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def reports(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """The digest of the repaired `damaged` for every conv_id of `turns`; zeros and the empty audit where no row is left."""
    found = digest(repair(damaged)).withColumnRenamed("conv_id", "_conv")
    ids = turns.select("conv_id").distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    both = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv"]), "left")
    return both.select("conv_id", *[F.coalesce(c, F.lit(none.get(c, 0))).alias(c) for c in found.columns if c != "_conv"])
