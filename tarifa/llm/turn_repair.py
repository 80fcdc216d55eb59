"""Repair of the turn structure of conversations by a min-plus matrix scan.

A repaired conversation is empty or an optional system turn and then one or more pairs of user and assistant. Edits are: keep a turn,
give it the role its place needs, delete it, insert an empty turn. Read as an automaton of four states (nothing yet, after the
system turn, after user, after assistant), each turn is a 4x4 matrix over pairs of cost and audit (the initials of the edits): the smaller
pair wins, and one after the other costs add up and audits are joined. Its product with the closure of inserts on both sides is
associative, so a conversation may be cut anywhere.

Turns are dealt by ranges of conversation and turn, so a very long conversation lies in many tasks. Each task gives one
piece for each conversation it has turns of, with the product of its turns, and pieces are joined pairwise until each
conversation has one. Only narrow facts take part in that; texts are joined to the edits at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import checkpointed, written

#: What edits cost; a truncated turn that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: (from, to) of the automaton by the initial of a turn's role.
MOVES = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
LEGAL = frozenset({"su", "ua", "au"})
OK, CUT, GONE = range(3)

Matrix = tuple  # 16 entries, None or (cost, audit)


def product(a: Matrix, b: Matrix) -> Matrix:
    """a, then b. Audits of the same turns and cost are never prefixes of each other, so the smaller one stays smaller whatever follows."""
    out = [None] * 16
    for i in range(4):
        for k in range(4):
            if (x := a[4 * i + k]) is None:
                continue
            for j in range(4):
                if (y := b[4 * k + j]) is not None and ((z := out[4 * i + j]) is None or x[0] + y[0] <= z[0]):
                    now = (x[0] + y[0], x[1] + y[1])
                    if z is None or now < z:
                        out[4 * i + j] = now
    return tuple(out)


def _of(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


@functools.cache
def inserts() -> Matrix:
    """Any number of inserted turns, none included."""
    step = {move: (INSERT, "I") for initial in "ua" for move in MOVES[initial]}
    now = _of(step | {(i, i): (0, "") for i in range(4)})
    return product(product(now, now), product(now, now))


@functools.cache
def turn(initial: str, fault: int) -> Matrix:
    """One turn: kept, given another role or deleted, with inserts before and after."""
    entries = {(i, i): (DELETE, "D") for i in range(4)}
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        for move in [*MOVES["u"], *MOVES["a"]]:
            entries[move] = (REROLE + more, "R")
        for move in MOVES.get(initial, []):
            entries[move] = (more, "K")
    return product(product(inserts(), _of(entries)), inserts())


@functools.lru_cache(maxsize=1 << 14)
def word(turns: tuple[tuple[str, int], ...]) -> Matrix:
    """A few turns."""
    if len(turns) == 1:
        return turn(*turns[0])
    half = len(turns) // 2
    return product(word(turns[:half]), word(turns[half:]))


def deleted(n: int) -> Matrix:
    """n turns that have to go."""
    return product(product(inserts(), _of({(i, i): (DELETE * n, "D" * n) for i in range(4)})), inserts())


class Piece(NamedTuple):
    """Consecutive turns of a conversation: the numbers of turns and faults, what its ends look like, the matrix."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int  # distinct ones
    first_turn: int | None  # least and most, nulls left out
    last_turn: int | None
    first: str | None  # initials
    last: str | None
    matrix: Matrix


EMPTY = Piece(0, 0, 0, 0, 0, 0, None, None, None, None, inserts())


def joined(a: Piece, b: Piece) -> Piece:
    """a, then b, of one conversation; turns ascend, so a shared turn is at the end of a and the start of b."""
    if not a.rows:
        return b
    if not b.rows:
        return a
    both = a.last_turn is not None and a.last_turn == b.first_turn
    return Piece(
        *(x + y for x, y in zip(a[:4], b[:4], strict=True)),
        a.illegal + b.illegal + (a.last + b.first not in LEGAL),
        a.turns + b.turns - both,
        b.first_turn if a.first_turn is None else a.first_turn,
        a.last_turn if b.last_turn is None else b.last_turn,
        a.first,
        b.last,
        product(a.matrix, b.matrix),
    )


class Scan:
    """The turns of one conversation, one after the other, into one piece; products are of equal lengths as far as possible, so audits are copied seldom."""

    def __init__(self, chunk: int = 8):
        self.chunk, self.held, self.stack, self.rows = chunk, [], [], 0

    def add(self, turn: int | None, initial: str, fault: str, copies: int) -> None:
        """A turn with its equal copies, which are duplicates if it is no blank."""
        self.rows += copies
        kind = {"": OK, "truncated": CUT}.get(fault, GONE)
        self.held.append((turn, initial, fault, kind))
        if copies > 1:
            self.flush()
            n, blank = copies - 1, fault == "blank"
            self.push(Piece(n, n * blank, n * (not blank), 0, n - 1, int(turn is not None), turn, turn, initial, initial, deleted(n)))
        elif len(self.held) == self.chunk:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        numbers = [t for t, *_ in self.held if t is not None]
        initials = [i for _, i, *_ in self.held]
        count = lambda f: sum(x[2] == f for x in self.held)
        bad = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        ends = (numbers[0], numbers[-1]) if numbers else (None, None)
        matrix = word(tuple((i if i in MOVES else "", k) for _, i, _, k in self.held))
        self.push(Piece(len(self.held), count("blank"), count("duplicate"), count("truncated"), bad, len(set(numbers)), *ends, initials[0], initials[-1], matrix))
        self.held = []

    def push(self, piece: Piece) -> None:
        self.stack.append(piece)
        while len(self.stack) > 1 and self.stack[-2].rows <= self.stack[-1].rows:
            last = self.stack.pop()
            self.stack[-1] = joined(self.stack[-1], last)

    def piece(self) -> Piece:
        self.flush()
        out = EMPTY
        for p in reversed(self.stack):
            out = joined(p, out)
        return out


PIECE = "struct<rows: long, blank: long, duplicate: long, truncated: long, illegal: long, turns: long, first_turn: long, last_turn: long, first: string, last: string, costs: array<long>, audits: array<string>>"
_LONGS, _TEXTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"], ["first", "last"]
_STRUCT = pa.struct([*[(n, pa.int64()) for n in _LONGS], *[(n, pa.string()) for n in _TEXTS], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _plain(p: Piece) -> dict:
    return {n: getattr(p, n) for n in [*_LONGS, *_TEXTS]} | {"costs": [x and x[0] for x in p.matrix], "audits": [x and x[1] for x in p.matrix]}


def _piece(r: dict) -> Piece:
    return Piece(*[r[n] for n in _LONGS], *[r[n] for n in _TEXTS], tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)))


def prepared(turns: DataFrame) -> DataFrame:
    """The distinct turns of turns (conv_id, turn, role, text and, if there, copies), written once: with their number of copies, a hash of role and
    text, the initial of the role and the fault that the text alone has (blank, truncated or none)."""
    copies = turns["copies"].cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), text("role"), text("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return written(rows.withColumns({"same": same, "initial": F.substring("role", 1, 1), "fault": fault}), "turns")


def facts(distinct: DataFrame) -> DataFrame:
    """What the scan needs of the distinct turns: their place in the order, copies, initial and first fault."""
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    rows = distinct.select("conv_id", place.alias("place"), F.substring("role", 1, 16).alias("r"), F.substring("text", 1, 16).alias("t"), "same", "copies", "initial", "fault")
    seen = rows.filter("copies > 0").groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    both = rows.join(seen, rows["conv_id"].eqNullSafe(seen["c"]) & (rows["same"] == seen["s"]), "left")
    fault = F.when((F.col("fault") != "blank") & (F.col("place") > F.col("first")), "duplicate").otherwise(F.col("fault"))
    return both.select("conv_id", "place.numbered", "place.turn", "r", "t", "same", "copies", "initial", fault.alias("fault"))


def scanned(found: DataFrame) -> DataFrame:
    """One row for each turn (conv_id, part, turn, same, at: its place in its part) and one for each piece (conv_id, part, piece); part is the number of the task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, open_ = None, False

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([_plain(now[1].piece())], _STRUCT)], names)

        names = ["conv_id", "part", "turn", "same", "at", "piece"]
        for batch in batches:
            at, done = [], []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies"))
            for conv, number, initial, fault, copies in zip(*columns, strict=True):
                if not open_ or now[0] != conv:
                    if open_:
                        done.append(piece())
                    now, open_ = (conv, Scan()), True
                at.append(now[1].rows if copies else None)
                if copies:
                    now[1].add(number, initial, fault, copies)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([part] * n, pa.int64()), batch.column("turn"), batch.column("same").cast(pa.binary()), pa.array(at, pa.int64()), pa.nulls(n, _STRUCT)], names)
            yield from done
        if open_:
            yield piece()

    order = ["conv_id", "numbered", "turn", "r", "t", "same"]
    schema = f"conv_id long, part long, turn long, same binary, at long, piece {PIECE}"
    return written(written(found, "facts").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema), "pieces")


def reduced(pieces: DataFrame) -> DataFrame:
    """conv_id and piece: the pieces (conv_id, part, piece) of each conversation joined two by two, until there is one."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["conv_id", "place", "piece"], None

        def row(c: int | None, n: int, p: Piece) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array([_plain(p)], _STRUCT)], names)

        for batch in batches:
            for c, n, p in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                if held and held[:2] == (c, n // 2):
                    yield row(c, n // 2, joined(held[2], _piece(p)))
                    held = None
                    continue
                if held:
                    yield row(*held)
                held = (c, n // 2, _piece(p))
        if held:
            yield row(*held)

    # At most one piece a task and conversation.
    own = Window.partitionBy("conv_id")
    placed = pieces.withColumn("place", F.row_number().over(own.orderBy("part")).cast("long") - 1)
    placed = checkpointed(placed.withColumn("several", F.max("place").over(own) > 0))
    done, now = placed.filter("NOT several").select("conv_id", "piece"), placed.filter("several").select("conv_id", "place", "piece")
    while now.filter("place > 0").limit(1).count():
        now = now.withColumn("pair", F.shiftright("place", 1)).repartition("conv_id", "pair").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "piece")
        now = checkpointed(now.mapInArrow(pairs, f"conv_id long, place long, piece {PIECE}"))
    return done.union(now.select("conv_id", "piece"))


def verdicts(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of the conversations with one piece each."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, r in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                p = _piece(r)
                gaps = p.last_turn - p.first_turn + 1 - p.turns if p.turns else 0
                best = min(x for x in (p.matrix[4 * START + START], p.matrix[4 * START + ASSISTANT]) if x)
                rows.append((c, gaps if gaps < 1 << 63 else None, p.blank, p.duplicate, p.truncated, p.illegal, *best))
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return pieces.mapInArrow(judge, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _outcomes(judged: DataFrame) -> DataFrame:
    """conv_id, position, edit, row (null for an inserted turn) and role (null for a kept turn) of every turn of the repaired conversations."""
    names = ["conv_id", "position", "edit", "row", "new_role"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist(), strict=True):
                # A user stands at even places, counted without a system turn: an even number of turns stays in all but for that.
                shift, row, position = (len(audit) - audit.count("D")) % 2, 0, 0
                for edit in audit:
                    if edit != "D":
                        role = None if edit == "K" else ("user", "assistant")[(position - shift) % 2]
                        out.append((conv, position, edit, None if edit == "I" else row, role))
                        position += 1
                    row += edit != "I"
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return judged.select("conv_id", "audit").mapInArrow(read, "conv_id long, position long, edit string, row long, new_role string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdict of each conversation of turns (conv_id, turn, role, text), and the turns of the repaired ones.

    Verdicts: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (turns by first
    fault), illegal (adjacent turns whose role initials aren't su, ua or au), cost and audit of the cheapest repair (of several, the audit first in ASCII).
    Repaired turns: conv_id, position, edit, role, text.

    Turns are taken by number, null first; turns of one number by the first 16 characters of role and of text, then by a hash of both. Null roles and
    texts count as one space. Equal rows are turns each (the second is a duplicate), and rows with a null conv_id are one conversation. Where there is
    a column copies, a row stands for so many equal turns; a conversation that has only rows of zero copies is one without turns, with cost zero
    and an empty audit. An empty table gives empty results; other columns are ignored.
    """
    distinct = prepared(turns)
    scan = scanned(facts(distinct))
    pieces = scan.filter("piece IS NOT NULL")
    judged = written(verdicts(reduced(pieces.select("conv_id", "part", "piece"))), "verdicts")

    own = Window.partitionBy("conv_id").orderBy("part")
    before = pieces.select("conv_id", "part", F.col("piece.rows").alias("n")).withColumn("offset", F.sum("n").over(own) - F.col("n")).filter("offset > 0")
    before = before.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "offset")
    rows = scan.filter("at IS NOT NULL")
    rows = rows.join(before, rows["conv_id"].eqNullSafe(before["c"]) & (rows["part"] == before["p"]), "left")
    rows = rows.select(F.col("conv_id").alias("rc"), F.col("turn").alias("rt"), F.col("same").alias("rs"), (F.col("at") + F.coalesce("offset", F.lit(0))).alias("row_no"))
    edits = _outcomes(judged)
    placed = edits.join(rows, edits["conv_id"].eqNullSafe(rows["rc"]) & (edits["row"] == rows["row_no"]), "left")
    texts = distinct.select(F.col("conv_id").alias("tc"), F.col("turn").alias("tt"), F.col("same").alias("ts"), "role", "text")
    found = placed.join(texts, placed["rc"].eqNullSafe(texts["tc"]) & placed["rt"].eqNullSafe(texts["tt"]) & (placed["rs"] == texts["ts"]), "left")
    return judged, found.select("conv_id", "position", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
