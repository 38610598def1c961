"""Repairing the structure of conversations with the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the turns so far form: nothing, a system turn, or something that ends in a user's or an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: BEHIND[y][x]: what a path in state y pays at most to go on as one in state x goes on, whatever comes.
#: From START only the system turn, which is deleted instead, is out of reach of the others.
BEHIND = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
#: A repaired conversation may end in START or ASSISTANT; from the others it takes these turns.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}

WHITE = "\t\n\x0b\x0c\r "
REPORT = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Node:
    """The edits at one row, after those of ``parent``; ``refs`` counts children and survivors here."""

    __slots__ = ("parent", "edits", "state", "refs")

    def __init__(self, parent: Node | None, edits: str, state: int):
        self.parent, self.edits, self.state, self.refs = parent, edits, state, 0


@dataclass(slots=True)
class Survivor:
    """The best way into a state. ``place`` is its place among the survivors in the order of their whole audits."""

    state: int
    cost: int
    place: int
    node: Node
    digest: object


class Repair:
    """Finds a conversation's cheapest edits, row by row (survivor-coalescence Viterbi).

    Each state has one survivor. Their edits form a tree of backpointers; what no
    survivor needs any more leaves it, and once all survivors share an ancestor the
    edits up to it are given out and forgotten. Survivors that can't win any more,
    whatever follows, are put out, so that paths meet soon. Of equally cheap ways
    into a state the one whose whole audit is least in ASCII wins: two audits that
    differ keep their order whatever follows both, since each row adds exactly one
    letter other than I as the last of its letters; so the places of the survivors,
    renewed at every row, hold the outcome of comparing whole unresolved suffixes.
    Each survivor carries the digest of the conversation it would leave, so no text is kept.

    What is held is one letter's node for each unresolved row. Rows of which every
    role has to be changed can stay unresolved to the end, at some 150 bytes each.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", START)
        self.root.refs = 1
        self.survivors = [Survivor(START, 0, 0, self.root, hashlib.sha256())]

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, int]]:
        """Takes the next row and gives out what has become certain: (letters, state) of a row each."""
        best: dict[int, tuple[int, int, str, Survivor]] = {}

        def offer(state: int, cost: int, edits: str, before: Survivor) -> None:
            way = (cost, before.place, edits, before)
            if state not in best or way[:3] < best[state][:3]:
                best[state] = way

        initial, extra = role[:1], TRUNCATED * truncated
        for s in self.survivors:
            offer(s.state, s.cost + DELETE, "D", s)
            if must_go:
                continue
            if initial == "s" and s.state == START:
                offer(SYSTEM, s.cost + extra, "K", s)
            for target, letter in ((USER, "u"), (ASSISTANT, "a")):
                fits = (s.state == USER) == (target == ASSISTANT)  # else the other role goes in between
                cost = s.cost + extra + (0 if fits else INSERT) + (0 if initial == letter else REROLE)
                offer(target, cost, ("" if fits else "I") + ("K" if initial == letter else "R"), s)
        ways = [(state, *way) for state, way in best.items() if not any(other[0] + BEHIND[y][state] < way[0] for y, other in best.items())]
        ways.sort(key=lambda w: (w[2], w[3]))
        told, after = text.encode(), []
        for place, (state, cost, _, edits, before) in enumerate(ways):
            node = Node(before.node, edits, state)
            node.refs = 1
            before.node.refs += 1
            digest = before.digest
            if edits != "D":
                digest = digest.copy()
                lines = b"" if before.state == START else b"\n"
                if edits[0] == "I":
                    lines += NAMES[USER if state == ASSISTANT else ASSISTANT].encode() + b":\n"
                digest.update(lines + (role if edits[-1] == "K" else NAMES[state]).encode() + b":")
                digest.update(told)
            after.append(Survivor(state, cost, place, node, digest))
        for s in self.survivors:
            self._let_go(s.node)
        self.survivors = after
        return self._certain(after[0].node)

    def _let_go(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def _certain(self, tip: Node) -> Iterator[tuple[str, int]]:
        """Moves the root down to where the survivors part, if they all lie under one child of it."""
        if self.root.refs > 1:
            return
        path = []
        while tip is not self.root:
            path.append(tip)
            tip = tip.parent
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            yield self.root.edits, self.root.state

    def finish(self) -> tuple[list[tuple[str, int]], int, str]:
        """(the other rows' letters, those of added turns at the end included; cost; digest)."""
        last = min(self.survivors, key=lambda s: (s.cost + INSERT * len(ENDING[s.state]), s.place))
        rest, node, digest = [], last.node, last.digest.copy()
        while node is not self.root:
            rest.append((node.edits, node.state))
            node = node.parent
        rest.reverse()
        for turn in ENDING[last.state]:
            rest.append(("I", turn))
            digest.update(f"\n{NAMES[turn]}:".encode())
        return rest, last.cost + INSERT * len(ENDING[last.state]), digest.hexdigest()


class Report:
    """Counts a conversation's faults while its rows go by, and repairs it."""

    def __init__(self) -> None:
        self.repair, self.audit = Repair(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.audit.extend(edits for edits, _ in self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        if len(self.audit) > 1000:
            self.audit = ["".join(self.audit)]

    def values(self) -> tuple:
        rest, cost, digest = self.repair.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join([*self.audit, *(edits for edits, _ in rest)]), digest


def in_order(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """Rows of ``rows(conv_id, turn, role, text)`` by conversation and turn, with the column ``fault``.

    Turns that are null come first; rows of the same turn are in order of role and
    text. A row's fault is blank, duplicate, truncated, gone or none. The rows move once,
    by conversation; what they are compared with for duplicates, and their order, are
    sorts within the partitions, which spill.
    """
    lost = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    said = lambda c: F.when(~F.col("lost"), F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise(F.lit("")).alias(c)
    rows = rows.withColumn("__lost", lost).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("__lost").alias("lost"))
    dealt = rows.select("conv_id", "turn", "lost", said("role"), said("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(F.col("lost"), "gone").when(end == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    marked = dealt.withColumn("fault", fault).drop("lost")
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")


def repair(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of each conversation of ``conversations(conv_id, turn, role, text)``.

    Rows are read by turn, nulls first. Each is kept (K), gets another role (R, costs
    3) or is deleted (D, 4); empty turns are inserted (I, 3). Blank rows and repeats
    of a role and text go; a truncated one that stays costs 3. What is left has the
    roles of ``(system? (user assistant)+)?``, as far as initials tell.

    Returns conv_id, gaps (turns missing between the first and the last), blank,
    duplicate, truncated (a row counts under its first fault), illegal (neighbours
    whose roles don't follow each other), cost, audit (the edits' letters; of equally
    cheap ones the least) and repaired_sha256 (of ``role:text``, joined by newlines).

    Null roles and texts are a blank; rows without conv_id are a conversation of their
    own; a role of no letters is none. Repeated rows are duplicates; rows that share a
    turn are in order of role and text. Rows for which ``gone`` is true take no part,
    but their conversation has its row: zeros, an empty audit and the digest of nothing
    if no other is left. An empty table gives no rows. Other columns are passed over.

    A conversation is read in one pass by one task, since a digest can't be split, but
    nothing of it is gathered: see ``Repair`` for what is held.
    """
    key = dict(conversations.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, conv, report, done = [f.split()[0] for f in REPORT.split(", ")], None, None, []
        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for i, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if report is None or i != conv:
                    if report is not None:
                        done.append((conv, *report.values()))
                    conv, report = i, Report()
                if fault != "gone":
                    report.row(turn, role, text, fault)
            if done:
                yield _batch(done, names, kinds)
                done = []
        if report is not None:
            yield _batch([(conv, *report.values())], names, kinds)

    return in_order(conversations, gone).mapInArrow(run, REPORT.format(key=key))


def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repaired_turns(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, position, role, text, turn, edit), edit being K, R or I.

    Positions count from 0; inserted turns have an empty text and no turn. Rows,
    nulls and repeats as in ``repair``. Edits are given out as they become certain and
    meet their rows by (conv_id, place), so no task gathers a conversation.
    """
    key = dict(conversations.dtypes)["conv_id"]
    kinds = f"conv_id {key}, position long, place long, said string, edit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found, position, place, out = None, None, 0, 0, []

        def put(edits: str, state: int) -> None:
            nonlocal position, place
            for n, edit in enumerate(edits):
                own = state if n == len(edits) - 1 else (USER if state == ASSISTANT else ASSISTANT)
                if edit != "D":
                    out.append((conv, position, None if edit == "I" else place, None if edit == "K" else NAMES[own], edit))
                    position += 1
                place += edit != "I"

        def end() -> None:
            for step in found.finish()[0]:
                put(*step)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for i, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault")), strict=True):
                if fault == "gone":
                    continue
                if found is None or i != conv:
                    if found is not None:
                        end()
                    conv, found, position, place = i, Repair(), 0, 0
                for step in found.row(role, text, fault in ("blank", "duplicate"), fault == "truncated"):
                    put(*step)
            if out:
                yield _edits(out, kind)
                out = []
        if found is not None:
            end()
            yield _edits(out, kind)

    ordered = in_order(conversations, gone)
    edits = ordered.mapInArrow(run, kinds)
    numbered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = ordered.filter("fault <> 'gone'").withColumn("at", F.row_number().over(numbered) - 1).select(F.col("conv_id").alias("of"), "at", "turn", "role", "text")
    met = edits.join(rows, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")), "left")
    return met.select("conv_id", "position", F.coalesce("said", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn", "edit")


def _edits(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [key, pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "position", "place", "said", "edit"])


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn``, for measuring a repair.

    Of 20 remainders 0 drops a row (it stays with ``dropped``), 1 empties its text, 2
    takes its full stops and marks away, 3 repeats it, 4 gives it the user's role. Nulls
    in texts, roles and the key are a blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(kind == 0))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("dropped"))
