"""Conversation repair: a generalised LR parser over the grammar of roles, with weighted edits.

A sound conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn:

    Z -> (nothing) | H T      H -> (nothing) | s      T -> P | T P      P -> u a

The parser reads the rows' role initials.  For each row it may keep it, give it another role or delete it, and before each row
and at the end it may insert empty turns; all ways go on at once on a graph-structured stack.  Stacks that share a top
state accept the same continuations in this grammar, so equal tops merge to the one of least (cost, audit), and no more than
four stay.  The audit is the string of the edits' initials (Keep, Rerole, Delete, Insert); two different audits over the
same rows are never prefixes of each other unless inserts come last, so their order is known from the order of the audits
that they continue, and no audit is read again.

``faults`` finds blank, repeated and truncated rows.  ``plans`` parses rows without their texts, streaming through sorted
partitions: a conversation costs memory for its audits only, however many rows it has.  ``apply_plans`` streams the rows
with their texts behind each plan and emits the repaired turns.

Defined results
    * null role or text: one space, so a null text is blank and a null role can't be kept.  Null turns come first.
    * null conversation id: one conversation of its own.
    * roles go by their first character; rows with another one than s, u, a are reroled or deleted.
    * rows with equal turns: by role, then by a digest of the text.  Repeated rows: the first stays, the others are duplicates.
    * empty input: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, cut_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What the best way costs more, at most, if it is to end like any other way: a row deleted and an insert.
GAP = 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Left side and length of each rule.
RULES = {"none": ("Z", 0), "whole": ("Z", 2), "no_system": ("H", 0), "system": ("H", 1), "first_pair": ("T", 1), "next_pair": ("T", 2), "pair": ("P", 2)}
#: By state and next symbol ($ is the end): a state to go to, or a rule to reduce by.
ACTION: dict[tuple[int, str], int | str] = {
    (0, "s"): 1, (0, "u"): "no_system", (0, "$"): "none",
    (1, "u"): "system",
    (2, "u"): 4,
    (3, "u"): 4, (3, "$"): "whole",
    (4, "a"): 5,
    (5, "u"): "pair", (5, "$"): "pair",
    (6, "u"): "first_pair", (6, "$"): "first_pair",
    (7, "u"): "next_pair", (7, "$"): "next_pair",
}
GOTO = {(0, "H"): 2, (2, "T"): 3, (2, "P"): 6, (3, "P"): 7}

#: A node of the stack: its state and the node below.
Node = tuple
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@functools.lru_cache(maxsize=4096)
def step(top: Node, symbol: str) -> Node | None:
    """The stack after a symbol, reductions first; None if the grammar has no such way.  At the end: a stack, if all is accepted."""
    while (action := ACTION.get((top[0], symbol))) is not None:
        if isinstance(action, int):
            return (action, top)
        head, length = RULES[action]
        for _ in range(length):
            top = top[1]
        if head == "Z":
            return top
        top = (GOTO[top[0], head], top)
    return None


@functools.lru_cache(maxsize=4096)
def ways(top: Node, initial: str, removed: bool, end: bool) -> list[tuple[str, int, Node]]:
    """Edits (inserts and then one for the row, or the end), their cost without faults, and the new stack.

    More than two inserts in a row never help: they lead back to a top that fewer of them reach.
    """
    out, open_ways = [], [("", 0, top)]
    for _ in range(3):
        further = []
        for audit, cost, node in open_ways:
            if end:
                if step(node, "$") is not None:
                    out.append((audit, cost, node))
            else:
                out.append((audit + "D", cost + DELETE, node))
                if not removed:
                    out += [(audit + "K", cost + KEEP, to) for to in [step(node, initial) if initial in ROLES else None] if to]
                    out += [(audit + "R", cost + REROLE, to) for role in "ua" if role != initial and (to := step(node, role))]
            further += [(audit + "I", cost + INSERT, to) for role in "ua" if (to := step(node, role))]
        open_ways = further
    return out


@dataclass
class Way:
    """One top of the stack with its cheapest edits: ``rank`` orders the audits of all tops, ``parts`` and ``tail`` are the audit."""

    cost: int
    node: Node
    rank: int = 0
    parts: tuple | None = None
    tail: str = ""

    def then(self, audit: str, cost: int, node: Node) -> Way:
        tail, parts = self.tail + audit, self.parts
        if len(tail) > 1024:
            tail, parts = "", (parts, tail)
        return Way(self.cost + cost, node, 0, parts, tail)

    def audit(self) -> str:
        pieces, parts = [self.tail], self.parts
        while parts:
            parts, piece = parts
            pieces.append(piece)
        return "".join(reversed(pieces))


@dataclass
class Parser:
    """The ways that are open after the rows read so far."""

    tops: list[Way] = field(default_factory=lambda: [Way(0, (0, None))])

    def read(self, initial: str, removed: bool, truncated: bool, end: bool = False) -> None:
        least: dict[int, tuple] = {}
        for way in self.tops:
            for audit, cost, node in ways(way.node, initial, removed, end):
                cost += TRUNCATED if truncated and audit[-1:] in ("K", "R") else 0
                found = (way.cost + cost, way.rank, audit, cost, node, way)
                state = -1 if end else node[0]
                if state not in least or found[:3] < least[state][:3]:
                    least[state] = found
        best = min(found[0] for found in least.values())
        kept = sorted((found for found in least.values() if found[0] <= best + GAP), key=lambda found: found[1:3])
        self.tops = [way.then(audit, cost, node) for _, _, audit, cost, node, way in kept]
        for rank, way in enumerate(self.tops):
            way.rank = rank

    def end(self) -> Way:
        self.read("", False, False, end=True)
        return self.tops[0]


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of rows given as (role initial, blank or duplicate, truncated)."""
    parser = Parser()
    for row in rows:
        parser.read(*row)
    best = parser.end()
    return best.cost, best.audit()


def _clean(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    # the length tells where the role ends
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.md5(key)))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "digest")


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, blank, truncated, first_turn, repeats``: rows without texts.

    ``repeats`` is true where role and text occur twice or more in the conversation, first in ``first_turn``.
    """
    text = F.rtrim("text", F.lit(SEPARATORS))
    rows = _clean(turns).select("conv_id", "turn", "role", "digest", (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    again = rows.where(~F.col("blank")).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("turn"))["turn"].alias("first_turn")).where("n > 1")
    return rows.join(again.drop("n").withColumn("repeats", F.lit(True)), "digest", "left").select("conv_id", "turn", "role", "digest", "blank", "truncated", "first_turn", F.coalesce("repeats", F.lit(False)).alias("repeats"))


def plans(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its faults (each row counts for its first one), least cost and audit."""
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PLAN.split(", ")]
        out: list[tuple] = []
        state: dict | None = None

        def close() -> None:
            best = state["parser"].end()
            low, high = state["low"], state["high"]
            gaps = 0 if low is None else high - low + 1 - state["distinct"]
            out.append((state["conv"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], best.cost, best.audit()))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.record_batch([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

        for b in batches:
            for conv, turn, role, digest, blank, truncated, first, repeats in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        close()
                    state = {"conv": conv, "parser": Parser(), "low": None, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "initial": None}
                duplicate = not blank and repeats and (turn != first or (turn, digest) == state["last"])
                cut = truncated and not blank and not duplicate
                state["blank"] += blank
                state["duplicate"] += duplicate
                state["truncated"] += cut
                if turn is not None:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["distinct"] += turn != state["high"]
                    state["high"] = turn
                initial = role[:1]
                if state["initial"] is not None:
                    state["illegal"] += state["initial"] + initial not in legal
                state["last"], state["initial"] = (turn, digest), initial
                state["parser"].read(initial, bool(blank or duplicate), bool(cut))
            if out:
                yield flushed()
        if state is not None:
            close()
        yield flushed()

    columns = ["conv_id", "turn", "role", "digest", "blank", "truncated", "first_turn", "repeats"]
    return _in_order(faults(turns)).select(*columns).mapInArrow(run, PLAN)


def apply_plans(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, nth, edit, role, text``: the repaired turns, each conversation's together and in order within a partition."""
    rows = _clean(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    names = ["conv_id", "nth", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, nth, expected = "", 0, 0, "u"
        out: list[tuple] = []

        def emit(conv: int | None, edit: str, role: str, text: str) -> None:
            nonlocal nth, expected
            out.append((conv, nth, edit, role, text))
            nth, expected = nth + 1, "a" if role[:1] == "u" else "u"

        def inserts(conv: int | None) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(conv, "I", ROLES[expected], "")
                at += 1

        conv = None
        for b in batches:
            for conv_now, kind, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    inserts(conv)
                    conv, audit, at, nth, expected = conv_now, text, 0, 0, "u"
                    continue
                inserts(conv)
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(conv, edit, role if edit == "K" else ROLES[expected], text)
            if out:
                columns = list(zip(*out, strict=True))
                out.clear()
                yield pa.record_batch([pa.array(c, pa.int64() if n in ("conv_id", "nth") else pa.string()) for c, n in zip(columns, names, strict=True)], names=names)
        inserts(conv)
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, pa.int64() if n in ("conv_id", "nth") else pa.string()) for c, n in zip(columns, names, strict=True)], names=names)

    dealt = _in_order(rows.unionByName(heads), "kind")
    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(run, "conv_id long, nth long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of turns as ``apply_plans`` gives them: ``role:text`` of all turns, joined by newlines."""
    names = ["conv_id", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            out = []
            for conv_now, nth, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if nth == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = conv_now, hashlib.sha256()
                digest.update(f"{chr(10) if nth else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=names)
        if digest is not None:
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=names)

    return repaired.select("conv_id", "nth", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of their place: dropped, emptied, cut, repeated or given to the user."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("kind")).where("kind != 0")
    cut: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("nth"))
    return rows.drop("nth")


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns for each id of ``ids`` (``conv_id``); ids without turns get zeros."""
    planned = cut_table(plans(turns))
    made = digests(apply_plans(turns, planned)).withColumnRenamed("conv_id", "made_id")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    known = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = known.join(planned, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(made, F.col("id").eqNullSafe(F.col("made_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
