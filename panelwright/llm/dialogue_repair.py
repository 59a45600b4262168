"""Repair of conversations by the cheapest edits, with square-root checkpoints.

Roles must read (s?(ua)+)? by their initials. A small automaton follows them; for every row and state there is a least cost of all that is still to
come. Such vectors are stored only at checkpoints, every sqrt(n) rows; walking forward, the vectors between two checkpoints are computed again
from the later one, and of the edits that lie on a cheapest way the ASCII-least is emitted. The walk holds about 2 sqrt(n) vectors.

Rows are sorted by ranges of (conversation, turn, role, head of the text), so a conversation that holds a third of all rows spreads over many tasks. One
that a task has whole is finished there. Of others, each block of bounded size gives its costs from state to state; a scan over these small
matrices from the end gives every block the vector behind it (a checkpoint of the whole conversation), a scan from the start the state before it, and the
blocks are walked in parallel. Only the audits and repaired texts of such a conversation meet in one task, as a stream: a hash of all its text needs them
in order. Copies of a whole row are counted before they move.

Defined cases: null roles and texts are one space, null turns come first and count for no gap, a null conversation is one of its own; rows of equal turn
are ordered by role, then text; roles of other initials can't be kept; conversations left without rows have zeros, an empty audit and the hash of nothing;
texts of any length are taken whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import fresh, stage

BLOCK_ROWS = 4_096
BLOCK_CHARS = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
HEAD = 32  # characters of the text that may part rows of equal turn and role into ranges

# The costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = 1 << 60
# States: nothing yet, after the system's row, after a user's, after an assistant's. The next row must be of the role that NEXT leads to.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_KEEP = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}


# --- one sequence of rows ----------------------------------------------------------------------------

def closed(v: list[int]) -> list[int]:
    """Costs when rows may be inserted first."""
    one = [INSERT + v[n] for n in _NEXT]
    return [min(a, b, INSERT + one[n]) for a, b, n in zip(v, one, _NEXT)]


END = closed([0, _FAR, _FAR, 0])


def before(row: tuple[str, bool], after: list[int]) -> list[int]:
    """Costs from each state ahead of a row (initial, truncated) that may stay, given those behind it."""
    initial, cut = row
    extra = TRUNCATED if cut else 0
    out = []
    for s in range(4):
        kept = _KEEP[s].get(initial)
        stays = REROLE + after[_NEXT[s]] if kept is None else min(after[kept], REROLE + after[_NEXT[s]])
        out.append(min(DELETE + after[s], extra + stays))
    return closed(out)


def through(rows: list[tuple[str, bool]], after: list[int]) -> list[int]:
    for row in reversed(rows):
        after = before(row, after)
    return after


def walk(rows: list[tuple[str, bool]], after: list[int], state: int) -> Iterator[tuple[int, str, int]]:
    """(row, letter, state behind it) along the ASCII-least of the cheapest ways; an insertion ahead of a row has that row's number."""
    step = max(1, math.isqrt(len(rows)))
    starts = list(range(0, len(rows), step))
    checkpoints = [after]  # behind each stretch, the last first
    for at in reversed(starts[1:]):
        checkpoints.append(through(rows[at:at + step], checkpoints[-1]))
    for at in starts:
        vectors = [checkpoints.pop()]
        for row in reversed(rows[at:at + step]):
            vectors.append(before(row, vectors[-1]))
        for i in range(at, min(at + step, len(rows))):
            here, behind, (initial, cut) = vectors.pop(), vectors[-1], rows[i]
            extra = TRUNCATED if cut else 0
            while True:
                if here[state] == DELETE + behind[state]:
                    yield i, "D", state
                    break
                if here[state] == INSERT + here[_NEXT[state]]:
                    state = _NEXT[state]
                    yield i, "I", state
                    continue
                kept = _KEEP[state].get(initial)
                if kept is not None and here[state] == extra + behind[kept]:
                    state = kept
                    yield i, "K", state
                else:
                    state = _NEXT[state]
                    yield i, "R", state
                break


def ending(state: int) -> Iterator[int]:
    """The states that insertions at the end pass."""
    while END[state]:
        state = _NEXT[state]
        yield state


# --- blocks ------------------------------------------------------------------------------------------

class Block:
    """Consecutive rows of a conversation: what the counts need, and the rows. Rows that must go have the initial None."""

    def __init__(self) -> None:
        self.initials: list[str | None] = []
        self.cut: list[bool] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list[int | None] = []  # first and last
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.ends: list[str] = []  # role initials of the first and the last row

    def __len__(self) -> int:
        return len(self.initials)

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        must = blank or again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not must
        initial = role[:1]
        if self.ends:
            self.illegal += self.ends[1] + initial not in _LEGAL
            self.ends[1] = initial
        else:
            self.ends = [initial, initial]
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.turns = [self.turns[0] if self.turns else turn, turn]
        self.initials.append(None if must else initial)
        self.cut.append(cut)
        self.roles.append("" if must else role)
        self.texts.append("" if must else text)
        self.chars += 0 if must else len(text)

    def free(self) -> list[tuple[str, bool]]:
        """The rows that may stay."""
        return [(i, c) for i, c in zip(self.initials, self.cut) if i is not None]


def steps(rows: list[tuple[str, bool]]) -> list[int]:
    """Costs from state to state, row by row."""
    columns = [through(rows, [0 if s == t else _FAR for s in range(4)]) for t in range(4)]
    return [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]


def repaired(initials: list[str | None], cut: list[bool], roles: list[str], texts: list[str], after: list[int], state: int) -> tuple[str, list[str], int]:
    """Audit, repaired rows and the state behind, of a block."""
    places = [i for i, x in enumerate(initials) if x is not None]
    audit, out, at = [], [], 0
    for n, letter, state in walk([(initials[i], cut[i]) for i in places], after, state):
        i = places[n]
        audit.append("D" * (i - at))  # deletions that must be are the least letter of a cheapest way wherever they stand
        at = i
        audit.append(letter)
        if letter == "I":
            out.append(f"{_ROLE[state]}:")
            continue
        at += 1
        if letter != "D":
            out.append(f"{roles[i] if letter == 'K' else _ROLE[state]}:{texts[i]}")
    audit.append("D" * (len(initials) - at))
    return "".join(audit), out, state


def wrapped(value: int) -> int:
    """As a 64-bit sum would have it."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_SUMMARY = f"{_COUNTS}, distinct_turns long, low long, high long, first_turn long, last_turn long, first_role string, last_role string, rows long"
_RESULT = f"gaps long, {_COUNTS}, cost long, audit string, repaired_sha256 string"
_BLOCK = (f"part int, seq long, whole boolean, gaps long, cost long, audit string, repaired_sha256 string, {_SUMMARY}, costs array<long>, "
          "initials array<string>, cut array<boolean>, roles array<string>, texts array<string>")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}


def _table(rows: list[dict], schema: str, conversation: pa.DataType) -> pa.RecordBatch:
    fields = [("conv", conversation), *[(n, _ARROW[k]) for n, k in (f.split(" ") for f in schema.split(", "))]]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in fields], [n for n, _ in fields])


def _blocks(block_rows: int, block_chars: int):
    """Conversations that end within the task, finished; blocks of its first and last one and of those longer than a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        held = 0
        key, block, first, split = (), Block(), True, False

        def summary(b: Block) -> dict:
            return {"conv": key, "part": part, "seq": seq, "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated, "illegal": b.illegal,
                    "distinct_turns": b.distinct, "low": b.low, "high": b.high, "first_turn": b.turns[0] if b.turns else None,
                    "last_turn": b.turns[1] if b.turns else None, "first_role": b.ends[0] if b.ends else None, "last_role": b.ends[1] if b.ends else None,
                    "rows": len(b)}

        def close(last: bool, more: bool) -> None:
            """Hands on the block. last: the task has no more rows; more: the conversation goes on."""
            nonlocal block, seq, split, held
            row = summary(block)
            if not (first or last or split or more):
                rows = block.free()
                audit, lines, state = repaired(block.initials, block.cut, block.roles, block.texts, END, _START)
                for s in ending(state):
                    audit, lines = audit + "I", [*lines, f"{_ROLE[s]}:"]
                gaps = 0 if block.high is None else wrapped(block.high - block.low + 1 - block.distinct)
                row |= {"whole": True, "gaps": gaps, "audit": audit, "cost": through(rows, END)[_START] + DELETE * (len(block) - len(rows)),
                        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
            else:
                row |= {"whole": False, "costs": steps(block.free()), "initials": block.initials, "cut": block.cut, "roles": block.roles, "texts": block.texts}
                held += block.chars
            out.append(row)
            seq += 1
            block, split = Block(), more

        started = False
        for batch in batches:
            kind = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "blank", "cut", "again")]
            for conv, turn, role, text, copies, blank, cut, again in zip(*columns):
                if not started or conv != key:
                    if started:
                        close(False, False)
                        first = False
                    key, started = conv, True
                if role is None:  # all its rows may be gone
                    continue
                for n in range(copies):
                    if len(block) >= block_rows or block.chars >= block_chars:
                        close(False, True)
                    block.add(turn, role, text, blank, cut, again or n > 0)
                if len(out) >= 4_096 or held >= block_chars:
                    yield _table(out, _BLOCK, kind)
                    out, held = [], 0
        if started:
            close(True, False)
        if out:
            yield _table(out, _BLOCK, kind)

    return run


# --- scans over the blocks of a long conversation ------------------------------------------------------

def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind every block; the blocks of a conversation come last to first."""
    key, after = object(), END
    for batch in batches:
        rows = []
        for conv, part, seq, costs in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "seq", "costs"))):
            if conv != key:
                key, after = conv, END
            rows.append({"conv": conv, "part": part, "seq": seq, "after": after})
            after = closed([min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4)])
        yield _table(rows, "part int, seq long, after array<long>", batch.schema.field("conv").type)


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind every block for each state before it."""
    for batch in batches:
        rows = []
        for conv, part, seq, after, initials, cut in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "seq", "after", "initials", "cut"))):
            free = [(i, c) for i, c in zip(initials, cut) if i is not None]
            leads = []
            for state in range(4):
                for _, _, state in walk(free, after, state):
                    pass
                leads.append(state)
            rows.append({"conv": conv, "part": part, "seq": seq, "leads": leads})
        yield _table(rows, "part int, seq long, leads array<int>", batch.schema.field("conv").type)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before every block; the blocks of a conversation come first to last."""
    key, state = object(), _START
    for batch in batches:
        rows = []
        for conv, part, seq, leads in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "seq", "leads"))):
            if conv != key:
                key, state = conv, _START
            rows.append({"conv": conv, "part": part, "seq": seq, "state": state})
            state = leads[state]
        yield _table(rows, "part int, seq long, state int", batch.schema.field("conv").type)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, repaired text and cost of every block."""
    for batch in batches:
        names = ("conv", "part", "seq", "after", "state", "initials", "cut", "roles", "texts", "costs")
        rows = []
        for conv, part, seq, after, state, initials, cut, roles, texts, costs in zip(*(batch.column(c).to_pylist() for c in names)):
            audit, lines, leaves = repaired(initials, cut, roles, texts, after, state)
            ahead = closed([min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4)])[state]
            rows.append({"conv": conv, "part": part, "seq": seq, "audit": audit, "lines": "\n".join(lines) if lines else None, "leaves": leaves, "ahead": ahead,
                         "must": DELETE * initials.count(None)})
        yield _table(rows, "part int, seq long, audit string, lines string, leaves int, ahead long, must long", batch.schema.field("conv").type)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations whose blocks arrive first to last."""
    total: dict | None = None

    def finish(t: dict) -> dict:
        for s in ending(t["leaves"]):
            t["audit"].append("I")
            t["hash"].update(("\n" if t["lines"] else "").encode() + f"{_ROLE[s]}:".encode())
            t["lines"] = True
        gaps = 0 if t["high"] is None else wrapped(t["high"] - t["low"] + 1 - t["distinct_turns"])
        return {n: t[n] for n in ("conv", "blank", "duplicate", "truncated", "illegal")} | {
            "gaps": gaps, "cost": t["cost"], "audit": "".join(t["audit"]), "repaired_sha256": t["hash"].hexdigest()}

    for batch in batches:
        kind, rows = batch.schema.field("conv").type, []
        for r in batch.to_pylist():
            if total is None or r["conv"] != total["conv"]:
                if total is not None:
                    rows.append(finish(total))
                total = {"conv": r["conv"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct_turns": 0, "low": None, "high": None, "last_role": None,
                         "rows": 0, "cost": r["ahead"], "audit": [], "hash": hashlib.sha256(), "lines": False, "leaves": _START}
            t = total
            for n in ("blank", "duplicate", "truncated", "illegal", "distinct_turns"):
                t[n] += r[n]
            if r["rows"]:
                t["illegal"] += t["rows"] > 0 and t["last_role"] + r["first_role"] not in _LEGAL
                t["last_role"], t["rows"] = r["last_role"], t["rows"] + r["rows"]
            if r["low"] is not None:
                t["distinct_turns"] -= t["high"] is not None and t["high"] == r["low"]
                t["low"], t["high"] = (r["low"] if t["low"] is None else t["low"]), r["high"]
            t["cost"] += r["must"]
            t["audit"].append(r["audit"])
            if r["lines"] is not None:
                t["hash"].update(("\n" if t["lines"] else "").encode() + r["lines"].encode())
                t["lines"] = True
            t["leaves"] = r["leaves"]
        if rows:
            yield _table(rows, _RESULT, kind)
    if total is not None:
        yield _table([finish(total)], _RESULT, kind)


# --- tables ------------------------------------------------------------------------------------------

def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of the rows that are left, damaged by a checksum of conversation and turn; of a dropped row only conv_id."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in (conversation, turn)])
    found = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                        F.coalesce(F.col(text), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    hurt = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    gone = F.col("fault") == 0
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return found.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
                        F.when(~gone, hurt).alias("text"), copies).drop("col")


def _items(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with their copies, and whether they are blank, truncated, or said before at an earlier turn."""
    rows = rows.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
                       F.when(F.col(role).isNotNull(), F.coalesce(F.col(text), F.lit(" "))).alias("text"))
    said = F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"))
    items = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (rows.filter("role is not null").select(F.col("conv").alias("conv_"), said.alias("said_"), order.alias("order")).groupBy("conv_", "said_")
              .agg(F.min("order").alias("first"), F.max("order").alias("last")).filter("first != last").drop("last"))
    firsts = stage(firsts, "dialogue-repeats")
    joined = items.withColumn("said", said).join(firsts, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("said") == F.col("said_")), "left")
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    return joined.select("conv", "turn", "role", "text", "copies", (left == "").alias("blank"), ((left != "") & ~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"),
                         (F.col("first").isNotNull() & (order != F.col("first"))).alias("again"))


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows without a role stand for their conversation only."""
    items = _items(rows, conversation, turn, role, text)
    (head,) = fresh(items, "head")
    keys: list[Column | str] = ["conv", "turn", "role"]
    sorted_rows = (items.withColumn(head, F.substring("text", 1, HEAD)).repartitionByRange(*keys, head).drop(head).sortWithinPartitions(*keys, "text"))
    kind = items.schema["conv"].dataType.simpleString()
    blocks = stage(sorted_rows.mapInArrow(_blocks(block_rows, block_chars), f"conv {kind}, {_BLOCK}"), "dialogue-blocks")
    names = ["conv", *[f.split(" ")[0] for f in _RESULT.split(", ")]]
    whole, rest = blocks.filter("whole"), blocks.filter("not whole")

    def scanned(df: DataFrame, run, schema: str, back: bool, name: str) -> DataFrame:
        order = [F.col(c).desc() if back else F.col(c).asc() for c in ("part", "seq")]
        return stage(df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, f"conv {kind}, part int, seq long, {schema}"), name)

    def at(df: DataFrame, more: DataFrame) -> DataFrame:
        return df.join(more.drop("conv"), ["part", "seq"])

    after = scanned(rest.select("conv", "part", "seq", "costs"), _behind, "after array<long>", True, "dialogue-behind")
    leads = at(rest.select("conv", "part", "seq", "initials", "cut"), after).select("conv", "part", "seq", "after", "initials", "cut")
    leads = leads.mapInArrow(_passes, f"conv {kind}, part int, seq long, leads array<int>")
    entries = scanned(leads, _entries, "state int", False, "dialogue-states")
    ready = at(at(rest, after), entries).select("conv", "part", "seq", "after", "state", "initials", "cut", "roles", "texts", "costs")
    walked = ready.mapInArrow(_walked, f"conv {kind}, part int, seq long, audit string, lines string, leaves int, ahead long, must long")
    walked = at(walked, rest.select("part", "seq", *[f.split(" ")[0] for f in _SUMMARY.split(", ")]))
    joined = walked.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_joined, f"conv {kind}, {_RESULT}")
    return whole.select(*names).unionByName(joined.select(*names)).withColumnRenamed("conv", conversation)
