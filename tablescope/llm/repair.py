"""Conversation structure repair: faults, and the cheapest edits that mend them.

Every row gets a code from its role initial and its fault; costs, ranks and the
path of edits come from `ranking`.  Rows are dealt by ranges of (conversation,
turn), so a conversation of any length is cut into parts.  Parts that hold a
whole conversation are solved where they are.  The others exchange their costs
from state to state, then their ranks and end states, through one small row
per part, and are solved with what these leave at their ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablescope.functions.session import stored
from tablescope.llm.ranking import CHAT, Grammar, Ranked, costs_to_end, crossing
from tablescope.llm.words import sliced

WHITE = " \t\n\x0b\x0c\r"
#: Rows and characters after which a part is closed.
PART_ROWS = 8192
PART_CHARS = 4 << 20
#: Rows whose paths are found at once.
SOLVED_ROWS = 16_384
#: Characters of a text that order rows of one turn and role; beyond, its SHA-256 does.
HEAD = 64
_COUNTS = "n_rows long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_PART = f"conv_id long, part long, open boolean, codes binary, roles array<string>, texts array<string>, {_COUNTS}"
REPAIRED = f"conv_id long, part long, open boolean, edits string, cost long, roles array<string>, texts array<string>, {_COUNTS}"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after reproducible damage.

    The CRC-32 of `conv_id:turn` modulo 20 decides: 0 drops a row, 1 empties its
    text, 2 takes the `.!?` out of it, 3 repeats the row, 4 makes it a user's.
    Nulls are one space, in that key too.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("kind != 0").withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def _fault(text: Column, later: Column) -> Column:
    """0 none, 1 truncated, 2 blank, 3 duplicate."""
    visible = F.rtrim(text, F.lit(WHITE))
    return (
        F.when(visible == "", 2).when(later, 3).when(F.right(visible, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    )


def faulty(chats: DataFrame) -> DataFrame:
    """Rows with the first fault of each: conv_id, turn, role, text, fault, and what orders them.

    A row is a duplicate if an earlier row of its conversation has its role and
    text; earlier is by turn (nulls first), and of equal rows one comes first.
    Only pairs that occur more than once are joined back, so no conversation
    meets in one task.
    """
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = stored(rows.select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("id")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull(), "turn", "id")
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("place.id").alias("first"))
    joined = rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["c"]) & (rows["digest"] == firsts["d"]), "left")
    later = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "text", _fault(F.col("text"), later).alias("fault"), F.substring("text", 1, HEAD).alias("head"), "digest", "id")


class _Part:
    """Rows of one part while they are gathered."""

    def __init__(self, conv, number: int) -> None:
        self.conv, self.number, self.chars = conv, number, 0
        self.codes, self.roles, self.texts, self.turns, self.faults = bytearray(), [], [], [], []

    def row(self, whole: bool, grammar: Grammar) -> tuple:
        known = [t for t in self.turns if t is not None]
        starts = [r[:1] for r in self.roles]
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        illegal = sum(pair not in legal for pair in zip(starts, starts[1:], strict=False))
        counts = [self.faults.count(f) for f in (2, 3, 1)]
        ends = (min(known), max(known)) if known else (None, None)
        return (self.conv, self.number, not whole, bytes(self.codes), self.roles, self.texts, len(self.roles), *ends, len(set(known)), *counts, illegal, starts[0], starts[-1])


def _gathered(batches: Iterable[pa.RecordBatch], grammar: Grammar, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parts of a task's rows; those that may go on in another part are open."""
    number = TaskContext.get().partitionId() << 32
    current, begun, held, size = None, False, [], 0  # begun: another part of this conversation was closed, or the task starts with it
    codes: dict[tuple[str, int], int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)

    for batch in sliced(batches, "text"):
        for conv, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            full = current is not None and (len(current.roles) >= PART_ROWS or current.chars >= PART_CHARS)
            if current is None or conv != current.conv or full:
                if current is not None:
                    number += 1
                    held.append(current.row(not begun and conv != current.conv, grammar))
                    size += current.chars + len(current.roles)
                    begun = conv == current.conv
                else:
                    begun = True
                current = _Part(conv, number)
            key = (role[:1], min(fault, 2))
            if key not in codes:
                codes[key] = grammar.code(*key)
            current.codes.append(codes[key])
            current.roles.append(role)
            current.texts.append(text)
            current.turns.append(turn)
            current.faults.append(fault)
            current.chars += len(text)
            if size >= PART_CHARS:
                yield out()
                held, size = [], 0
    if current is not None:
        held.append(current.row(False, grammar))
        yield out()


def _groups(batches: Iterable[pa.RecordBatch], rows: int = SOLVED_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of parts with about so many rows of conversations."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(np.diff(np.cumsum(batch.column("n_rows").to_numpy()) // rows)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)


def _codes(batch: pa.RecordBatch, closed: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts in a row and where they begin; parts that end a conversation get the closing code."""
    parts = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
    parts = [np.append(p, np.uint8(grammar.end)) if last else p for p, last in zip(parts, closed.tolist(), strict=True)]
    return np.concatenate(parts).astype(np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _repaired(batches: Iterable[pa.RecordBatch], grammar: Grammar, schema: pa.Schema, alone: bool) -> Iterator[pa.RecordBatch]:
    """Parts after the edits of the least cheapest path."""
    kept = {n: schema.get_field_index(n) for n in ("conv_id", "part", "open", *[f.split()[0] for f in _COUNTS.split(", ")])}
    for batch in _groups(batches):
        n, states = batch.num_rows, grammar.states
        if alone:
            last, begin = np.ones(n, bool), np.zeros(n, np.int64)
            ends, ranks = np.zeros((n, states), np.int64), np.zeros((n, states), np.int64)
        else:
            last, begin = batch.column("closes").to_numpy(zero_copy_only=False), batch.column("begin").to_numpy()
            ends, ranks = (np.array(batch.column(c).to_pylist(), np.int64).reshape(n, states) for c in ("ends", "end_ranks"))
            ends, ranks = np.where(last[:, None], 0, ends), np.where(last[:, None], 0, ranks)
        codes, starts = _codes(batch, last, grammar)
        offsets, arcs, prices = Ranked(grammar, codes, starts, ends, ranks).paths(begin)
        names = np.array(["", "D", "K", *["R"] * len(grammar.offered), *["I"] * len(grammar.offered)])[arcs]
        edits, costs, roles, texts = [], [], [], []
        all_roles, all_texts = batch.column("roles").to_pylist(), batch.column("texts").to_pylist()
        arcs = arcs.tolist()
        for p in range(n):
            at, new_roles, new_texts = 0, [], []
            for arc in arcs[offsets[p] : offsets[p + 1]]:
                if arc >= grammar.first_insert:
                    new_roles.append(grammar.offered[arc - grammar.first_insert])
                    new_texts.append("")
                    continue
                if arc >= 2:
                    new_roles.append(all_roles[p][at] if arc == 2 else grammar.offered[arc - 3])
                    new_texts.append(all_texts[p][at])
                at += 1
            edits.append("".join(names[offsets[p] : offsets[p + 1]].tolist()))
            costs.append(int(prices[offsets[p] : offsets[p + 1]].sum()))
            roles.append(new_roles)
            texts.append(new_texts)
        made = {"edits": edits, "cost": costs, "roles": roles, "texts": texts}
        columns = [batch.column(f.name) if f.name in kept else pa.array(made[f.name], f.type) for f in schema]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows of each conversation; they are numbers of one part each."""
    conv, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["conv_id"] != conv:
                yield conv, rows
                rows = []
            conv = row["conv_id"]
            rows.append(row)
    if rows:
        yield conv, rows


def _links(open_parts: DataFrame, grammar: Grammar) -> DataFrame:
    """What the rest of its conversation leaves to each open part: closes, begin, ends, end_ranks.

    Costs at a part's end follow from the last part backwards, the order of the
    states there likewise, and the state in which the path enters a part from
    the first part forwards.
    """
    states = grammar.states
    thin = open_parts.select("conv_id", "part", "n_rows", "codes")

    def crossed(batches):
        for batch in _groups(batches):
            found = crossing(grammar, *_codes(batch, np.zeros(batch.num_rows, bool), grammar))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(list(found.reshape(len(found), -1)), pa.list_(pa.int64()))], names=["conv_id", "part", "across"])

    closing = np.array([grammar.end]), np.array([0, 1])
    zero = np.zeros((1, states), np.int64)

    def ended(batches):
        final = costs_to_end(grammar, *closing, zero)[0]
        for _, rows in _by_conversation(batches):
            cost, out = final, []
            for row in reversed(rows):
                out.append({"number": row["part"], "closes": row is rows[-1], "ends": cost.tolist()})
                cost = (np.array(row["across"]).reshape(states, states) + cost).min(1)
            yield pa.RecordBatch.from_pylist(out, schema=ends_schema)

    def ordered(batches):
        for batch in _groups(batches):
            ends = np.array(batch.column("ends").to_pylist(), np.int64).reshape(-1, states)
            ranks, reached = Ranked(grammar, *_codes(batch, np.zeros(batch.num_rows, bool), grammar), ends, np.zeros_like(ends)).begins()
            arrays = [batch.column(c) for c in ("conv_id", "part", "closes", "ends")] + [pa.array(list(x), pa.list_(pa.int64())) for x in (ranks, reached)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "closes", "ends", "ranks", "reached"])

    def entered(batches):
        final = Ranked(grammar, *closing, zero, zero).begins()[0][0]
        for _, rows in _by_conversation(batches):
            order = np.lexsort([np.arange(states), final]).argsort()
            for row in reversed(rows):
                row["end_ranks"] = order.tolist()
                led = [min((int(order[q]) for q in range(states) if mask >> q & 1), default=states) for mask in row["reached"]]
                order = np.lexsort([np.arange(states), led, row["ranks"]]).argsort()
            state, out = 0, []
            for row in rows:
                out.append({"number": row["part"], "closes": row["closes"], "begin": state, "ends": row["ends"], "end_ranks": row["end_ranks"]})
                state = min((q for q in range(states) if row["reached"][state] >> q & 1), key=lambda q: row["end_ranks"][q])
            yield pa.RecordBatch.from_pylist(out, schema=links_schema)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    ends_fields = "number long, closes boolean, ends array<long>"
    links_fields = "number long, closes boolean, begin long, ends array<long>, end_ranks array<long>"
    ends_schema, links_schema = (to_arrow_schema(StructType.fromDDL(f)) for f in (ends_fields, links_fields))
    across = thin.mapInArrow(crossed, "conv_id long, part long, across array<long>")
    ends = in_order(across).mapInArrow(ended, ends_fields)
    given = thin.join(ends, thin["part"] == ends["number"])
    begins = given.select("conv_id", "part", "n_rows", "codes", "closes", "ends").mapInArrow(ordered, "conv_id long, part long, closes boolean, ends array<long>, ranks array<long>, reached array<long>")
    return in_order(begins).mapInArrow(entered, links_fields)


def _solved(chats: DataFrame, grammar: Grammar) -> tuple[DataFrame, DataFrame]:
    """Repaired parts: whole conversations, and parts of those that are cut."""
    order = ["conv_id", "turn", "role", "head", "digest", "id"]
    dealt = faulty(chats).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = to_arrow_schema(StructType.fromDDL(_PART))
    parts = stored(dealt.mapInArrow(lambda it: _gathered(it, grammar, schema), _PART), "repair-parts")
    out = to_arrow_schema(StructType.fromDDL(REPAIRED))
    whole = parts.filter("not open").mapInArrow(lambda it: _repaired(it, grammar, out, True), REPAIRED)
    cut = parts.filter("open")
    links = _links(cut, grammar)
    given = cut.join(links, cut["part"] == links["number"]).drop("number")
    return whole, given.mapInArrow(lambda it: _repaired(it, grammar, out, False), REPAIRED)


def repair(chats: DataFrame, grammar: Grammar = CHAT) -> DataFrame:
    """Repaired conversations in parts: conv_id, part, edits, roles and texts after the edits, and counts of faults.

    A part's rows follow those of the part before; most conversations are one
    part.  Rows go by turn, nulls first; ties by role, then by the first 64
    characters of the text, then by its SHA-256.  Null roles and texts are one
    space, repeated rows are rows of their own (all but one are duplicates), rows
    without conv_id form one conversation.  A text of any length is one row.
    Other columns are ignored.  No rows, no parts.
    """
    whole, cut = _solved(chats, grammar)
    return whole.unionByName(cut)


def _summaries(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its parts in order."""
    names = ["conv_id", "edits", "cost", "roles", "texts", *[f.split()[0] for f in _COUNTS.split(", ")]]
    done, state = [], None

    def closed() -> tuple:
        span = 0 if state["low"] is None else min(state["high"] - state["low"] + 1 - state["turns"], (1 << 63) - 1)
        counts = [state[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return state["conv"], span, *counts, "".join(state["edits"]), state["sha"].hexdigest()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)

    for batch in sliced(batches, "edits", 1 << 16):
        for values in zip(*(batch.column(n) for n in names), strict=True):
            row = {n: v.as_py() for n, v in zip(names, values, strict=True)}
            if state is None or row["conv_id"] != state["conv"]:
                if state is not None:
                    done.append(closed())
                state = {"conv": row["conv_id"], "low": None, "high": None, "turns": 0, "last": None, "edits": [], "sha": hashlib.sha256(), "lines": 0}
                state |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            if row["first_turn"] is not None:
                state["turns"] += row["turns"] - (state["high"] == row["first_turn"])
                state["low"] = row["first_turn"] if state["low"] is None else state["low"]
                state["high"] = row["last_turn"]
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[c] += row[c]
            state["illegal"] += state["last"] is not None and state["last"] + row["first"] not in ("su", "ua", "au")
            state["last"] = row["last"]
            state["edits"].append(row["edits"])
            for role, text in zip(row["roles"], row["texts"], strict=True):
                state["sha"].update(f"{chr(10) if state['lines'] else ''}{role}:{text}".encode())
                state["lines"] += 1
            if len(done) >= 1000:
                yield out()
                done = []
    if state is not None:
        done.append(closed())
        yield out()


def repair_summary(chats: DataFrame, grammar: Grammar = CHAT) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, the edits, and a digest of what they give.

    Whole conversations are summed up where they are; parts of one meet in one
    task in order, which keeps counts and a running digest.  Rows as in `repair`.
    """
    whole, cut = _solved(chats, grammar)
    schema = to_arrow_schema(StructType.fromDDL(SUMMARY))
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.mapInArrow(lambda it: _summaries(it, schema), SUMMARY).unionByName(cut.mapInArrow(lambda it: _summaries(it, schema), SUMMARY))
