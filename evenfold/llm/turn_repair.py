"""Structure repair of conversations: faults of each turn, cheapest edits, repaired text.

Turns are ordered by (turn, nulls first; role; hash of text) and cut into blocks of a
bounded size by their place in the order alone, so a conversation of any length is spread
over tasks. Each block is parsed by itself (``turn_grammar``); the cells of a
conversation's blocks, which hold no texts, are joined in one place, and the edits go back
to the blocks, which are rendered where they are. Equal turns of one conversation are told
apart by a salt only, so they spread over tasks too; a task counts those that follow one
another, and the join of blocks sees to equal turns on both sides of a border.

Faults, the first of these that holds: blank (no character but ASCII white space),
duplicate (role and text stood earlier in the conversation), truncated (the last character
that is not white space is none of . ! ?). Blank and duplicate turns must be deleted.

Defined results: null role or text is one blank; null conversation ids are one
conversation; null turns come first; repeated rows are duplicates of the first; turns of
one number are ordered by role and text hash; a conversation that lost all its turns gives
zeros and empty texts; texts are used whole; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evenfold.llm import turn_grammar as G
from evenfold.llm.common import SPACES, settled_clean, small_side, text_batches
from evenfold.session import settle

BLOCK_TURNS = 256
BLOCK_CHARS = 1_000_000
OK, CUT, BLANK = 0, 1, 2
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): turns after the damage that a hash of (conversation, turn) deals, ``n`` of each."""
    name = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    r, t = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    kind = F.crc32(name.cast("binary")) % 20
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), kind.alias("kind"), r.alias("role"), t.alias("text")).where("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def state_of(text: Column) -> Column:
    trimmed = F.rtrim(text, F.lit(SPACES))
    return F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), OK).otherwise(CUT)


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``h`` (hash of the text), ``state`` and ``later`` (an equal turn has a smaller number)."""
    rows = turns.withColumns({"h": F.md5("text"), "state": state_of(F.col("text"))})
    often = rows.groupBy("conv", "role", "h").agg(F.count(F.lit(1)).alias("rows"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("some_null"))
    often = settle(often.where("rows > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("hash"), "least", "some_null"), "repeated")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("hash"))
    late = F.when(F.col("some_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    return rows.join(small_side(often, 5 * often.count()), same, "left").withColumn("later", F.coalesce(late, F.lit(False))).drop("c", "r", "hash", "least", "some_null")


class _Block:
    """Turns of one conversation that follow one another; equal ones are one entry."""

    def __init__(self, conv, first_turn) -> None:
        self.conv, self.first_turn, self.last_turn, self.least = conv, first_turn, first_turn, None
        self.roles, self.texts, self.ns, self.states, self.later = [], [], [], [], []
        self.numbers, self.chars, self.last = 0, 0, None

    def add(self, turn, role, text, h, state, later, n) -> None:
        if self.last == (turn, role, h):
            self.ns[-1] += n
            return
        if turn is not None and (self.numbers == 0 or turn != self.last_turn):
            self.numbers += 1
            self.least = turn if self.least is None else self.least
        self.last, self.last_turn = (turn, role, h), turn
        for values, v in ((self.roles, role), (self.texts, text), (self.ns, n), (self.states, state), (self.later, later)):
            values.append(v)
        self.chars += len(text)

    def full(self, turns: int, chars: int) -> bool:
        return len(self.ns) >= turns or self.chars >= chars


def faults(states: list[int], later: list[bool], ns: list[int]) -> tuple[int, int, int]:
    """Numbers of blank, duplicate and truncated turns."""
    blank = duplicate = cut = 0
    for state, late, n in zip(states, later, ns, strict=True):
        if state == BLANK:
            blank += n
        else:
            duplicate += n - (not late)
            cut += state == CUT and not late
    return blank, duplicate, cut


def cells_of(roles: list[str], states: list[int], later: list[bool], ns: list[int]) -> G.Cells:
    return G.span([G.turns(r[:1], s == CUT, s != BLANK and not late, n) for r, s, late, n in zip(roles, states, later, ns, strict=True)])


def illegal_pairs(roles: list[str], ns: list[int]) -> int:
    return sum(n - 1 for n in ns) + sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
STRINGS, LONGS = pa.list_(pa.string()), pa.list_(pa.int64())


def blocks(turns: DataFrame) -> DataFrame:
    """Blocks of turns in order of (part, block), each with its cells, faults and what its borders need.

    The first entry of a task stands alone in its block: an equal turn may end the task before.
    """
    kind, number = (turns.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    order = ["conv", "turn", "role", "h", "salt"]
    rows = turns.withColumn("salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "h", "state", "later", "n")
    conv_type, turn_type = (to_arrow_type(turns.schema[c].dataType) for c in ("conv", "turn"))

    def emit(out: list[_Block], part: int, at: int) -> pa.RecordBatch:
        cells = [[{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells_of(b.roles, b.states, b.later, b.ns).items()] for b in out]
        columns = {
            "conv": pa.array([b.conv for b in out], conv_type), "part": pa.array([part] * len(out), pa.int32()), "block": pa.array(range(at, at + len(out)), pa.int64()),
            "roles": pa.array([b.roles for b in out], STRINGS), "texts": pa.array([b.texts for b in out], STRINGS), "ns": pa.array([b.ns for b in out], LONGS),
            "cells": pa.array(cells, CELLS), "faults": pa.array([list(faults(b.states, b.later, b.ns)) for b in out], LONGS),
            "illegal": pa.array([illegal_pairs(b.roles, b.ns) for b in out], pa.int64()), "numbers": pa.array([b.numbers for b in out], pa.int64()),
            "first_turn": pa.array([b.first_turn for b in out], turn_type), "last_turn": pa.array([b.last_turn for b in out], turn_type), "least": pa.array([b.least for b in out], turn_type),
            "last_hash": pa.array([b.last[2] for b in out]), "state": pa.array([b.states[0] for b in out], pa.int32()), "alone": pa.array([len(b.ns) == 1 for b in out])}
        return pa.record_batch(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, done, now, head = TaskContext.get().partitionId(), 0, [], None, True
        for batch in batches:
            for conv, turn, role, text, h, state, late, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                new = now is None or now.conv != conv or (now.full(BLOCK_TURNS, BLOCK_CHARS) or head) and now.last != (turn, role, h)
                if new:
                    head = now is None
                    done += [] if now is None else [now]
                    now = _Block(conv, turn)
                now.add(turn, role, text, h, state, late, n)
            if done:
                yield emit(done, part, at)
                at, done = at + len(done), []
        if now is not None:
            yield emit([now], part, at)

    schema = (f"conv {kind}, part int, block bigint, roles array<string>, texts array<string>, ns array<bigint>, cells array<struct<p: int, q: int, cost: bigint, audit: string>>, "
              f"faults array<bigint>, illegal bigint, numbers bigint, first_turn {number}, last_turn {number}, least {number}, last_hash string, state int, alone boolean")
    return text_batches(rows).mapInArrow(cut, schema)


def divided(audit: str, sizes: list[int]) -> tuple[list[str], list[int]]:
    """The audit's share of each block, by the number of turns it holds, and the output place at which it starts."""
    letters = np.frombuffer(audit.encode(), dtype=np.uint8)
    after = np.append(0, np.flatnonzero(letters != ord("I")) + 1)
    ends = after[np.cumsum([0, *sizes])]
    ends[-1] = len(letters)
    places = np.append(0, np.cumsum(letters != ord("D")))
    return [audit[a:b] for a, b in zip(ends, ends[1:], strict=False)], places[ends[:-1]].tolist()


def whole_conversation(rows: list[dict]) -> dict:
    """Numbers, cost and audit of a conversation from its blocks in order, and the edits of each block."""
    found, illegal, numbers, cells = np.zeros(3, dtype=np.int64), 0, 0, []
    for before, b in zip([None, *rows], rows, strict=False):
        own, fault = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in b["cells"]}, b["faults"]
        if before is not None:
            illegal += before["roles"][-1][:1] + b["roles"][0][:1] not in LEGAL
            numbers -= b["first_turn"] is not None and before["last_turn"] == b["first_turn"]
            if b["alone"] and (before["last_turn"], before["roles"][-1], before["last_hash"]) == (b["first_turn"], b["roles"][0], b["last_hash"]):
                own = cells_of(b["roles"][:1], [b["state"]], [True], b["ns"])
                fault = faults([b["state"]], [True], b["ns"])
        found += fault
        illegal, numbers = illegal + b["illegal"], numbers + b["numbers"]
        cells.append(own)
    cost, audit = G.best(G.span(cells))
    shares, places = divided(audit, [sum(b["ns"]) for b in rows])
    opens = (len(audit) - audit.count("D")) % 2 == 1
    least = next((b["least"] for b in rows if b["least"] is not None), None)
    return {"conv": rows[0]["conv"], "blank": int(found[0]), "duplicate": int(found[1]), "truncated": int(found[2]), "illegal": int(illegal), "numbers": int(numbers), "least": least, "most": rows[-1]["last_turn"],
            "cost": cost, "audit": audit, "edits": [{"part": b["part"], "block": b["block"], "share": s, "place": p, "opens": opens} for b, s, p in zip(rows, shares, places, strict=True)]}


def parsed(table: DataFrame) -> DataFrame:
    """One row per conversation: fault numbers, cost, audit, and the edits of its blocks."""
    kind = table.schema["conv"].dataType.simpleString()
    rows = table.drop("texts")
    ends = F.array(F.get("roles", F.lit(0)), F.get("roles", F.size("roles") - 1))
    total = F.array(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n))
    rows = rows.withColumns({"roles": ends, "ns": total}).repartition("conv").sortWithinPartitions("conv", "part", "block")
    edit = pa.struct([("part", pa.int32()), ("block", pa.int64()), ("share", pa.string()), ("place", pa.int64()), ("opens", pa.bool_())])
    names = ("blank", "duplicate", "truncated", "illegal", "numbers", "least", "most", "cost")

    conv_type = to_arrow_type(table.schema["conv"].dataType)

    def emit(done: list[dict]) -> pa.RecordBatch:
        longs = {n: pa.array([x[n] for x in done], pa.int64()) for n in names}
        return pa.record_batch({"conv": pa.array([x["conv"] for x in done], conv_type), **longs, "audit": pa.array([x["audit"] for x in done]), "edits": pa.array([x["edits"] for x in done], pa.list_(edit))})

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if group and group[0]["conv"] != row["conv"]:
                    done.append(whole_conversation(group))
                    group = []
                group.append(row)
            if done:
                yield emit(done)
        if group:
            yield emit([whole_conversation(group)])

    schema = f"conv {kind}, {', '.join(f'{n} bigint' for n in names)}, audit string, edits array<struct<part: int, block: bigint, share: string, place: bigint, opens: boolean>>"
    return rows.mapInArrow(conversations, schema)


def rendered_block(roles: list[str], texts: list[str], ns: list[int], share: str, place: int, opens: bool) -> str:
    """Repaired turns of a block as lines ``role:text``."""
    lines, entry, left = [], 0, ns[0] if ns else 0
    for letter in share:
        if letter == "I":
            lines.append(f"{G.role_at(place, opens)}:")
        else:
            if left == 0:
                entry, left = entry + 1, ns[entry + 1]
            left -= 1
            if letter != "D":
                lines.append(f"{roles[entry] if letter == 'K' else G.role_at(place, opens)}:{texts[entry]}")
        place += letter != "D"
    return "\n".join(lines)


def rendered(table: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, part, block, n_turns, text): the repaired turns of every block."""
    kind = table.schema["conv"].dataType.simpleString()
    each = edits.select(F.inline("edits")).toDF("_part", "_block", "share", "place", "opens")
    rows = table.select("conv", "part", "block", "roles", "texts", "ns").join(small_side(each, 6 * table.count()), (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")))
    rows = rows.select("conv", "part", "block", "roles", "texts", "ns", "share", "place", "opens")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3, 9)]
            kept = [len(s) - s.count("D") for s in columns[3]]
            texts = [rendered_block(*row) for row in zip(*columns, strict=True)]
            yield pa.record_batch({"conv": batch.column(0), "part": batch.column(1), "block": batch.column(2), "n_turns": pa.array(kept, pa.int64()), "text": pa.array(texts, pa.string())})

    return text_batches(rows).mapInArrow(render, f"conv {kind}, part int, block bigint, n_turns bigint, text string")


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv, turn, role, text, n) repaired: one row per conversation, and its text in blocks."""
    table = settled_clean(blocks(with_faults(turns)), "turn_blocks")
    whole = settle(parsed(table), "turn_edits")
    return whole, rendered(table, whole)


def digests(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's repaired text; only those in several blocks are brought together."""
    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256).alias("sha256")

    several = whole.where(F.size("edits") > 1).select(F.col("conv").alias("_c"))
    single = whole.where(F.size("edits") == 1).select(F.col("edits")[0]["part"].alias("_p"), F.col("edits")[0]["block"].alias("_b"))
    one = pieces.join(small_side(single, 2 * single.count()), (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")), "left_semi").select("conv", digest(F.col("text")))
    many = pieces.join(small_side(several, several.count()), F.col("conv").eqNullSafe(F.col("_c")), "left_semi").where("n_turns > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", "text"))), lambda p: p["text"]), "\n")
    return one.unionAll(many.groupBy("conv").agg(digest(joined)))
