"""Repair of conversations against plain interval parsing and a search over all edits."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenfold.llm import queries
from evenfold.llm import turn_grammar as G
from evenfold.llm import turn_repair as R

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(turns):
    """Least (cost, audit) by a search over points of the pattern; ``turns`` are (initial, truncated, must go)."""
    steps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def closed(cells):
        for _ in range(2):
            for p, (c, a) in list(cells.items()):
                for role in "ua":
                    q = steps.get((role, p))
                    if q is not None:
                        cells[q] = min(cells.get(q, (c + 3, a + "I")), (c + 3, a + "I"))
        return cells

    cells = closed({0: (0, "")})
    for initial, cut, gone in turns:
        out = {}
        for p, (c, a) in cells.items():
            options = [(p, 4, "D")]
            if not gone:
                options += [(steps[initial, p], 3 * cut, "K")] if (initial, p) in steps else []
                options += [(steps[r, p], 3 + 3 * cut, "R") for r in "ua" if (r, p) in steps]
            for q, cost, letter in options:
                out[q] = min(out.get(q, (c + cost, a + letter)), (c + cost, a + letter))
        cells = closed(out)
    return min(cells[q] for q in (0, 3) if q in cells)


def full_table(turns):
    """The textbook table: every span, every split."""
    n = len(turns)
    cell = {(i, i + 1): G.turns(t[0], t[1], not t[2], 1) for i, t in enumerate(turns)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            out = {}
            for k in range(i + 1, i + length):
                for at, c in G.join(cell[i, k], cell[k, i + length]).items():
                    G.put(out, at, c)
            cell[i, i + length] = out
    return G.best(cell[0, n]) if n else G.best(G.EMPTY)


TURN = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=9))
def test_one_split_is_as_good_as_all(turns):
    cells = G.span([G.turns(i, cut, not gone, 1) for i, cut, gone in turns])
    assert G.best(cells) == full_table(turns) == cheapest(turns)


def test_least_over_every_edit_of_short_conversations():
    def valid(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))

    for turns in itertools.product([("s", False, False), ("u", False, False), ("a", True, False), ("u", False, True)], repeat=3):
        found = []
        slots = [["", "u", "a", "ua", "au"]] * 4
        for edits in itertools.product("KRr D", repeat=3):
            cost, parts = 0, []
            for e, (i, cut, gone) in zip(edits, turns, strict=True):
                if e == " " or (gone and e != "D"):
                    break
                cost += {"K": 0, "R": 3, "r": 3, "D": 4}[e] + 3 * (cut and e != "D")
                parts.append(({"K": i, "R": "u", "r": "a", "D": ""}[e], e.upper()))
            else:
                for gaps in itertools.product(*slots):
                    roles = "".join(g + (parts[j][0] if j < 3 else "") for j, g in enumerate(gaps))
                    if valid(roles):
                        audit = "".join("I" * len(g) + (parts[j][1] if j < 3 else "") for j, g in enumerate(gaps))
                        found.append((cost + 3 * sum(map(len, gaps)), audit))
        assert G.best(G.span([G.turns(i, c, not g, 1) for i, c, g in turns])) == min(found)


def test_equal_turns_as_one_entry():
    assert G.turns("u", False, True, 3) == G.span([G.turns("u", False, True, 1), G.turns("u", False, False, 1), G.turns("u", False, False, 1)])


def plain(rows):
    """The result by conversation; ``rows`` are (conv, turn, role, text)."""
    out, kept = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] = None
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        kept[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        turns = sorted(kept[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        seen, blank, dup, cut, coded = set(), 0, 0, 0, []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            b, d = bare == "", bare != "" and (role, text) in seen
            c = not b and not d and bare[-1] not in ".!?"
            blank, dup, cut = blank + b, dup + d, cut + c
            seen.add((role, text))
            coded.append((role[:1], c, b or d))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        numbers = {t[0] for t in turns if t[0] is not None}
        cost, audit = cheapest(coded)
        opens, place, at, lines = (len(audit) - audit.count("D")) % 2, 0, 0, []
        for letter in audit:
            made = ("user", "assistant")[(place + opens) % 2]
            if letter != "D":
                lines.append(f"{made}:" if letter == "I" else f"{turns[at][1] if letter == 'K' else made}:{turns[at][2]}")
            at, place = at + (letter != "I"), place + (letter != "D")
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, parts, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int").repartition(parts)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return {r[0]: tuple(r[1:]) for r in queries.QUERIES["op12_interval_turn_repair"](spark, str(tmp_path)).select(*COLUMNS).collect()}


def many_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(700)]
    rows += [(2, None if i % 3 else i // 7, ("user", "assistant", "system", None, "")[i % 5], f"t{i % 11}" + (".", "?", " ", "")[i % 4]) for i in range(400)]
    rows += [(3, 5, "user", "same text.")] * 900 + [(None, i, "assistant", "a!") for i in range(6)]
    rows += [(10 + i, j, "user" if (i + j) % 3 else "assistant", (None, "", " \n", "ok.", "cut", "ok.")[(i * j) % 6]) for i in range(80) for j in range(i % 9)]
    rows += [(500, None, "user", None), (501, 3, None, "x" * 50_000 + "?"), (502, 1, "system", "s."), (502, 2, "user", "u.")]
    return rows


@pytest.mark.parametrize("size,chars", [(256, 1_000_000), (3, 1_000_000), (50, 40)])
def test_same_as_plain_repair(spark, monkeypatch, tmp_path, size, chars):
    monkeypatch.setattr(R, "BLOCK_TURNS", size)
    monkeypatch.setattr(R, "BLOCK_CHARS", chars)
    rows = many_rows()
    assert run(spark, rows, 5, tmp_path) == plain(rows)


def test_equal_turns_are_spread_over_tasks(spark):
    rows = [(1, 1, "user", "same.", 1)] * 4_000 + [(1, 2, "assistant", "end.", 1)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string, n int").repartition(4)
    table = R.blocks(R.with_faults(turns)).cache()
    parts = table.groupBy("part").agg(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).collect()
    assert len(parts) > 3 and max(r["n"] for r in parts) < 2_000 and sum(r["n"] for r in parts) == 4_001
    whole = R.parsed(table).first()
    assert (whole["duplicate"], whole["cost"], whole["audit"]) == (3_999, 4 * 3_999, "K" + "D" * 3_999 + "K")


def test_blocks_are_bounded(spark):
    rows = [(1, i, "user", f"text {i}.", 1) for i in range(3_000)]
    table = R.blocks(R.with_faults(spark.createDataFrame(rows, "conv long, turn long, role string, text string, n int")))
    assert table.agg(F.max(F.size("ns"))).first()[0] <= R.BLOCK_TURNS


def test_empty_table(spark, tmp_path):
    assert run(spark, [], 1, tmp_path) == {}
