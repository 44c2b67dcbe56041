"""A weighted repair grammar for the roles of a conversation, parsed over spans of turns.

Roles must read (s?(ua)+)?: an opening s, then u and a in turn, or nothing at all. The
grammar is in Chomsky normal form over the nonterminals [p q], which derive what leads from
one of four points of that pattern to another:

    [p q] -> [p r] [r q]        [p q] -> an edited turn that leads from p to q

Edits: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an empty turn of user
or assistant (3). The cell of a span and a nonterminal is the least (cost, audit) of its
derivations, audit being the initials of the edits in order. Cells of single turns are
closed under insertion on both sides. Costs are whole numbers and no audit of a span is the
beginning of another one of the same cost (an extra letter of the same turns is an
insertion, which costs), so the least cells of two spans joined are the least of both.

Every span holds every rule at each of its splits: the points are shared by all turns, so
[p q] over a span needs one split, not the best of many. Spans are therefore combined
bottom-up with lengths 1, 2, 4, ..., two neighbours at a time, n - 1 joins in all, and a
part of a conversation can be parsed apart from the rest.
"""

from __future__ import annotations

from functools import cache

RULE_COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Where a role leads: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)

Cells = dict[tuple[int, int], tuple[int, str]]


def put(cells: Cells, at: tuple[int, int], cell: tuple[int, str]) -> None:
    if at not in cells or cell < cells[at]:
        cells[at] = cell


def join(a: Cells, b: Cells) -> Cells:
    """The cells of two neighbouring spans as one."""
    out: Cells = {}
    for (p, r), (cost, audit) in a.items():
        for q in range(4):
            right = b.get((r, q))
            if right is not None:
                put(out, (p, q), (cost + right[0], audit + right[1]))
    return out


def inserted() -> Cells:
    """The cells of an empty span: nothing, or insertions."""
    out: Cells = {(p, p): (0, "") for p in range(4)}
    for p in range(4):
        for role in "ua":
            for a, q in STEPS[role]:
                if a == p:
                    put(out, (p, q), (RULE_COST["I"], "I"))
    return join(out, out)


EMPTY = inserted()


@cache
def kept_turn(initial: str, truncated: bool) -> Cells:
    """The cells of one turn that may be kept."""
    extra = TRUNCATED * truncated
    out: Cells = {(p, p): (RULE_COST["D"], "D") for p in range(4)}
    for at in STEPS.get(initial, ()):
        put(out, at, (extra, "K"))
    for role in "ua":
        for at in STEPS[role]:
            put(out, at, (RULE_COST["R"] + extra, "R"))
    return join(join(EMPTY, out), EMPTY)


def turns(initial: str, truncated: bool, kept: bool, n: int) -> Cells:
    """The cells of ``n`` equal turns, of which at most the first may be kept."""
    drop = n - kept
    gone = {(p, p): (RULE_COST["D"] * drop, "D" * drop) for p in range(4)}
    return join(join(kept_turn(initial, truncated), gone) if kept else join(EMPTY, gone), EMPTY)


def span(cells: list[Cells]) -> Cells:
    """The cells of neighbouring spans as one, shortest spans first."""
    while len(cells) > 1:
        cells = [join(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of the whole pattern."""
    return min(cells[0, q] for q in ENDS if (0, q) in cells)


def role_at(place: int, opens: bool) -> str:
    """The role of an output turn that is not kept; ``opens`` if an s comes first."""
    return ("assistant" if opens else "user") if place % 2 == 0 else ("user" if opens else "assistant")
