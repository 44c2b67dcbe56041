"""Boolean trigram queries of regular expressions.

A query is a condition on the set of byte trigrams of a text (A-Z in lower case) that
every text with a match fulfils: a trigram, ("and", parts), ("or", parts) or ``ANY``,
which says nothing. It is derived from what is known of each part of the expression:
the few strings it can match, or how its matches begin and end, and what they hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

#: Sets of strings larger than this, and classes of more bytes, are no longer told apart.
MOST_STRINGS = 48
MOST_CLASS = 6
MOST_LENGTH = 24

Query = int | tuple
ANY: Query = ("any",)


def gram(b: bytes) -> int:
    return b[0] << 16 | b[1] << 8 | b[2]


def both(parts: list[Query]) -> Query:
    return joined("and", [p for p in parts if p != ANY], ANY)


def either(parts: list[Query]) -> Query:
    return ANY if ANY in parts else joined("or", parts, ANY)


def joined(how: str, parts: list[Query], empty: Query) -> Query:
    flat: dict[Query, None] = {}
    for p in parts:
        for x in p[1] if isinstance(p, tuple) and p[0] == how else [p]:
            flat[x] = None
    kept = least(list(flat)) if how == "or" else list(flat)
    return empty if not kept else kept[0] if len(kept) == 1 else (how, tuple(kept))


def least(parts: list[Query]) -> list[Query]:
    """The parts of an "or" without those that ask for all another one asks for and more."""
    asked = [frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts]
    return [p for p, a in zip(parts, asked, strict=True) if not any(b < a for b in asked)]


def holding(strings: set[bytes]) -> Query:
    """The trigrams of one of ``strings``."""
    return either([both([gram(s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else ANY


@dataclass
class Known:
    """What is known of the matches of a part: all of them, or their first and last bytes and their trigrams."""

    exact: set[bytes] | None
    first: set[bytes]
    last: set[bytes]
    must: Query

    def query(self) -> Query:
        return self.must if self.exact is None else holding(self.exact)

    def loose(self) -> Known:
        if self.exact is None:
            return self
        return Known(None, {s[:3] for s in self.exact}, {s[-3:] for s in self.exact}, holding(self.exact))


SOMETHING = Known(None, {b""}, {b""}, ANY)
NOTHING = Known({b""}, set(), set(), ANY)


def only(strings: set[bytes]) -> Known:
    return Known(strings, set(), set(), ANY)


def pairs(a: set[bytes], b: set[bytes]) -> set[bytes]:
    return {x + y for x in a for y in b}


def bounded(ends: set[bytes]) -> set[bytes]:
    return ends if len(ends) <= MOST_STRINGS else {b""}


def after(a: Known, b: Known) -> Known:
    """``b`` straight after ``a``."""
    if a.exact is not None and b.exact is not None:
        whole = pairs(a.exact, b.exact) if len(a.exact) * len(b.exact) <= MOST_STRINGS else None
        if whole and max(map(len, whole)) <= MOST_LENGTH:
            return only(whole)
    x, y = a.loose(), b.loose()
    first = pairs(a.exact, y.first) if a.exact is not None else x.first
    last = pairs(x.last, b.exact) if b.exact is not None else y.last
    seam = holding(pairs(x.last, y.first)) if len(x.last) * len(y.first) <= MOST_STRINGS else ANY
    return Known(None, bounded({s[:3] for s in first}), bounded({s[-3:] for s in last}), both([x.must, seam, y.must]))


def one_of(parts: list[Known]) -> Known:
    if all(p.exact is not None for p in parts):
        strings = set().union(*[p.exact for p in parts])
        if len(strings) <= MOST_STRINGS:
            return only(strings)
    loose = [p.loose() for p in parts]
    return Known(None, bounded(set().union(*[p.first for p in loose])), bounded(set().union(*[p.last for p in loose])), either([p.must for p in loose]))


def byte_of(code: int) -> bytes:
    """The UTF-8 bytes of a character, A-Z in lower case."""
    return chr(code).encode("utf-8", "surrogatepass").lower()


def class_of(items: list) -> Known:
    chars: set[bytes] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(byte_of(value))
        elif op is C.RANGE and value[1] - value[0] < 2 * MOST_CLASS:
            chars |= {byte_of(c) for c in range(value[0], value[1] + 1)}
        else:
            return SOMETHING
    return only(chars) if len(chars) <= MOST_CLASS else SOMETHING


def repeated(part: Known, least: int, most: int) -> Known:
    out = NOTHING
    for _ in range(min(least, 3)):
        out = after(out, part)
    if most == least and least <= 3:
        return out
    if least == 0 and most == 1:
        return one_of([NOTHING, part])
    return after(out, SOMETHING) if least == 0 else after(after(out, SOMETHING), Known(None, {b""}, part.loose().last, ANY))


def of_items(items) -> Known:
    out = NOTHING
    for item in items:
        out = after(out, of_item(*item))
    return out


def of_item(op, value) -> Known:
    if op is C.LITERAL:
        return only({byte_of(value)})
    if op is C.IN:
        return class_of(value)
    if op is C.BRANCH:
        return one_of([of_items(x) for x in value[1]])
    if op is C.SUBPATTERN:
        return of_items(value[3])
    if op is C.ATOMIC_GROUP:
        return of_items(value)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        return repeated(of_items(value[2]), value[0], value[1])
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return NOTHING
    return SOMETHING


def query_of(pattern: str) -> Query:
    """The trigram query of ``pattern``, which is read with ASCII rules for case and classes."""
    return of_items(_parser.parse(pattern, re.ASCII)).query()


def grams_of(query: Query) -> set[int]:
    return {query} if isinstance(query, int) else set().union(*[grams_of(p) for p in query[1]]) if len(query) > 1 else set()


def holds(query: Query, grams: set[int]) -> bool:
    if isinstance(query, int):
        return query in grams
    return query == ANY or (all if query[0] == "and" else any)(holds(p, grams) for p in query[1])
