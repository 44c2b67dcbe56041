"""Tables without a key: chains of near values dealt into ranges, against the same chains on lists."""

import math
import random
from collections import Counter

import pytest

from evenfold.operators.diff import chains, compare_unkeyed

INF, NAN = float("inf"), float("nan")


def rank(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


def chained(values, rtol, atol):
    """Start of the chain of every value."""
    out, last, start = {}, "none", None
    for v in sorted(values, key=rank):
        same = last != "none" and rank(v) == rank(last)
        near = last not in ("none", None) and v is not None and v - last <= atol + rtol * abs(v) and v - last < INF
        if not (same or near):
            start = v
        out[rank(v)], last = start, v
    return out


def plain(a, b, rtol, atol):
    """Rows (key, x, y): both columns in turn, within the key and the chain before."""
    rows = [(*r, 1, 0) for r in a] + [(*r, 0, 1) for r in b]
    groups = {}
    for k in {r[0] for r in rows}:
        first = chained([r[1] for r in rows if r[0] == k], rtol, atol)
        for g in {rank(s) for s in first.values()}:
            inside = [r for r in rows if r[0] == k and rank(first[rank(r[1])]) == g]
            second = chained([r[2] for r in inside], rtol, atol)
            for r in inside:
                n = groups.setdefault((k, g, rank(second[rank(r[2])])), Counter())
                n["a"] += r[3]
                n["b"] += r[4]
    return Counter((k, n["a"], n["b"]) for (k, *_), n in groups.items() if n["a"] != n["b"])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_chains_cross_ranges(spark, parts):
    """One key holds nearly all values; its chains are longer than a range."""
    rng = random.Random(5)
    values = [("hot", round(i * 0.4 + (3 if i % 60 == 0 else 0), 3)) for i in range(400)] + [("hot", None), ("hot", NAN), ("hot", INF), ("hot", -INF), (None, 1.0), (None, 1.2), ("a", 0.0), ("z", None)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "k string, v double")
    got = chains(df, ["k"], "v", 0.0, 0.5, parts).collect()
    assert len(got) == len(values)
    for k in ("hot", None, "a", "z"):
        want = chained([v for x, v in values if x == k], 0.0, 0.5)
        assert {rank(r.v): rank(r._start) for r in got if r.k == k} == {v: rank(s) for v, s in want.items()}
    assert len({rank(r._start) for r in got if r.k == "hot"}) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_equal_the_plain_comparison(spark, seed):
    rng = random.Random(seed)

    def row():
        return (rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, NAN, INF, 0.0, 1.0, 1.004, 1.009, 2.0, rng.random()]), rng.choice([None, 3.0, 3.005, rng.random() * 9]))

    a = [row() for _ in range(150)]
    b = [(k, x + 1e-9 if x is not None and rng.random() < 0.5 else x, y) for k, x, y in a[:120]] + [row() for _ in range(20)]
    schema = "k string, x double, y double"
    found = compare_unkeyed(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "x", "y"], 0.0, 0.01, 5).collect()
    assert Counter((r.k, r.n_first, r.n_second) for r in found) == plain(a, b, 0.0, 0.01) and found


def test_no_exact_column_and_empty_tables(spark):
    schema = "v double, w float"
    a = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (5.0, 1.0)], schema)
    b = spark.createDataFrame([(1.0 + 1e-12, 2.0), (5.0, 1.0)], schema)
    assert [(r.v, r.n_first, r.n_second) for r in compare_unkeyed(a, b, ["v", "w"]).collect()] == [(1.0, 2, 1)]
    assert compare_unkeyed(a, a, ["v", "w"]).collect() == []
    assert compare_unkeyed(a.where("false"), a.where("false"), ["v", "w"]).collect() == []
