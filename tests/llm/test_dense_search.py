"""Ranked search by tiles against plain whole-number scores."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import table

from evenfold.llm import dense_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items, k):
    """{item: [(score, key), ...]} in order; ``docs`` are (key, text) rows."""
    bags = [(key, Counter(TERM.findall(lower(t)))) for key, t in docs]
    bags = [(key, b) for key, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = defaultdict(set)
    for item, t in items:
        terms[item] |= set(TERM.findall(lower(t)))
    out = {}
    for item, wanted in terms.items():
        rows = []
        for key, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                rows.append((-score, key is None, key or 0))
        if rows:
            out[item] = [(-s, None if none else key) for s, none, key in sorted(rows)[:k]]
    return out


def got(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (str(r["item"]), r["rank"])):
        assert r["rank"] == len(out[r["item"]]) + 1
        out[r["item"]].append((r["score"], r["key"]))
    return dict(out)


def items_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, key string, score string")


@pytest.mark.parametrize("k,pairs,rows,kept", [(50, 100_000, 512, 200_000), (3, 40, 7, 5), (1, 7, 64, 50)])
def test_same_as_plain_scores(spark, small, monkeypatch, k, pairs, rows, kept):
    monkeypatch.setattr(S, "TILE_ROWS", rows)
    monkeypatch.setattr(S, "MOST_KEPT", kept)
    docs = small.limit(120).union(small.limit(20)).repartition(5)
    items = [(i, " ".join((r.text or "").split()[:12])) for i, r in enumerate(small.limit(9).collect())] + [(3, "Von the LA"), (77, None), (78, "qqqqzzzz"), (None, "the la")]
    found = got(S.ranked(docs, items_table(spark, items), k, block_pairs=pairs))
    assert found == plain([(r.doc_id, r.text) for r in docs.collect()], items, k)


def test_ties_go_by_key_and_null_keys_are_last(spark):
    rows = [(i, "same words here", "en", "a") for i in range(300, 0, -1)] + [(None, "same words here", "en", "a")] * 2 + [(5, "Same-words_here", None, None)]
    docs = table(spark, rows).repartition(9)
    found = S.ranked(docs, items_table(spark, [(1, "words"), (2, "HERE words")]), 4)
    assert [(r["item"], r["key"]) for r in sorted(found.collect(), key=lambda r: (r["item"], r["rank"]))] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)]
    last = got(S.ranked(docs, items_table(spark, [(1, "words")]), 400))[1]
    assert [k for _, k in last[-2:]] == [None, None] and [k for _, k in last[4:6]] == [5, 5]


def test_tiles_are_exact_however_narrow():
    rng = np.random.default_rng(3)
    block = S.Block(rng.integers(0, 40_000, 90), rng.random((90, 11)) < 0.4, 1_000_000_000, 300_000_000_000)
    wide = S.Block(np.full(90, 10**9), block.holds, 1, 1)
    assert block.slice_terms > 100 and wide.slice_terms == 9
    n = [3, 70_000_000, 1, 500]
    sizes, terms = np.array([3, 90, 1, 40]), np.concatenate([[4, 7, 9], np.arange(90), [0], np.arange(40)])
    counts = rng.integers(1, 9, len(terms))
    for b in (block, wide):
        scores, at = S.tile_scores(b, n, sizes, terms, counts), 0
        for d, size in enumerate(sizes):
            m = 50 + 50 * n[d] * b.documents // b.terms
            for item in range(11):
                assert scores[d, item] == sum(int(b.weights[t]) * (10**9 * int(c) // (1000 * int(c) + 20 * m)) for t, c in zip(terms[at:at + size], counts[at:at + size], strict=True) if b.holds[t, item])
            at += size


def test_best_rows_keep_ties():
    rows = pa.table({"item": pa.array([1, 0, 1, 1, 0], pa.int32()), "key": pa.array([9, None, 4, 7, 2]), "score": pa.array([5, 3, 5, 6, 3])})
    assert S.best_rows(rows, 2).to_pylist() == [{"item": 0, "key": 2, "score": 3}, {"item": 0, "key": None, "score": 3}, {"item": 1, "key": 7, "score": 6}, {"item": 1, "key": 4, "score": 5}]


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 10)
    text = "Été-42 " * 50 + "x" * 100 + " end"
    assert [w for ws in S.words_of(text) for w in ws] == [t.encode() for t in TERM.findall("Été-42 ".replace("É", "É") * 50 + "x" * 100 + " end")]


def test_edges(spark, edges, nothing):
    items = items_table(spark, [(1, "dup near1 A"), (2, "")])
    found = got(S.ranked(edges, items))
    assert found == plain([(r.doc_id, r.text) for r in edges.collect()], [(1, "dup near1 A"), (2, "")], 50)
    assert S.ranked(nothing, items).count() == 0
    assert S.ranked(edges, items.limit(0)).count() == 0
