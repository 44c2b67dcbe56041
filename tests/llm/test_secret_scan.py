"""Trigram queries, postings and the secret scan against plain regular expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenfold.llm import secret_scan as S
from evenfold.llm import trigrams as G
from conftest import table

PATTERNS = [r.pattern for r in S.RULES] + [r"(abc)+d", r"a*bcd", r"(ab|c)def?", r"[xy]{2}z", r"ab.cd\b", r"é(ab)?cd", r"(?i:key)[0-9]", r"[^a]bcd{2,3}e"]


def grams(text):
    data = text.encode("utf-8", "surrogatepass").lower()
    return {G.gram(data[i:i + 3]) for i in range(len(data) - 2)}


def test_queries_of_known_expressions():
    assert G.query_of(r"AKIA[A-Z0-9]+") == ("and", (G.gram(b"aki"), G.gram(b"kia")))
    assert G.query_of(r"[0-9a-f]{32,}") == G.ANY
    assert G.query_of(r"(?:abc|abcd)x?") == G.gram(b"abc")
    assert G.query_of(r"x?") == G.ANY
    assert G.query_of(r"abc|q") == G.ANY


@pytest.mark.parametrize("pattern", PATTERNS)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_every_match_fulfils_the_query(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII)))
    assert G.holds(G.query_of(pattern), grams(text))


def plain(rules, text):
    out = []
    for i, r in enumerate(rules):
        out += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return sorted(out)


def spans_of(found):
    return sorted(((r["key"] is None, r["key"] or 0, [tuple(s) for s in r["spans"]]) for r in found.collect()))


SECRETS = [
    (1, 'x PassWord = "abcdefgh1" token:short secret=12345678', "en", "a"), (2, "AKIA0123456789AB AKIA123 " + "0a" * 20, "en", "a"),
    (3, "xpassword=aaaa" * 3, "en", "a"), (4, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " https://me:pw@host/", "en", None),
    (5, "é\U0001f600 api_key='ABCDEFGH' apikey=ABCDEFGHI", "de", "a"), (6, "paſſword=abcdefgh tokeN=abcdefgh", "de", "b"), (6, "no secret here", "de", "b"),
    (7, "f" * 31 + " " + "f" * 32 + "g", None, None), (8, " " * 50_000 + "sk_live_" + "A1" * 10 + " " * 50_000, "en", "a"), (None, "secret=abcdefgh", None, None),
]


def test_spans_are_those_of_the_expressions(spark):
    docs = table(spark, SECRETS + SECRETS[:2]).repartition(3)
    expected = sorted(((k is None, k or 0, plain(S.RULES, t)) for k, t, _, _ in SECRETS + SECRETS[:2]))
    assert spans_of(S.scan(docs)) == expected
    assert sum(len(s) for _, _, s in expected) > 15


def test_small_table_and_own_rules(spark, small):
    rules = (*S.BASE, S.Rule("word", r"\bthe [a-z]+ing\b"), S.Rule("rare", r"zzqzz"))
    assert spans_of(S.scan(small, rules)) == sorted((False, r.doc_id, plain(rules, r.text)) for r in small.collect())


def test_candidates_are_few_and_enough(spark):
    path = S.new_folder(docs := table(spark, SECRETS), "trigrams")
    S.write_index(docs, path)
    index = S.read_index(spark, path)
    masks = {r["key"]: r["rules"] for r in S.candidates(index, S.RULES).collect()}
    kinds = [r.kind for r in S.RULES]
    assert masks[4] >> kinds.index("github") & 1 and masks[4] >> kinds.index("pem") & 1 and 7 not in masks
    assert not any(m >> kinds.index("hex") & 1 for m in masks.values())
    assert S.candidates(index, (S.Rule("hex", "[0-9a-f]{32,}"),)).count() == 0


def test_postings_are_those_of_each_text():
    texts = ["abcabc", None, "", "xab", "ABCé", "a" * 10]
    grams_, offsets, places = S.posting_lists(texts)
    got = {(int(g), int(p)) for i, g in enumerate(grams_) for p in places[offsets[i]:offsets[i + 1]]}
    assert got == {(g, i) for i, t in enumerate(texts) for g in grams(t or "")}
    assert list(grams_) == sorted(grams_)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 7)
    text = "".join(chr(97 + i * 7 % 26) for i in range(100))
    assert set(S.posting_lists([text])[0].tolist()) == grams(text)


def test_edges(edges, nothing):
    rows = spans_of(S.scan(edges))
    assert len(rows) == edges.count() and not any(s for _, _, s in rows)
    assert S.scan(nothing).count() == 0
