"""Chat collapse, sanitisation and quality rules against plain Python."""

import hashlib
import math
import re

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from evenfold.llm import adaptive_rules, chat, disclosure, queries

TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos string, c string")


def test_prefixes_collapse(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "b"), (5, 0, "user", None),
        (6, 0, None, None), (6, 1, "bot", ""), (None, 0, "user", "z"), (7, 5, "user", "a"), (7, 5, "user", "a"), (8, None, "user", "q"),
    ] + [(9, i, "user", f"t{i}") for i in range(700)] + [(10, i, "user", f"t{i}") for i in range(600)]
    got = chat.collapsed(turns(spark, rows)).collect()
    assert {r.conv_id for r in got} == {2, 4, 5, 6, 7, 8, 9, None}
    parts = [r.text for r in sorted((r for r in got if r.conv_id == 9), key=lambda r: r.part)]
    assert "".join(parts) == "".join(f"<|user|>\nt{i}\n" for i in range(700)) and len(parts) == 11
    assert chat.collapsed(turns(spark, [])).collect() == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    digits = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{list(PATTERNS)[i]}:{a}:{b}" for a, i, b in sorted(found))


ODD = [
    "a@b.c_x@y.zz q@w", "1.2.3.4.5.6.7.8", "0000255.1.1.001 256.1.1.1", "4111-1111 1111 1111 4111 1111 1111 1111 0", "+1 (555) 123-4567, +12 +1 5 +49.30.1234567",
    "\U0001f600é a@b.coé +1 555 123 4567, 10.0.0.1", "@@ a@ @b.c a@b", "x" * 30_000 + "@y.zz", "9" * 5000, "1 " * 3000, "", None, "a.b+c%d@e-f.g.h-i",
]


def test_spans_are_those_of_the_patterns(spark, small):
    texts = ODD + [r.text for r in small.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.base for r in disclosure.spans(docs).select("k", disclosure.listed(F.col("base")).alias("base")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}


def revealing(spark):
    """One address in five different contexts that share a rare word; common words are everywhere."""
    told = [(i, f"memo nr {'abcdefgh'[i]}{'abcdefgh'[i]}{'abcdefgh'[i]} common words before Zorblax writes from boss@corp.example today and then more text {i}") for i in range(5)]
    return spark.createDataFrame(told + [(100 + i, f"common words before today and then writes more text {i} from memo") for i in range(300)], "doc_id long, text string")


def test_revealing_terms_are_found_and_removed(spark):
    docs = revealing(spark)
    found = disclosure.spans(docs).where(F.size("terms") > 0).collect()
    assert {r.k for r in found} == set(range(5))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {texts[r.k][t.s:t.e] for r in found for t in r.terms} == {"Zorblax"}
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] and "common words" in clean[i] for i in range(5))
    assert all(clean[i] == texts[i] for i in texts if i >= 100)


def test_far_terms_are_found_and_replaced_everywhere(spark):
    """The term stands 500 characters from its entity; one document names it alone; a word of one text only is kept."""
    far = " common words and more text" * 20
    told = [(i, f"Zorblax{far} writes from boss@corp.example only{'abcdefgh'[i] * 3}") for i in range(6)]
    docs = spark.createDataFrame(told + [(50, f"about zorblax{far} here")] + [(100 + i, f"writes from common words and more text about here {i}") for i in range(300)], "doc_id long, text string")
    found = {r.k: r.terms for r in disclosure.spans(docs).where(F.size("terms") > 0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(found) == {*range(6), 50} and {texts[k][t.s:t.e] for k, x in found.items() for t in x} == {"Zorblax", "zorblax"}
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert not any("orblax" in clean[i] for i in clean) and clean[50].endswith(f"{far} here") and "onlyaaa" in clean[0]


def test_every_entity_is_weighed(spark):
    """Two texts are enough for a level; one text is no evidence."""
    docs = spark.createDataFrame([(0, "Quux wrote to a@b.co again"), (1, "again to a@b.co from quux"), (2, "lone c@d.co and hapax")] + [(10 + i, f"wrote again from and lone {i}") for i in range(400)], "doc_id long, text string")
    found = disclosure.spans(docs).where(F.size("terms") > 0).collect()
    assert {(r.k, t.s, t.e) for r in found for t in r.terms} == {(0, 0, 4), (1, 21, 25)}


def test_copies_count_once_on_both_sides(spark):
    """Three texts in 100 copies each give the level of three texts; one text in many copies gives none."""
    told = [f"Zorblax writes {x} from boss@corp.example" for x in ("one", "two", "six")] * 100 + ["Hapax from c@d.co"] * 100
    docs = spark.createDataFrame(list(enumerate(told + [f"writes one two six from {i}" for i in range(996)])), "doc_id long, text string")
    found = disclosure.spans(docs).where(F.size("terms") > 0).collect()
    assert {r.k for r in found} == set(range(300)) and {(t.s, t.e) for r in found for t in r.terms} == {(0, 7)}
    prior = 3 / 1000
    want = math.log((2 + prior) / 3 / prior) / math.log(1 / prior)
    assert all(t.level == pytest.approx(want) for r in found for t in r.terms)


def test_sanitised_texts_keep_the_rest(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert clean[1] == "[IP].[IP]" and clean[10] is None or clean[11] is None
    assert clean[5] == "\U0001f600é [EMAIL]é [PHONE], [IP]" and clean[8] == ODD[8]


def test_sanitisation_edges(edges, nothing):
    out = disclosure.sanitised(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert out.where("doc_id = 12").first().text == "mail [EMAIL] and [IP] or [PHONE] card [CARD]."
    assert disclosure.sanitised(nothing).collect() == [] and disclosure.spans(nothing).collect() == []


def test_rules_on_edges(edges, nothing):
    got = adaptive_rules.judge(edges, least_group=1).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got}
    assert (by[8].n_words, by[8].n_repeat_words, by[14].n_dup_lines) == (6, 6, 0) and not by[2].kept and by[6].n_words == 30_000
    assert adaptive_rules.judge(nothing).collect() == []


def test_repeated_words_count_covered_positions(spark):
    text = "a b c d a b c e f a b c d x"
    row = adaptive_rules.measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.split()
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    assert row.n_repeat_words == len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_outliers_of_a_source_are_rejected_and_its_habits_kept(spark):
    def words(n):
        return " ".join(f"word{i}" for i in range(n))

    clean = [(i, words(80 + i % 7), "en", "plain") for i in range(300)]
    shouty = [(1000 + i, " # ".join(f"word{j}" for j in range(80 + i % 7)), "en", "markdown") for i in range(300)]
    odd = [(2000, " # ".join(f"word{j}" for j in range(90)), "en", "plain")]
    docs = spark.createDataFrame(clean + shouty + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in adaptive_rules.judge(docs).collect()}
    assert not got[2000] and all(v for k, v in got.items() if k != 2000)


def test_every_rule_takes_its_cutoff_from_the_group(spark):
    """The second source has longer words, more symbols, more repeated lines and more repeated words: all four cutoffs differ, and a document at home in one is odd in the other."""
    def text(n, i, extra):
        lines = [" ".join(f"w{i}x{n}y{j}z{k}" + "q" * (6 * extra) + (" #" if extra and k == 0 else "") for k in range(5)) for j in range(20)]
        return "\n".join(lines + lines[:1 + i % 5] * extra)

    rows = [(1000 * s + i, text(s, i, s), "en", f"source{s}") for s in (0, 1) for i in range(300)] + [(5000, text(2, 3, 1), "en", "source0"), (5001, text(2, 3, 1), "en", "source1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = adaptive_rules.judge(docs)
    bounds = {r.source: r for r in got.select("source", *[c for c in got.columns if c[:3] in ("lo_", "hi_")]).distinct().collect()}
    assert len(bounds) == 2
    for rule in adaptive_rules.RULES:
        assert bounds["source0"][f"hi_{rule.name}"] < bounds["source1"][f"hi_{rule.name}"]
    assert [r.doc_id for r in got.where("not kept").collect()] == [5000]


def test_a_single_event_is_spared(spark):
    plain = [(i, "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6)), "en", "a") for i in range(300)]
    one = plain[0][1]
    docs = [(900, one + " #", "en", "a"), (901, one + "\n" + "one\n" * 2, "en", "a"), (902, one + " # # # #", "en", "a"), (903, one + "\n" + "one\n" * 4, "en", "a")]
    got = adaptive_rules.judge(spark.createDataFrame(plain + docs, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in got.where("not kept").collect()} == {902, 903}


def test_empty_digest_is_that_of_no_spans(spark):
    row = queries.QUERIES["op3_disclosure_sanitisation"](spark, SMALL).where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
