"""Personal data: patterns, and terms that reveal a protected value by co-occurrence.

Patterns give the base spans (email, ip, card, phone). Their values are protected
entities. Letters-only terms are weighed by how strongly they reveal an entity that
stands anywhere in the same text: disclosure(e; t) = PMI(e; t) / IC(e), about 0 when
they are independent; it nears 1 as more texts hold t and all of them hold e.

    p(e|t) = (n_et - 1 + p(e)) / n_t,  p(e) = n_e / n       one text of each pair is replaced by
    disclosure = ln(p(e|t) / p(e)) / ln(1 / p(e))           what independence would give

n counts distinct texts, n_e and n_t those that hold e and t, n_et both; copies of a
text count once in all four. Every rare word
stands in one text with something, so one text alone weighs 0; two of two give
1 - ln 2 / IC. A term of at least ``GENERALISE`` for any entity is replaced by a
general label wherever it stands, one of at least ``REMOVE`` is removed.

All work is done by DataFrame functions. Offsets are code points, ends exclusive.
Terms are runs of letters outside base spans, told apart by 64-bit hashes of their
lower case.

Defined results: a null text has no spans; a null language or source is not read;
repeated rows get the same spans; spans of one kind never overlap, a term span
never overlaps a base span; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.llm.common import fresh, let, settled_clean, small_side
from evenfold.session import settle

KINDS = ("email", "ip", "card", "phone", "term")

#: The same leftmost matches as the plain patterns. A run of characters that cannot match is tried once only, and
#: possessive groups, after which nothing follows, are matched in a loop: a greedy group recurses once per repetition.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}+"
LEAST_TERM = 3
GENERALISE = 0.8
REMOVE = 0.95

NO_PLACES = "cast(array() as array<struct<s: bigint, e: bigint, v: string>>)"


def located(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` that are ``valid``, as structs (s, e, v): the gaps between matches give their places."""
    zero = F.lit(0).cast("long")

    def places(found: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.length(pair["v"])
            one = F.array(F.struct(start.alias("s"), end.alias("e"), pair["v"].alias("v")))
            return F.struct(end.alias("at"), F.when(valid(pair["v"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        pairs = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
        empty = F.struct(zero.alias("at"), F.expr(NO_PLACES).alias("out"))
        return F.when(F.size(found) == 0, F.expr(NO_PLACES)).otherwise(F.aggregate(pairs, empty, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def small_parts(value: Column) -> Column:
    """Whether every number of a dotted quad is at most 255, however many zeros lead it."""
    return F.forall(F.split(value, r"\."), lambda p: let(
        F.ltrim(p, F.lit("0")), lambda x: F.when(F.length(x) > 3, F.lit(False)).otherwise(F.concat(F.lit("0"), x).cast("int") <= 255)))


def luhn(value: Column) -> Column:
    """Whether 14 to 19 digits pass the Luhn test."""
    def total(digits: Column) -> Column:
        places = F.transform(F.reverse(F.split(digits, "(?<=[0-9])(?=[0-9])")), lambda d, i: d.cast("int") * (1 + i % 2))
        return F.aggregate(F.transform(places, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(14, 19), total(d)).otherwise(F.lit(False)))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": small_parts,
    "card": luhn,
    "phone": lambda v: F.length(F.translate(v, "+ ().-", "")).between(10, 15),
}


def base_places(t: Column) -> Column:
    """The base spans of a text in order, as structs (s, kind, e, v)."""
    def tagged(kind: int) -> Column:
        return F.transform(located(t, PATTERNS[KINDS[kind]], VALID[KINDS[kind]]), lambda p: F.struct(p["s"].alias("s"), F.lit(kind).alias("kind"), p["e"].alias("e"), p["v"].alias("v")))

    return F.array_sort(F.concat(*map(tagged, range(4))))


def replaced(t: Column, places: Column, label: Callable[[Column], Column]) -> Column:
    """The text with every span (s, kind, e, label) of ``places`` replaced by its ``label``; overlapping spans are one, labelled by the first."""
    def merge(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["s"].alias("s"), last["kind"].alias("kind"), F.greatest(last["e"], p["e"]).alias("e"), last["label"].alias("label"))
        return F.when(F.coalesce(last["e"] > p["s"], F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(p)))

    merged = F.aggregate(places, F.expr("cast(array() as array<struct<s: bigint, kind: int, e: bigint, label: string>>)"), merge)

    def rewritten(spans_: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            at = F.coalesce(F.get(spans_, i - 1)["e"], F.lit(0).cast("long"))
            return F.concat(F.substring(t, (at + 1).cast("int"), (p["s"] - at).cast("int")), label(p))

        tail = F.substring(t, (F.get(spans_, F.size(spans_) - 1)["e"] + 1).cast("int"), F.length(t))
        return F.when(F.size(spans_) == 0, t).otherwise(F.concat(F.array_join(F.transform(spans_, piece), ""), tail))

    return let(merged, rewritten)


def masked(t: Column, base: Column) -> Column:
    """The text with blanks for the base spans, so that other places stay."""
    blank = F.transform(base, lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"), F.lit("").alias("label")))
    return F.when(F.size(base) == 0, t).otherwise(replaced(t, blank, lambda p: F.repeat(F.lit(" "), (p["e"] - p["s"]).cast("int"))))


def base_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, row, base, entities, terms) per row: the base spans in order, and hashes of the distinct protected values and terms of the text.

    ``h`` is a hash of the text: rows of one key and one text share their spans. ``row`` numbers the rows; the caller stores it before use.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), t.alias("t"), base_places(t).alias("base"))
    words = F.filter(F.split(F.lower(masked(F.col("t"), F.col("base"))), r"\P{L}+"), lambda w: F.length(w) >= LEAST_TERM)
    return rows.select(
        "k", "h", F.monotonically_increasing_id().alias("row"), F.transform("base", lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"))).alias("base"),
        F.array_distinct(F.transform("base", lambda p: F.xxhash64(p["kind"], F.lower(p["v"])))).alias("entities"),
        F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("terms"))


def once(facts: DataFrame) -> DataFrame:
    """One row per distinct text: rows of repeated texts other than the first are left out, the rest stay where they are.

    Only hashes and row numbers are grouped; the arrays of terms move only if there are too many repeated texts to broadcast.
    """
    seen = facts.groupBy("h").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("h").alias("_h"), "first")
    seen = settle(seen, "repeated_texts")
    return facts.join(small_side(seen, 2 * seen.count()), F.col("h") == F.col("_h"), "left").where("first IS NULL OR row = first").drop("_h", "first")


def revealing(facts: DataFrame, least: float) -> DataFrame:
    """(term, level): the terms that reveal an entity at a level of ``least`` or more (above 0), each with its highest level.

    Pairs are added up before the shuffle. A level of ``least`` needs p(e|t) of at least p(e) ** (1 - least), so a term in more than
    n_e * p(e) ** (least - 1) texts reveals no entity of n_e texts; a pair of one text has level 0, and with it an entity or a term of one text. What cannot
    reach ``least`` by these bounds is left out before entities and terms of a text are paired.
    """
    texts = once(facts)
    total = facts.select("h").distinct().count()
    often = settle(texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where("n_e > 1"), "entities")
    most = often.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    reach = most * (total / most) ** (1 - least) if most else 0
    bearing = texts.select("h", F.explode("entities").alias("entity")).join(small_side(often, 2 * often.count()), "entity").groupBy("h").agg(F.collect_list(F.struct("entity", "n_e")).alias("own"))
    bearing = settle(bearing, "bearing").withColumnRenamed("h", "_h")
    telling = texts.select("h", "terms").join(small_side(bearing, 3 * bearing.count()), F.col("h") == F.col("_h")).select("own", F.explode("terms").alias("term"))
    held = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t").between(2, F.lit(float(reach))))
    pairs = telling.join(held, "term").select("term", "n_t", F.inline("own")).groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et")).where("n_et > 1")
    prior = F.col("n_e") / F.lit(float(total or 1))
    level = F.ln((F.col("n_et") - 1 + prior) / F.col("n_t") / prior) / F.greatest(-F.ln(prior), F.lit(1e-9))
    weighed = pairs.select("term", level.alias("level")).where(F.col("level") >= least)
    return settled_clean(weighed.groupBy("term").agg(F.max("level").alias("level")), "revealing")


def term_spans(docs: DataFrame, facts: DataFrame, key: str, text: str, generalise: float) -> DataFrame:
    """(k, h, terms): term spans (s, kind, e, level) of the texts of ``docs`` that hold a revealing term, once per key and text."""
    strong = revealing(facts, generalise)
    near = small_side(strong, 2 * strong.count())
    hits = facts.select("k", "h", F.explode("terms").alias("term")).join(near, "term").groupBy("k", "h").agg(F.map_from_entries(F.collect_set(F.struct("term", "level"))).alias("levels"))
    hits = settle(hits, "hits")
    size = hits.agg(F.coalesce(F.sum(2 + 2 * F.size("levels")), F.lit(0))).first()[0]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), t.alias("t"))
    rows = rows.join(small_side(hits, size), F.col("_k").eqNullSafe(F.col("k")) & (F.col("_h") == F.col("h"))).select("k", "h", "t", "levels", base_places(F.col("t")).alias("base"))

    def level(v: Column) -> Column:
        return F.try_element_at("levels", F.xxhash64(F.lower(v)))

    found = located(masked(F.col("t"), F.col("base")), TERM, lambda v: (F.length(v) >= LEAST_TERM) & level(v).isNotNull())
    terms = F.transform(found, lambda p: F.struct(p["s"].alias("s"), F.lit(4).alias("kind"), p["e"].alias("e"), level(p["v"]).alias("level")))
    return settle(rows.select("k", "h", terms.alias("terms")).dropDuplicates(["k", "h"]), "terms")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """(k, h, base, terms): base spans (s, kind, e) and term spans (s, kind, e, level) of every row of ``docs``."""
    docs = docs.select(key, text)
    facts = settle(base_spans(docs, key, text), "spans")
    each = term_spans(docs, facts, key, text, generalise).toDF("_k", "_h", "terms")
    rows = facts.select("k", "h", "base").join(each, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left").drop("_k", "_h")
    return rows.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<s: bigint, kind: int, e: bigint, level: double>>)")))


def listed(places: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(places), lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def all_spans() -> Column:
    return F.concat("base", F.transform("terms", lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"))))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The documents with their columns, each span replaced: base spans and weaker terms by a label, strong terms by nothing.

    Overlapping spans are one replacement, labelled by the first of them. Base spans
    are found again in the row itself, so only the term spans are joined.
    """
    plain = docs.select(key, text)
    strong = term_spans(plain, settle(base_spans(plain, key, text), "spans"), key, text, generalise)
    size = strong.agg(F.coalesce(F.sum(2 + 4 * F.size("terms")), F.lit(0))).first()[0]
    k, h, terms = (fresh(docs, x) for x in ("_k", "_h", "_terms"))
    rows = docs.join(small_side(strong.toDF(k, h, terms), size), F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left")
    labels = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.transform(base_places(t), lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"), F.get(labels, p["kind"]).alias("label")))
    added = F.transform(F.coalesce(F.col(terms), F.expr("cast(array() as array<struct<s: bigint, kind: int, e: bigint, level: double>>)")),
                        lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"), F.when(p["level"] >= remove, F.lit("")).otherwise(F.get(labels, p["kind"])).alias("label")))
    places = F.array_sort(F.concat(base, added))
    clean = let(places, lambda x: F.when(F.size(x) == 0, F.col(text)).otherwise(replaced(t, x, lambda p: p["label"])))
    return rows.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
