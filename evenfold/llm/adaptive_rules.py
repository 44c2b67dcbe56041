"""Quality rules whose cutoffs are read from mergeable quantile sketches per language and source.

Every document gets integer measurements. Their distribution in a (language,
source) group is kept as a sketch: counts of logarithmic-linear buckets that keep
six leading bits, so a quantile is off by at most one part in 32. Two sketches are
merged by adding counts, which is how sparse groups fall back to their language
and then to the whole corpus. A cutoff is an upper quantile of the sketch moved
outwards by a multiple of its distance from the median, so it follows both the
level and the tail of its group. The distance is at least the rounding of the
sketch, one unit and a 32nd of the value. A habit of a quarter of a group (symbols)
or of more than one document in twenty (repeated lines and words) lifts its cutoff.

One event in a document is no evidence: rates are judged on the count less
``spared`` events, as one repeated line in five says little about a document.

Defined results: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; a value equal to its cutoff is
kept; repeated rows count each time; a text of any length is measured whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.llm.common import SPACES, let, space_words
from evenfold.session import settle

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """One measurement: the percentile that is its upper level, and how far beyond it a value may lie, in distances from the median.

    ``low`` adds the mirrored lower bound.
    """

    name: str
    upper: int
    reach: int
    spared: int = 0
    low: bool = False


#: Parts per thousand, but for the mean word length in hundredths of a character. One repeated three-word window covers six words.
RULES = (
    Rule("word_length", 90, 4, low=True),
    Rule("symbol_rate", 75, 4, spared=1),
    Rule("dup_line_rate", 95, 4, spared=1),
    Rule("repeat_rate", 95, 4, spared=6),
)
LEAST_GROUP = 200


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the same text.

    Windows are compared by 64-bit hashes. Sorting (hash, position) pairs brings
    equal windows together, so the cost is n log n in the length of the text; a
    text without equal windows is not sorted.
    """
    def cover(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.sort_array(F.transform(
                F.filter(s, lambda p, j: F.coalesce(F.get(s, j - 1)["k"] == p["k"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["k"] == p["k"], F.lit(False))),
                lambda p: p["i"]))

        def covered(r: Column) -> Column:
            gaps = F.transform(r, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - v, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        return let(let(ranked, starts), covered)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(cover(g)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    facts = let(space_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    line_facts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "*", facts.alias("_facts"), line_facts.alias("_lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(*docs.columns, "_facts.*", "_lines.*", "word_chars", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates(spared: bool = False) -> dict[str, Column]:
    """The measurements by rule; with ``spared`` of the counts less the events that each rule spares."""
    less = {r.name: r.spared if spared else 0 for r in RULES}
    return {
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1L)"),
        "symbol_rate": F.expr(f"1000 * greatest(n_symbols - {less['symbol_rate']}, 0L) div greatest(n_words, 1L)"),
        "dup_line_rate": F.expr(f"1000 * greatest(n_dup_lines - {less['dup_line_rate']}, 0L) div greatest(n_lines, 1L)"),
        "repeat_rate": F.expr(f"1000 * greatest(n_repeat_words - {less['repeat_rate']}, 0L) div greatest(n_words, 1L)"),
    }


def bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared: exact below 64, else at most 1/32 too small."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - 6, F.lit(0)))
    return value - value % unit


def rounding(value: Column) -> Column:
    """At least the width of the value's bucket."""
    return F.floor(value / 32) + 1


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, value, n): one mergeable quantile sketch per key and rule."""
    stacked = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(rates()[r.name]).alias("value")) for r in RULES]))
    return rows.select(*keys, stacked.alias("s")).select(*keys, "s.rule", "s.value").groupBy(*keys, "rule", "value").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))


def levels(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, total, lower, middle, upper) of each sketch: the smallest values that these shares of its rows lie at or below."""
    by = Window.partitionBy(*keys, "rule")
    upper = F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r.name, r.upper)]), F.col("rule"))
    run = sketch.withColumn("_c", 100 * F.sum("n").over(by.orderBy("value"))).withColumn("_t", F.sum("n").over(by)).withColumn("_u", upper)
    return run.groupBy(*keys, "rule").agg(
        F.max("_t").alias("total"),
        F.min(F.when(F.col("_c") >= (100 - F.col("_u")) * F.col("_t"), F.col("value"))).alias("lower"),
        F.min(F.when(F.col("_c") >= 50 * F.col("_t"), F.col("value"))).alias("middle"),
        F.min(F.when(F.col("_c") >= F.col("_u") * F.col("_t"), F.col("value"))).alias("upper"),
    )


def cutoffs(sketch: DataFrame, lang: str = "lang", source: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per (lang, source) with ``lo_`` and ``hi_`` bounds of every rule.

    A group of fewer than ``least_group`` measured rows takes the sketch of its
    language, and that of all rows where the language is as small.
    """
    parts = ("total", "lower", "middle", "upper")
    own = levels(sketch, [lang, source])
    by_lang = levels(merged(sketch, [lang]), [lang]).select(F.col(lang).alias("_l"), F.col("rule").alias("_r"), F.struct(*parts).alias("_lang"))
    overall = levels(merged(sketch, []), []).select(F.col("rule").alias("_ra"), F.struct(*parts).alias("_all"))
    picked = (
        own.join(by_lang, F.col(lang).eqNullSafe(F.col("_l")) & (F.col("rule") == F.col("_r")))
        .join(overall, F.col("rule") == F.col("_ra"))
        .withColumn("_q", F.when(F.col("total") >= least_group, F.struct(*parts))
                    .when(F.col("_lang.total") >= least_group, F.col("_lang")).otherwise(F.col("_all")))
    )
    lower, middle, upper = (F.col(f"_q.{p}") for p in parts[1:])
    bounds = []
    for r in RULES:
        mine = F.col("rule") == r.name
        bounds.append(F.max(F.when(mine, upper + r.reach * F.greatest(upper - middle, rounding(upper)))).alias(f"hi_{r.name}"))
        if r.low:
            bounds.append(F.max(F.when(mine, lower - r.reach * F.greatest(middle - lower, rounding(lower)))).alias(f"lo_{r.name}"))
    return picked.groupBy(F.col(lang).alias("_lang_key"), F.col(source).alias("_source_key")).agg(*bounds)


def within_cutoffs() -> Column:
    ok, values = F.lit(True), rates(spared=True)
    for r in RULES:
        ok = ok & (values[r.name] <= F.col(f"hi_{r.name}"))
        if r.low:
            ok = ok & (values[r.name] >= F.col(f"lo_{r.name}"))
    return ok


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per document with its measurements, base_failed, the cutoffs of its group, and kept.

    Texts are read once: the narrow measurements are written to the shared folder
    and serve both the sketches and the filter. Sketches are counts, combined
    before the shuffle, so a source of any size is only as large as its buckets.
    Only rows that pass the base rule enter the sketches.
    """
    rows = settle(measured(docs.select(key, lang, source, text), text).drop(text).withColumn("base_failed", base_failed()), "rules")
    sketch = settle(sketches(rows.where(~F.col("base_failed")), [lang, source]), "rule_sketch")
    bounds = cutoffs(sketch, lang, source, least_group)
    joined = rows.join(bounds, F.col(lang).eqNullSafe(F.col("_lang_key")) & F.col(source).eqNullSafe(F.col("_source_key")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within_cutoffs(), F.lit(False))).drop("_lang_key", "_source_key")
