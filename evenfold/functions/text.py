"""Cleaning of text, booleans and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted boolean spellings.
TRUE_TOKENS = ("true", "1", "yes", "y")
FALSE_TOKENS = ("false", "0", "no", "n")

# Environment classes recognised by a part of their name.
INERT_PATTERN = "vacuum|inert|argon"
WET_PATTERN = "water|steam"

# Marks of a life that was only read off a plot or not reached.
APPROXIMATE_PATTERN = "~|未断|runout|>"


def parse_bool(value: Column) -> Column:
    """True, false, or null for any other token; contract checks report the nulls."""
    token = F.lower(F.trim(value.cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def trimmed(value: Column, default: str = "") -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(default)))


def label(value: Column, default: str = "unknown") -> Column:
    return F.lower(trimmed(value, default))


def number(value: Column) -> Column:
    return value.try_cast("double")


def is_inert(env: Column) -> Column:
    return F.lower(env).rlike(INERT_PATTERN)


def is_wet(env: Column) -> Column:
    return F.lower(env).rlike(WET_PATTERN)


def env_kind(env: Column) -> Column:
    return F.when(is_inert(env), "inert").when(is_wet(env), "wet").otherwise("other")


def exposure(env: Column, wet_factor=1.0, air_factor=1.0, inert_factor=0.0) -> Column:
    """Environment exposure; the factors may be numbers or columns of a variant table."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (
        F.when(is_inert(env), as_col(inert_factor))
        .when(is_wet(env), as_col(wet_factor))
        .otherwise(as_col(air_factor))
    )


def shortest_number(value: Column) -> Column:
    """Shortest text that gives the number back, without a fraction of zero: 20 and 20.0 are alike, 1.2e-7 keeps its digits."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0(?=$|E)", "")


def series_key(*parts: Column) -> Column:
    """Composite key text; numbers must come in as text (see ``shortest_number``)."""
    return F.concat_ws("|", *parts)


def joined_labels(value: Column, separator: str = "|") -> Column:
    """Aggregate: the sorted distinct labels of a group as one text.

    For factor levels and issue codes, whose number is small by definition.
    """
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def upper_bin_at(value: Column, bin_label: Column, edge: float, bins: tuple[str, str]) -> Column:
    """A value that lies on the edge of two bins belongs to the upper one."""
    return F.when((value == edge) & bin_label.isin(*bins), bins[1]).otherwise(bin_label)


def near(value: Column, target: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(value - target) <= atol + rtol * abs(target)


def open_ended_bins(value: Column) -> Column:
    """Training support of a cell by number of groups."""
    return (
        F.when(value <= 0, "0").when(value <= 1, "1").when(value <= 3, "2-3").otherwise("4+")
    )
