"""Exact quantiles by scope, with or without weights, for scopes of any size.

Values are counted in order-preserving buckets first (map-side combined, so a hot scope is
spread over all tasks), the buckets that hold a wanted rank are refined, and only the rows
of the refined buckets are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.session import settle, with_scalars

Targets = Callable[[Column], list[tuple[float, str, Column]]]


def value_bucket(v: Column, bits: int) -> Column:
    """Exponent and leading ``bits`` of the mantissa as one number that grows with ``v``."""
    size = 2.0**bits
    a = F.abs(v)
    e = F.greatest(F.floor(F.log2(a)), F.lit(-1000)).cast("double")
    m = F.floor(a * F.pow(F.lit(2.0), bits - e)) - int(size)
    key = ((e + 1100.0) * size).cast("long") + m
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -key).otherwise(key)


def _crossing(hist: DataFrame, part: list[str], order: str, last_total: str) -> DataFrame:
    """Keep the bucket of each target: the first whose running mass reaches it."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = Window.partitionBy(*part).orderBy(order)
    return (
        hist.withColumn("_cum", F.col("_base") + F.sum("_mass").over(upto))
        .withColumn("_before", F.lag("_cum").over(seq))
        .withColumn("_vlag", F.lag("_vmax").over(seq))
        .withColumn("_last", F.lead("_mass").over(seq).isNull())
        .withColumn("_before", F.coalesce("_before", "_base"))
        .withColumn("_vprev", F.coalesce("_vlag", "_vprev"))
        .where((F.col(last_total) > F.col("_before")) | (F.col("_before") == F.col("_base")))
        .where((F.col(last_total) <= F.col("_cum")) | F.col("_last"))
    )


def locate(df: DataFrame, scope: list[str], value: Column, mass: Column, order: Column,
           targets: Targets, bits: tuple[int, int] = (10, 20)) -> DataFrame:
    """For every scope and target mass: the value whose running mass first reaches it.

    Result columns: the scope, ``q``, ``part``, ``target``, ``v``, ``before`` (mass below
    v), ``first_mass`` (mass of the first row at v by ``order``) and ``v_prev``.
    """
    rows = df.select(*scope, value.cast("double").alias("_v"), mass.cast("double").alias("_w"), order.alias("_o"))
    rows = rows.where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    coarse = (
        rows.withColumn("_b1", value_bucket(F.col("_v"), bits[0]))
        .groupBy(*scope, "_b1")
        .agg(F.sum("_w").alias("_mass"), F.max("_v").alias("_vmax"))
        .withColumn("_total", F.sum("_mass").over(Window.partitionBy(*scope)))
    )
    wanted = F.array(*[
        F.struct(F.lit(q).alias("q"), F.lit(p).alias("part"), t.cast("double").alias("target"))
        for q, p, t in targets(F.col("_total"))
    ])
    tagged = coarse.withColumn("_t", F.explode(wanted)).select("*", "_t.*").drop("_t")
    part = [*scope, "q", "part"]
    level1 = _crossing(
        tagged.withColumn("_base", F.lit(0.0)).withColumn("_vprev", F.lit(None).cast("double")),
        part, "_b1", "target",
    )
    keep = [*part, "target"]
    level1 = settle(
        level1.select(*keep, "_b1", F.col("_before").alias("_base"), "_vprev"), "rank1"
    )
    fine = (
        rows.withColumn("_b1", value_bucket(F.col("_v"), bits[0]))
        .join(level1, [*scope, "_b1"])
        .withColumn("_b2", value_bucket(F.col("_v"), bits[1]))
        .groupBy(*keep, "_base", "_vprev", "_b2")
        .agg(F.sum("_w").alias("_mass"), F.max("_v").alias("_vmax"))
    )
    level2 = settle(
        _crossing(fine, part, "_b2", "target").select(
            *keep, "_b2", F.col("_before").alias("_base"), "_vprev"), "rank2",
    )
    exact = (
        rows.withColumn("_b2", value_bucket(F.col("_v"), bits[1]))
        .join(level2, [*scope, "_b2"])
        .groupBy(*keep, "_base", "_vprev", "_v")
        .agg(F.sum("_w").alias("_mass"), F.min_by("_w", "_o").alias("first_mass"), F.max("_v").alias("_vmax"))
    )
    return _crossing(exact, part, "_v", "target").select(
        *keep, F.col("_v").alias("v"), F.col("_before").alias("before"), "first_mass",
        F.col("_vprev").alias("v_prev"),
    )


def weighted_quantiles(df: DataFrame, scope: list[str], value: Column, weight: Column, order: Column,
                       qs: tuple[float, ...]) -> DataFrame:
    """Linear interpolation of the value over the running share of weight.

    A quantile below the first share gives the smallest value. Equal values are ordered by
    ``order``, which must be unique.
    """
    found = locate(df, scope, value, weight, order, lambda total: [(q, "at", total * q) for q in qs])
    step = (F.col("target") - F.col("before")) / F.col("first_mass")
    between = F.col("v_prev").isNotNull() & (step < 1.0)
    result = F.when(between, F.col("v_prev") + (F.col("v") - F.col("v_prev")) * step).otherwise(F.col("v"))
    return found.select(*scope, "q", result.alias("value"))


def linear_quantiles(df: DataFrame, scope: list[str], value: Column, qs: tuple[float, ...]) -> DataFrame:
    """Quantile at position q (n - 1) between the two neighbouring order statistics."""
    def ranks(total: Column) -> list[tuple[float, str, Column]]:
        out = []
        for q in qs:
            position = F.round((total - 1.0) * q, 9)
            out += [(q, "low", F.floor(position) + 1.0), (q, "high", F.ceil(position) + 1.0)]
        return out

    found = locate(df, scope, value, F.lit(1.0), F.lit(0), ranks)
    sizes = df.where(value.isNotNull()).groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    ends = found.groupBy(*scope, "q").agg(
        F.max(F.when(F.col("part") == "low", F.col("v"))).alias("_low"),
        F.max(F.when(F.col("part") == "high", F.col("v"))).alias("_high"),
    )
    joined = ends.join(sizes, scope) if scope else with_scalars(ends, sizes)
    position = F.round((F.col("_n") - 1.0) * F.col("q"), 9)
    return joined.select(
        *scope, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - F.floor(position))).alias("value")
    )
